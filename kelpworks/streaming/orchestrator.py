"""Keeping a stored index up to date: native events while they are few, polling while they are many."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import changes as C


class Orchestrator:
    """Refreshes an Engine from batches of change events (path, change, ts, event_id).

    While more than `limit` events came in the last `seconds`, events are not followed one by one: the mode is polling,
    and `tick` compares the listing with the one stored at the last tick. When the window has calmed down, a last
    tick brings what the events of that time changed, and the mode is native again. `listing` gives the present
    files (path, hash, language, size, modified, content, file_id).
    """

    def __init__(self, engine, listing: Callable[[], DataFrame], limit: int = C.RATE_LIMIT, seconds: float = C.RATE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.engine, self.listing, self.limit, self.seconds, self.clock = engine, listing, limit, seconds, clock
        self.mode, self.refreshed = "native", 0
        self._recent: deque[tuple[float, int]] = deque()
        self._done: set[int] = set()

    def _rate(self, events: int = 0) -> int:
        now = self.clock()
        if events:
            self._recent.append((now, events))
        while self._recent and now - self._recent[0][0] >= self.seconds:
            self._recent.popleft()
        return sum(n for _, n in self._recent)

    def _refresh(self, changes: DataFrame) -> None:
        changes = changes.select("path", "change").persist()
        if not changes.isEmpty():
            self.engine.refresh(changes, self.listing())
            self.refreshed += 1
        changes.unpersist()

    def on_events(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch; a batch that comes again is ignored."""
        if batch_id in self._done:
            return
        if self._rate(batch.count()) > self.limit:
            self.mode = "polling"
        if self.mode == "native":
            self._refresh(C.latest_per_path(batch))
        self._done.add(batch_id)

    def tick(self) -> None:
        """One look in polling mode: what differs between the index and the listing is refreshed."""
        if self.mode != "polling":
            return
        calm = self._rate() <= self.limit
        marks = ("hash",)
        now, then = self.listing().select("path", "hash"), self.engine.tables["files"].select("path", "hash")
        self._refresh(C.snapshot_diff(then, now, "path", marks))
        if calm:
            self.mode = "native"

    def start(self, events: DataFrame, checkpoint: str, every: str = C.DEBOUNCE):
        """The stream: each batch of events, then a look if there were too many."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            self.on_events(batch, batch_id)
            self.tick()

        return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

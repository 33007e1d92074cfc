"""Filling fixed-capacity containers with items.

An item longer than the capacity is cut into full containers and a rest; every other item stays whole.
Items are spread over groups of about `group_items` by a hash, so a group's size is bounded whatever the
input's; within a group they are packed by decreasing size into the fullest container that takes them, and then a local search
moves items of the emptier containers into fuller ones (a move, one for one, two for one; of all such changes the one that
raises the sum of squared fills most), until the containers are as few as their contents allow, or no change of a
container that could be emptied improves anything. A container could be emptied if those fuller than it have room for its contents.

Defined cases: null, empty texts and sizes of 0 are items of size 0, which lie in a container of their
group without taking space; repeated keys are one item, of the largest size given; ties go by key; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "container string, item long, piece int, pieces int, token_start long, n_tokens long, item_tokens long, position int"


class _Bins:
    """Containers with a sorted list of (free, bin)."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill, self.free = capacity, [], [], []

    def new(self) -> int:
        self.items.append([])
        self.fill.append(0)
        bisect.insort(self.free, (self.capacity, len(self.items) - 1))
        return len(self.items) - 1

    def change(self, b: int, size: int) -> None:
        i = bisect.bisect_left(self.free, (self.capacity - self.fill[b], b))
        self.free.pop(i)
        self.fill[b] += size
        bisect.insort(self.free, (self.capacity - self.fill[b], b))

    def put(self, b: int, item: int, size: int) -> None:
        self.items[b].append(item)
        self.change(b, size)

    def best(self, size: int) -> int:
        """The fullest container with room for size; -1 if there is none."""
        i = bisect.bisect_left(self.free, (size, -1))
        return self.free[i][1] if i < len(self.free) else -1


class _Search:
    """Containers as flat arrays in order of (bin, size), so all exchanges of an item are looked at at once."""

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int):
        self.sizes, self.bins, self.fill, self.capacity = sizes, bins, fill, capacity
        self.sort()

    def sort(self) -> None:
        self.order = np.lexsort((self.sizes, self.bins))
        self.size, self.bin = self.sizes[self.order], self.bins[self.order]
        self.key = self.bin * (self.capacity + 1) + self.size
        self.end = np.searchsorted(self.bin, self.bin, "right")

    def emptiable(self) -> list[int]:
        """The bins that could be emptied into fuller ones, the emptiest first."""
        by = np.argsort(-self.fill, kind="stable")
        room = np.cumsum(self.capacity - self.fill[by]) - (self.capacity - self.fill[by])
        return [int(b) for b, r in zip(by[::-1], room[::-1]) if 0 < self.fill[b] <= r]

    def best(self, x: int) -> tuple[int, list[int], int] | None:
        """(gain, items that come back, bin) of the best change that takes item x out of its bin."""
        s, a = int(self.sizes[x]), int(self.bins[x])
        free, lead = self.capacity - self.fill, self.fill - self.fill[a]
        into = (free >= s) & (self.fill > 0)
        into[a] = False
        gain = np.where(into, s * (lead + s), 0)
        b = int(gain.argmax())
        found = (int(gain[b]), [], b)
        # One comes back: the room must do for the difference, and less must come back than went.
        rest, ahead = free[self.bin], lead[self.bin]
        less = s - self.size
        ok = (less > 0) & (less <= rest) & (self.bin != a)
        gain = np.where(ok, less * (ahead + less), 0)
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > found[0]:
            found = (int(gain[i]), [int(self.order[i])], int(self.bin[i]))
        # Two come back: for each item the smallest partner after it in its bin with which the rest has room.
        need = np.maximum(s - rest - self.size, 0)
        j = np.maximum(np.searchsorted(self.key, self.bin * (self.capacity + 1) + need), np.arange(len(self.key)) + 1)
        ok = (j < self.end) & (self.bin != a)
        j = np.where(ok, j, 0)
        less = s - self.size - self.size[j] if len(j) else need
        gain = np.where(ok & (less > 0) & (less <= rest), less * (ahead + less), 0)
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > found[0]:
            found = (int(gain[i]), [int(self.order[i]), int(self.order[j[i]])], int(self.bin[i]))
        return found if found[0] > 0 else None

    def apply(self, x: int, back: list[int], b: int) -> None:
        a = int(self.bins[x])
        moved = int(self.sizes[x]) - sum(int(self.sizes[y]) for y in back)
        self.bins[x] = b
        for y in back:
            self.bins[y] = a
        self.fill[a] -= moved
        self.fill[b] += moved
        self.sort()


def _improve(search: _Search, least: int) -> None:
    """Changes until the containers are `least` or none that could be emptied can be improved."""
    while int((search.fill > 0).sum()) > least:
        for a in search.emptiable():
            mine = sorted(np.flatnonzero(search.bins == a).tolist(), key=lambda i: (-search.sizes[i], i))
            change = next(((x, c) for x in mine if (c := search.best(x))), None)
            if change:
                x, (_, back, b) = change
                search.apply(x, back, b)
                break
        else:
            return


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of indexes into sizes; every size is at most the capacity."""
    bins = _Bins(capacity)
    for x in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = bins.best(sizes[x])
        bins.put(b if b >= 0 else bins.new(), x, sizes[x])
    least = -(-sum(sizes) // capacity)
    if sum(f > 0 for f in bins.fill) <= least:
        return [b for b in bins.items if b]
    solid = np.asarray([x for b in bins.items for x in b if sizes[x]], np.int64)
    at = np.asarray([i for i, b in enumerate(bins.items) for x in b if sizes[x]], np.int64)
    search = _Search(np.asarray(sizes, np.int64)[solid], at, np.asarray(bins.fill, np.int64), capacity)
    _improve(search, least)
    out: list[list[int]] = [[] for _ in bins.items]
    for x, b in zip(solid.tolist(), search.bins.tolist()):
        out[b].append(x)
    empty = [x for b in bins.items for x in b if not sizes[x]]
    if empty:
        next((b for b in out if b), out[0]).extend(empty)
    return [b for b in out if b]


def fill_containers(items: DataFrame, key: str, size: str, capacity: int = 4096, group_items: int = 8_000, expected: int | None = None) -> DataFrame:
    """The rows of SCHEMA: one per item, or per piece of an item over the capacity.

    expected is the number of items (counted here if it isn't given); it only sets the number of groups.
    """
    items = items.select(F.col(key).cast("long").alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")).filter("item IS NOT NULL")
    groups = max(1, -(-(items.count() if expected is None else expected) // group_items))
    items = items.groupBy("item").agg(F.max("n").alias("n"))  # repeated rows end on the map side, so groups stay as large as planned
    full = F.floor(F.col("n") / capacity)
    rest = F.col("n") - full * capacity
    count = F.when(F.col("n") <= capacity, 1).otherwise(full + (rest > 0).cast("int")).cast("int")
    keyed = items.withColumn("pieces", count).withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        out, left = [], []
        for item, n, pieces in zip(pdf["item"].tolist(), pdf["n"].tolist(), pdf["pieces"].tolist()):
            for p in range(pieces):
                at = p * capacity
                length = min(capacity, n - at)
                row = (item, p, pieces, at, length, n)
                if length == capacity and pieces > 1:
                    out.append((f"{group[0]}-f{item}-{p}", *row, 0))
                else:
                    left.append(row)
        for k, b in enumerate(pack([r[4] for r in left], capacity)):
            out += [(f"{group[0]}-{k}", *left[i], pos) for pos, i in enumerate(b)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return keyed.groupBy("g").applyInPandas(run, SCHEMA)

"""Splitting oversized items at natural boundaries, by lexical cohesion.

Every gap between words is a possible cut. Two blocks of words, one on either side, slide along the
text; where their similarity has a valley, the topic changes. Of the window that the size limit leaves (from a quarter of the
limit on, so that pieces do not become crumbs) the deepest valley is cut. A valley's depth is weighed by the
kind of its gap (blank 1, sentence end 1.5, line end 2, blank line 2.5); equally deep ones, as in text without words, go by the kind and then
the later. Only a stretch without any blank, tab, CR or LF that is longer than the limit is
cut by force, at a character boundary.

Each piece after the first starts with the end of the piece before it: at most `overlap` bytes, from a
word's start where there is one, and fewer where otherwise a stretch that fits a piece would not.

Defined cases: null and empty texts and texts within the limit give no pieces; a node whose range is
null, reversed or past the end of its file is no item; repeated rows are one item; a range that cuts a
character is split by bytes and shown with U+FFFD.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..operators.orphans import bloom_table, mask_of, word_of

#: Rows of the filter of files with oversized nodes.
WORDS = 1 << 18
PIECES = "item_kind string, item_id long, piece int, byte_start long, byte_end long, overlap int, forced boolean, text string"
_GAP = re.compile(rb"[ \t\r\n]+")
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")


def _classes(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, strength) of each run of blanks."""
    out = []
    for m in _GAP.finditer(data):
        g = m.group()
        breaks = g.count(b"\n") or g.count(b"\r")
        strength = 3 if breaks > 1 else 2 if breaks else 1 if data[m.start() - 1 : m.start()] in (b".", b"!", b"?", b";", b":") else 0
        out.append((m.start(), m.end(), strength))
    return out


def valley_depths(data: bytes, gaps: list[tuple[int, int, int]], block: int = 24) -> np.ndarray:
    """Depth of the similarity valley at each gap: how far it lies below the peaks on both sides."""
    n = len(gaps)
    if not n:
        return np.zeros(0)
    words, at = [], []
    for m in _WORD.finditer(data):
        words.append(m.group().lower())
        at.append(m.start())
    place = np.searchsorted(np.asarray(at, np.int64), [e for _, e, _ in gaps])  # words before each gap
    left, right = Counter(), Counter()
    dot = nl = nr = 0
    sims = np.zeros(n)
    lo = mid = hi = 0
    for i, p in enumerate(place.tolist()):
        a, b = max(0, p - block), min(len(words), p + block)
        while hi < b:  # words enter on the right, pass the gap, and leave on the left
            w = words[hi]
            dot += left[w]
            nr += 2 * right[w] + 1
            right[w] += 1
            hi += 1
        while mid < p:
            w = words[mid]
            dot -= left[w]
            nr -= 2 * right[w] - 1
            right[w] -= 1
            dot += right[w]
            nl += 2 * left[w] + 1
            left[w] += 1
            mid += 1
        while lo < a:
            w = words[lo]
            dot -= right[w]
            nl -= 2 * left[w] - 1
            left[w] -= 1
            lo += 1
        sims[i] = dot / (nl * nr) ** 0.5 if nl and nr else 0.0
    # The peak on a side is where the climb from the gap ends.
    up_l, up_r = sims.copy(), sims.copy()
    for i in range(1, n):
        if sims[i - 1] >= sims[i]:
            up_l[i] = up_l[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            up_r[i] = up_r[i + 1]
    return up_l + up_r - 2 * sims


def split_bytes(data: bytes, limit: int = 2000, overlap: int = 200, block: int = 24) -> list[tuple[int, int, int, bool]]:
    """(start, end, overlap, forced) of each piece; forced if its end is no natural boundary."""
    gaps = _classes(data)
    kinds = np.asarray([g[2] for g in gaps], np.int64)
    weighed = valley_depths(data, gaps, block) * (1 + 0.5 * kinds)
    starts = np.asarray([g[0] for g in gaps], np.int64)
    ends = np.asarray([g[1] for g in gaps], np.int64)
    out, done = [], 0  # done: where the piece before ended
    while done < len(data):
        back = _overlap(data, done, overlap) if done else 0
        # The next place where a natural cut could be; a stretch that fits a piece must not be cut for the overlap's sake.
        nxt = int(np.searchsorted(starts, done, "right"))
        in_gap = nxt and ends[nxt - 1] > done
        reach = int(ends[nxt - 1]) if in_gap else int(starts[nxt]) if nxt < len(starts) else len(data)
        if in_gap and reach - done > limit:
            reach = done + limit  # a cut within a run of blanks is natural
        if reach - done <= limit < reach - done + back:
            back = limit - (reach - done)
            while back and data[done - back] & 0xC0 == 0x80:
                back -= 1
        begin = done - back
        stop = begin + limit
        if len(data) <= stop:
            out.append((begin, len(data), back, False))
            break
        # Gaps that begin after `done` and by `stop`: the cut is at the gap's end, or where the window ends within it.
        lo, hi = nxt, int(np.searchsorted(starts, stop, "right"))
        late = int(np.searchsorted(starts, begin + limit // 4, "left"))
        a = max(lo, late) if late < hi else lo
        if a < hi:
            best = a + int(np.lexsort((np.arange(a, hi), kinds[a:hi], np.round(weighed[a:hi], 9)))[-1])
            end = min(int(ends[best]), stop)
            forced = False
        elif in_gap:
            end, forced = min(reach, stop), False
        else:
            end, forced = stop, True
            while end > done + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
        out.append((begin, end, back, forced))
        done = end
    return out


def _overlap(data: bytes, done: int, most: int) -> int:
    """How many of the bytes before `done` the next piece repeats."""
    low = max(0, done - most)
    m = _GAP.search(data, low, done)
    if m and m.end() < done:
        return done - m.end()
    while low < done and data[low] & 0xC0 == 0x80:
        low += 1
    return done - low


def oversized(hits: DataFrame, nodes: DataFrame, files: DataFrame, limit: int = 2000) -> DataFrame:
    """`item_kind, item_id, data binary`: every item over the limit, once.

    Sizes are tested before anything is shuffled, and of a file's text only the node's bytes leave the join.
    """
    text = hits.select(F.col("hit_id").alias("item_id"), F.col("chunk_text").alias("t")).filter((F.octet_length("t") > limit) & F.col("item_id").isNotNull()).dropDuplicates(["item_id"])
    one = text.select(F.lit("hit").alias("item_kind"), "item_id", F.encode("t", "utf-8").alias("data"))
    ranges = nodes.select(F.col("id").alias("item_id"), F.col("file_id").alias("nf"), "byte_start", "byte_end").filter(f"item_id IS NOT NULL AND nf IS NOT NULL AND byte_start >= 0 AND byte_end - byte_start > {limit}").dropDuplicates(["item_id"])
    # Texts of files without such a node are kept out of the shuffle by a filter of bounded size; a full filter only keeps more in.
    wanted = F.broadcast(bloom_table(ranges, "nf", WORDS))
    hit = F.col("bits").bitwiseAND(mask_of(F.col("file_id"))) == mask_of(F.col("file_id"))
    long_ = files.select("file_id", "content").filter(F.octet_length("content") > limit).withColumn("word", word_of(F.col("file_id"), WORDS))
    bodies = long_.join(wanted, "word").filter(hit).select("file_id", "content").dropDuplicates(["file_id"]).select("file_id", F.encode("content", "utf-8").alias("body"))
    cut = F.expr("substring(body, cast(byte_start + 1 AS int), cast(byte_end - byte_start AS int))")
    met = salted_join(ranges, bodies, "nf", "file_id", spread_by="item_id", how="inner")
    two = met.filter("byte_end <= octet_length(body)").select(F.lit("node").alias("item_kind"), "item_id", cut.alias("data"))
    return one.unionByName(two)


def split_items(items: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """The rows of PIECES for `item_kind, item_id, data`."""

    def run(batches):
        for pdf in batches:
            rows = []
            for kind, item, data in zip(pdf["item_kind"], pdf["item_id"], pdf["data"]):
                data = bytes(data)
                if len(data) > limit:
                    rows += [(kind, item, i, a, b, o, f, data[a:b].decode("utf-8", "replace")) for i, (a, b, o, f) in enumerate(split_bytes(data, limit, overlap))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return items.mapInPandas(run, PIECES)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """`item_kind, item_id, cut`: forced if any piece had to end within a word."""
    return pieces.groupBy("item_kind", "item_id").agg(F.when(F.max("forced"), "forced").otherwise("clean").alias("cut"))

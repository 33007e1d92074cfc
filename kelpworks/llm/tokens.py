"""Encoding texts with a public byte-level tokenizer.

The rank file is a parameter and is read on each worker from a local path; nothing is trained. Long
texts are cut at safe boundaries (before a blank between two words, between letters, digits and marks), where the
tokenizer's own pattern always cuts too, so the ids are those of the whole text.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text;
further columns are ignored; a repeated key gives one row per row of the input.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = os.environ.get("KELPWORKS_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that goes with the rank file; it splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where that pattern cuts whatever stands around: before a blank within a line, and between letters, digits and other marks.
#: After an apostrophe it may not, as 's and the like are one piece.
SAFE = r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
LONG = 1 << 16


@functools.lru_cache(maxsize=4)
def encoding(ranks: str = RANKS):
    """The tokenizer of a rank file, once per process."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """Parts of about `size` characters whose ids, one after another, are those of the text."""
    import regex

    if len(text) <= size:
        return [text]
    boundary = regex.compile(SAFE)
    parts, start = [], 0
    while len(text) - start > size:
        m = boundary.search(text, start + size)
        if not m:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def encode(text: str | None, ranks: str = RANKS) -> np.ndarray:
    """The ids of one text as uint32."""
    if not text:
        return np.empty(0, np.uint32)
    enc = encoding(ranks)
    out = []
    for part in safe_parts(text):
        try:
            out.append(enc.encode_to_numpy(part, disallowed_special=()))
        except ValueError as e:  # the pattern's engine gives up on runs of over a million blanks
            if not str(e).startswith("Regex error"):
                raise
            import regex

            # The pieces are cut by another engine; each is merged as it is, without the pattern.
            out += [np.asarray(enc._encode_single_piece(p.encode()), np.uint32) for p in regex.findall(PATTERN, part)]
    return out[0] if len(out) == 1 else np.concatenate(out)


def decode_bytes(ids, ranks: str = RANKS) -> bytes:
    """The raw bytes of a list of ids; any list of valid ids has some, also one cut inside a character."""
    enc = encoding(ranks)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """`<key> long, ids array<int>`, one row per row of df; nothing is shuffled."""

    def run(batches):
        for b in batches:
            ids = [encode(t, ranks) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, ids array<int>").withColumnRenamed("k", key)


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """`<key> long, n_tokens long`."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t, ranks)) for t in b.column(1).to_pylist()], pa.int64())], names=["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, n_tokens long").withColumnRenamed("k", key)

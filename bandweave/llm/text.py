"""Flat-array text helpers for Arrow batches, and numbering of rows without one large sort.

Words are ``[^\\x20\\x09-\\x0D]+``. A batch of texts is looked at as one byte array with
offsets, so words, lines and their 64-bit hashes are found with array operations; no
Python object is made for a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

WORD_CLASS = "[\\x20\\x09-\\x0D]"
SLICE_BYTES = 4 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``limit`` bytes, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of ``inside`` that stays within one text."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    filled = off[:-1] < off[1:]
    head, tail = off[:-1][filled], off[1:][filled] - 1
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[head] = inside[head]
    last[:-1] &= ~inside[1:]
    last[tail] = inside[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~space_table()[data], off)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool) -> np.ndarray:
    """A fixed random 64-bit value for each byte; with ``lower``, A-Z count as a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if lower:
        table[65:91] = table[97:123]
    return table


class SpanHasher:
    """64-bit hash of byte spans, from one running polynomial over the array; powers are kept between calls."""

    def __init__(self, lower: bool = False):
        self.values = byte_values(lower)
        self.powers = self.back = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if n >= len(self.powers):
            self.powers = np.multiply.accumulate(np.full(n + 1, BASE, np.uint64))
            self.back = np.multiply.accumulate(np.full(n + 1, BASE_INVERSE, np.uint64))
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=running[1:])
        return mix((running[end] - running[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chained(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of a sequence grown by one element."""
    return mix(hashes * np.uint64(BASE) + more + np.uint64(1))


def windows(values: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and hash of every run of ``size`` neighbouring values of one owner."""
    if len(values) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(values) - size + 1
    at = np.flatnonzero(owner[:n] == owner[size - 1:])
    hashes = values[at]
    for k in range(1, size):
        hashes = chained(hashes, values[at + k])
    return at, hashes


def word_count(text: Column) -> Column:
    """Number of words, as a built-in expression; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(marks, WORD_CLASS + "+", "")).cast("long")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int) -> DataFrame:
    """``df`` with a gapless number from 0 within each group of ``keys``, as column ``name``.

    Rows are dealt to ``parts`` parts by a hash of ``order``, the parts of a group are numbered
    one after the other, so no group is sorted in one task. Rows equal in ``order`` get
    different numbers in no stated order. ``df`` is read twice and must give the same rows.
    """
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    held = {c: f"__k{i}" for i, c in enumerate(keys)}
    sizes = dealt.groupBy(*[F.col(c).alias(h) for c, h in held.items()], F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*held.values()).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*held.values(), "__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    same = [dealt[c].eqNullSafe(sizes[h]) for c, h in held.items()] + [dealt["__part"] == sizes["__p"]]
    number = F.col("__ahead") + F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    return dealt.join(sizes, same).withColumn(name, number.cast("long")).drop("__part", "__p", "__ahead", *held.values())


def parts_for(count: int, each: int = 20_000) -> int:
    """Parts of about ``each`` rows for ``count`` rows."""
    return max(1, math.ceil(count / each))

"""Collocations of neighbouring words: mergeable Misra-Gries summaries find the frequent phrases, a second pass counts them exactly.

The first pass cuts the texts in slices, counts the phrases of a slice by hash and sends them, packed, to hash
partitions. Each partition merges them as a stream into a Misra-Gries summary whose capacity exceeds the partition's
mass divided by the threshold, so no phrase that reaches the threshold is lost, whatever the text. What survives
marks a bitmap of fixed size. The second pass counts each phrase whose bit is set, word for word; a bit set by
chance costs a counted row, never a wrong count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from bandweave.session import cut_lineage

from .text import SpanHasher, chained, flat, sliced, spans

PART_BYTES = 8 << 20
MAX_PARTS = 1 << 14
MERGE_ENTRIES = 1 << 20
BITMAP_BITS = 1 << 27
MANY = 255
HELD_ROWS = 1 << 20


def byte_set(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


BLANK, PIECE_END = byte_set(b" \t"), byte_set(b".,;:!?\n\x0b\x0c\r")


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Slice:
    """The words of some texts: lower-cased bytes in a row, their bounds, owner (piece of a text) and document."""

    def __init__(self, texts: pa.Array):
        raw, off = flat(texts)
        self.data = lowered()[raw]
        ends = PIECE_END[raw]
        self.start, self.end, self.doc = spans(~(ends | BLANK[raw]), off)
        pieces = np.cumsum(ends)
        self.owner = (pieces[self.start] if len(self.start) else np.zeros(0, np.int64)) + self.doc

    def phrases(self, hasher: SpanHasher, salts: np.ndarray, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``max_words`` words: the number of words, the first word and the hash of every phrase."""
        values = hasher(self.data, self.start, self.end)
        at, hashes = np.arange(len(values)), chained(salts[self.doc], values)
        for size in range(1, max_words + 1):
            yield size, at, hashes
            grow = at + size < len(values)
            grow[grow] = self.owner[at[grow] + size] == self.owner[at[grow]]
            at = at[grow]
            hashes = chained(hashes[grow], values[at + size])

    def word_ids(self) -> np.ndarray:
        """The same number for equal words, compared by their bytes."""
        sizes = self.end - self.start
        ends = np.cumsum(sizes)
        joined = self.data[np.repeat(self.start - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        return array.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def strings(self, first: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words at ``first``, joined by single spaces."""
        word = first[:, None] + np.arange(size)
        sizes = (self.end - self.start)[word] + 1
        sizes, starts = sizes.ravel(), self.start[word].ravel()
        ends = np.cumsum(sizes)
        place = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        joined = self.data[np.minimum(place, max(len(self.data) - 1, 0))] if len(place) else np.zeros(0, np.uint8)
        joined[ends - 1] = 32
        joined = np.delete(joined, ends[size - 1::size] - 1)
        bounds = np.concatenate([[0], ends[size - 1::size] - np.arange(1, len(first) + 1)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).cast(pa.string())


def language_salts(langs: pa.Array) -> np.ndarray:
    data, off = flat(langs)
    return SpanHasher()(data, off[:-1], off[1:])


def dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition (high half) and key within it (low half) of each hash."""
    low = hashes & np.uint64(0xFFFFFFFF)
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32) << np.uint64(32)) | low


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences in byte planes, and counts of one byte with the larger ones behind."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T
    large = counts[counts >= MANY].astype("<i8")
    raw = planes.tobytes() + np.minimum(counts, MANY).astype(np.uint8).tobytes() + large.tobytes()
    return len(keys).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    raw = np.frombuffer(pa.decompress(blob[12:], size, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[:4 * n].reshape(4, n).T).view("<u4").ravel()
    counts = raw[4 * n:5 * n].astype(np.int64)
    counts[counts == MANY] = np.frombuffer(raw[5 * n:].tobytes(), "<i8")
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32), counts


class Summary:
    """Mergeable Misra-Gries summary over integer keys: at most ``capacity`` counters; a true count is at most
    the counter (0 if absent) plus ``error``, and ``error`` is at most the mass divided by ``capacity`` + 1."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.entries += len(keys)
        if self.entries >= max(MERGE_ENTRIES, 2 * self.capacity):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.entries = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[head], np.add.reduceat(counts, head) if len(head) else counts
        if len(self.keys) > self.capacity:
            place = len(self.counts) - self.capacity - 1
            cut = int(np.partition(self.counts, place)[place])
            left = self.counts > cut
            self.keys, self.counts, self.error = self.keys[left], self.counts[left] - cut, self.error + cut


def slice_summaries(docs: DataFrame, max_words: int, parts: int) -> DataFrame:
    """part, mass and packed (key, count) pairs of each slice of the texts; counts of a slice are exact by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in sliced(batches, "text"):
            some = Slice(batch.column(1))
            found = [h for _, _, h in some.phrases(hasher, language_salts(batch.column(0)), max_words)]
            codes, counts = np.unique(dealt(np.concatenate(found), parts), return_counts=True)
            part = (codes >> np.uint64(32)).astype(np.int64)
            bounds = np.searchsorted(part, np.arange(parts + 1))
            filled = np.flatnonzero(np.diff(bounds))
            keys = (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = [(bounds[p], bounds[p + 1]) for p in filled]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([int(counts[a:b].sum()) for a, b in rows], pa.int64()),
                                              pa.array([pack(keys[a:b], counts[a:b]) for a, b in rows], pa.binary())], names=["part", "mass", "packed"])

    return docs.mapInArrow(run, "part int, mass long, packed binary")


def survivor_bits(summaries: DataFrame, threshold: int, region: int) -> DataFrame:
    """part and its region of the bitmap, with a bit for every key that may reach ``threshold``."""
    whole = Window.partitionBy("part")
    known = summaries.select("part", "packed", F.sum("mass").over(whole).alias("total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None

        def close() -> pa.RecordBatch:
            summary.merge()
            bits = np.zeros(region, bool)
            bits[place_in(summary.keys[summary.counts + summary.error >= threshold], region)] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for p, blob, total in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if p != part:
                    if summary is not None:
                        yield close()
                    part, summary = p, Summary(total // threshold + 1)
                summary.add(*unpack(blob.as_py()))
        if summary is not None:
            yield close()

    return known.mapInArrow(run, "part int, bits binary")


def place_in(keys: np.ndarray, region: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(region)) >> np.uint64(32)).astype(np.int64)


def frequent_bitmap(docs: DataFrame, threshold: int, max_words: int, parts: int, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of phrases that may reach ``threshold``: ``bits`` / 8 bytes at every size of the corpus."""
    region = bits // parts // 8 * 8
    bitmap = np.zeros((parts, region // 8), np.uint8)
    for row in survivor_bits(slice_summaries(docs, max_words, parts), threshold, region).toLocalIterator():
        bitmap[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def exact_counts(docs: DataFrame, bitmap: np.ndarray, max_words: int, min_count: int) -> DataFrame:
    """lang, phrase, size and a of the phrases whose bit is set and that occur ``min_count`` times, and the words of a
    language as size 0. A task hands its counts over packed, a row for each hash partition, and the partition adds them up.
    """
    parts, region = bitmap.shape[0], bitmap.shape[1] * 8
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def counted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = SpanHasher(), shared.value.ravel()
        for batch in sliced(batches, "text"):
            some, langs = Slice(batch.column(1)), batch.column(0).dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids = some.word_ids()
            per_lang = np.bincount(lang[some.doc], minlength=len(langs.dictionary))
            yield rows(langs.dictionary, np.arange(len(per_lang)), pa.array([""] * len(per_lang)), 0, per_lang)
            for size, at, hashes in some.phrases(hasher, language_salts(batch.column(0)), max_words):
                codes = dealt(hashes, parts)
                place = (codes >> np.uint64(32)).astype(np.int64) * region + place_in((codes & np.uint64(0xFFFFFFFF)), region)
                kept = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                if not len(kept):
                    continue
                first, counts = grouped(at[kept], hashes[kept], ids, lang[some.doc], size)
                yield rows(langs.dictionary, lang[some.doc[first]], some.strings(first, size), size, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in summed(counted_slices(batches), flush=True):
            data, off = flat(counts.column("phrase"))
            part = (dealt(SpanHasher()(data, off[:-1], off[1:]), parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds, ordered = np.searchsorted(part[order], np.arange(parts + 1)), counts.take(pa.array(order))
            filled = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array([as_bytes(ordered.slice(bounds[p], bounds[p + 1] - bounds[p])) for p in filled], pa.binary())], names=["part", "packed"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in summed((from_bytes(x.as_py()) for batch in batches for x in batch.column("packed")), flush=False):
            yield counts.filter(pc.or_(pc.equal(counts.column("size"), 0), pc.greater_equal(counts.column("a"), min_count)))

    packed = docs.mapInArrow(run, "part int, packed binary")
    return packed.groupBy("part").applyInArrow(whole, "lang string, phrase string, size int, a long")


def summed(batches: Iterator[pa.RecordBatch], flush: bool) -> Iterator[pa.RecordBatch]:
    """Counts added up, HELD_ROWS at a time; with ``flush`` they are let go once so many are different."""
    held, entries, limit = [], 0, HELD_ROWS
    for counts in batches:
        held.append(counts)
        entries += counts.num_rows
        if entries >= limit:
            held = [added(held)]
            entries = held[0].num_rows
            if flush and entries >= HELD_ROWS // 2:
                yield held[0]
                held, entries = [], 0
            limit = max(HELD_ROWS, 2 * entries)
    if held:
        yield added(held)


def as_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_bytes(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def rows(langs: pa.Array, lang: np.ndarray, phrases: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), phrases, pa.array(np.full(len(counts), size), pa.int32()), pa.array(counts, pa.int64())],
                                      names=["lang", "phrase", "size", "a"])


def added(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The counts of equal (lang, phrase, size), added up."""
    table = pa.Table.from_batches(batches).group_by(["lang", "phrase", "size"]).aggregate([("a", "sum")])
    return pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("lang", "phrase", "size", "a_sum")], names=["lang", "phrase", "size", "a"])


def grouped(first: np.ndarray, hashes: np.ndarray, ids: np.ndarray, lang: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place and the count of each different phrase. Places of one hash are compared word for word with the
    first of them; those that differ stay on their own."""
    order = np.argsort(hashes, kind="stable")
    first, hashes = first[order], hashes[order]
    group = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1
    heads = first[np.searchsorted(group, np.arange(group[-1] + 1))]
    same = lang[first] == lang[heads[group]]
    for k in range(size):
        same &= ids[first + k] == ids[heads[group] + k]
    odd = first[~same]
    return np.concatenate([heads, odd]), np.concatenate([np.bincount(group[same], minlength=len(heads)), np.ones(len(odd), np.int64)])


def phrase_counts(docs: DataFrame, min_count: int, max_words: int, bits: int = BITMAP_BITS) -> DataFrame:
    """lang, size, phrase and a of every phrase of 1 to ``max_words`` words with a >= ``min_count``; a row of size 0
    holds the number of words of a language. Written to the shared folder."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(MAX_PARTS, math.ceil(size / PART_BYTES) or 1)
    bitmap = frequent_bitmap(docs, min_count, max_words, parts, bits)
    return cut_lineage(exact_counts(docs, bitmap, max_words, min_count))


def part_of(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, covered_percent: int = 100, bits: int = BITMAP_BITS) -> DataFrame:
    """The ``top`` phrases of each lang by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut in pieces at ``[.,;:!?\\x0A-\\x0D]`` and in words ``[^\\x20\\x09]+``. Phrases
    of 2 to ``max_words`` words that occur ``min_count`` times or more are scored by their lowest cut,
    floor(1000 a n / (l r)) in exact integers. A phrase goes when a longer candidate holds it and has at least
    ``covered_percent`` of its count; as a phrase is at least as frequent as any that holds it, looking at those
    longer by one word is enough. Ties: score, a, then the phrase by its bytes.

    Null lang: ``und``, together with a lang of that name. Null, empty and blank texts have no words. Repeated rows
    count each. Empty table: no rows. Only lang and text are read, so other columns may have any name.
    """
    counts = phrase_counts(docs, min_count, max_words, bits)
    totals = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    phrases = counts.where("size >= 2")
    shorter = phrases.where("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        part_of(F.col("phrase"), 1, F.col("size") - 1), part_of(F.col("phrase"), 2, F.col("size") - 1))).alias("phrase"))
    covered = shorter.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part_of(F.col("phrase"), 1, F.col("cut")).alias("first"),
                       part_of(F.col("phrase"), F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    known = counts.where("size >= 1")
    lefts = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"]).join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    scored = scored.withColumn("top_part", (F.lit(1000).cast("decimal(4,0)") * whole["a"]).cast("decimal(19,0)") * whole["n"]).withColumn("low_part", whole["l"] * whole["r"])
    best = F.min(F.struct(F.expr("top_part div low_part").alias("score"), "cut", "l", "r"))
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

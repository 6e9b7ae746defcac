"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, held as sorted arrays, mapped by workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bandweave.session import cut_lineage, shared_dir

from .flatfiles import mapped, write_flat
from .text import SpanHasher, chained, flat, mix, sliced, words

END = 0x5BD1E995A7C3F12D
START_ID = (1 << 32) - 1
UNKNOWN_ID = (1 << 32) - 2
SEGMENT = 2_000_000
PENDING = 1_000_000
SLICE = 1 << 20
SCORED_SLICE = 4 << 20
GRAM = np.dtype([("context", np.uint64), ("word", np.uint64)])
MANIFEST = "path string, entries long, contexts long, kinds string, total double, coc array<double>, heavy array<long>"
BLOCK = "deal long, apart long, rows binary"
BLOCK_SCHEMA = pa.schema([("deal", pa.int64()), ("apart", pa.int64()), ("rows", pa.binary())])
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Level:
    """Segments of one order: (path, entries, contexts, kinds of the counts, first and last shard value), those of parts that lie
    apart from their shard (with the number they are dealt to), and its count statistics."""
    segments: list[tuple[str, int, int, str, int, int]] = field(default_factory=list)
    total: float = 0.0
    coc: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    distinct: int = 0
    apart: list[tuple[str, int, int, str, int]] = field(default_factory=list)

    def discounts(self) -> np.ndarray:
        """D(0), D(1), D(2), D(3+); 0.5, 1 and 1.5 where the counts of counts give no valid value."""
        n1, n2, n3, n4 = self.coc
        plain = [0.5, 1.0, 1.5]
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            plain = [d if 0 < d <= k else p for k, d, p in zip((1, 2, 3), (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), plain)]
        return np.array([0.0, *plain])


def tokens(texts: pa.Array, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and their text: words with A-Z in lower case, then one end."""
    data, off = flat(texts)
    start, end, doc = words(data, off)
    n = np.bincount(doc, minlength=len(texts)) + 1
    out = np.full(int(n.sum()), END, np.uint64)
    out[np.arange(len(start)) + doc] = hasher(data, start, end)
    return out, np.repeat(np.arange(len(texts)), n)


def many_tokens(batch: pa.RecordBatch, column: str, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of a batch, a SLICE of text at a time."""
    parts, done = [], 0
    for piece in sliced([batch], column, SLICE):
        hashes, owner = tokens(piece.column(column), hasher)
        parts.append((hashes, owner + done))
        done += piece.num_rows
    return np.concatenate([h for h, _ in parts]), np.concatenate([o for _, o in parts])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Positions at which a new value begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


class Pending:
    """Counts of rows met so far in a task, merged when many wait."""

    def __init__(self, bits: int, limit: int) -> None:
        self.bits, self.limit = bits, limit
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        return combined(np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts]), self.bits)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((rows, counts))
        self.size += len(counts)
        if self.size > self.limit:
            rows, counts = self.merged()
            if len(counts) > self.limit // 2:
                yield rows, counts
            else:
                self.parts, self.size = [(rows, counts)], len(counts)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            yield self.merged()


def sort_key(rows: np.ndarray, bits: int) -> np.ndarray:
    """A number for each row of ids, in the order of the columns and equal for equal rows; the lowest ``bits`` of an id tell it
    from all others. Leading columns that would not fit any more are replaced by their rank."""
    ids = rows & np.uint64((1 << bits) - 1)
    key, used = ids[:, 0], bits
    for k in range(1, rows.shape[1]):
        if used + bits > 64:
            distinct, key = np.unique(key, return_inverse=True)
            key, used = key.astype(np.uint64), len(distinct).bit_length()
        key, used = (key << np.uint64(bits)) | ids[:, k], used + bits
    return key


def combined(rows: np.ndarray, counts: np.ndarray, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (n x width) with summed counts, in the order of the columns."""
    key = sort_key(rows, bits)
    order = np.argsort(key)
    at = runs(key[order])
    return rows[order[at]], np.add.reduceat(counts[order], at) if len(at) else counts


def context_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of each row of ids; every row of no ids gives the same."""
    out = np.full(len(ids), 0x243F6A8885A308D3, np.uint64)
    for k in range(ids.shape[1]):
        out = chained(out, ids[:, k])
    return out


def entry_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a gram: its context's hash and its last word."""
    out = np.empty(len(word), GRAM)
    out["context"], out["word"] = context, word
    return out


def spread(ids: np.ndarray) -> np.ndarray:
    """What deals a gram to its shard: its context, or for single words the word."""
    return context_hash(ids[:, :-1] if ids.shape[1] > 1 else ids)


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts as the narrowest unsigned integers that hold them all."""
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def whole_words(array: np.ndarray) -> np.ndarray:
    """The array's bytes, filled up to a multiple of 8, so that the next array in a file is aligned."""
    raw = array.view(np.uint8)
    return np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)])


def byte_planes(column: np.ndarray) -> np.ndarray:
    """The column's bytes, all lowest bytes first; upper bytes that are zero in every row are left out. One row a byte."""
    planes = np.ascontiguousarray(column.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return np.ascontiguousarray(planes[:max(1, (int(column.max()).bit_length() + 7) // 8)])


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows in the order of the columns, and counts, without loss: steps within equal leading columns, as byte planes, compressed."""
    columns, same = [], np.arange(len(rows)) > 0
    for column in rows.T:
        before = np.concatenate([column[:1], column[:-1]])
        columns.append(byte_planes(np.where(same, column - before, column)))
        same &= column == before
    columns.append(byte_planes(counts))
    head = np.array([len(rows), *map(len, columns)], "<u4").tobytes()
    return head + pa.compress(np.concatenate([x.ravel() for x in columns]), codec="zstd", asbytes=True)


def unpacked(block: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and counts of a packed block."""
    n, *sizes = np.frombuffer(block, "<u4", width + 2).tolist()
    raw = np.frombuffer(pa.decompress(memoryview(block)[4 * (width + 2):], decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    rows, at, same = np.empty((n, width), np.uint64), 0, np.arange(n) > 0
    for k, size in enumerate(sizes):
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :size] = raw[at:at + n * size].reshape(size, n).T
        column, at = whole.view("<u8")[:, 0], at + n * size
        if k < width:
            upto, first = np.cumsum(column), np.flatnonzero(~same)
            rows[:, k] = column = upto - np.repeat((upto - column)[first], np.diff(np.append(first, n)))
            same[1:] &= column[1:] == column[:-1]
    return rows, column


@dataclass
class Deal:
    """Deals grams to shards by ``spread``. A context whose words are all met more than SEGMENT times is cut into parts by the last
    word, as many as its rarest word asks for, since it is met no more often than that. All parts but the first go to tasks of their
    own, where the parts that meet make one segment; what they hold of the context's sums is added on reading."""
    bits: int
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def cut(self, context: np.ndarray) -> np.ndarray:
        """Number of parts of each context (a row of ids)."""
        if not len(self.heavy) or not context.shape[1]:
            return np.ones(len(context), np.uint64)
        out = np.full(len(context), self.parts.max())
        for column in context.T:
            at, hit = found(self.heavy, column)
            out = np.minimum(out, np.where(hit, self.parts[at], np.uint64(1)))
        return out

    def shard(self, context: np.ndarray) -> np.ndarray:
        return context >> np.uint64(64 - self.bits)

    def place(self, context: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Number that a part of a context (given by its hash) is dealt to."""
        return np.where(part > 0, self.shard(chained(self.shard(context), part)), self.shard(context))

    def __call__(self, rows: np.ndarray, counts: np.ndarray, hashed: bool = False) -> pa.RecordBatch:
        """Blocks of the rows, which come in the order of the columns; ``hashed``: single columns that are spread already."""
        context = rows[:, 0] if hashed else spread(rows)
        part = mix(rows[:, -1]) % self.cut(rows[:, :-1])
        code = self.place(context, part) << np.uint64(1) | (part > 0).astype(np.uint64)
        order = np.argsort(code.astype(np.min_scalar_type((2 << self.bits) - 1)), kind="stable")
        code, rows, counts = code[order], rows[order], counts[order]
        at = runs(code)
        blocks = pa.array([packed(rows[s:e], counts[s:e]) for s, e in zip(at, [*at[1:], len(rows)])], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (code[at] >> np.uint64(1), code[at] & np.uint64(1))), blocks], schema=BLOCK_SCHEMA)


@dataclass
class Model:
    """vocabulary (word hashes with counts; a word's id is its rank), one level for each order and how their grams were dealt."""
    order: int
    vocabulary: Level
    levels: list[Level]
    deal: Deal


@dataclass
class Segment:
    """Arrays of a segment. Of single words: sorted keys and counts. Of longer grams: contexts whose one gram was met once, with
    its last word; all other contexts by their hash, with the end of their entries and four sums; last words and counts of the entries."""
    lone: np.ndarray
    keys: np.ndarray
    lone_words: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    sums: list[np.ndarray]

    @classmethod
    def read(cls, raw: np.ndarray, entries: int, contexts: int, kinds: str) -> Segment:
        """Views of the file written by ``Writer.segment``."""
        raw = np.asarray(raw)
        lone, distinct = raw[:16].view(np.uint64).tolist()
        grams = len(kinds) > 1
        held = contexts - lone if grams else entries
        sizes = [(lone, np.uint64), (held, np.uint64), (lone, np.uint32), (held * grams, np.uint32), ((entries - lone) * grams, np.uint32),
                 (entries - lone, np.min_scalar_type(max(0, distinct - 1))), (distinct, kinds[0]), *[(held, kind) for kind in kinds[1:]]]
        out, at = [], 16
        for n, kind in sizes:
            size = n * np.dtype(kind).itemsize
            out.append(raw[at:at + size].view(kind))
            at += size + -size % 8
        return cls(*out[:7], out[7:])

    def add(self, values: np.ndarray, context: np.ndarray, word: np.ndarray | None) -> None:
        """Adds the four sums of each context, after the count of its gram with ``word`` if given. Contexts are sorted."""
        at = runs(context)
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(context))))
        for keys in (self.lone, self.keys):
            place, hit = found(keys, context[at])
            rows = np.flatnonzero(hit[group])
            place = place[group[rows]]
            if keys is self.lone:
                sums = [1, 1, 0, 0]
                if word is not None:
                    values[0, rows] += self.lone_words[place] == word[rows]
            else:
                sums = [x[place] for x in self.sums]
                if word is not None:
                    end = self.ends[place].astype(np.int64)
                    start = np.where(place > 0, self.ends[place - 1], 0).astype(np.int64)
                    entry = reached(self.words, start, end, word[rows])
                    hit = np.flatnonzero(entry < end)
                    hit = hit[self.words[entry[hit]] == word[rows[hit]]]
                    values[0, rows[hit]] += self.counts[self.codes[entry[hit]]]
            for k, x in enumerate(sums, len(values) - 4):
                values[k, rows] += x


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def reached(words: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """First place from ``start`` on at which the words, sorted up to ``end``, are not below the wanted one."""
    out = start.copy()
    at = np.flatnonzero(start < end)
    low, high, wanted = start[at], end[at], wanted[at]
    while len(at):
        middle = (low + high) >> 1
        below = words[middle] < wanted
        low, high = np.where(below, middle + 1, low), np.where(below, high, middle)
        out[at] = low
        rest = np.flatnonzero(low < high)
        at, low, high, wanted = at[rest], low[rest], high[rest], wanted[rest]
    return out


class Writer:
    """Writes the blocks of one task as segments of merged entries and contexts."""

    def __init__(self, folder: str, width: int, vocabulary: bool, bits: int = 32) -> None:
        self.folder, self.width, self.vocabulary, self.bits, self.limit = folder, width, vocabulary, bits, SEGMENT

    def segment(self, deal: int, rows: np.ndarray, counts: np.ndarray) -> tuple[dict, np.ndarray]:
        """Rows are distinct, those of a context stand together and their last words ascend."""
        stats = {"deal": deal, "entries": len(rows), "total": float(counts.sum()), "coc": [float((counts == k).sum()) for k in (1, 2, 3, 4)], "heavy": []}
        no_words = np.zeros(0, np.uint32)
        if self.width == 1:
            keys = rows[:, 0] if self.vocabulary else spread(rows)
            order = np.argsort(keys)
            keys, held, lone, lone_words, ends, last, sums = keys[order], counts[order], keys[:0], no_words, no_words, no_words, []
            if self.vocabulary:
                often = np.flatnonzero(held > self.limit)
                stats["heavy"] = np.column_stack([np.where(keys[often] == np.uint64(END), -1, often), held[often].astype(np.int64)]).ravel().tolist()
        else:
            context = spread(rows)
            at = runs(context)
            size, context = np.diff(np.append(at, len(rows))), context[at]
            once = (size == 1) & (counts[at] == 1)
            by = np.flatnonzero(once)[np.argsort(context[once])]
            lone, lone_words = context[by], rows[at[by], -1].astype(np.uint32)
            by = np.flatnonzero(~once)[np.argsort(context[~once])]
            ends = np.cumsum(size[by])
            entry = np.repeat(at[by] - ends + size[by], size[by]) + np.arange(len(rows) - len(lone))
            keys, ends, last, held = context[by], ends.astype(np.uint32), rows[entry, -1].astype(np.uint32), counts[entry]
            sums = [narrow(np.add.reduceat(x.astype(np.uint64), at)[by]) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        values, codes = np.unique(held, return_inverse=True)
        codes, values = codes.astype(np.min_scalar_type(max(0, len(values) - 1))), narrow(values)
        head = np.array([len(lone), len(values)], np.uint64)
        path = write_flat(self.folder, [head, *[whole_words(x) for x in (lone, keys, lone_words, ends, last, codes, values, *sums)]])
        contexts = len(lone) + len(keys) if self.width > 1 else 0
        return stats | {"path": path, "contexts": contexts, "kinds": "".join(x.dtype.char for x in (values, *sums))}, rows[:, 1:]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        """Blocks come as deal, apart, rows; those of a segment stand together."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = (-1, -1)
        for batch in batches:
            for deal, apart, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and (deal, apart) != last:
                    yield self.written(last, held)
                    held = []
                last = deal, apart
                held.append(unpacked(block, self.width))
        if held:
            yield self.written(last, held)

    def written(self, place: tuple[int, int], held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[dict, np.ndarray]:
        stats, below = self.segment(place[0], *combined(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]), self.bits))
        return stats | {"apart": place[1]}, below


def written_once(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder; the files of its shuffle go once it is written, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def build_level(blocks: DataFrame, width: int, folder: str, deal: Deal, id_bits: int, vocabulary: bool = False) -> tuple[Level, DataFrame | None, list]:
    """Writes the level of the dealt ``blocks`` and gives it with the blocks of the level below and the rows of its manifest."""
    writer = Writer(folder, width, vocabulary, id_bits)
    below = width > 1
    schema = pa.schema([("path", pa.string()), ("entries", pa.int64()), ("contexts", pa.int64()), ("kinds", pa.string()), ("total", pa.float64()), ("coc", pa.list_(pa.float64())),
                        ("heavy", pa.list_(pa.int64())), *BLOCK_SCHEMA])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = Pending(id_bits, PENDING)

        def out(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            dealt = deal(rows, counts)
            return pa.RecordBatch.from_arrays([dealt.column(f.name) if f.name in BLOCK_SCHEMA.names else pa.nulls(dealt.num_rows, f.type) for f in schema], schema=schema)

        for stats, suffix in writer(batches):
            yield pa.RecordBatch.from_pylist([{f.name: stats.get(f.name) for f in schema}], schema)
            if below and len(suffix):
                for rows, counts in pending.add(suffix, np.ones(len(suffix), np.uint64)):
                    yield out(rows, counts)
        for rows, counts in pending.rest():
            yield out(rows, counts)

    dealt = blocks.repartition(1 << deal.bits, "deal").sortWithinPartitions("deal", "apart")
    written = written_once(dealt.mapInArrow(write, f"{MANIFEST}, {BLOCK}"))
    parts = written.where(F.col("path").isNotNull()).select("deal", "apart", *[c.split()[0] for c in MANIFEST.split(", ")]).collect()
    parts.sort(key=lambda r: r["deal"])
    level, step = Level(), 1 << (64 - deal.bits)
    level.segments = [(r["path"], r["entries"], r["contexts"], r["kinds"], r["deal"] * step, (r["deal"] + 1) * step - 1) for r in parts if not r["apart"]]
    level.apart = [(r["path"], r["entries"], r["contexts"], r["kinds"], r["deal"]) for r in parts if r["apart"]]
    level.total, level.distinct = sum(r["total"] for r in parts), sum(r["entries"] for r in parts)
    level.coc = tuple(sum(r["coc"][k] for r in parts) for k in range(4))
    return level, written.where(F.col("path").isNull()).select(*BLOCK_SCHEMA.names) if below else None, parts


class Lookup:
    """Values of sorted keys in the mapped segments of a level: word hashes, keys of grams, or with ``contexts`` hashes of contexts."""

    def __init__(self, level: Level, contexts: bool = False, deal: Deal | None = None) -> None:
        self.contexts, self.deal = contexts, deal
        self.parts = [Segment.read(mapped(path), n, m, kinds) for path, n, m, kinds, _, _ in level.segments]
        self.apart = {place: Segment.read(mapped(path), n, m, kinds) for path, n, m, kinds, place in level.apart}
        self.low, self.high = (np.array([s[k] for s in level.segments], np.uint64) for k in (4, 5))

    def __call__(self, keys: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of words the count, of contexts four sums, of grams (which may repeat) the count and their context's sums; and a
        word's rank in the whole level or -1. ``cut``: into how many parts each gram's context is cut, all of which are added."""
        grams = keys.dtype == GRAM
        hashes = np.ascontiguousarray(keys["context"]) if grams else keys
        values, rank, ahead = np.zeros((5 if grams else 4 if self.contexts else 1, len(keys))), np.full(len(keys), -1, np.int64), 0
        for part, s, e in zip(self.parts, np.searchsorted(hashes, self.low), np.searchsorted(hashes, self.high, side="right")):
            if e > s and (grams or self.contexts):
                part.add(values[:, s:e], hashes[s:e], keys["word"][s:e] if grams else None)
            elif e > s:
                at, hit = found(part.keys, hashes[s:e])
                values[0, s:e][hit] = part.counts[part.codes[at[hit]]]
                rank[s:e][hit] = ahead + at[hit]
            ahead += len(part.keys)
        if cut is not None and self.apart:
            self.add_apart(values, hashes, keys["word"], cut.astype(np.int64) - 1)
        return values, rank

    def add_apart(self, values: np.ndarray, hashes: np.ndarray, word: np.ndarray, more: np.ndarray) -> None:
        """Adds what the ``more`` further parts of each context hold; a segment that has several of them is asked once."""
        rows = np.repeat(np.arange(len(more)), more)
        part = np.arange(len(rows)) - np.repeat(np.cumsum(more) - more, more) + 1
        place = self.deal.place(hashes[rows], part.astype(np.uint64))
        order = np.argsort(place, kind="stable")
        place, rows = place[order], rows[order]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])])) if len(rows) else rows
        place, rows = place[new], rows[new]
        at = runs(place)
        for s, e in zip(at, [*at[1:], len(rows)]):
            if (segment := self.apart.get(int(place[s]))) is not None:
                here = np.zeros((len(values), e - s))
                segment.add(here, hashes[rows[s:e]], word[rows[s:e]])
                values[:, rows[s:e]] += here


def word_ids(hashes: np.ndarray, vocabulary: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Id (UNKNOWN_ID if absent) and training count of each token."""
    distinct, back = np.unique(hashes, return_inverse=True)
    values, rank = vocabulary(distinct)
    ids = np.where(rank < 0, UNKNOWN_ID, rank).astype(np.uint64)
    return ids[back], values[0][back]


def grams_of(ids: np.ndarray, owner: np.ndarray, order: int) -> np.ndarray:
    """For each token the ``order - 1`` ids before it, then its own; START_ID before a text."""
    out = np.empty((len(ids), order), np.uint64)
    out[:, -1] = ids
    for back in range(1, order):
        shifted = np.full(len(ids), START_ID, np.uint64)
        inside = owner[back:] == owner[:-back] if len(ids) > back else np.zeros(0, bool)
        shifted[back:][inside] = ids[:-back][inside] if len(ids) > back else ids[:0]
        out[:, order - 1 - back] = shifted
    return out


def train(texts: DataFrame, order: int = 2) -> Model:
    """A model of the column ``text`` of every row, null as empty.

    Two scans: words are counted by their hash and get their rank as id; then grams of the highest order
    are counted. Tasks merge equal grams and hand them over packed, a block for each shard; shards are dealt by context and
    hold about SEGMENT grams at most, longer contexts are cut into parts, so no task holds a large context, and a task writes two
    files at most, so files grow with the tokens. Lower orders count
    distinct left neighbours. Texts begin with order - 1 start marks, which are never predicted. The driver sees one
    row of file names and statistics a segment, and the words met more than SEGMENT times. Counts of an empty table give a model
    that knows no word.

    Only ``text`` is read: doc_id may be null, repeated or absent and other columns may have any name. Empty and blank
    texts count their end alone; repeated rows count each.
    """
    folder = f"{shared_dir(texts.sparkSession)}/lm-{uuid.uuid4().hex}"
    by_word = Deal(min(16, max(4, (texts.rdd.getNumPartitions() - 1).bit_length())))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pending = SpanHasher(lower=True), Pending(64, PENDING)
        for batch in sliced(batches, "text", SLICE):
            hashes, _ = tokens(batch.column(0), hasher)
            for rows, counts in pending.add(hashes[:, None], np.ones(len(hashes), np.uint64)):
                yield by_word(rows, counts, hashed=True)
        for rows, counts in pending.rest():
            yield by_word(rows, counts, hashed=True)

    vocabulary, _, parts = build_level(texts.select("text").mapInArrow(count_words, BLOCK), 1, folder, by_word, 64, vocabulary=True)
    id_bits = max(2, (vocabulary.distinct + 1).bit_length())
    deal = heavy_deal(vocabulary, parts)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pending, known = SpanHasher(lower=True), Pending(id_bits, PENDING), Lookup(vocabulary)
        for batch in sliced(batches, "text", SLICE):
            hashes, owner = tokens(batch.column(0), hasher)
            grams = grams_of(word_ids(hashes, known)[0], owner, order)
            for rows, counts in pending.add(grams, np.ones(len(grams), np.uint64)):
                yield deal(rows, counts)
        for rows, counts in pending.rest():
            yield deal(rows, counts)

    blocks = texts.select("text").mapInArrow(count_grams, BLOCK)
    levels: list[Level] = []
    for width in range(order, 0, -1):
        level, blocks, _ = build_level(blocks, width, folder, deal, id_bits)
        levels.insert(0, level)
    return Model(order, vocabulary, levels, deal)


def heavy_deal(vocabulary: Level, parts: list) -> Deal:
    """Shards for all tokens, and the parts that each word met more than SEGMENT times, or the start mark, asks for."""
    heavy, ahead = {}, 0
    for r in parts:
        for at, count in zip(r["heavy"][::2], r["heavy"][1::2]):
            heavy[START_ID if at < 0 else ahead + at] = -(-count // SEGMENT)
        ahead += r["entries"]
    ids = sorted(heavy)
    bits = min(16, max(4, (int(vocabulary.total) // SEGMENT).bit_length()))
    return Deal(bits, np.array(ids, np.uint64), np.array([heavy[k] for k in ids], np.uint64))


class Scorer:
    """Probabilities from the mapped arrays; one for a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known = Lookup(model.vocabulary)
        self.grams = [Lookup(level, deal=model.deal) for level in model.levels]
        self.discounts = [level.discounts() for level in model.levels]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last id of each row after the others."""
        one, size = self.model.levels[0], self.model.vocabulary.distinct + 1
        d = self.discounts[0]
        c = self.values(self.grams[0], context_hash(grams[:, -1:]))[0]
        n1, n2 = one.coc[0], one.coc[1]
        spare = (d[1] * n1 + d[2] * n2 + d[3] * (one.distinct - n1 - n2)) / one.total if one.total else 1.0
        p = (c - d[np.minimum(c, 3).astype(int)]) / max(one.total, 1.0) + spare / size
        for k in range(2, self.model.order + 1):
            context, d = context_hash(grams[:, -k:-1]), self.discounts[k - 1]
            order = np.argsort(context)
            c, total, o1, o2, o3 = self.grams[k - 1](entry_keys(context[order], grams[order, -1]), self.model.deal.cut(grams[order, -k:-1]))[0]
            seen = np.flatnonzero(total)
            at, c, total = order[seen], c[seen], total[seen]
            p[at] = (c - d[np.minimum(c, 3).astype(int)] + (d[1] * o1[seen] + d[2] * o2[seen] + d[3] * o3[seen]) * p[at]) / total
        return p

    @staticmethod
    def values(lookup: Lookup, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        return lookup(distinct)[0][:, back]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row: log10 probabilities of whole texts.

    Null text is empty: one end. Rows that repeat are scored again. Only doc_id and text are read; a null
    doc_id stays null. base_score smooths single tokens by one. Empty table: no rows.
    """
    total, size = model.vocabulary.total, model.vocabulary.distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, scorer = SpanHasher(lower=True), Scorer(model)
        for batch in sliced(batches, "text", SCORED_SLICE):
            hashes, owner = many_tokens(batch, "text", hasher)
            ids, c = word_ids(hashes, scorer.known)
            p = scorer.probabilities(grams_of(ids, owner, model.order))
            n = batch.num_rows
            base = np.log10((c + 1) / (total + 1.0 * (size + 1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(np.bincount(owner, c > 0, n).astype(np.int64)),
                pa.array(np.full(n, int(total), np.int64)), pa.array(np.bincount(owner, base, n)), pa.array(np.bincount(owner, np.log10(p), n))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Token files in a range asymmetric numeral system: one shared frequency table, interleaved blocks, checkpoints, checksums.

File: a header (magic, scale bits, lanes, tokens of a block, checksum of the table); segments; a footer that lists the
segments as checkpoints (offset, bytes, first document and first token within the file, documents, tokens, checksum).
A segment holds whole documents: their ids and lengths, then blocks coded on their own. In a block token k belongs to
lane k mod ``lanes``; every lane has its own state and all share one stream of 32-bit words, so the lanes of all blocks
of a segment move together in array operations, and any segment is read without the others.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bandweave.session import collect_bounded, cut_lineage, shared_dir

from .flatfiles import columns, read_range, store
from .text import flat, sliced, space_table

MAGIC = b"LANEANS1"
SCALE_BITS = 20
LANES, BLOCK_TOKENS, SEGMENT_TOKENS = 32, 1 << 14, 1 << 20
LOWEST = np.uint64(1 << 31)
WORD = np.uint64(32)
MAX_VOCABULARY = 1 << 19
MAX_FILES = 1 << 20
SEGMENTS_A_TASK = 8
CACHED_UNITS, CACHED_IDS = 3 << 18, 1 << 23
CHECKPOINT = ["offset", "bytes", "first_doc", "first_token", "docs", "tokens", "checksum"]

#: ASCII punctuation that never joins letters or digits in a token: all but what contractions and special tokens are made of.
PUNCTUATION = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for themselves, the others from 256 up.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTER = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


# ---- tokens ----

def byte_letters(word: str) -> str:
    """The word in lower case, a letter for each of its bytes."""
    return word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(BYTE_LETTER)


class UnitEncoder:
    """Ids of whole texts from a cache of encoded units.

    Units end at ASCII white space and between an ASCII letter or digit and one of PUNCTUATION. For a tokenizer that
    drops white space and splits there anyway, the ids of a text are those of its units in a row. A unit of LETTERS
    alone goes to the tokenizer's model in lower case, if the tokenizer treats such words so; all others go through
    the whole tokenizer. The cache is emptied when it is full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        probe = "The quick Brown fox jumpEd uncharacteristically over thththnd zzzqx LAZY dogs Équeêeux schÜßler ÑÀÿ".split()
        self.direct = all([t.id for t in self.tokenizer.model.tokenize(byte_letters(w))] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in a row and the number of each."""
        if self.direct:
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(byte_letters(u))] if LETTERS.fullmatch(u) else None for u in units]
        else:
            found = [None] * len(units)
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([units[k] for k in rest], add_special_tokens=False)):
            found[k] = e.ids
        return np.fromiter(chain.from_iterable(found), self.kind), np.fromiter(map(len, found), np.int64, len(found))

    def numbers(self, units: list[str]) -> np.ndarray:
        if len(self.known) + len(units) > CACHED_UNITS or len(self.ids) > CACHED_IDS:
            self.clear()
        found = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [units[k] for k in new]
            ids, sizes = self.encoded(names)
            found[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(names, found[new].tolist()))
            self.ids = np.concatenate([self.ids, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text closed by ``end_id``, and the number of ids of each."""
        data, off = flat(texts)
        docs = len(off) - 1
        inside = ~space_table()[data]
        first = inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1] | unit_ends(data)
            heads = off[:-1][off[:-1] < off[1:]]
            first[heads] = inside[heads]
        start, joined = np.flatnonzero(first), data[inside]
        if not len(start):
            return np.full(docs, end_id, self.kind), np.ones(docs, np.int64)
        bounds = np.append(np.flatnonzero(first[inside]), len(joined)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
        number = self.numbers(units.dictionary.to_numpy(zero_copy_only=False).tolist())[units.indices.to_numpy(zero_copy_only=False)]
        sizes = np.diff(self.bounds)[number]
        ends = np.cumsum(sizes)
        total = np.append(0, ends)[np.searchsorted(start, off)]
        per_doc = np.diff(total) + 1
        place = np.arange(ends[-1] if len(ends) else 0)
        place += np.repeat(self.bounds[number] - (ends - sizes), sizes)
        return np.insert(self.ids[place], total[1:], end_id), per_doc


def unit_ends(data: np.ndarray) -> np.ndarray:
    """True where a byte and the next are an ASCII letter or digit and one of PUNCTUATION, in either order."""
    kind = np.zeros(256, np.int8)
    kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
    kind[list(PUNCTUATION)] = 2
    kind = kind[data]
    return kind[:-1] + kind[1:] + 4 * (kind[:-1] == kind[1:]) == 3


ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in ENCODERS:
        ENCODERS[path] = UnitEncoder(path)
    return ENCODERS[path]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and the ids of each text as packed little-endian integers, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in sliced(batches, "text"):
            ids, sizes = encode(batch.column(1), end_id)
            bounds = np.concatenate([[0], np.cumsum(sizes)]) * encode.kind.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary()), pa.array(np.full(batch.num_rows, encode.kind.itemsize), pa.int32())], names=["doc_id", "ids", "width"])

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    typed.mapInArrow(run, "doc_id long, ids binary, width int").write.option("compression", "zstd").parquet(path)
    return spark.read.schema("doc_id long, ids binary, width int").parquet(path)


def unpacked(ids: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and the number of each row."""
    sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // width
    return np.frombuffer(b"".join(ids.to_pylist()), f"<u{width}"), sizes


def token_frequencies(tokens: DataFrame) -> np.ndarray:
    """Number of each id in the whole table; the driver gets a row for each different id, no more than MAX_VOCABULARY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                some = np.bincount(unpacked(batch.column(0), batch.column(1)[0].as_py())[0])
                if len(some) > len(counts):
                    counts = np.pad(counts, (0, len(some) - len(counts)))
                counts[:len(some)] += some
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())], names=["id", "n"])

    rows = collect_bounded(tokens.select("ids", "width").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")), MAX_VOCABULARY, "different ids")
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


# ---- coder ----

@dataclass
class Table:
    """Frequencies that sum to 2^SCALE_BITS, at least 1 for every id that occurs."""

    frequency: np.ndarray

    def __post_init__(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(self.frequency)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))
        self.frequency = self.frequency.astype(np.uint64)
        self.ceiling = self.frequency << np.uint64(63 - SCALE_BITS)
        self.checksum = zlib.crc32(self.frequency.astype("<u8").tobytes())

    def __reduce__(self) -> tuple:
        return Table, (self.frequency,)  # tasks get the frequencies alone


def table_of(counts: np.ndarray) -> Table:
    """Shares of the counts in 2^SCALE_BITS; what rounding leaves over or takes too much is settled at the most frequent ids."""
    whole = 1 << SCALE_BITS
    total = int(counts.sum())
    share = np.array([max(1, int(c) * whole // total) if c else 0 for c in counts.tolist()], np.int64)
    if (share > 0).sum() > whole:
        raise ValueError(f"more than {whole} different ids")
    for at in np.argsort(-share, kind="stable"):
        rest = whole - int(share.sum())
        if not rest:
            break
        share[at] = max(1, share[at] + rest)
    return Table(share)


def encode_blocks(ids: np.ndarray, table: Table, lanes: int = LANES, block: int = BLOCK_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final states (block, lane), words in a row and the number of words of each block."""
    count = -(-len(ids) // block)
    steps, last_steps = block // lanes, -(-(len(ids) - (count - 1) * block) // lanes)
    padded = np.full(count * block, int(np.argmax(table.frequency)), np.int64)
    padded[:len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(count, steps, lanes).transpose(1, 0, 2))
    state = np.full((count, lanes), LOWEST, np.uint64)
    words, written = np.zeros((steps, count, lanes), np.uint32), np.zeros((steps, count, lanes), bool)
    for step in range(steps - 1, -1, -1):
        active = count if step < last_steps else count - 1
        if not active:
            continue
        x, symbol = state[:active], grid[step, :active]
        frequency = table.frequency[symbol]
        full = x >= table.ceiling[symbol]
        written[step, :active], words[step, :active] = full, x.astype(np.uint32)
        x = np.where(full, x >> WORD, x)
        times = x // frequency
        state[:active] = (times << np.uint64(SCALE_BITS)) + (x - times * frequency) + table.before[symbol]
    written = written.transpose(1, 0, 2)
    return state, words.transpose(1, 0, 2)[written], written.sum((1, 2))


def decode_blocks(total: int, state: np.ndarray, words: np.ndarray, sizes: np.ndarray, table: Table, block: int = BLOCK_TOKENS) -> np.ndarray:
    """The ``total`` ids that encode_blocks was given."""
    count, lanes = state.shape
    steps, last_steps = block // lanes, -(-(total - (count - 1) * block) // lanes)
    state, at = state.copy(), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    out = np.zeros((steps, count, lanes), np.uint32)
    low = np.uint64((1 << SCALE_BITS) - 1)
    for step in range(steps):
        active = count if step < last_steps else count - 1
        if not active:
            break
        x = state[:active]
        slot = x & low
        symbol = table.symbol[slot]
        out[step, :active] = symbol
        x = table.frequency[symbol] * (x >> np.uint64(SCALE_BITS)) + slot - table.before[symbol]
        short = x < LOWEST
        taken = np.cumsum(short, axis=1)
        place = np.minimum(at[:active, None] + taken - 1, len(words) - 1)
        state[:active] = np.where(short, (x << WORD) | words[np.maximum(place, 0)], x)
        at[:active] += taken[:, -1]
    if (state != LOWEST).any():
        raise ValueError("damaged block: its states do not end where they began")
    return out.transpose(1, 0, 2).ravel()[:total]


# ---- files ----

def segment_bytes(ids: np.ndarray, sizes: np.ndarray, doc_ids: pa.Array, table: Table) -> bytes:
    """Counts, ids and lengths of the documents, sizes and checksums of the blocks, states and words."""
    state, words, lengths = encode_blocks(ids, table)
    sums = [zlib.crc32(ids[k:k + BLOCK_TOKENS].astype("<u4").tobytes()) for k in range(0, len(ids), BLOCK_TOKENS)]
    known = pc.is_valid(doc_ids).to_numpy(zero_copy_only=False).astype(np.uint8)
    return b"".join([np.array([len(sizes), len(ids), len(lengths), len(words)], "<u8").tobytes(), state.astype("<u8").tobytes(),
                     pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), sizes.astype("<u8").tobytes(),
                     lengths.astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(), words.astype("<u4").tobytes(), known.tobytes()])


def read_segment(raw: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids, lengths and doc_ids of a segment; every block is held against its checksum."""
    docs, tokens, blocks, total = np.frombuffer(raw[:32], "<u8").astype(int).tolist()
    body = np.frombuffer(raw, np.uint8)
    at = 32 + 8 * blocks * LANES
    state = body[32:at].view("<u8").reshape(blocks, LANES)
    doc_ids, sizes = columns(body[at:], docs, ["<i8", "<u8"])
    at += 16 * docs
    lengths, sums = columns(body[at:], blocks, ["<u4", "<u4"])
    at += 8 * blocks
    words, known = body[at:at + 4 * total].view("<u4"), body[at + 4 * total:].astype(bool)
    ids = decode_blocks(tokens, state, words, lengths, table)
    for k, expected in enumerate(sums.tolist()):
        if zlib.crc32(ids[k * BLOCK_TOKENS:(k + 1) * BLOCK_TOKENS].astype("<u4").tobytes()) != expected:
            raise ValueError(f"damaged block {k}: its checksum differs")
    return ids, sizes.astype(np.int64), pa.array(doc_ids, pa.int64(), mask=~known)


def write_files(tokens: DataFrame, table: Table, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Writes ``tokens`` in ascending doc_id order (null first) over files whose order is ``part``; returns part, path, bytes and tokens of each.

    Rows of one doc_id follow each other in the order of a hash of their ids; many rows of one doc_id may reach over several files.
    A repeated task writes another file, and only the one named by a finished task is ever read.
    """
    folder = f"{shared_dir(tokens.sparkSession)}/rans-{uuid.uuid4().hex}"
    order = ["doc_id", "place", "row"]
    placed = tokens.withColumn("place", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    along = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/{uuid.uuid4().hex}.rans"
        system, plain = store(path)
        system.create_dir(os.path.dirname(plain), recursive=True)
        points, waiting, held, at, docs, total = [], [], 0, 0, 0, 0
        with system.open_output_stream(plain) as out:
            def put(raw: bytes) -> None:
                nonlocal at
                out.write(raw)
                at += len(raw)

            def close() -> None:
                nonlocal waiting, held, docs, total
                ids, sizes = [np.concatenate(x) for x in zip(*[w[:2] for w in waiting])]
                raw = segment_bytes(ids, sizes, pa.concat_arrays([w[2] for w in waiting]), table)
                points.append([at, len(raw), docs, total, len(sizes), len(ids), zlib.crc32(raw)])
                put(raw)
                waiting, held, docs, total = [], 0, docs + len(sizes), total + len(ids)

            put(MAGIC + np.array([SCALE_BITS, LANES, BLOCK_TOKENS, table.checksum], "<u4").tobytes())
            for batch in (b for some in ([first], batches) for b in some):
                ids, sizes = unpacked(batch.column(1), batch.column(2)[0].as_py())
                ends, row = np.cumsum(sizes), 0
                while row < len(sizes):
                    begin = ends[row - 1] if row else 0
                    stop = min(len(sizes), int(np.searchsorted(ends, begin + segment_tokens - held)) + 1)
                    waiting.append((ids[begin:ends[stop - 1]], sizes[row:stop], batch.column(0).slice(row, stop - row)))
                    held, row = held + int(ends[stop - 1] - begin), stop
                    if held >= segment_tokens:
                        close()
            if waiting:
                close()
            footer = np.array(points, "<u8").tobytes()
            put(footer + np.array([len(points), zlib.crc32(footer)], "<u8").tobytes() + MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([path]), pa.array([at], pa.int64()), pa.array([total], pa.int64())],
                                         names=["part", "path", "bytes", "tokens"])

    return cut_lineage(along.mapInArrow(run, "part long, path string, bytes long, tokens long"))


def read_checkpoints(path: str, size: int, table: Table) -> list[dict]:
    """The segments that the footer of a file lists."""
    tail = read_range(path, size - 24, 24)
    head = read_range(path, 0, 24)
    if tail[16:] != MAGIC or head[:8] != MAGIC or np.frombuffer(head[8:], "<u4").tolist() != [SCALE_BITS, LANES, BLOCK_TOKENS, table.checksum]:
        raise ValueError(f"{path}: not a token file of this table")
    count, expected = np.frombuffer(tail[:16], "<u8").astype(int).tolist()
    footer = read_range(path, size - 24 - 56 * count, 56 * count)
    if zlib.crc32(footer) != expected:
        raise ValueError(f"{path}: damaged footer")
    return [dict(zip(CHECKPOINT, row)) for row in np.frombuffer(footer, "<u8").astype(np.int64).reshape(count, 7).tolist()]


def read_files(files: DataFrame, table: Table) -> DataFrame:
    """doc_id, start, n_tokens and ids (packed 32-bit little-endian) of every document, in parallel over the checkpoints.

    ``files`` has part, path, bytes and tokens; start counts the ids of all documents before, over the files in the order of part.
    """
    spark = files.sparkSession
    named = collect_bounded(files.select("part", "path", "bytes", "tokens"), MAX_FILES, "token files")
    ahead, rows = 0, []
    for r in sorted(named, key=lambda r: r["part"]):
        rows.append((r["path"], r["bytes"], ahead))
        ahead += r["tokens"]
    listed = spark.createDataFrame(rows, "path string, bytes long, ahead long").repartition(max(1, min(len(rows), 1 << 12)), "path")
    points = "path string, ahead long, offset long, bytes long, first_token long, checksum long"

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"path": r["path"], "ahead": r["ahead"], **{k: p[k] for k in ("offset", "bytes", "first_token", "checksum")}}
                     for r in batch.to_pylist() for p in read_checkpoints(r["path"], r["bytes"], table)]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("path", pa.string()), *[(k, pa.int64()) for k in ("ahead", "offset", "bytes", "first_token", "checksum")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = read_range(r["path"], r["offset"], r["bytes"])
                if zlib.crc32(raw) != r["checksum"]:
                    raise ValueError(f"{r['path']}: damaged segment at {r['offset']}")
                ids, sizes, doc_ids = read_segment(raw, table)
                ends = np.cumsum(sizes)
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ends - sizes + r["ahead"] + r["first_token"], pa.int64()), pa.array(sizes, pa.int64()), packed.cast(pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    tasks = max(1, min(-(-ahead // (SEGMENTS_A_TASK * SEGMENT_TOKENS)), 1 << 15))
    spread = listed.mapInArrow(footers, points).repartition(tasks, F.col("path"), F.col("offset"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document, from files written from ``docs`` and read back.

    doc_id must be an integer; null doc_ids come first. Null and empty texts are ``end_id`` alone. Rows that repeat are
    written each. Empty table: no files, no rows. Only doc_id and text are read. ``tokenizer`` is the path, on every
    worker, of a tokenizers file that drops white space and splits words from punctuation.
    """
    tokens = token_rows(docs, tokenizer, end_id)
    counts = token_frequencies(tokens)
    if not len(counts):
        return tokens.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    table = table_of(counts)
    return read_files(write_files(tokens, table, segment_tokens), table)

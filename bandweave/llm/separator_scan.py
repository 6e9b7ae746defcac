"""Token counts from flat token files: a vectorised search for end-of-document ids, stitched over blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bandweave.session import cut_lineage, shared_dir

from .flatfiles import read_range, write_flat
from .text import SpanHasher, flat, sliced, words

FILE_BYTES = 64 << 20


def write_token_files(docs: DataFrame, width: int = 2, separator: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes each text as ids of ``width`` bytes and a separator; returns path, bytes (of the file), ordinal and doc_id of each document.

    A word (A-Z in lower case) becomes the id 1 + hash mod (2^(8 width) - 1), so no word is the separator 0.
    A file is closed once it holds ``file_bytes``, between documents. Null and empty texts are a separator alone.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    kind = np.dtype(f"<u{width}")
    ids = np.uint64((1 << 8 * width) - 1)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, waiting, names, size = SpanHasher(lower=True), [], [], 0

        def close() -> pa.RecordBatch:
            path = write_flat(folder, waiting)
            named = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays([pa.array([path] * len(named), pa.string()), pa.array(np.full(len(named), size)), pa.array(np.arange(len(named))), named],
                                               names=["path", "bytes", "ordinal", "doc_id"])

        for batch in sliced(batches, "text"):
            data, off = flat(batch.column(1))
            start, end, doc = words(data, off)
            out = np.full(len(start) + batch.num_rows, separator, kind)
            out[np.arange(len(start)) + doc] = (1 + hasher(data, start, end) % ids).astype(kind)
            waiting.append(out)
            names.append(batch.column(0))
            size += out.nbytes
            if size >= file_bytes:
                yield close()
                waiting, names, size = [], [], 0
        if waiting:
            yield close()

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, f"path string, bytes long, ordinal long, doc_id {key}"))


def scan_separators(files: DataFrame, width: int = 2, separator: int = 0, block_tokens: int = 4 << 20) -> DataFrame:
    """path, ordinal, start and n_tokens of each document in flat token files; ``closed`` is false for tokens
    after the last separator of a file.

    ``files`` has path and bytes. Files are cut into blocks of ``block_tokens``; each block is searched on its
    own for separators. A prefix scan over the blocks' summaries of a file (separators, last separator) gives
    each block the number of documents and the last separator before it, which a document that began in an
    earlier block needs. A document may span any number of blocks. Bytes after the last whole token are
    ignored; files without tokens give no rows. Paths that repeat are scanned once.
    """
    kind = np.dtype(f"<u{width}")
    sized = files.select("path", F.floor(F.col("bytes") / width).alias("tokens")).distinct()
    blocks = sized.where("tokens > 0").select("path", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    blocks = blocks.repartition(F.col("path"), F.col("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tokens, block in zip(*[c.to_pylist() for c in batch.columns]):
                first = block * block_tokens
                raw = read_range(path, first * width, min(block_tokens, tokens - first) * width)
                stops = np.flatnonzero(np.frombuffer(raw, kind) == separator) + first
                yield pa.RecordBatch.from_pylist([{"path": path, "tokens": tokens, "block": block, "n": len(stops), "last": int(stops[-1]) if len(stops) else None,
                                                   "starts": [None, *(stops[:-1] + 1).tolist()][:len(stops)], "stops": stops}], schema)

    schema = pa.schema([("path", pa.string()), ("tokens", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("last", pa.int64()),
                        ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64()))])
    found = cut_lineage(blocks.mapInArrow(search, "path string, tokens long, block long, n long, last long, starts array<long>, stops array<long>"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
                            (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("carried"))
    ended = found.select("path", "block", "starts", "stops").join(stitched, ["path", "block"]).select(
        "path", "ahead", "carried", F.posexplode(F.arrays_zip("starts", "stops")).alias("at", "doc"))
    start = F.coalesce("doc.starts", "carried")
    closed = ended.select("path", (F.col("ahead") + F.col("at")).alias("ordinal"), start.alias("start"),
                          (F.col("doc.stops") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = found.groupBy("path").agg(F.max("tokens").alias("tokens"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    opened = whole.where("last < tokens - 1").select("path", "ordinal", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(opened)


def token_counts(docs: DataFrame, width: int = 2, block_tokens: int = 4 << 20, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id and n_tokens of each row, counted by a separator scan over token files written from ``docs``.

    Null text: 0. Rows that repeat are counted each. Null doc_id: kept. Only doc_id and text are read.
    """
    named = write_token_files(docs, width, file_bytes=file_bytes)
    counts = scan_separators(named.select("path", "bytes"), width, block_tokens=block_tokens)
    return named.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens")

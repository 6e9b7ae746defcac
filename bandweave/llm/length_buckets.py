"""Packing into optimal length buckets: boundaries by dynamic programming, token-budget batches inside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .text import flat, numbered, parts_for, sliced, words

MAX_TOKENS = 2048


def optimal_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that minimise the padded tokens of the histogram.

    Every bound is a length that occurs. cost(i, j) pads lengths i..j to length j; the best cost of the
    first j lengths in k buckets follows from that in k - 1, for all j at once. Ties: the fewest buckets,
    then the shorter bounds.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    rows = np.concatenate([[0], np.cumsum([float(histogram[x]) for x in lengths.tolist()])])
    n = len(lengths)
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        new, came = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1]
            came[j] = int(np.argmin(cost))
            new[j] = cost[came[j]]
        back.append((new[n], came))
        best = new
    k, j, bounds = int(np.argmin([cost for cost, _ in back])), n, []
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j = int(back[k][1][j])
        k -= 1
    return bounds[::-1]


def packed_batches(docs: DataFrame, buckets: int = 12, batch_tokens: int = 16_384, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, text, n_tokens, bucket_len, batch and slot of each piece of each row.

    Tokens are words. A text longer than ``max_tokens`` becomes pieces of that many tokens and a rest; text
    keeps every character (blanks at a cut go with the piece before it), so the pieces in order are the
    text. The histogram has at most ``max_tokens`` + 1 lengths, whatever the data; its optimal bounds are
    the bucket lengths. In a bucket of length b each batch takes max(1, batch_tokens // b) pieces (0-token
    pieces: batch_tokens), in numbered order; only a bucket's last batch may be short.

    Null and empty texts are one piece without tokens (text null stays null). Repeated rows are packed each.
    Null doc_id is kept. Only doc_id and text are read. Empty table: no rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column(1)
            data, off = flat(texts)
            start, _, doc = words(data, off)
            count = np.bincount(doc, minlength=len(texts))
            number = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
            at = (number % max_tokens == 0) & (number > 0)
            owner = np.concatenate([np.arange(len(texts)), doc[at]])
            place = np.concatenate([off[:-1], start[at]])
            order = np.lexsort([np.concatenate([np.zeros(len(texts)), number[at]]), owner])
            owner, place = owner[order], place[order]
            piece = np.arange(len(owner)) - np.searchsorted(owner, owner)
            tokens = np.minimum(count[owner] - piece * max_tokens, max_tokens)
            text = pa.LargeStringArray.from_buffers(len(owner), pa.py_buffer(np.append(place, len(data)).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            absent = pa.array(texts.is_null().to_numpy(zero_copy_only=False)[owner])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pc.if_else(absent, pa.scalar(None, pa.string()), text),
                                              pa.array(tokens.astype(np.int64))], names=["doc_id", "piece", "text", "n_tokens"])

    pieces = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, piece int, text string, n_tokens long")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = optimal_bounds(histogram, buckets) or [0]
    bucket = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("n_tokens")))
    placed = numbered(pieces.withColumn("bucket_len", bucket), ["bucket_len"], ["doc_id", "piece", "n_tokens"], "number", parts_for(sum(histogram.values())))
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return placed.select("doc_id", "piece", "text", "n_tokens", "bucket_len", F.floor(F.col("number") / each).alias("batch"), F.pmod("number", each).alias("slot"))

"""Sharding by longest processing time: groups of equal texts, largest first, to the least loaded shard."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bandweave.session import cut_lineage

from .text import numbered, parts_for

MANTISSA = 14


def dealt_counts(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int]]]:
    """(class, groups for each shard) of longest-processing-time scheduling, largest size first.

    A class is a size and the number of groups of it. A group goes to the least loaded shard (ties: lower
    shard) through a heap; for a class of many groups the level up to which the shards fill is found first
    and only what is over goes through the heap, with the same outcome.
    """
    load, out = np.zeros(shards), []
    for name, n, size in sorted(classes, key=lambda c: (-c[2], c[0])):
        given = np.zeros(shards, np.int64)
        if n > 2 * shards and size > 0:
            low, high = load.min(), load.max() + size * n
            for _ in range(100):
                level = (low + high) / 2
                if np.floor(np.maximum(0, level - load) / size).sum() > n:
                    high = level
                else:
                    low = level
            given = np.floor(np.maximum(0, low - load) / size).astype(np.int64)
        heap = [(load[s] + given[s] * size, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - int(given.sum())):
            at, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (at + size, s))
        load += given * size
        out.append((name, given.tolist()))
    return out


def shard_groups(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; rows of equal text share a shard.

    Size is the UTF-8 length plus 8. Groups are summed by the text's SHA-256 and put in classes of equal
    size (above 2^14 bytes, sizes equal in their leading 14 bits), so the driver gets at most 2^14 classes for
    each doubling of the size and never a group. It schedules the classes; a group takes the shard of its
    number within its class. Slots number the rows of a shard from 0. Groups and rows are numbered in
    parts, so neither a common text nor a large class is sorted in one task.

    Null text is its own group, of no bytes (crc32 0). Repeated rows each take a slot. Null doc_id is kept.
    Only doc_id and text are read. Empty table: no rows.
    """
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit("")).alias("text_key")))
    groups = sized.groupBy("text_key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(groups.withColumn("class", F.expr(f"weight - pmod(weight, shiftleft(1L, greatest(length(bin(weight)) - {MANTISSA}, 0)))")))
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("size"), F.sum("n").alias("rows")).collect()
    plan = dealt_counts([(r["class"], r["n"], r["size"]) for r in classes], shards)
    table = pd.DataFrame({"class": [c for c, _ in plan], "ends": [np.cumsum(given).tolist() for _, given in plan]})
    ends = spark.createDataFrame(table, "class long, ends array<long>")
    ranked = numbered(groups, ["class"], ["text_key"], "number", parts_for(sum(r["n"] for r in classes)))
    placed = ranked.join(ends, "class").select("text_key", F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard"))
    rows = cut_lineage(sized.join(placed, "text_key").select("doc_id", "size", "text_crc32", "text_key", "shard"))
    total = sum(r["rows"] for r in classes)
    slots = numbered(rows, ["shard"], ["doc_id", "text_key"], "slot", parts_for(total))
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")

"""Near duplicates at a word-shingle similarity, with candidates from SimHash fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bandweave.session import cut_lineage

from .components import components, local_forest
from .simhash_trie import fingerprint, shingle_hashes, trie_join
from .text import mix, sliced

BLOCK = 512
COLUMNS = 16_384
RANGE = 1 << 20
BLOCK_VALUES = 4 << 20
SLICE = 1 << 20


def sampled_fingerprints(hashes: np.ndarray, samples: int, picks: int) -> list[int]:
    """The SimHash of the whole text, then of ``samples`` samples: the ``picks`` least hashes under as many permutations."""
    out = [fingerprint(hashes)]
    for k in range(samples):
        order = mix(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
        out.append(fingerprint(np.partition(order, picks - 1)[:picks] if len(order) > picks else order))
    return out


def similar_links(sets: list[np.ndarray], full: int | None, similarity: float) -> np.ndarray:
    """Index pairs whose sets (sorted, of spread hashes) have the similarity; a set of ``full`` values is the least part of a larger one.

    Two sets are compared below the lesser of the points up to which both are known: exact for whole sets, and all are
    whole if ``full`` is None. Shared values are counted over ranges of the hashes with about RANGE values each.
    """
    top = int(np.iinfo(sets[0].dtype).max)
    known = np.array([s[-1] if full is not None and len(s) >= full else top for s in sets], sets[0].dtype)
    count = np.stack([np.searchsorted(s, np.minimum(known, k), side="right") for s, k in zip(sets, known)])
    both = np.zeros((len(sets), len(sets)))
    ranges = max(1, -(-sum(map(len, sets)) // RANGE))
    cuts = np.array([top // ranges * k for k in range(1, ranges)], sets[0].dtype)
    ends = np.stack([np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in sets], axis=1)
    for low, high in zip(ends, ends[1:]):
        parts = [s[a:b] for s, a, b in zip(sets, low, high)]
        values, column = np.unique(np.concatenate(parts), return_inverse=True)
        owner, often = np.repeat(np.arange(len(sets)), high - low), np.bincount(column, minlength=len(values)) > 1
        new = np.cumsum(often) - 1
        use = often[column]
        owner, column = owner[use], new[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, int(often.sum()), COLUMNS):
            inside = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            block = np.zeros((len(sets), min(COLUMNS, int(often.sum()) - at)), np.float32)
            block[owner[inside], column[inside] - at] = 1
            both += block @ block.T
    found = both >= similarity * (count + count.T - both) - 1e-6
    return np.argwhere(np.triu(found, 1))


def block_pairs(members: DataFrame) -> DataFrame:
    """gid, node, i, j: the members of each group (gid, node, ``blocks``) dealt to blocks, for every pair of blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.select("gid", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("gid", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, samples: int = 12, picks: int = 4,
                    budget: int = 2, sketch: int = 512) -> DataFrame:
    """doc_id and group (least doc_id of its group of near duplicates) for each distinct non-null doc_id.

    Texts are equal if their words are (A-Z in lower case); of each, one goes on. Its fingerprints (whole
    text and samples of its shingles) are joined through the trie, one join a sample; texts that share a
    linked fingerprint are candidates. The ``sketch`` least hashes of their shingle sets only rule out pairs six or
    more standard errors below ``similarity``; within each component of what is left all pairs are decided by
    the Jaccard similarity of the whole sets (64-bit hashes). At similarity 0.8 a pair shares one of
    12 samples of 4 in 99.8 % of cases. Groups are cut into blocks of about BLOCK texts (and, of whole sets, BLOCK_VALUES
    shingles) and blocks are compared with blocks, so no task holds a large group and only forests of links come out.

    Null and empty texts are equal to each other. Texts shorter than ``words`` are one shingle. Rows that
    repeat a doc_id are one document. Rows with a null doc_id take no part. Other columns are not read.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                same, prints = [], []
                for text in part.column(1).to_pylist():
                    hashes = np.unique(shingle_hashes(text, words))
                    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
                    same.append(hashlib.md5(b" ".join(parts)).digest())
                    prints.append(sampled_fingerprints(hashes, samples, picks))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(same, pa.binary()), pa.array(prints, pa.list_(pa.int64()))],
                                                 names=["doc_id", "same", "prints"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique((mix(shingle_hashes(text, words)) >> np.uint64(32)).astype(np.uint32))[:sketch].tobytes() for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "sketch"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            sets = [np.unique(mix(shingle_hashes(text, words))) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "size", "hashes"])

    def linked(group: pa.Table, column: str, kind: type, full: int | None, bar: float) -> pa.Table:
        ids = group.column("node").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), kind) for x in group.column(column)]
        links = local_forest([ids[similar_links(sets, full, bar)]])
        return pa.table({"a": links[:, 0].astype(np.int64), "b": links[:, 1].astype(np.int64)})

    def compare_sketches(group: pa.Table) -> pa.Table:
        return linked(group, "sketch", np.uint32, sketch, similarity - 3 / sketch ** 0.5)

    def compare_whole(group: pa.Table) -> pa.Table:
        return linked(group, "hashes", np.uint64, None, similarity)

    seen = cut_lineage(docs.mapInArrow(features, "doc_id long, same binary, prints array<long>"))
    texts = cut_lineage(seen.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("prints").alias("prints")))
    bands = texts.select("node", F.posexplode("prints").alias("band", "fp"))
    links = trie_join(bands.select("band", "fp").distinct(), budget)
    place = F.xxhash64("band", "fp")
    roots = components(cut_lineage(links.select(F.xxhash64("band", "a").alias("a"), F.xxhash64("band", "b").alias("b"))))
    placed = bands.select("node", place.alias("place"))
    members = cut_lineage(placed.join(roots.withColumnRenamed("node", "place"), "place", "left").select("node", F.coalesce("root", "place").alias("gid")).distinct())
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
    once = sizes.where(F.col("n") > 1).groupBy("n", "least", "mark").agg(F.min("gid").alias("gid")).select("gid", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    asked = cut_lineage(members.join(once, "gid"))
    wanted = asked.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(wanted, "doc_id", "left_semi").mapInArrow(sketches, "node long, sketch binary")
                       .groupBy("node").agg(F.first("sketch").alias("sketch")))
    pairs = block_pairs(asked).join(sets, "node").groupBy("gid", "i", "j").applyInArrow(compare_sketches, "a long, b long")
    loose = components(cut_lineage(pairs)).withColumnRenamed("root", "gid")
    named = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(loose.select("node"), "node", "left_semi")
    hashed = cut_lineage(named.mapInArrow(whole, "node long, size long, hashes binary").groupBy("node").agg(F.first(F.struct("size", "hashes")).alias("v")).select("node", "v.*"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_VALUES)).cast("int")
    cuts = loose.join(hashed.select("node", "size"), "node").groupBy("gid").agg(blocks.alias("blocks"))
    pairs = block_pairs(loose.join(cuts, "gid")).join(hashed, "node").groupBy("gid", "i", "j").applyInArrow(compare_whole, "a long, b long")
    near = components(cut_lineage(pairs))
    grouped = texts.select("same", "node").join(near, "node", "left").select("same", F.coalesce("root", "node").alias("group"))
    return seen.select("doc_id", "same").join(grouped, "same").groupBy("doc_id").agg(F.min("group").alias("group"))

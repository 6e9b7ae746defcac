"""SimHash near-dedup: fingerprints joined with themselves through a binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from bandweave.session import cut_lineage

from .components import components, local_forest

TOP_BITS = 16
LEAST_DEPTH = 5
LEAF_ROWS = 65_536
FRONTIER = 50_000
FINISH = 32


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, A-Z in lower case; shorter texts give one run."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    first, last = starts[:len(parts) - size + 1].tolist(), ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(first, last)), np.uint64, len(first))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; none give zero. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = [fingerprint(shingle_hashes(text, words)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def top_trie(counts: dict[int, int], leaf_rows: int) -> list[tuple[int, int]]:
    """(prefix, depth) of the leaves of the upper trie: at most ``leaf_rows`` rows from LEAST_DEPTH on, or TOP_BITS deep."""
    leaves, level = [], counts_at(counts, 0)
    for depth in range(TOP_BITS + 1):
        done = {p for p, n in level.items() if depth >= LEAST_DEPTH and n <= leaf_rows or depth == TOP_BITS}
        leaves += [(p, depth) for p in sorted(done)]
        if len(done) == len(level):
            break
        level = {p: n for p, n in counts_at(counts, depth + 1).items() if p >> 1 in level and p >> 1 not in done}
    return leaves


def counts_at(counts: dict[int, int], depth: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for prefix, n in counts.items():
        out[prefix >> (TOP_BITS - depth)] = out.get(prefix >> (TOP_BITS - depth), 0) + n
    return out


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> np.ndarray:
    """Pairs of leaf numbers whose common prefix length differs in at most ``budget`` bits."""
    value = np.array([p << (TOP_BITS - d) for p, d in leaves], np.int64)
    depth = np.array([d for _, d in leaves], np.int64)
    found = []
    for i in range(len(leaves)):
        cut = TOP_BITS - np.minimum(depth[i], depth[i:])
        near = np.flatnonzero(np.bitwise_count((value[i] ^ value[i:]) >> cut) <= budget) + i
        found.append(np.column_stack([np.full(len(near), i), near]))
    return np.concatenate(found)


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> Iterator[np.ndarray]:
    """Index pairs (a, b) within ``budget`` bits, by walking both tries down together.

    ``a`` and ``b`` are sorted unsigned arrays; a node is a range of equal prefixes. A pair of nodes
    carries the bits in which its prefixes differ and is given up beyond the budget. ``same``: both
    are one trie, so each pair of nodes is met once.
    """
    ones_a = [np.concatenate([[0], np.cumsum((a >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]) for d in range(64)]
    ones_b = ones_a if same else [np.concatenate([[0], np.cumsum((b >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)]) for d in range(64)]
    stack = [(0, np.array([[0, len(a), 0, len(b), 0]], np.int64))]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes) > FRONTIER:
            stack += [(depth, nodes[at:at + FRONTIER]) for at in range(0, len(nodes), FRONTIER)]
            continue
        width = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = width <= FINISH if depth < 64 else np.ones(len(nodes), bool)
        if small.any():
            alo, _, blo, bhi, _ = nodes[small].T
            each, across = width[small], (bhi - blo)
            pair = np.repeat(np.arange(len(each)), each)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            i, j = alo[pair] + at // across[pair], blo[pair] + at % across[pair]
            near = (np.bitwise_count(a[i] ^ b[j]) <= budget) & ((i < j) if same else True)
            yield np.column_stack([i[near], j[near]])
        nodes = nodes[~small]
        if not len(nodes):
            continue
        alo, ahi, blo, bhi, diff = nodes.T
        amid = ahi - (ones_a[depth][ahi] - ones_a[depth][alo])
        bmid = bhi - (ones_b[depth][bhi] - ones_b[depth][blo])
        twin = (alo == blo) & (ahi == bhi) & same
        down = np.concatenate([
            np.column_stack([alo, amid, blo, bmid, diff]), np.column_stack([amid, ahi, bmid, bhi, diff]),
            np.column_stack([alo, amid, bmid, bhi, diff + 1]), np.column_stack([amid, ahi, blo, bmid, diff + 1])[~twin]])
        keep = (down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)
        stack.append((depth + 1, down[keep]))


def trie_join(fps: DataFrame, budget: int = 2, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (band, a, b) between the distinct fingerprints of each band that span all pairs within ``budget`` bits.

    ``fps`` has band (a small number, one trie each) and fp. The upper tries are cut from LEAST_DEPTH on where a
    node holds at most ``leaf_rows`` fingerprints (TOP_BITS deep at most, so 2^16 counts a band reach the driver). Each
    pair of leaves that can still be in budget is one group, walked in one task. A group returns a spanning
    forest of its links, never all pairs of a dense group.
    """
    spark = fps.sparkSession
    shift = 64 - TOP_BITS
    counts: dict[int, dict[int, int]] = {}
    for row in fps.groupBy("band", F.shiftrightunsigned("fp", shift).cast("int").alias("top")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(row["band"], {})[row["top"]] = row["n"]
    if not counts:
        return spark.createDataFrame([], "band int, a long, b long")
    starts, routes = [], []
    for band in sorted(counts):
        leaves = sorted(top_trie(counts[band], leaf_rows), key=lambda x: x[0] << (TOP_BITS - x[1]))
        pairs = leaf_pairs(leaves, budget) + len(starts)
        starts += [(band << TOP_BITS) + (p << (TOP_BITS - d)) for p, d in leaves]
        routes.append(pairs)
    pairs = np.concatenate(routes)
    number, cross = np.arange(len(pairs)), pairs[:, 0] != pairs[:, 1]
    sides = pd.DataFrame({"leaf": np.concatenate([pairs[:, 0], pairs[cross, 1]]), "pair": np.concatenate([number, number[cross]]),
                          "side": np.repeat([0, 1], [len(pairs), int(cross.sum())])})

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(starts)
        for batch in batches:
            band, fp = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            spot = (band << TOP_BITS) + (fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            leaf = np.searchsorted(bounds, spot, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int64())], names=["band", "fp", "leaf"])

    def walk(group: pa.Table) -> pa.Table:
        fp, side = group.column("fp").to_numpy().view(np.uint64), group.column("side").to_numpy()
        a = np.sort(fp[side == 0])
        same = not (side == 1).any()
        b = a if same else np.sort(fp[side == 1])
        found = local_forest(np.column_stack([a[x[:, 0]], b[x[:, 1]]]) for x in trie_links(a, b, budget, same))
        band = np.full(len(found), group.column("band")[0].as_py() if group.num_rows else 0, np.int32)
        return pa.table({"band": band, "a": found[:, 0].copy().view(np.int64), "b": found[:, 1].copy().view(np.int64)})

    routed = fps.select(F.col("band").cast("int").alias("band"), "fp").mapInArrow(leaf_of, "band int, fp long, leaf long")
    table = spark.createDataFrame(sides.astype("int64"), "leaf long, pair long, side long")
    return routed.join(table, "leaf").select("pair", "side", "band", "fp").groupBy("pair").applyInArrow(walk, "band int, a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over links of at most ``budget`` bits.

    Whole texts; null text and texts without words have fingerprint zero and are linked like any other.
    Exact copies share a fingerprint and are never compared. Rows that repeat a doc_id keep their own
    fingerprint. A null doc_id is never a component_id unless its component has no other; then it is
    null. Only doc_id and text are read. Empty table: no rows.
    """
    prints = cut_lineage(fingerprints(docs, words))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(cut_lineage(trie_join(classes.select(F.lit(0).alias("band"), "fp"), budget)))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")

"""Connected components over tables of links."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from bandweave.session import cut_lineage


def local_forest(links: Iterable[np.ndarray]) -> np.ndarray:
    """A spanning forest (star by star, around the least member) of links that come in arrays of pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = np.uint64
    for part in links:
        kind = part.dtype
        for a, b in part.tolist():
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    stars = [(x, root(x)) for x in list(parent) if root(x) != x]
    return np.array(stars, kind).reshape(-1, 2)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (least node reachable) of every node in ``links`` (columns a and b).

    Alternates large and small stars: each node hangs its larger, then its smaller neighbours under
    the least of them, until nothing changes; the number of rounds grows with the logarithm of the
    graph. Least neighbours are aggregated before they are joined, so a hub is never one sorted group.
    Each round is a table in the shared folder. Self links and repeated links change nothing.
    """
    def stars(edges: DataFrame, larger: bool) -> DataFrame:
        """edges have u > v."""
        if larger:
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            hung = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            least = edges.groupBy("u").agg(F.min("v").alias("m"))
            hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return hung.where(F.col("u") != F.col("v")).distinct()

    edges = cut_lineage(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        edges = cut_lineage(stars(stars(edges, True), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

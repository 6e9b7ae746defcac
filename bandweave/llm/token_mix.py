"""Mixing sources to target weights: budgets down a tree, then a token prefix of seeded epochs in each leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandweave.session import cut_lineage

from .text import parts_for, word_count


def node_weight(levels: list[str], weights: dict[tuple[str, ...], float]) -> Column:
    """Weight of the node at the end of ``levels``: its entry in ``weights`` (a path of names), or 1."""
    own = [(path, w) for path, w in weights.items() if len(path) == len(levels)]
    out = F.lit(1.0)
    for path, weight in own:
        same = F.lit(True)
        for level, name in zip(levels, path):
            same = same & F.col(level).eqNullSafe(F.lit(name))
        out = F.when(same, F.lit(float(weight))).otherwise(out)
    return out


def usable_tokens(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], max_epochs: int) -> DataFrame:
    """``leaves`` with what each can give, ``able``: tokens x max_epochs, and nothing below a node of weight 0."""
    able = F.col("tokens") * F.lit(float(max_epochs))
    for depth in range(1, len(levels) + 1):
        able = F.when(node_weight(levels[:depth], weights) > 0, able).otherwise(0.0)
    return leaves.withColumn("able", able)


def leaf_budgets(able: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], target: float) -> DataFrame:
    """The levels, tokens and token ``budget`` (long) of each leaf of ``able``; ``target`` is at most the sum of able.

    From the root down each node's budget is split among its children by weight; what a child cannot use
    goes to its siblings by weight. The part of a budget that no sibling can use was already given to the siblings of
    the parent, because the parent's own share was held to what its leaves can use. With children ordered
    by able / weight, the level is the greatest of (budget - able before) / (weights from here).
    """
    nodes = None
    for depth in range(1, len(levels) + 1):
        here, above = levels[:depth], levels[:depth - 1]
        kids = able.groupBy(*here).agg(F.sum("able").alias("able")).withColumn("weight", node_weight(here, weights))
        if nodes is None:
            kids = kids.withColumn("parent", F.lit(float(target)))
        else:
            up = nodes.select(*[F.col(c).alias(f"__{c}") for c in above], F.col("budget").alias("parent"))
            kids = kids.join(up, [kids[c].eqNullSafe(up[f"__{c}"]) for c in above])
        kids = kids.where("able > 0")
        order = Window.partitionBy(*above).orderBy(F.col("able") / F.col("weight"), *here)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        level = (F.col("parent") - F.coalesce(F.sum("able").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
        kids = kids.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(*above)))
        nodes = kids.select(*here, F.greatest(F.lit(0.0), F.least("able", F.col("weight") * F.col("level"))).alias("budget"))
    plan = nodes.select(*[F.col(c).alias(f"__{c}") for c in levels], F.floor(F.col("budget") + 1e-6).cast("long").alias("__budget"))
    joined = able.join(plan, [able[c].eqNullSafe(plan[f"__{c}"]) for c in levels], "left")
    return joined.select(*levels, "tokens", F.coalesce("__budget", F.lit(0)).alias("budget"))


def mixed(docs: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], share: float = 0.6, max_epochs: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, the levels, epoch, n_tokens and take_tokens of each selected reading of a document.

    The target is ``share`` of all tokens (words); ``leaf_budgets`` gives each leaf's part. A leaf reads its
    documents epoch after epoch, each epoch in the order of an MD5 of seed, epoch and doc_id, until its budget is
    used: whole epochs first, then a prefix of the next, whose last document may be cut (take_tokens <
    n_tokens). The prefix is found by token sums of parts of the order and sums inside a part, so no leaf is
    sorted in one task. Texts are scanned once, for their token counts. Only built-in expressions are used.

    Null text and texts without words have no tokens and are never selected. Null level values are a name of
    their own; null doc_ids share one place in the order. Rows that repeat are each read, in no stated order among
    themselves. Only doc_id, text and the levels are read. Empty table: no rows.
    """
    names = [f"__l{k}" for k in range(len(levels))]
    rows = docs.select("doc_id", *[F.col(c).cast("string").alias(n) for c, n in zip(levels, names)], word_count(F.col("text")).alias("n_tokens"))
    rows = cut_lineage(rows.where("n_tokens > 0"))
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("n"))
    able = usable_tokens(leaves, names, weights, max_epochs)
    totals = able.agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.sum("able").alias("able")).first()
    parts = parts_for(totals["n"] or 0)
    budgets = leaf_budgets(able.drop("n"), names, weights, min(share * (totals["tokens"] or 0.0), totals["able"] or 0.0))
    plan = budgets.where("budget > 0").select(*[F.col(n).alias(f"p{n}") for n in names], F.floor(F.col("budget") / F.col("tokens")).alias("full"),
                                              (F.col("budget") - F.floor(F.col("budget") / F.col("tokens")) * F.col("tokens")).cast("long").alias("rest"))
    planned = rows.join(plan, [rows[n].eqNullSafe(plan[f"p{n}"]) for n in names]).drop(*[f"p{n}" for n in names])
    whole = planned.where("full > 0").select("doc_id", *names, F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    ordered = planned.where("rest > 0").withColumn("mark", mark).withColumn(
        "part", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("long"))
    sums = ordered.groupBy(*[F.col(n).alias(f"s{n}") for n in names], F.col("part").alias("s_part")).agg(F.sum("n_tokens").alias("s_tokens"))
    ahead = Window.partitionBy(*[f"s{n}" for n in names]).orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("s_tokens").over(ahead), F.lit(0)))
    inside = Window.partitionBy(*names, "part").orderBy("mark", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ordered.join(sums, [ordered[n].eqNullSafe(sums[f"s{n}"]) for n in names] + [ordered["part"] == sums["s_part"]])
    begun = F.col("ahead") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    prefix = placed.withColumn("begun", begun).where("begun < rest").select(
        "doc_id", *names, F.col("full").cast("int").alias("epoch"), "n_tokens", F.least("n_tokens", F.col("rest") - F.col("begun")).alias("take_tokens"))
    return whole.unionByName(prefix).select("doc_id", *[F.col(n).alias(c) for n, c in zip(names, levels)], "epoch", "n_tokens", "take_tokens")

"""Caps, subsamples, budgets and deterministic splits.

Order comes from a seeded hash of the row key, so a sample does not depend on file
order, partitioning or the number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import hash_text, hash_unit
from ..session import collect_bounded, cut_lineage
from .ranking import exact_percentiles, first_per_group, null_safe_join, numbered, ranked, with_scalars


SMALL_SAMPLE = 1000


def cap_per_group(df: DataFrame, keys: list[str], row_key: list[str], n: int | None, seed: int) -> DataFrame:
    """At most ``n`` rows per group in hash order; None or 0 keeps everything."""
    if not n:
        return df
    return first_per_group(df, keys, [hash_text(seed, *row_key), *[F.col(c) for c in row_key]], n)


def subsample(df: DataFrame, row_key: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order, all of them when there are fewer.

    A small sample is a plain top-n. For a large one a top-n would bring ``n`` rows of
    every partition into one task, so rows that cannot be among the first ``n`` are
    filtered by their hash first and the rest is ranked over many tasks.
    """
    key = hash_text(seed, *row_key)
    if n <= SMALL_SAMPLE:
        return df.orderBy(key, *row_key).limit(n)
    total = df.count()
    if total <= n:
        return df
    share = (n + 8.0 * n ** 0.5 + 50.0) / total
    near = df.where(hash_unit(seed, *row_key) < share)
    if share >= 1.0 or near.count() < n:
        near = df
    order = ranked(near.withColumn("__h", key), [], ["__h", *row_key], "__rn")
    return order.where(F.col("__rn") <= n).drop("__h", "__rn")


def subsample_classes(df: DataFrame, by: str, row_key: list[str], budget: int, seed: int, classes: int) -> DataFrame:
    """Equal share of the budget per class, then the overall cap."""
    per_class = max(1, budget // max(1, classes))
    return subsample(cap_per_group(df, [by], row_key, per_class, seed), row_key, budget, seed)


def viz_subsample(df: DataFrame, row_key: list[str], per_polygon: int, per_class: int, seed: int) -> DataFrame:
    """Cap per polygon within each class, then per class."""
    capped = cap_per_group(df, ["class", "tile_id", "polygon_id"], row_key, per_polygon, seed)
    return cap_per_group(capped, ["class"], row_key, per_class, seed)


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first along ``order``."""
    return first_per_group(df, keys, order, 1)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest row per key; combines on the map side, so a hot key stays cheap."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def last_decided(decisions: DataFrame, predicted: str, n: int) -> DataFrame:
    """Most recently decided uids of one class."""
    mine = decisions.where(F.col("predicted_class") == predicted)
    return latest(mine, "polygon_uid", ["ts", "event_id"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def evenly_spread(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows at evenly spaced positions of a unique order; only the columns of the order are ranked."""
    rows = numbered(df.select(*order), order, "__at")
    last = rows.agg(F.max("__at").alias("last")).first()["last"]
    if last is None or last + 1 <= n:
        return df
    positions = df.sparkSession.range(n).select(
        F.floor(F.col("id") * F.lit(float(last)) / F.lit(float(n - 1))).cast("bigint").alias("__at")).distinct()
    return null_safe_join(df, rows.join(positions, "__at", "left_semi").drop("__at"), order, "left_semi")


def split_tiles(tiles: DataFrame, key: str, seed: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Random split by whole tiles: shares of the tile count in hash order."""
    named = tiles.select(key).distinct().withColumn("__h", hash_text(seed, key))
    rows = ranked(named, [], ["__h", key], "__rn")
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    at = F.col("__rn") - 1
    share = with_scalars(rows, total)
    return share.select(key, F.when(at < F.floor(F.col("__n") * train), "train")
                        .when(at < F.floor(F.col("__n") * train) + F.floor(F.col("__n") * val), "val")
                        .otherwise("test").alias("split"))


def split_rows(df: DataFrame, row_key: list[str], seed: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Independent split of each row from its hash."""
    u = hash_unit(seed, *row_key)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def quota_on_tiles(df: DataFrame, tiles: DataFrame, row_key: list[str], per_tile: int, seed: int) -> DataFrame:
    """At most ``per_tile`` rows, in hash order, of each listed tile; rows of other tiles stay."""
    listed = tiles.select("tile_id").distinct()
    capped = cap_per_group(df.join(listed, "tile_id", "left_semi"), ["tile_id"], row_key, per_tile, seed)
    return df.join(listed, "tile_id", "left_anti").unionByName(capped)


def split_on_tiles(df: DataFrame, tiles: DataFrame, row_key: list[str], seed: int) -> DataFrame:
    """Rows of the listed tiles are split one by one; other rows keep their split."""
    listed = tiles.select("tile_id").distinct()
    drawn = split_rows(df.join(listed, "tile_id", "left_semi"), row_key, seed)
    return df.join(listed, "tile_id", "left_anti").unionByName(drawn.select(df.columns))


def gate_on_tiles(df: DataFrame, tiles: DataFrame, gated: Column) -> DataFrame:
    """Rows that match ``gated`` stay on the listed tiles alone; all other rows stay."""
    held = df.where(gated).join(tiles.select("tile_id").distinct(), "tile_id", "left_semi")
    return df.where(~F.coalesce(gated, F.lit(False))).unionByName(held.select(df.columns))


def hold_out_polygons(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """Whole polygons to val and test: the first and second ``share`` of them in hash order."""
    polygons = df.select(*keys).distinct().withColumn("__h", hash_text(seed, *keys))
    rows = ranked(polygons, [], ["__h", *keys], "__rn")
    total = rows.agg(F.greatest(F.lit(1), F.rint(F.count(F.lit(1)) * share)).cast("bigint").alias("__n"))
    marked = with_scalars(rows, total).withColumn("split", F.when(F.col("__rn") <= F.col("__n"), "val")
                                                       .when(F.col("__rn") <= 2 * F.col("__n"), "test").otherwise("train"))
    return null_safe_join(df.drop("split"), marked.select(*keys, "split"), keys)


def sample_polygons(df: DataFrame, keys: list[str], where: Column, n: int, seed: int) -> DataFrame:
    """Rows of at most ``n`` polygons that match; every other polygon is kept whole."""
    chosen = subsample(df.where(where).select(*keys).distinct(), keys, n, seed)
    return df.where(~where).unionByName(df.where(where).join(chosen, keys, "left_semi"))


# ------------------------------------------------------------------- budgets

def equal_fill(capacity: dict, budget: int, tiers: list[list]) -> dict:
    """Equal target per key, the unspent rest handed out tier by tier.

    Within a tier the rest is levelled: keys receive one each per round while they
    have room. Levelling is computed in whole rounds, so the cost does not depend on
    the budget.
    """
    if not capacity or budget <= 0:
        return dict.fromkeys(capacity, 0)
    target = budget // len(capacity)
    filled = {k: min(target, max(0, int(c))) for k, c in capacity.items()}
    left = budget - sum(filled.values())
    seen: set = set()
    for tier in [*tiers, [k for k in capacity if k not in {x for t in tiers for x in t}]]:
        open_keys = [k for k in tier if k in capacity and k not in seen and capacity[k] > filled[k]]
        seen.update(tier)
        while left > 0 and open_keys:
            rounds = min(min(capacity[k] - filled[k] for k in open_keys), left // len(open_keys))
            if rounds == 0:
                for k in open_keys[:left]:
                    filled[k] += 1
                return filled
            for k in open_keys:
                filled[k] += rounds
            left -= rounds * len(open_keys)
            open_keys = [k for k in open_keys if capacity[k] > filled[k]]
    return filled


def allocate(df: DataFrame, cell: list[str], budget: int, tiers_of, max_cells: int = 10_000) -> dict:
    """Budget per cell; cells are vocabulary x stratum, so their number is bounded."""
    counts = collect_bounded(df.groupBy(*cell).count(), max_cells, "budget cells")
    capacity = {tuple(r[c] for c in cell): r["count"] for r in counts}
    capacity = {k: capacity[k] for k in sorted(capacity, key=str)}
    return equal_fill(capacity, budget, tiers_of(list(capacity)))


def as_table(spark, quota: dict, cell: list[str], name: str, like: DataFrame) -> DataFrame:
    fields = [like.schema[c] for c in cell]
    from pyspark.sql import types as T
    schema = T.StructType([*fields, T.StructField(name, T.LongType())])
    return spark.createDataFrame([(*k, int(v)) for k, v in quota.items()], schema)


def flattest(df: DataFrame, cell: list[str], depth: str, key: str, share: float) -> DataFrame:
    """Flag the lowest ``round(share * n)`` rows of each cell by depth, at least one."""
    order = ranked(df, cell, [depth, key], "__rn")
    size = df.groupBy(*cell).agg(F.greatest(F.lit(1), F.rint(F.count(F.lit(1)) * F.lit(share))).cast("bigint").alias("__pool"))
    return null_safe_join(order, size, cell).withColumn("bland_pool", F.col("__rn") <= F.col("__pool")).drop("__rn", "__pool")


def take_quota(df: DataFrame, quota: DataFrame, keys: list[str], row_key: str, seed: int) -> DataFrame:
    """The first ``quota`` rows of each key in hash order."""
    hashed = df.withColumn("__h", hash_text(seed, row_key))
    order = ranked(hashed, keys, ["__h", row_key], "__rn")
    return null_safe_join(order, quota, keys).where(F.col("__rn") <= F.col("quota")).drop("__h", "__rn", "quota")


def sample_cells(df: DataFrame, cell: list[str], chart: str, key: str, depth: str, budget: int, seed: int,
                 tiers_of, bland_share: float = 0.35, bland_pool: float = 0.30) -> DataFrame:
    """Stratified sample: a budget per cell, a share of it from the flattest rows,
    spread over charts, each side backfilled from the other when it is short.

    ``key`` names a row. Cells, charts, keys and depths are ranked; the other columns join the rows that are taken."""
    spark = df.sparkSession
    flagged = cut_lineage(flattest(df.select(*dict.fromkeys([*cell, chart, key, depth])), cell, depth, key, bland_pool))
    groups = [*cell, "bland_pool", chart]
    counts = collect_bounded(flagged.groupBy(*groups).count(), 100_000, "sample groups")
    room: dict = {}
    for r in counts:
        room.setdefault(tuple(r[c] for c in cell), {False: {}, True: {}})[r["bland_pool"]][r[chart]] = r["count"]
    capacity = {k: sum(sum(side.values()) for side in room[k].values()) for k in sorted(room, key=str)}
    budgets = equal_fill(capacity, budget, tiers_of(list(capacity)))
    quota: dict = {}
    for k, n in budgets.items():
        flat, rest = sum(room[k][True].values()), sum(room[k][False].values())
        from_flat = min(round(bland_share * n), flat)
        from_rest = min(n - from_flat, rest)
        from_flat = min(n - from_rest, flat)
        for side, take in ((True, from_flat), (False, from_rest)):
            charts = sorted(room[k][side])
            share = equal_fill({c: room[k][side][c] for c in charts}, take, [charts]) if take else {}
            quota.update({(*k, side, c): q for c, q in share.items() if q})
    taken = take_quota(flagged, as_table(spark, quota, groups, "quota", flagged), groups, key, seed)
    return df.join(taken.select(key, "bland_pool"), key).select(*df.columns, "bland_pool")


# ----------------------------------------------------------- spatial thinning

def thin(df: DataFrame, tile: str, row: str, col: str, min_sep: int, per_tile: int, seed: int) -> DataFrame:
    """Points at least ``min_sep`` apart, at most ``per_tile`` per tile: the greedy set in hash order.

    In each round a point is kept if no undecided point closer than ``min_sep`` comes before it; it and the
    points closer than that are then decided. This gives the set a walk in hash order would keep, in rounds
    that grow with the logarithm of the points. Only points of the nine cells (of side ``min_sep``) around a
    cell's first point are compared. Rows that repeat a point share its fate.
    """
    order = [F.col("__h"), F.col(row), F.col(col)]
    undecided = cut_lineage(df.select(tile, row, col).distinct().withColumns({
        "__h": hash_text(seed, tile, row, col), "__i": F.floor(F.col(row) / min_sep), "__j": F.floor(F.col(col) / min_sep)}))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def around(points: DataFrame) -> DataFrame:
        """(point as __r, __c, __rh; undecided point closer than min_sep, itself included)."""
        spread = points.select(tile, F.col(row).alias("__r"), F.col(col).alias("__c"), F.col("__h").alias("__rh"), "__i", "__j", F.explode(steps).alias("s"))
        spread = spread.select(tile, "__r", "__c", "__rh", (F.col("__i") + F.col("s.a")).alias("__i"), (F.col("__j") + F.col("s.b")).alias("__j"))
        near = (F.pow(F.col(row) - F.col("__r"), 2) + F.pow(F.col(col) - F.col("__c"), 2)) < float(min_sep * min_sep)
        return undecided.join(spread, [tile, "__i", "__j"]).where(near)

    kept = None
    while not undecided.isEmpty():
        heads = first_per_group(undecided, [tile, "__i", "__j"], order, 1)
        before = F.struct("__h", row, col) < F.struct("__rh", "__r", "__c")
        beaten = around(heads).where(before).select(tile, F.col("__r").alias(row), F.col("__c").alias(col)).distinct()
        winners = cut_lineage(heads.join(beaten, [tile, row, col], "left_anti").select(*undecided.columns))
        kept = winners if kept is None else kept.unionByName(winners)
        undecided = cut_lineage(undecided.join(around(winners).select(tile, row, col), [tile, row, col], "left_anti").select(*undecided.columns))
    if kept is None:
        return df.limit(0)
    return df.join(first_per_group(kept, [tile], order, per_tile).select(tile, row, col), [tile, row, col], "left_semi").select(*df.columns)


# ------------------------------------------------------------------- triplets

def triplets(anchors: DataFrame, positives: DataFrame, hard: DataFrame, soft: DataFrame, key: str, k_hard: int,
             k_soft: int, seed: int) -> DataFrame:
    """(anchor, role, slot, partner): one positive that is not the anchor, ``k`` hard and
    soft negatives drawn with replacement. Pools get dense positions; a hash picks one."""
    out = None
    for role, pool, k in (("positive", positives, 1), ("hard", hard, k_hard), ("soft", soft, k_soft)):
        dense = numbered(pool.select(F.col(key).alias("partner")), ["partner"], "__at")
        size = dense.count()
        draw = F.conv(F.substring(hash_text(seed, key, F.lit(role), "slot"), 1, 12), 16, 10).cast("bigint")
        if role == "positive":
            own = dense.select(F.col("partner").alias(key), F.col("__at").alias("__own"))
            base = anchors.select(key).withColumn("slot", F.lit(0)).join(own, key, "left")
            at = F.when(F.col("__own").isNull(), F.pmod(draw, F.lit(size))).otherwise(
                F.pmod(F.col("__own") + 1 + F.pmod(draw, F.lit(max(size - 1, 1))), F.lit(size)))
        else:
            base = anchors.select(key).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            at = F.pmod(draw, F.lit(size))
        rows = base.withColumn("__at", at).join(dense, "__at").select(key, F.lit(role).alias("role"), "slot", "partner")
        out = rows if out is None else out.unionByName(rows)
    return out


def median_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_percentiles(df, keys, value, {name: 0.5}).drop("n")


def with_tier_rank(df: DataFrame, threshold: str, name: str = "confidence") -> DataFrame:
    """Distinct positive thresholds ranked from 1; zero is background and dropped."""
    kept = df.where(F.col(threshold) > 0)
    tiers = numbered(kept.select(threshold).distinct(), [threshold], name, 1)
    return kept.join(tiers, threshold)


def extra_positives(df: DataFrame, label: str, labels: list[str], weight: float) -> DataFrame:
    """Rows with a one-hot label vector and a constant weight."""
    return df.select("*", F.array(*[F.lit(1.0 if c == label else 0.0) for c in labels]).alias("label"),
                     F.lit(weight).alias("weight"))


def by_suspicion(df: DataFrame, depth: str, key: str) -> DataFrame:
    """Largest depth first, unknown depth last."""
    return df.orderBy(F.col(depth).desc_nulls_last(), F.col(key))


def queue(regions: DataFrame, decided: DataFrame, uid: str = "polygon_uid") -> DataFrame:
    """Undecided regions: strictest threshold first, larger area first, file order last."""
    open_rows = regions.join(decided.select(uid).distinct(), uid, "left_anti")
    return open_rows.orderBy(F.desc("threshold"), F.desc("area_m2"), F.asc("original_idx"))



"""Ranks, running totals and order statistics that never put one group in one task.

A plain window over a hot group sorts that whole group in one task. Here the rows
are range-partitioned on (group, order), so a hot group spreads over many tasks;
the totals of the earlier partitions are then added as an offset. The result is
exact for any distribution of groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage

GROUP_LIMIT = 1000  # Spark drops rows past this rank before the shuffle
LEVEL_BITS, MAX_LEVELS = 16, 3  # 48 of the 52 bits of a fraction
SORTED_ROWS = 1 << 20


def _name(i: int) -> str:
    return f"__k{i}"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL meets NULL; the right keys are dropped."""
    if not keys:  # the right side is a single summary row
        return with_scalars(left, right)
    renamed = right.select(*[F.col(k).alias(_name(i)) for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[_name(i)]) for i, k in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[_name(i) for i in range(len(keys))])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row summary, as one scalar subquery."""
    held = df.withColumn("__one", one_row.select(F.struct(*one_row.columns).alias("one")).scalar())
    return held.withColumns({c: F.col("__one")[c] for c in one_row.columns}).drop("__one")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, fan: int = 8) -> DataFrame:
    """First ``n`` rows of each group, exact.

    Up to GROUP_LIMIT Spark takes the first ``n`` of a group in each task before the only shuffle. Beyond it a tournament
    does: the rows of a group are dealt to ``fan`` x ``fan`` heats, the first ``n`` of each go on to ``fan`` heats and from
    there to the last one, so after the first round no task sees more than ``fan * n`` rows of a group.
    """
    if n > GROUP_LIMIT:
        content = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)]
        heat = F.pmod(F.xxhash64(*content) + F.spark_partition_id(), F.lit(fan * fan))
        df = _head(df.withColumn("__heat", heat), [*keys, "__heat"], order, n)
        df = _head(df.withColumn("__heat", F.col("__heat") % fan), [*keys, "__heat"], order, n).drop("__heat")
    return _head(df, keys, order, n)


def _head(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column],
                   descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Inclusive running sums per group along ``order``.

    ``(keys, order)`` must be unique per row: aggregate ties first. Without a partition
    count, adaptive execution merges small neighbouring ranges, which keeps the order.
    """
    inputs = {name: f"__in{i}" for i, name in enumerate(totals)}
    base = df.select("*", *[expr.alias(inputs[name]) for name, expr in totals.items()])
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    columns = [*[F.col(k).asc() for k in keys], *direction]
    spread = base.repartitionByRange(partitions, *columns) if partitions else base.repartitionByRange(*columns)
    ranged = cut_lineage(spread.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*keys, "__part")
               .agg(*[F.sum(c).alias(c) for c in inputs.values()])
               .select(*keys, "__part",
                       *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}o") for c in inputs.values()]))
    within = (Window.partitionBy(*keys, "__part").orderBy(*direction)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = null_safe_join(ranged, offsets, [*keys, "__part"])
    out = joined.select(*df.columns, *[(F.sum(c).over(within) + F.col(f"{c}o")).alias(name)
                                       for name, c in inputs.items()])
    return out


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank",
           descending: bool = False) -> DataFrame:
    """Row number per group along a unique order."""
    out = running_totals(df, keys, order, {name: F.lit(1)}, descending)
    return out.withColumn(name, F.col(name).cast("bigint"))


def _bucket(value: Column, depth: int) -> Column:
    """Number of the value's bucket at a depth, rising with the value within its bucket of the depth before.

    Depth 0 cuts every octave in 2^LEVEL_BITS even buckets, later ones cut a bucket again. Dividing by a power of two
    is exact, and a logarithm rounded to the wrong side of an octave gives the same number.
    """
    x = value.cast("double")
    size, steps = F.abs(x), float(1 << LEVEL_BITS)
    octave = F.floor(F.log2(size))
    scaled = size / F.pow(F.lit(2.0), octave) * steps
    at = (octave + 1100) * int(steps) + F.floor(scaled)
    for _ in range(depth):
        scaled = (scaled - F.floor(scaled)) * steps
        at = F.floor(scaled)
    largest = F.lit((1 << 62) if depth == 0 else 0)
    return F.when(size == 0, F.lit(0)).when(size == float("inf"), F.signum(x).cast("bigint") * largest).otherwise(F.signum(x).cast("bigint") * at).cast("bigint")


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Values at 0-based sorted positions; each pick is an expression over the count ``n``.

    Selection by refinement: rows are counted in buckets on the map side, only the buckets that hold a wanted position
    are kept, and one that holds several values is counted again in finer buckets. Once the kept buckets are small,
    their different values are numbered. No value is sorted or written before that. NULL and NaN values are left out.
    ``df`` is read once for each step; data of few different values need one step.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).alias("__v"))
    wanted, levels, found = None, [], []
    while True:
        rows = known.withColumns({level: _bucket(F.col("__v"), depth) for depth, level in enumerate(levels)})
        if wanted is not None:
            rows = null_safe_join(rows, wanted.where("__lo < __hi").select(*keys, *levels, "__before", "__size"), [*keys, *levels])
        last = wanted is not None and (size <= SORTED_ROWS or len(levels) == MAX_LEVELS)
        step = "__v" if last else f"__b{len(levels)}"
        held = F.max("__before") if wanted is not None else F.lit(0)
        rows = rows if last else rows.withColumn(step, _bucket(F.col("__v"), len(levels)))
        bounds = [F.col("__v").alias("__lo"), F.col("__v").alias("__hi")] if last else ["__lo", "__hi"]
        spread = [] if last else [F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
        counts = rows.groupBy(*keys, *levels, step).agg(
            F.count(F.lit(1)).alias("__c"), *spread, held.alias("__held"), *([F.max("__size").alias("__size")] if wanted is not None else []))
        whole = Window.partitionBy(*keys, *levels)
        cum = F.sum("__c").over(whole.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        total = F.col("__size") if wanted is not None else F.sum("__c").over(whole)
        counts = counts.withColumns({"__before": F.col("__held") + cum - F.col("__c"), "n": total})
        hits = [(pos >= F.col("__before")) & (pos < F.col("__before") + F.col("__c")) for pos in picks.values()]
        kept = counts.where(reduce(lambda a, b: a | b, hits)) if hits else counts
        kept = kept.select(*keys, *levels, *([] if last else [step]), *bounds, "__c", "__before", F.col("n").alias("__size"))
        if last:
            found.append(kept)
            break
        levels.append(step)
        wanted = cut_lineage(kept)
        found.append(wanted.where("__lo = __hi"))
        size = wanted.where("__lo < __hi").agg(F.max("__c")).first()[0]
        if size is None:
            break
    known_picks = reduce(DataFrame.unionByName, [f.select(*keys, "__lo", "__c", "__before", F.col("__size").alias("n")) for f in found])
    picked = [F.max(F.when((pos >= F.col("__before")) & (pos < F.col("__before") + F.col("__c")), F.col("__lo"))).alias(name) for name, pos in picks.items()]
    return known_picks.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group (the usual type 7 rule)."""
    picks: dict[str, Column] = {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        picks[f"{name}__lo"] = F.floor(at)
        picks[f"{name}__hi"] = F.ceil(at)
    stats = order_statistics(df, keys, value, picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"{name}__lo").cast("double"), F.col(f"{name}__hi").cast("double")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return stats.select(*keys, "n", *out)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive ids along a unique order over the whole table."""
    return ranked(df, [], order, name).withColumn(name, F.col(name) + F.lit(start - 1))

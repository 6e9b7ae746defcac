"""Append-only keyed tables: one folder a batch, the newest rows of a key taken at read, versions by compaction.

    path/batch-000000000007    rows of one batch; a replayed batch writes its own folder again
    path/version-000000000007  what batches 0 to 7 leave; its readers skip those batches

A batch touches no file of another one, so writing costs what the batch holds and a lost driver leaves either a whole
folder or one without its success marker, which nobody reads. A row with ``removed`` true is a tombstone: it beats older
rows of its key and is kept through compaction, so an older row that arrives later does not come back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import null_safe_join
from .sinks import exists

BATCH, REMOVED = "batch", "removed"


def append(rows: DataFrame, path: str, batch: int) -> None:
    """``rows`` as batch number ``batch`` of the table; appending the same batch again changes nothing."""
    held = rows if REMOVED in rows.columns else rows.withColumn(REMOVED, F.lit(False))
    held.withColumn(BATCH, F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch-{batch:012d}")


def _complete(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the whole batches and versions."""
    found: dict[str, list[int]] = {"batch": [], "version": []}
    if exists(spark, path):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        for status in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
            kind, _, number = status.getPath().getName().partition("-")
            if kind in found and number.isdigit() and exists(spark, f"{path}/{kind}-{number}/_SUCCESS"):
                found[kind].append(int(number))
    return found


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the last version and of the batches after it."""
    found = _complete(spark, path)
    start = max(found["version"], default=-1)
    names = [f"{path}/version-{start:012d}"] * (start >= 0) + [f"{path}/batch-{n:012d}" for n in sorted(found["batch"]) if n > start]
    if not names:
        raise FileNotFoundError(f"no complete batch under {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(n) for n in names])


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of each key that share its greatest (order, batch), tombstones included.

    The greatest is found with a map-side maximum; a key may have any number of rows.
    """
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, BATCH)).alias("__last"))
    return null_safe_join(rows, last, key).where(F.struct(*order, BATCH).eqNullSafe(F.col("__last"))).drop("__last")


def read(spark: SparkSession, path: str, key: list[str], order: list[str] = ()) -> DataFrame:
    """Current rows: of each key those of its greatest ``order`` (ties: the later batch), none where that is a tombstone."""
    return newest(rows_of(spark, path), key, list(order)).where(~F.col(REMOVED)).drop(REMOVED, BATCH)


def compact(spark: SparkSession, path: str, key: list[str], order: list[str] = ()) -> None:
    """Writes what all batches so far leave as a version; batches that arrive meanwhile stay after it."""
    found = _complete(spark, path)["batch"]
    if found:
        upto = max(found)
        newest(rows_of(spark, path).where(F.col(BATCH) <= upto), key, list(order)).write.mode("overwrite").parquet(f"{path}/version-{upto:012d}")

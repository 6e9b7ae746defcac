"""The decision ledger as a stream: progress, latest decisions, audits and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import masks as M
from ..operators.review import confirmed_rows
from ..operators.sampling import latest
from ..schema import DECISION_SCHEMA
from ..sources import log


def read_ledger(spark: SparkSession, folder: str, schema: T.StructType = DECISION_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """One CSV file per batch of decisions; each file is read once."""
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def read_table(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def progress(decisions: DataFrame) -> DataFrame:
    """Running totals per class; one state row per class."""
    return decisions.groupBy("predicted_class").agg(
        F.count(F.lit(1)).alias("n_decisions"), F.count_if(F.col("decision") == "confirm").alias("n_confirm"),
        F.sum(F.when(F.col("decision") == "confirm", F.col("n_pixels")).otherwise(0)).alias("pixels_confirmed"))


def first_seen(decisions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First event per uid; the watermark bounds the state."""
    return decisions.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["polygon_uid"])


def audit_counts(rows: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Running defect counts per tile."""
    flags = M.audit_flags(spectrum)
    bad = None
    for name in M.AUDIT_FAIL:
        bad = flags[name] if bad is None else bad | flags[name]
    return rows.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))


def merge_latest(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Appends the latest decision per uid of each batch to the log at ``path``; ``log.read`` takes the latest of all.

    A batch writes its own rows alone, in whatever order batches come, and replaying one leaves the log as it is.
    """
    def write(batch: DataFrame, number: int) -> None:
        log.append(latest(batch, "polygon_uid", order), path, number)
    return write


def skip_decided(decided: DataFrame, sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """Rows whose uid is not in the static table go to the sink."""
    def write(batch: DataFrame, _: int) -> None:
        sink(batch.join(decided.select("polygon_uid").distinct(), "polygon_uid", "left_anti"))
    return write


def upsert_confirmed(pixels: DataFrame, path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Pixel rows of confirmed polygons as a log keyed on ``polygon_uid``.

    A confirm appends the polygon's rows, any other decision a tombstone. The decision that is last by ``order`` counts,
    also when it arrives in an earlier batch than an older one.
    """
    def write(batch: DataFrame, number: int) -> None:
        last = latest(batch, "polygon_uid", order)
        rows = confirmed_rows(pixels, last.where("decision = 'confirm'")).join(last.select("polygon_uid", *order), "polygon_uid")
        gone = last.where("decision <> 'confirm'").select("polygon_uid", *order, F.lit(True).alias(log.REMOVED))
        log.append(rows.withColumn(log.REMOVED, F.lit(False)).unionByName(gone, allowMissingColumns=True), path, number)
    return write


def keep_totals(path: str) -> Callable[[DataFrame, int], None]:
    """Changed rows of a running result (update mode) appended to the log at ``path``; the last batch of a key holds its total."""
    return lambda changed, number: log.append(changed, path, number)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available, then stop."""
    return (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_totals(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running totals kept as a log in the shared folder; a restart from the checkpoint goes on where it stopped."""
    return run_batches(stream, keep_totals(path), checkpoint, "update")

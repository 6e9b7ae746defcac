"""Tables written by the engine: versioned replace, score and class layers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def publish(df: DataFrame, path: str) -> str:
    """Replace a table atomically: a new version folder counts once its success marker exists.

    Readers keep the old version until then; no file is renamed or overwritten.
    """
    last = latest_version(df.sparkSession, path)
    target = f"{path}/v{0 if last is None else last + 1:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def latest_version(spark: SparkSession, path: str) -> int | None:
    if not exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    done = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(done) if done else None


def current(spark: SparkSession, path: str) -> DataFrame:
    version = latest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no complete version under {path}")
    return spark.read.parquet(f"{path}/v{version:08d}")


def write_scores(df: DataFrame, path: str, channels: list[str], probs: str = "probs") -> None:
    """Score table with its channel order kept in the schema; a wrong width fails the job."""
    ok = F.assert_true(F.size(probs) == len(channels), F.lit(f"expected {len(channels)} channels"))
    typed = df.where(ok.isNull()).withColumn(probs, F.col(probs).cast("array<float>"))
    typed.withMetadata(probs, {"class_names": list(channels)}).write.mode("errorifexists").parquet(path)


def class_layers(df: DataFrame, channels: list[str], probs: str = "probs", valid: str = "valid") -> DataFrame:
    """One row per (pixel, class); invalid pixels carry NULL."""
    rest = [c for c in df.columns if c not in (probs, valid)]
    tall = df.select(*rest, valid, F.posexplode(probs).alias("i", "p"))
    name = F.element_at(F.array(*[F.lit(c) for c in channels]), F.col("i") + 1)
    return tall.select(*rest, name.alias("class"), F.when(F.col(valid), F.col("p")).alias("value"))


def write_layers(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_pool(patches: DataFrame, path: str, name: str) -> None:
    """Patches and metadata in one table, so they stay aligned row by row."""
    patches.withColumn("pool", F.lit(name)).write.mode("append").partitionBy("pool").parquet(path)

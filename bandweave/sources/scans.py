"""Projected, filtered scans of pixel, review, score and manifest tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import labels as L
from ..operators.curate import tagged, with_defaults
from ..schema import LABELS_RAW, MINERALS_RAW, check_channels

# ---- fixed values: must equal the reference's for right results ----
REGION_FILES = ["north_hellas"]
TILE_FILE = r"^(t\d+)_(mrral|mrrsu|mrrde)_?.*\.img$"
# ---- end of fixed values ----


def pixel_scan(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mineral rows, bland rows); columns and both filters reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df.select(*[c for c in columns if c in df.columns])
    minerals = df.where((F.col("other") <= 0.5) & L.any_mineral([c for c in MINERALS_RAW if c in df.columns]))
    return minerals, df.where(F.col("other") > 0.5)


def review_scan(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Many small files with drifting schemas; the session is read from the folder name."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    df = df.withColumn("review_session", L.session_of(F.col("_metadata.file_path")))
    present = [c for c in columns if c in df.columns]
    return with_defaults(df.select(*present, "review_session"), [c for c in LABELS_RAW if c in columns])


def tag_scan(spark: SparkSession, path: str, tag: str | None) -> DataFrame:
    return tagged(spark.read.option("mergeSchema", True).parquet(path), tag)


def reject_scan(spark: SparkSession, path: str, minerals: bool) -> DataFrame:
    """Untagged reject rows with a mineral, or bland ones without any."""
    rows = tag_scan(spark, path, None)
    hit = L.any_mineral(MINERALS_RAW)
    return rows.where(hit) if minerals else rows.where((F.col("other") > 0.5) & ~hit)


def optional_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A source that may be absent or empty: an empty table of the declared schema then."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def polygon_rows(corpus: DataFrame, cls: str, source: str, tile_id: str, polygon_id) -> DataFrame:
    return corpus.where((F.col("class") == cls) & (F.col("source") == source) & (F.col("tile_id") == tile_id) & (F.col("polygon_id") == polygon_id))


def is_region_file(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(name).startswith(p) for p in REGION_FILES])


def tile_pairs(files: DataFrame, product: str, path: str = "path") -> DataFrame:
    """(tile_id, polygons, raster): polygon files without a raster drop out, the first raster path wins."""
    base = F.element_at(F.split(path, "/"), -1)
    named = files.select(F.col(path), base.alias("name"))
    polygons = named.where(F.col("name").endswith(".gpkg") & ~is_region_file(F.col("name"))).select(
        F.lower(F.regexp_replace("name", r"\.gpkg$", "")).alias("tile_id"), F.col(path).alias("polygons"))
    rasters = (named.where(F.regexp_extract("name", TILE_FILE, 2) == product)
               .groupBy(F.regexp_extract("name", TILE_FILE, 1).alias("tile_id")).agg(F.min(path).alias("raster"), F.count(F.lit(1)).alias("n_rasters")))
    return polygons.join(rasters, "tile_id")


def tile_products(files: DataFrame, need: list[str], path: str = "path") -> DataFrame:
    """One row per tile with the first path of each needed product; incomplete tiles drop out."""
    base = F.element_at(F.split(path, "/"), -1)
    named = files.select(F.col(path), F.regexp_extract(base, TILE_FILE, 1).alias("tile_id"), F.regexp_extract(base, TILE_FILE, 2).alias("product"))
    wide = named.where(F.col("product") != "").groupBy("tile_id").pivot("product", need).agg(F.min(path))
    return wide.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in need]))


def sibling_path(path, old: str, new: str) -> Column:
    """Path of the co-registered product."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, f"_{old}_", f"_{new}_")


def observation_pairs(files: DataFrame, pattern: str, kinds: list[str], path: str = "path") -> DataFrame:
    """(observation, first path per kind) for observations that have every kind.

    ``pattern`` has two groups: the observation id and the kind.
    """
    named = files.select(F.col(path), F.lower(F.regexp_extract(path, pattern, 1)).alias("obsid"), F.lower(F.regexp_extract(path, pattern, 2)).alias("kind"))
    wide = named.where(F.col("obsid") != "").groupBy("obsid").pivot("kind", kinds).agg(F.min(path))
    return wide.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in kinds]))


def roi_rows(sheet_rows: DataFrame, position: str = "line", include_low: bool = False) -> DataFrame:
    """Region of interest rows of exported sheets: blanks filled downward per sheet,
    non-numeric pixels and excluded or low-confidence rows dropped, duplicates once.

    A sheet is a spreadsheet page, so the fill window is small.
    """
    down = Window.partitionBy("sheet").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.trim(c))
    filled = sheet_rows.withColumns({"region": F.last(blank("region"), ignorenulls=True).over(down),
                                     "obsid": F.last(blank("obsid"), ignorenulls=True).over(down)})
    rows = filled.withColumns({"x": F.col("x").try_cast("double").cast("int"), "y": F.col("y").try_cast("double").cast("int"),
                               "obsid": F.lower(F.regexp_replace("obsid", r"\s+", ""))})
    kept = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("obsid").isNotNull() & ~F.coalesce(F.col("excluded"), F.lit(False)))
    if not include_low:
        kept = kept.where(F.lower(F.coalesce("confidence", F.lit(""))) != "low")
    return kept.dropDuplicates(["obsid", "x", "y"])


def polygon_attributes(df: DataFrame, min_len: int = 59) -> DataFrame:
    """Attribute rows with parsed minerals, tier and spectrum; short spectra drop out."""
    parsed = df.withColumns({"minerals": L.keyword_minerals("Category"), "confidence_tier": L.named_tier("Category"),
                             "spectrum": L.parse_numbers("spectrum_text")})
    return parsed.where(F.size("spectrum") >= min_len).withColumn("spectrum", F.slice("spectrum", 1, min_len)).drop("spectrum_text")


def candidate_scan(regions: DataFrame, strata=L.STRATA) -> DataFrame:
    """Regions whose mean score lies in the stratum that starts at their own layer threshold."""
    lows = F.array(*[F.lit(a) for a, _ in strata])
    s = L.stratum("mean_prob")
    own = regions.withColumn("stratum", s).where(s.isNotNull())
    own = own.where(F.abs(F.element_at(lows, F.col("stratum") + 1) - F.col("threshold")) < 1e-12)
    return own.withColumn("cand_key", F.concat_ws("::", "mc", "mineral", "tile_id", F.col("region_id").cast("string")))


def score_scan(spark: SparkSession, path: str, expected: list[str]) -> DataFrame:
    """Score table whose stored channel order equals the expected one."""
    df = spark.read.parquet(path)
    check_channels(df.schema["probs"].metadata.get("class_names"), expected)
    return df


def merge_layers(layers: list[DataFrame], columns: list[str]) -> DataFrame:
    """Per-tile layers in one table, preferred columns first, tile id from the file name when absent."""
    full = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
    tile = F.coalesce(F.col("tile_id"), F.regexp_extract(F.col("source_file"), r"(t\d+)", 1)) if "source_file" in full.columns else F.col("tile_id")
    full = full.withColumn("tile_id", tile)
    first = [c for c in columns if c in full.columns]
    return full.select(*first, *[c for c in full.columns if c not in first])


def replace_tiles(base: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows of rebuilt tiles replace the old ones; new rows train only."""
    fresh = rebuilt.withColumn("split", F.lit("train"))
    return base.join(rebuilt.select("tile_id").distinct(), "tile_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def minimal_label_rows(rows: DataFrame, spectra: DataFrame, key: str, label: str, weight: float, tier: str, provenance: str) -> DataFrame:
    """Rows of one label with fixed weight and tier; a row without a spectrum fails the job."""
    j = rows.join(spectra, key, "left")
    ok = F.assert_true(F.col("spectrum").isNotNull(), F.concat(F.lit("no spectrum for "), F.col(key).cast("string")))
    return j.where(ok.isNull()).withColumns({**{c: F.lit(1.0 if c == label else 0.0) for c in LABELS_RAW},
                                             "confidence_weight": F.lit(weight), "confidence_tier": F.lit(tier), "provenance": F.lit(provenance)})

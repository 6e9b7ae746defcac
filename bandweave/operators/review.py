"""Decision ledger, confirmed and rejected pixel tables, queues and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..functions.keys import canonical_layer, id_from_uid, uid
from ..schema import DECISION_COLUMNS, LABELS_RAW
from .ranking import ranked


def progress(latest: DataFrame, target_pixels: int) -> DataFrame:
    """Confirmed pixels, decisions by kind and whether the pixel target is reached, per class."""
    confirmed = F.sum(F.when(F.col("decision") == "confirm", F.col("n_pixels")).otherwise(0))
    counts = [F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("confirm", "reject", "skip")]
    out = latest.groupBy("predicted_class").agg(confirmed.alias("pixels_confirmed"), *counts)
    return out.withColumns({"fraction": F.least(F.col("pixels_confirmed") / float(target_pixels), F.lit(1.0)),
                            "target_reached": F.col("pixels_confirmed") >= target_pixels})


def migrate_ledger(df: DataFrame) -> DataFrame:
    """Ledger rows in the canonical columns; columns an older file lacks are ''."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in DECISION_COLUMNS])


def append_decisions(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    return migrate_ledger(ledger).unionByName(migrate_ledger(rows), allowMissingColumns=True)


def uids_seen(ledger: DataFrame) -> DataFrame:
    if "polygon_uid" not in ledger.columns:
        return ledger.sparkSession.createDataFrame([], "polygon_uid string")
    return ledger.select(F.col("polygon_uid").cast("string")).distinct()


def confirmed_rows(pixels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pixel rows of confirmed polygons with all named classes positive."""
    d = decisions.select("polygon_uid", "confidence", F.concat(F.array("label_class"), F.coalesce("extra_classes", F.array())).alias("__c"))
    return _stamped(pixels.join(d, "polygon_uid"), L.multi_hot("__c"), L.review_weight("confidence"),
                    F.concat(F.lit("Reviewed-"), F.col("confidence"))).drop("__c", "confidence")


def rejected_rows(pixels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pixel rows of rejected polygons.

    No correction: all labels 0, tagged with the predicted class, full weight.
    Mineral correction: its labels, empty tag. Any other correction: a tag.
    """
    d = decisions.select("polygon_uid", "predicted_class", "corrected_class", "confidence", "extra_classes")
    j = pixels.join(d, "polygon_uid")
    fixed = F.coalesce(F.col("corrected_class"), F.lit("")) != ""
    mineral = fixed & L.is_mineral_class("corrected_class")
    named = F.when(mineral, F.concat(F.array("corrected_class"), F.coalesce("extra_classes", F.array()))).otherwise(F.array().cast("array<string>"))
    tag = F.when(~fixed, F.col("predicted_class")).when(mineral, F.lit("")).otherwise(F.col("corrected_class"))
    out = _stamped(j.withColumn("__c", named), L.multi_hot("__c"), F.when(fixed, L.review_weight("confidence")).otherwise(1.0),
                   F.when(fixed, F.concat(F.lit("Reviewed-"), F.col("confidence"))).otherwise("High"))
    return out.withColumn("negative_of", tag).drop("__c", "confidence", "predicted_class", "corrected_class", "extra_classes")


def _stamped(df: DataFrame, labels: dict, weight, tier) -> DataFrame:
    return df.withColumns({**{c: labels[c] for c in LABELS_RAW}, "confidence_weight": weight, "confidence_tier": tier,
                           "polygon_id": id_from_uid("polygon_uid"), "split": F.lit("train")})


def upsert(table: DataFrame, rows: DataFrame, key: str = "polygon_id") -> DataFrame:
    """New rows replace every earlier row of the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def drop_keys(table: DataFrame, keys: DataFrame, key: str = "polygon_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def relabel_polygons(selection: DataFrame, corpus: DataFrame, new_label: str, confidence: str) -> tuple[DataFrame, DataFrame]:
    """(decision rows, pixel rows) for relabelling whole polygons of the corpus."""
    keys = ["class", "source", "tile_id", "polygon_id"]
    picked = corpus.join(selection.select(*keys).distinct(), keys, "left_semi").withColumn("polygon_uid", uid(*keys))
    decisions = picked.groupBy("polygon_uid", "tile_id", "class").agg(F.count(F.lit(1)).alias("n_pixels"))
    decisions = decisions.select("polygon_uid", "tile_id", F.col("class").alias("predicted_class"), F.lit("reject").alias("decision"),
                                 F.lit(new_label).alias("corrected_class"), "n_pixels", F.lit(confidence).alias("confidence"),
                                 F.lit(None).cast("array<string>").alias("extra_classes"))
    pixels = picked.select("polygon_uid", "tile_id", "pixel_row", "pixel_col", "spectrum")
    return decisions, rejected_rows(pixels, decisions)


def review_manifest(selected: DataFrame, lows: list[float]) -> DataFrame:
    """Stable position uid per (mineral, stratum), ordered by tile then source uid."""
    order = ranked(selected, ["mineral", "stratum"], ["tile_id", "source_uid"], "position")
    low = F.element_at(F.array(*[F.lit(x) for x in lows]), F.col("stratum") + 1)
    rank = F.format_string("%02d", F.lit(len(lows)) - F.col("stratum"))
    token = canonical_layer(low)
    return order.withColumns({"position": F.col("position") - 1}).withColumns({
        "review_uid": uid("tile_id", token, "position"), "layer": F.concat(F.lit("thresh_"), rank, F.substr(token, F.lit(7)))})


def with_verdicts(regions: DataFrame, verdicts: DataFrame, key: str = "poly_id") -> DataFrame:
    """Verdict columns ensured on every region."""
    return regions.join(verdicts.select(key, "verdict", "confidence", "note"), key, "left")

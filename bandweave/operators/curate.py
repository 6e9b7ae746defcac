"""Source policies, class stamping and the assembled corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..schema import CORPUS_CLASSES, LABELS_RAW, MINERALS_RAW, PIXEL_KEY, SOURCE_RANK, require
from .joins import precedence_dedupe, supersede, suppress
from .sampling import cap_per_group, subsample

# fixed values: mafic labels zeroed by the hand policy, and artifact polygons
MAFIC = ["olivine_t1", "olivine_t2", "lcp", "hcp"]
EXCLUDED_POLYGONS = [("t0638", 949), ("t0636", 823), ("t0566", 958), ("t0636", 769), ("t0638", 852)]


def with_defaults(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Numeric columns present and not NULL."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) if c in df.columns else F.lit(value)
                           for c in columns})


def align(df: DataFrame, template: DataFrame) -> DataFrame:
    """Columns of the template in its order; missing ones get 0 or '' by type."""
    out = []
    for field in template.schema.fields:
        blank = F.lit("") if field.dataType.typeName() == "string" else F.lit(0).cast(field.dataType)
        if field.dataType.typeName() in ("array", "struct", "map"):
            blank = F.lit(None).cast(field.dataType)
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else blank
        out.append(F.coalesce(value, blank).alias(field.name))
    return df.select(*out)


def union_aligned(template: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [align(o, template) for o in others], template)


def stamp_classes(df: DataFrame, bland: float = 0.0, junk: float = 0.0, alteration: float | None = None,
                  zero_plag: bool = True) -> DataFrame:
    """Set the class columns of a source; 'other' mirrors 'bland'."""
    have = set(df.columns)
    plag = F.lit(0.0) if zero_plag or "plagioclase" not in have else F.col("plagioclase")
    if alteration is not None:
        alt = F.lit(float(alteration))
    else:
        alt = F.coalesce(F.col("alteration"), F.lit(0.0)) if "alteration" in have else F.lit(0.0)
    return df.withColumns({"bland": F.lit(float(bland)), "junk": F.lit(float(junk)), "plagioclase": plag,
                           "alteration": alt, "other": F.lit(float(bland))})


def hand_policy(df: DataFrame, policy: str) -> DataFrame:
    """'all' keeps hand rows, 'none' drops them, 'plag_only' keeps plagioclase without mafic labels."""
    if policy == "all":
        return df
    if policy == "none":
        return df.where(F.lit(False))
    if policy == "plag_only":
        return df.where(F.col("plagioclase") > 0.5).withColumns({c: F.lit(0.0) for c in MAFIC})
    raise ValueError(f"unknown hand policy {policy!r}")


def review_grades(df: DataFrame, grades: list[str]) -> DataFrame:
    """Graded sessions keep the named grades; legacy rows were never graded and pass."""
    require(df, "review_session")
    return df.where((F.col("review_session") != "v3") | F.col("confidence_tier").isin([f"Reviewed-{g}" for g in grades]))


def legacy_policy(df: DataFrame, target: str, admitted: list[str], confirm_cap: int, seed: int,
                  row_key: list[str], is_confirm: bool = False) -> DataFrame:
    """Legacy rows only for admitted classes; legacy confirms are capped per polygon."""
    require(df, "review_session")
    legacy = F.col("review_session") == "legacy"
    if target not in admitted:
        return df.where(~legacy)
    if not is_confirm:
        return df
    capped = cap_per_group(df.where(legacy), ["tile_id", "polygon_id"], row_key, confirm_cap, seed)
    return df.where(~legacy).unionByName(capped)


def stamp_legacy_tier(df: DataFrame) -> DataFrame:
    if "review_session" not in df.columns:
        return df
    return df.withColumn("confidence_tier", F.when(F.col("review_session") == "legacy", "Reviewed-Legacy")
                         .otherwise(F.col("confidence_tier")))


def tagged(df: DataFrame, tag: str | None) -> DataFrame:
    """Rows of one tag; None means the untagged reject pool."""
    c = F.col("negative_of")
    return df.where(c.isNull() | (c == "")) if tag is None else df.where(c == tag)


def bland_review(df: DataFrame, mc13: bool, n: int, seed: int, row_key: list[str],
                 per_polygon: int | None = None) -> DataFrame:
    """Reject pool of one region without mineral reassignments, capped, subsampled, stamped bland."""
    region = L.in_mc13("tile_id") if mc13 else ~L.in_mc13("tile_id")
    rows = tagged(df, None).where(region).where(~L.any_mineral(MINERALS_RAW, 0.0))
    capped = cap_per_group(rows, ["tile_id", "polygon_id"], row_key, per_polygon, seed)
    chosen = subsample(capped, row_key, n, seed + 1)
    return L.confidence_defaults(stamp_classes(chosen, bland=1.0, alteration=0.0))


def reassigned(df: DataFrame, row_key: list[str], seed: int, per_polygon: int | None = None) -> DataFrame:
    rows = tagged(df, None).where(L.any_mineral(MINERALS_RAW, 0.0))
    capped = cap_per_group(rows, ["tile_id", "polygon_id"], row_key, per_polygon, seed)
    return L.confidence_defaults(stamp_classes(capped, zero_plag=False))


def ambiguous(df: DataFrame, row_key: list[str], seed: int, per_polygon: int | None = None) -> DataFrame:
    capped = cap_per_group(tagged(df, "ambiguous"), ["tile_id", "polygon_id"], row_key, per_polygon, seed)
    return L.confidence_defaults(stamp_classes(capped, junk=1.0, alteration=0.0))


def altered(df: DataFrame) -> DataFrame:
    return L.confidence_defaults(stamp_classes(tagged(df, "alteration"), alteration=1.0))


# ------------------------------------------------------------------ the corpus

CORPUS = ["class", "source", "tile_id", "polygon_id", "confidence_weight", "multi", "pixel_row", "pixel_col", "spectrum"]


def explode_classes(df: DataFrame, source: str) -> DataFrame:
    """One row per (pixel, positive class); ``multi`` marks co-occurrence."""
    df = with_defaults(df, [*MINERALS_RAW, "alteration"])
    flags = {"olivine": (F.col("olivine_t1") > 0.5) | (F.col("olivine_t2") > 0.5),
             **{c: F.col(c) > 0.5 for c in CORPUS_CLASSES[1:]}}
    named = df.withColumn("__classes", F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()])))
    weight = F.coalesce(F.col("confidence_weight").cast("double"), F.lit(1.0)) if "confidence_weight" in df.columns else F.lit(1.0)
    return (named.withColumns({"multi": F.size("__classes") > 1, "source": F.lit(source), "confidence_weight": weight})
            .withColumn("class", F.explode("__classes")).select(*CORPUS))


def fixed_class(df: DataFrame, name: str, source: str, weight: float | None = None) -> DataFrame:
    """One row per pixel under a fixed class, with the stamped or a forced weight."""
    w = F.lit(weight) if weight is not None else F.coalesce(F.col("confidence_weight").cast("double"), F.lit(1.0))
    return df.withColumns({"class": F.lit(name), "source": F.lit(source), "confidence_weight": w,
                           "multi": F.lit(False)}).select(*CORPUS)


def hand_rows(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mineral rows, bland rows) of the hand table; both carry full weight, alteration is not read."""
    base = with_defaults(pixels.drop("alteration"), MINERALS_RAW).withColumn("confidence_weight", F.lit(1.0))
    minerals = base.where((F.col("other") <= 0.5) & L.any_mineral(MINERALS_RAW))
    return minerals, base.where(F.col("other") > 0.5)


def relabel_positives(session: DataFrame) -> DataFrame:
    """Positive rows of an interactive session; discards only suppress."""
    neg = F.coalesce(F.col("negative_of"), F.lit(""))
    s = session.withColumn("negative_of", neg)
    free, mineral = F.col("negative_of") == "", L.any_mineral(MINERALS_RAW)
    return (explode_classes(s.where(free & mineral), "ndviz")
            .unionByName(fixed_class(s.where(free & ~mineral & (F.col("other") > 0.5)), "bland_reject", "ndviz"))
            .unionByName(fixed_class(s.where(F.col("negative_of") == "alteration"), "alteration", "ndviz"))
            .unionByName(fixed_class(s.where(F.col("negative_of") == "ambiguous"), "junk", "ndviz")))


def source_rank():
    return L.lookup(F.col("source"), SOURCE_RANK, 99)


def dedupe_corpus(df: DataFrame) -> DataFrame:
    """One row per (pixel, class): the best source, then a fixed order of polygon and weight."""
    return precedence_dedupe(df, [*PIXEL_KEY, "class"], source_rank(), ["polygon_id", "confidence_weight"])


def assemble(hand: DataFrame, confirmed: DataFrame, rejects: DataFrame, session: DataFrame | None = None,
             include_bland: bool = True) -> DataFrame:
    """Full labelled-spectra corpus from all sources."""
    minerals, bland = hand_rows(hand)
    pool = tagged(rejects, None)
    mineral = L.any_mineral(MINERALS_RAW)
    parts = [explode_classes(minerals, "hand")]
    if include_bland:
        parts.append(fixed_class(bland, "bland_dust", "hand", 1.0))
    parts += [explode_classes(confirmed, "confirmed"),
              explode_classes(pool.where(mineral), "reassigned"),
              fixed_class(tagged(rejects, "alteration"), "alteration", "tag"),
              fixed_class(tagged(rejects, "ambiguous"), "junk", "tag"),
              fixed_class(pool.where((F.col("other") > 0.5) & ~mineral), "bland_reject", "reassigned")]
    combined = reduce(lambda a, b: a.unionByName(b), parts)
    if session is not None:
        combined = suppress(combined, session).unionByName(relabel_positives(session))
    return dedupe_corpus(combined)


def reviewed_over_base(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviewed row wins over the existing row of the same pixel."""
    return supersede(base, align(reviewed, base), list(PIXEL_KEY))


def session_positives(session: DataFrame) -> DataFrame:
    """Review-format session rows as stamped class rows for the training table."""
    neg = F.coalesce(F.col("negative_of"), F.lit(""))
    s = session.withColumn("negative_of", neg)
    free, mineral = F.col("negative_of") == "", L.any_mineral(MINERALS_RAW)
    parts = [stamp_classes(s.where(free & mineral), zero_plag=False),
             stamp_classes(s.where(free & ~mineral & (F.col("other") > 0.5)), bland=1.0, alteration=0.0),
             stamp_classes(s.where(F.col("negative_of") == "alteration"), alteration=1.0),
             stamp_classes(s.where(F.col("negative_of") == "ambiguous"), junk=1.0, alteration=0.0)]
    return L.confidence_defaults(reduce(lambda a, b: a.unionByName(b), parts))


def apply_session(base: DataFrame, session: DataFrame) -> DataFrame:
    """Suppress every touched pixel, then append the session's own positives."""
    return union_aligned(suppress(base, session), session_positives(session))


def seven_class_base(pixels: DataFrame, n_bland: int, row_key: list[str], seed: int, policy: str = "all",
                     bland_sources: str = "all") -> DataFrame:
    """Hand rows under the policy plus a bland subsample."""
    spark = pixels.sparkSession
    listed = spark.createDataFrame(EXCLUDED_POLYGONS, "tile_id string, polygon_id bigint")
    kept = pixels.join(listed, ["tile_id", "polygon_id"], "left_anti")
    hand = hand_policy(stamp_classes(kept.where(F.col("other") <= 0), zero_plag=False), policy)
    if bland_sources == "review":
        return hand
    bland = stamp_classes(subsample(kept.where(F.col("other") > 0), row_key, n_bland, seed), bland=1.0, alteration=0.0)
    return hand.unionByName(bland)


def seven_class_table(pixels: DataFrame, confirmed: DataFrame, rejects: DataFrame, session: DataFrame | None, n_bland: int,
                      row_key: list[str], seed: int, grades: list[str], admitted: list[str], confirm_cap: int,
                      policy: str = "all", bland_sources: str = "all",
                      per_polygon: int | None = None) -> DataFrame:
    """The whole 7-class table from hand, confirmed and rejected pixels, before its joint split.

    Review sources pass the grade bar and the legacy admission of their class while they still carry
    ``review_session``, are aligned to the hand columns, and give way to the pixels of the session.
    ``build_source`` names where a row came from.
    """
    base = seven_class_base(pixels, n_bland, row_key, seed, policy, bland_sources).withColumn("build_source", F.lit("base"))
    loaded = {"confirmed": ("lcp", L.confidence_defaults(stamp_classes(confirmed, zero_plag=False))),
              "reassigned": ("lcp", reassigned(rejects, row_key, seed, per_polygon)),
              "mc13_bland": ("bland", bland_review(rejects, True, n_bland, seed + 10, row_key, per_polygon)),
              "mc11_bland": ("bland", bland_review(rejects, False, n_bland, seed + 20, row_key, per_polygon)),
              "junk": ("junk", ambiguous(rejects, row_key, seed, per_polygon)),
              "alteration": ("alteration", altered(rejects))}
    parts = []
    for name, (target, rows) in loaded.items():
        kept = legacy_policy(review_grades(rows, grades), target, admitted, confirm_cap, seed, row_key, is_confirm=name == "confirmed")
        parts.append(stamp_legacy_tier(kept).withColumn("build_source", F.lit(name)))
    combined = union_aligned(base, *parts)
    if session is None:
        return combined
    return apply_session(combined, session.withColumn("build_source", F.lit("session")))


def review_augmented(existing: DataFrame, review: DataFrame, ambiguous_rows: DataFrame, alteration: DataFrame, weight: float,
                     tier: str, holdout: float, seed: int) -> DataFrame:
    """Existing, review, ambiguous and alteration rows in the existing columns; a reviewed pixel replaces the existing one.

    Missing numbers become 0. Alteration rows are positives with the review's weight and tier, and whole
    polygons of them are held out.
    """
    from .sampling import hold_out_polygons
    positive = alteration.withColumns({"alteration": F.lit(1.0), "confidence_weight": F.lit(weight), "confidence_tier": F.lit(tier)})
    positive = hold_out_polygons(positive, ["polygon_id"], holdout, seed) if holdout > 0 else positive.withColumn("split", F.lit("train"))
    kept = suppress(existing, review)
    return union_aligned(kept, review, ambiguous_rows, positive)


def negatives_like(mined: DataFrame, target: DataFrame, tier: str, weight: float, first_id: int) -> DataFrame:
    """Mined pixels in the target's schema: bands renamed by index, labels 0, bland 1,
    one synthetic polygon per tile in tile order."""
    from ..schema import bland_column, is_band, rename_bands
    from .ranking import numbered
    bands = rename_bands(mined.columns, target.columns)
    bland = bland_column(target.columns)
    ids = numbered(mined.select("tile_id").distinct(), ["tile_id"], "__polygon", first_id)
    joined = mined.join(ids, "tile_id")
    out = []
    for f in target.schema.fields:
        if is_band(f.name):
            value = F.col(bands[f.name])
        elif f.name in PIXEL_KEY:
            value = F.col(f.name)
        elif f.name == "polygon_id":
            value = F.col("__polygon")
        elif f.name in (bland, "bland", "other"):
            value = F.lit(1.0)
        elif f.name == "confidence_tier":
            value = F.lit(tier)
        elif f.name == "confidence_weight":
            value = F.lit(weight)
        elif f.name in LABELS_RAW or f.name == "junk":
            value = F.lit(0.0)
        else:
            value = F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(*out)



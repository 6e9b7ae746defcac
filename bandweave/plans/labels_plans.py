"""Label algebra, masks and projections on the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import keys, labels as L, masks as M
from .registry import query
from .tables import PIXELS, POLYGONS, SPECTRA, cte, derive, load

POLY = cte(p=POLYGONS)
PIX = cte(p=PIXELS)
SPEC = cte(p=SPECTRA)

# A spectrum with planted defects: sentinel, over-range, NaN and zero bands by position.
DEFECT_SQL = ("SELECT vec_id, i AS band, CASE WHEN (vec_id + i) % 97 = 0 THEN 65535e0 WHEN (vec_id + i) % 89 = 0 THEN 15e-1 "
              "WHEN (vec_id * 3 + i) % 83 = 0 THEN CAST('nan' AS DOUBLE) WHEN vec_id % 10 = 0 AND i > 60 THEN 0e0 "
              "WHEN vec_id % 9 = 0 AND i BETWEEN 20 AND 26 THEN 0e0 ELSE CAST(v AS DOUBLE) END AS v "
              "FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) q")


def defects(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    v = F.col("vec_id")

    def plant(x, i0):
        i = i0 + 1
        return (F.when((v + i) % 97 == 0, 65535.0).when((v + i) % 89 == 0, 1.5)
                .when((v * 3 + i) % 83 == 0, F.lit(float("nan")))
                .when((v % 10 == 0) & (i > 60), 0.0)
                .when((v % 9 == 0) & i.between(20, 26), 0.0).otherwise(x.cast("double")))

    return e.select("vec_id", "label", F.concat(F.lit("t"), (v % 8).cast("string")).alias("tile_id"),
                    F.transform("embedding", plant).alias("spectrum"))


BAD = "(isnan(v) OR v = 65535 OR v > 1)"


@query("sanitize_spectra", f"""
WITH d AS ({DEFECT_SQL})
SELECT vec_id, CAST(sum(CASE WHEN {BAD} THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
       round(sum(CASE WHEN {BAD} THEN 0e0 ELSE least(greatest(v, 0e0), 5e-1) END), 6) AS total,
       round(max(CASE WHEN {BAD} THEN 0e0 ELSE least(greatest(v, 0e0), 5e-1) END), 6) AS top
FROM d GROUP BY vec_id""")
def sanitize_spectra(spark, sf_dir):
    d = defects(spark, sf_dir).withColumn("clean", M.sanitize("spectrum"))
    return d.select("vec_id", M.bad_count("spectrum").cast("bigint").alias("n_bad"),
                    F.round(F.aggregate("clean", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
                    F.round(F.array_max("clean"), 6).alias("top"))


@query("drop_nodata_pixels", f"""
WITH d AS ({DEFECT_SQL})
SELECT vec_id, round(sum(CASE WHEN isnan(v) THEN 0e0 ELSE v END), 6) AS total
FROM d GROUP BY vec_id HAVING count(CASE WHEN NOT isnan(v) AND v >= 65535 THEN 1 END) = 0""")
def drop_nodata_pixels(spark, sf_dir):
    d = defects(spark, sf_dir).where(~M.has_sentinel("spectrum")).withColumn("s", M.nan_to_zero("spectrum"))
    return d.select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("tile_valid_mask", f"""
WITH d AS ({DEFECT_SQL})
SELECT vec_id, count(CASE WHEN isnan(v) OR v = 65535 THEN 1 END) = 0 AND count(CASE WHEN v <> 0 THEN 1 END) > 0 AS valid
FROM d GROUP BY vec_id""")
def tile_valid_mask(spark, sf_dir):
    return defects(spark, sf_dir).select("vec_id", M.tile_valid("spectrum").alias("valid"))


@query("bounded_rows", f"""
WITH d AS ({DEFECT_SQL})
SELECT vec_id FROM d GROUP BY vec_id HAVING count(CASE WHEN isnan(v) OR abs(v) >= 1e4 THEN 1 END) = 0""")
def bounded_rows(spark, sf_dir):
    return defects(spark, sf_dir).where(M.rows_bounded("spectrum")).select("vec_id")


@query("physical_range", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_quantity / 5e1 BETWEEN 5e-1 AND 1e0 THEN l_quantity / 5e1 END AS rpeak1,
       CASE WHEN l_extendedprice / 1e5 - 5e-1 BETWEEN -5e-1 AND 5e-1 THEN l_extendedprice / 1e5 - 5e-1 END AS bd1300
FROM lineitem""")
def physical_range(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        M.physical(F.col("l_quantity") / 50.0, "RPEAK1").alias("rpeak1"),
        M.physical(F.col("l_extendedprice") / 1e5 - 0.5, "BD1300").alias("bd1300"))


AUDIT_SQL = f"""
WITH d AS ({DEFECT_SQL}), z AS (SELECT *, v = 0 AS zero FROM d),
runs AS (SELECT vec_id, band, zero, band - row_number() OVER (PARTITION BY vec_id, zero ORDER BY band) AS g FROM z),
longest AS (SELECT vec_id, max(n) AS run FROM (SELECT vec_id, g, count(*) AS n FROM runs WHERE zero GROUP BY vec_id, g) q GROUP BY vec_id),
tail AS (SELECT vec_id, 64 - coalesce(max(CASE WHEN NOT zero THEN band END), 0) AS n FROM z GROUP BY vec_id),
f AS (SELECT vec_id, bool_and(zero) AS all_zero, bool_or(v = 65535) AS nodata, bool_or(isnan(v)) AS nonfinite,
             bool_or(band > 1 AND NOT isnan(v) AND v > 1) AS over_phys,
             max(CASE WHEN NOT isnan(v) THEN v END) = min(CASE WHEN NOT isnan(v) THEN v END) AS flat,
             bool_or(band = 1 AND NOT isnan(v) AND v > 1) AS blue_edge FROM z GROUP BY vec_id)
SELECT f.vec_id, tail.n >= 3 AS zero_tail, coalesce(longest.run, 0) >= 5 AS zero_run, all_zero, nodata, nonfinite, over_phys, flat, blue_edge
FROM f JOIN tail USING (vec_id) LEFT JOIN longest USING (vec_id)"""


@query("audit_spectra", AUDIT_SQL)
def audit_spectra(spark, sf_dir):
    d = defects(spark, sf_dir)
    return d.select("vec_id", *[c.alias(n) for n, c in M.audit_flags("spectrum").items()])


@query("mask_options", f"""
WITH d AS ({DEFECT_SQL})
SELECT vec_id, round(sum(CASE WHEN v > 0 AND v < 65535 AND NOT isnan(v) THEN v END), 6) AS positive_sum,
       round(sum(CASE WHEN {BAD} OR v < 0 THEN NULL ELSE v END), 6) AS strict_sum,
       CAST(sum(CASE WHEN {BAD} OR v < 0 THEN 1 ELSE 0 END) AS BIGINT) AS strict_bad
FROM d GROUP BY vec_id""")
def mask_options(spark, sf_dir):
    d = defects(spark, sf_dir).withColumns({
        "p": M.positive_only("spectrum"), "q": M.sanitize("spectrum", clip=None, below_zero=True, fill=None)})

    def total(c):
        return F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)

    return d.select("vec_id", F.round(total("p"), 6).alias("positive_sum"), F.round(total("q"), 6).alias("strict_sum"),
                    M.bad_count("spectrum", below_zero=True).cast("bigint").alias("strict_bad"))


# ------------------------------------------------------------- label columns

SCHEME = "CASE lower(confidence_tier) WHEN 'high' THEN 1e0 WHEN 'moderate' THEN 85e-2 WHEN 'low' THEN 7e-1 WHEN 'reviewed-legacy' THEN 1e0 END"


@query("collapse_labels", PIX + f"""
SELECT tile_id, polygon_id, pixel_row, pixel_col,
       CASE WHEN greatest(olivine_t1, olivine_t2) > 0 THEN 1e0 ELSE 0e0 END AS olivine,
       greatest(lcp, hcp) AS pyx, CASE WHEN other > 0 THEN 1e0 ELSE 0e0 END AS bland,
       CASE WHEN alteration > 0 THEN 1e0 ELSE 0e0 END AS alteration, 0e0 AS junk,
       coalesce({SCHEME}, confidence_weight, 85e-2) AS confidence_weight
FROM p""")
def collapse_labels(spark, sf_dir):
    return L.collapse_labels(derive(spark, sf_dir, PIXELS)).select(
        "tile_id", "polygon_id", "pixel_row", "pixel_col", "olivine", "pyx", "bland", "alteration", "junk", "confidence_weight")


@query("weight_schemes", PIX + """
, t AS (SELECT pixel_row, pixel_col, CASE WHEN split = 'train' THEN 'Reviewed-' || confidence_tier WHEN split = 'val' THEN 'Reviewed-Legacy' ELSE 'Ambiguous' END AS tier, confidence_weight AS w FROM p)
SELECT tier, CAST(count(*) AS BIGINT) AS n, round(sum(coalesce(CASE tier WHEN 'Reviewed-Legacy' THEN 1e0 END, w, 85e-2)), 4) AS level,
  round(sum(coalesce(CASE tier WHEN 'Reviewed-High' THEN 2e0 WHEN 'Reviewed-Moderate' THEN 17e-1 WHEN 'Reviewed-Low' THEN 14e-1 WHEN 'Reviewed-Legacy' THEN 15e-1 END, w, 85e-2)), 4) AS review_up,
  round(sum(coalesce(CASE tier WHEN 'Reviewed-High' THEN 1e0 WHEN 'Reviewed-Moderate' THEN 85e-2 WHEN 'Reviewed-Low' THEN 7e-1 WHEN 'Reviewed-Legacy' THEN 85e-2 END, w, 13e-1)), 4) AS hand_up
FROM t GROUP BY tier""")
def weight_schemes(spark, sf_dir):
    tier = (F.when(F.col("split") == "train", F.concat(F.lit("Reviewed-"), F.col("confidence_tier")))
            .when(F.col("split") == "val", "Reviewed-Legacy").otherwise("Ambiguous"))
    p = derive(spark, sf_dir, PIXELS).withColumn("tier", tier)
    return p.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), *[
        F.round(F.sum(L.scheme_weight("tier", "confidence_weight", s)), 4).alias(s) for s in L.WEIGHT_SCHEMES])


TOKENS_SQL = POLY + """
, t AS (SELECT polygon_id, Category, trim(lower(unnest(string_split(trim(regexp_replace(Category, '\\((\\w+)\\)', '')), '+')))) AS token FROM p),
k AS (SELECT *, CASE WHEN contains(token, 'type 1 olivine') THEN 'o1' WHEN contains(token, 'type 2 olivine') THEN 'o2' WHEN contains(token, 'plagioclase') THEN 'plagioclase'
  WHEN contains(token, 'alteration') THEN 'alteration' WHEN contains(token, 'red slope') THEN 'x' WHEN contains(token, 'olivine') THEN 'o' WHEN contains(token, 'other') THEN 'other'
  WHEN contains(token, 'lcp') THEN 'lcp' WHEN contains(token, 'hcp') THEN 'hcp' END AS k FROM t)
SELECT polygon_id, max(CASE k WHEN 'o1' THEN 1e0 WHEN 'o' THEN 5e-1 ELSE 0e0 END) AS olivine_t1, max(CASE k WHEN 'o2' THEN 1e0 WHEN 'o' THEN 5e-1 ELSE 0e0 END) AS olivine_t2,
  max(CASE k WHEN 'lcp' THEN 1e0 ELSE 0e0 END) AS lcp, max(CASE k WHEN 'hcp' THEN 1e0 ELSE 0e0 END) AS hcp, max(CASE k WHEN 'plagioclase' THEN 1e0 ELSE 0e0 END) AS plagioclase,
  max(CASE k WHEN 'other' THEN 1e0 ELSE 0e0 END) AS other, max(CASE k WHEN 'alteration' THEN 1e0 ELSE 0e0 END) AS alteration,
  max(CASE lower(regexp_extract(Category, '\\((\\w+)\\)', 1)) WHEN 'high' THEN 1e0 WHEN 'moderate' THEN 5e-1 ELSE 25e-2 END) AS confidence_weight,
  max(CASE WHEN regexp_extract(Category, '\\((\\w+)\\)', 1) = '' THEN 'Low' ELSE regexp_extract(Category, '\\((\\w+)\\)', 1) END) AS confidence_tier
FROM k GROUP BY polygon_id"""


@query("category_labels", TOKENS_SQL)
def category_labels(spark, sf_dir):
    return L.with_category(derive(spark, sf_dir, POLYGONS)).select(
        "polygon_id", *schema.LABELS_RAW, "confidence_weight", "confidence_tier")


@query("category_keywords", POLY + """
SELECT polygon_id,
  CASE WHEN m = '' AND contains(lower(Category), 'other') THEN 'other' ELSE m END AS minerals,
  CASE WHEN t = '' THEN '' ELSE upper(left(t, 1)) || lower(substr(t, 2)) END AS tier
FROM (SELECT *, concat_ws('|', CASE WHEN contains(lower(Category), 'olivine') THEN 'olivine' END, CASE WHEN contains(lower(Category), 'lcp') THEN 'lcp' END,
  CASE WHEN contains(lower(Category), 'hcp') THEN 'hcp' END, CASE WHEN contains(lower(Category), 'plagioclase') THEN 'plagioclase' END,
  CASE WHEN contains(lower(Category), 'alter') THEN 'alteration' END) AS m,
  regexp_extract(Category, '(?i)\\((high|moderate|low)\\)', 1) AS t FROM p) q""")
def category_keywords(spark, sf_dir):
    p = derive(spark, sf_dir, POLYGONS)
    return p.select("polygon_id", F.array_join(L.keyword_minerals("Category"), "|").alias("minerals"),
                    L.named_tier("Category").alias("tier"))


@query("label_space", POLY + """
, k AS (SELECT polygon_id, tile_id, Category, contains(lower(Category), 'olivine') AS o, contains(lower(Category), 'lcp') AS l, contains(lower(Category), 'hcp') AS h,
  contains(lower(Category), 'plagioclase') AS g, contains(lower(Category), 'alter') AS a, contains(lower(Category), 'other') AS z FROM p)
SELECT polygon_id, CAST(o AS INT) + CAST(l AS INT) + CAST(h AS INT) + CAST(g AS INT) + CAST(z AND NOT (o OR l OR h OR g OR a) AS INT) = 1 AS pure_in_vocab,
  concat_ws(',', CASE WHEN o THEN '0' END, CASE WHEN l THEN '1' END, CASE WHEN h THEN '2' END, CASE WHEN g THEN '3' END, CASE WHEN z AND NOT (o OR l OR h OR g OR a) THEN '4' END) AS label_index,
  CASE WHEN o THEN 'olivine' WHEN l THEN 'lcp' WHEN h THEN 'hcp' WHEN g THEN 'plagioclase' END AS primary_mineral,
  (CAST(o AS INT) + CAST(l AS INT) + CAST(h AS INT) + CAST(g AS INT) + CAST(a AS INT)) = 1 AND NOT a AS pure_mineral,
  o AND NOT (l OR h OR contains(lower(Category), 'pyrox') OR contains(lower(Category), 'plag')) AS olivine_only,
  CASE WHEN tile_id IN ('t3', 't4') THEN 'north' WHEN tile_id = 't7' THEN 'south' ELSE 'cmu' END AS region
FROM k""")
def label_space(spark, sf_dir):
    p = derive(spark, sf_dir, POLYGONS).withColumn("minerals", L.keyword_minerals("Category"))
    return p.select("polygon_id", L.is_pure("minerals", schema.LABELS_5).alias("pure_in_vocab"),
                    F.array_join(L.label_indices("minerals", schema.LABELS_5).cast("array<string>"), ",").alias("label_index"),
                    L.primary_mineral("minerals", ["olivine", "lcp", "hcp", "plagioclase"]).alias("primary_mineral"),
                    L.is_pure_mineral("minerals").alias("pure_mineral"),
                    L.is_olivine_only("Category").alias("olivine_only"),
                    L.tile_region("tile_id", {"north": ["t3", "t4"], "south": ["t7"]}).alias("region"))


@query("category_parsable", POLY + """
SELECT polygon_id, c AS Category FROM (SELECT polygon_id, CASE WHEN p_size > 45 THEN p_name || ' + olivine (High)' WHEN p_size = 1 THEN '' ELSE Category END AS c FROM p) q
WHERE c = '' OR contains(c, 'olivine (High)') AND NOT regexp_matches(split_part(c, '+', 1), 'olivine|hcp|lcp|plagioclase|other|alteration|red slope|spinel|pyroxene')
  AND NOT starts_with(c, 'Type 1') AND NOT starts_with(c, 'hcp')""")
def category_parsable(spark, sf_dir):
    c = (F.when(F.col("p_size") > 45, F.concat("p_name", F.lit(" + olivine (High)")))
         .when(F.col("p_size") == 1, "").otherwise(F.col("Category")))
    p = derive(spark, sf_dir, POLYGONS).withColumn("Category", c)
    return p.where(L.unknown_token("Category")).select("polygon_id", "Category")


IDS = """SELECT p_partkey,
  CASE WHEN p_size % 9 = 0 THEN '±' || 'olivine' WHEN p_size % 9 = 1 THEN 'hcp' WHEN p_size % 9 = 2 THEN 'denom' WHEN p_size % 9 = 3 THEN 'LCP' WHEN p_size % 9 = 4 THEN 'red slope' WHEN p_size % 9 = 5 THEN NULL ELSE 'plagioclase' END AS id1,
  CASE p_type WHEN 'ECONOMY' THEN 'olivine' WHEN 'SMALL' THEN '±hcp' WHEN 'PROMO' THEN 'uncertain' WHEN 'LARGE' THEN 'alteration' ELSE NULL END AS id2,
  CASE WHEN p_brand = 'Brand#2' THEN 'felsic' ELSE '' END AS id3, CAST(NULL AS STRING) AS id4 FROM part"""


@query("mineral_id_category", f"""
WITH p AS ({IDS})
SELECT p_partkey, CASE WHEN names = '' THEN 'Other' ELSE names END || ' (' || CASE
   WHEN contains(coalesce(id1, ''), '±') OR contains(coalesce(id1, ''), 'slope') OR id3 = 'felsic' OR coalesce(id2, '') = 'alteration' THEN 'Low'
   WHEN contains(coalesce(id2, ''), '±') OR coalesce(id2, '') = 'uncertain' THEN 'Moderate' ELSE 'High' END || ')' AS Category
FROM (SELECT *, array_to_string(list_sort(list_filter([replace(lower(coalesce(id1, '')), '±', ''), replace(lower(coalesce(id2, '')), '±', ''), id3],
   lambda x: x IN ('olivine', 'plagioclase', 'lcp', 'hcp', 'red slope', 'felsic', 'alteration', 'spinel'))), ' + ') AS names FROM p) q
WHERE NOT (coalesce(id1, '') = 'denom' AND (coalesce(id2, '') <> '' OR id3 <> ''))""")
def mineral_id_category(spark, sf_dir):
    ids = ["id1", "id2", "id3", "id4"]
    p = spark.sql(IDS.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    return p.where(~L.contaminated_denominator(ids)).select("p_partkey", L.mineral_category(ids).alias("Category"))


@query("denominator_filter", f"""
WITH p AS ({IDS})
SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(CASE WHEN bad THEN 1 END) AS BIGINT) AS contaminated_dropped, CAST(count(CASE WHEN NOT bad THEN 1 END) AS BIGINT) AS rows_out
FROM (SELECT coalesce(id1, '') = 'denom' AND (coalesce(id2, '') <> '' OR id3 <> '') AS bad FROM p) q""")
def denominator_filter(spark, sf_dir):
    p = spark.sql(IDS.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    bad = L.contaminated_denominator(["id1", "id2", "id3", "id4"])
    return p.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("contaminated_dropped"),
                 F.count_if(~bad).alias("rows_out"))


@query("default_tier_category", "SELECT p_partkey, p_name || ' (Moderate)' AS Category FROM part WHERE p_name IS NOT NULL AND p_name <> ''")
def default_tier_category(spark, sf_dir):
    p = load(spark, sf_dir, "part").where(F.col("p_name").isNotNull() & (F.col("p_name") != ""))
    return p.select("p_partkey", L.default_tier_category("p_name").alias("Category"))


@query("relabel_soft_targets", """
SELECT o_orderkey, CASE WHEN contains(x, 'hcp') THEN t END AS hcp, CASE WHEN contains(x, 'lcp') THEN t END AS lcp
FROM (SELECT o_orderkey, lower(s) AS x, CASE regexp_extract(lower(s), '\\((high|moderate|low)\\)', 1) WHEN 'moderate' THEN 6e-1 WHEN 'low' THEN 3e-1 ELSE 1e0 END AS t
 FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'olivine + HCP (Moderate)' WHEN '2-HIGH' THEN 'lcp (Low)' WHEN '3-MEDIUM' THEN 'hcp + lcp' WHEN '5-LOW' THEN 'olivine' ELSE 'HCP (High)' END AS s FROM orders) a) b""")
def relabel_soft_targets(spark, sf_dir):
    text = L.lookup(F.col("o_orderpriority"), {"1-URGENT": "olivine + HCP (Moderate)", "2-HIGH": "lcp (Low)",
                                              "3-MEDIUM": "hcp + lcp", "5-LOW": "olivine"}, "HCP (High)")
    o = load(spark, sf_dir, "orders").withColumn("t", text)
    return o.select("o_orderkey", *[c.alias(n) for n, c in L.relabel_targets("t").items()])


@query("parse_number_blobs", """
SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(64 AS BIGINT) END AS n,
  CASE WHEN vec_id % 4 = 0 THEN NULL ELSE round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4))), 4) END AS total
FROM embeddings""")
def parse_number_blobs(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    text = F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", F.round(x.cast("double"), 4))), "  ")
    text = F.when(F.col("vec_id") % 4 == 0, F.lit("[0.1, 0.2 nonsense]")).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    found = L.bound(L.parse_numbers(text), lambda v: F.struct(
        F.size(v).cast("bigint").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total")))
    return e.select("vec_id", found.alias("found")).select("vec_id", F.when(F.col("found.total").isNotNull(), F.col("found.n")).alias("n"), "found.total")


@query("parse_slots_text", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(4 AS BIGINT) AS slots, CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS BIGINT) AS missing, round(l_discount + l_tax + 5e-1 + CASE WHEN l_quantity > 25 THEN 0e0 ELSE l_quantity END, 6) AS total FROM lineitem""")
def parse_slots_text(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    q = F.when(F.col("l_quantity") > 25, F.lit("nan")).otherwise(F.col("l_quantity").cast("string"))
    text = F.concat(F.lit("["), F.concat_ws(", ", F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), F.lit("junk"), F.lit("0.5"), q), F.lit("]"))
    found = L.bound(L.parse_slots(text), lambda v: L.bound(F.array_compact(v), lambda known: F.struct(
        F.size(v).cast("bigint").alias("slots"), (F.size(v) - F.size(known)).cast("bigint").alias("missing"),
        F.round(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return l.select(*key, found.alias("found")).select(*key, "found.slots", "found.missing", "found.total")


@query("category_tier_text", POLY + """
SELECT polygon_id, CASE WHEN contains(Category, '(High)') THEN 'High' WHEN contains(Category, '(Moderate)') THEN 'Moderate' WHEN contains(Category, '(Low)') THEN 'Low' ELSE 'Moderate' END AS tier FROM p""")
def category_tier_text(spark, sf_dir):
    return derive(spark, sf_dir, POLYGONS).select("polygon_id", L.stamped_tier("Category").alias("tier"))


# -------------------------------------------------------------- score vectors

PROBS = "l_discount * 1e1 AS p0, l_tax * 12e0 AS p1, l_quantity / 5e1 AS p2, l_extendedprice / 105e3 AS p3"
PROBS_SQL = f"WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag <> 'R' AS valid, {PROBS} FROM lineitem) "


def probs(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag <> 'R' AS valid", *PROBS.split(", "))
    return l.withColumn("probs", F.array("p0", "p1", "p2", "p3"))


ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROWS = ", ".join(ROW)


@query("threshold_argmax", PROBS_SQL + f"""
, k AS (SELECT *, CASE WHEN p0 >= 8e-1 THEN p0 END AS a, CASE WHEN p1 >= 7e-1 THEN p1 END AS b, CASE WHEN p2 >= 6e-1 THEN p2 END AS c, CASE WHEN p3 >= 5e-1 THEN p3 END AS d FROM p)
SELECT {ROWS}, CASE WHEN NOT valid THEN -1 WHEN greatest(a, b, c, d) IS NULL THEN 4 WHEN a = greatest(a, b, c, d) THEN 0 WHEN b = greatest(a, b, c, d) THEN 1 WHEN c = greatest(a, b, c, d) THEN 2 ELSE 3 END AS best FROM k""")
def threshold_argmax(spark, sf_dir):
    return probs(spark, sf_dir).select(*ROW, L.best_class("probs", [0.8, 0.7, 0.6, 0.5], "valid").alias("best"))


@query("inverse_ap_thresholds", """
SELECT p_partkey, greatest(99e-2 - 49e-2 * (p_size / 5e1), 8e-1) AS threshold FROM part""")
def inverse_ap_thresholds(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", L.inverse_ap_threshold(F.col("p_size") / 50.0, 0.8).alias("threshold"))


@query("category_bitmask", PROBS_SQL + f"""
, k AS (SELECT *, CAST(p0 >= 8e-1 AS INT) + 2 * CAST(p1 >= 7e-1 AS INT) + 4 * CAST(p2 >= 6e-1 AS INT) + 8 * CAST(p3 >= 5e-1 AS INT) AS bits FROM p)
SELECT {ROWS}, bits, CASE WHEN bits = 0 THEN 'unclassified' ELSE concat_ws(' + ', CASE WHEN p0 >= 8e-1 THEN 'olivine' END, CASE WHEN p1 >= 7e-1 THEN 'lcp' END, CASE WHEN p2 >= 6e-1 THEN 'hcp' END, CASE WHEN p3 >= 5e-1 THEN 'plagioclase' END) END AS category FROM k""")
def category_bitmask(spark, sf_dir):
    p = probs(spark, sf_dir)
    bits = L.class_bits([F.col(f"p{i}") >= t for i, t in enumerate([0.8, 0.7, 0.6, 0.5])])
    return p.withColumn("bits", bits).select(*ROW, "bits", L.bits_text("bits", ["olivine", "lcp", "hcp", "plagioclase"]).alias("category"))


@query("bland_gate", PROBS_SQL + f"SELECT {ROWS} FROM p WHERE valid AND p2 < 25e-2")
def bland_gate(spark, sf_dir):
    return probs(spark, sf_dir).where(L.bland_gate("valid", "probs", ["olivine", "lcp", "bland", "hcp"], 0.25)).select(*ROW)


@query("score_strata", """
SELECT o_orderkey, CASE WHEN s >= 5e-1 AND s < 85e-2 THEN 0 WHEN s >= 85e-2 AND s < 97e-2 THEN 1 WHEN s >= 97e-2 AND s < 99e-2 THEN 2 WHEN s >= 99e-2 AND s < 999e-3 THEN 3 WHEN s >= 999e-3 AND s < 9999e-4 THEN 4 WHEN s >= 9999e-4 AND s <= 1 THEN 5 END AS stratum
FROM (SELECT o_orderkey, o_totalprice / 499978.59e0 AS s FROM orders) q""")
def score_strata(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("s", F.col("o_totalprice") / 499978.59)
    return o.select("o_orderkey", L.stratum("s").alias("stratum"))


@query("truth_vectors", PIX + """
, t AS (SELECT pixel_row, pixel_col, polygon_id, tile_id, olivine_t1 + olivine_t2 AS o, lcp, hcp, plagioclase, other FROM p), g AS (SELECT *, greatest(o, lcp, hcp, plagioclase, other) AS top FROM t)
SELECT pixel_row, pixel_col, polygon_id, tile_id, CASE WHEN o = top THEN 0 WHEN lcp = top THEN 1 WHEN hcp = top THEN 2 WHEN plagioclase = top THEN 3 ELSE 4 END AS best,
  concat_ws(',', CASE WHEN o > 0 THEN '0' END, CASE WHEN lcp > 0 THEN '1' END, CASE WHEN hcp > 0 THEN '2' END, CASE WHEN plagioclase > 0 THEN '3' END, CASE WHEN other > 0 THEN '4' END) AS positives,
  CASE WHEN top = 0 THEN '(none)' ELSE concat_ws(' + ', CASE WHEN o > 0 THEN 'olivine(' || printf('%.2f', o) || ')' END, CASE WHEN lcp > 0 THEN 'lcp(1.00)' END, CASE WHEN hcp > 0 THEN 'hcp(1.00)' END, CASE WHEN plagioclase > 0 THEN 'plagioclase(1.00)' END, CASE WHEN other > 0 THEN 'other(1.00)' END) END AS label_text
FROM g""")
def truth_vectors(spark, sf_dir):
    p = derive(spark, sf_dir, PIXELS).withColumn("y", F.array("olivine_t1", "olivine_t2", "lcp", "hcp", "plagioclase", "other"))
    return p.select("pixel_row", "pixel_col", "polygon_id", "tile_id", L.truth_argmax("y").alias("best"),
                    F.array_join(L.truth_positives("y").cast("array<string>"), ",").alias("positives"),
                    L.truth_text("y", schema.LABELS_5).alias("label_text"))


# ----------------------------------------------------------------------- ids

@query("ids_and_thresholds", """
SELECT o_orderkey, CAST(('0x' || left(md5(u), 8)) AS BIGINT) AS polygon_id, u AS uid, t AS token, 'thresh_' || t AS layer
FROM (SELECT o_orderkey, concat_ws('::', 't' || CAST(o_custkey % 40 AS STRING), 'thresh', CAST(o_orderkey AS STRING)) AS u,
 CASE o_orderpriority WHEN '1-URGENT' THEN '0.9999' WHEN '2-HIGH' THEN '0.999' WHEN '3-MEDIUM' THEN '0.97' WHEN '5-LOW' THEN '0.50' ELSE '0.123456' END AS t FROM orders) q""")
def ids_and_thresholds(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    value = L.lookup(F.col("o_orderpriority"), {"1-URGENT": 0.9999, "2-HIGH": 0.999, "3-MEDIUM": 0.97, "5-LOW": 0.5}, 0.123456)
    u = keys.uid(F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")), F.lit("thresh"), "o_orderkey")
    return o.select("o_orderkey", keys.id_from_uid(u).alias("polygon_id"), u.alias("uid"),
                    keys.threshold_text(value).alias("token"), keys.canonical_layer(value).alias("layer"))


@query("layer_names", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 9999e-4 WHEN '2-HIGH' THEN 97e-2 ELSE NULL END AS threshold FROM orders""")
def layer_names(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    name = L.lookup(F.col("o_orderpriority"), {"1-URGENT": "thresh_01_0.9999", "2-HIGH": "thresh_0.97"}, "layer_0.5")
    return o.select("o_orderkey", keys.layer_threshold(name).alias("threshold"))


@query("multi_hot_labels", """
SELECT event_id, CASE WHEN event_type = 'click' OR event_type = 'view' THEN 1e0 ELSE 0e0 END AS olivine_t1, 0e0 AS olivine_t2, CASE WHEN event_type = 'signup' THEN 1e0 ELSE 0e0 END AS lcp,
 CASE WHEN event_type IN ('view', 'signup') THEN 1e0 ELSE 0e0 END AS hcp, 0e0 AS plagioclase, CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END AS other, CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END AS alteration,
 event_type <> 'purchase' AS is_mineral FROM events""")
def multi_hot_labels(spark, sf_dir):
    text = L.lookup(F.col("event_type"), {"click": "olivine", "view": "olivine;hcp", "signup": "lcp;hcp", "error": "dust"}, "alteration")
    e = load(spark, sf_dir, "events").withColumn("classes", F.split(text, ";"))
    return e.select("event_id", *[c.alias(n) for n, c in L.multi_hot("classes").items()],
                    L.is_mineral_class(F.col("classes")[0]).alias("is_mineral"))

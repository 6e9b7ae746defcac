"""Queries of the operators on the given tables, and their check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import adaptive_scan, divergence, length_buckets, line_dedup, lpt_shards, ngram_lm, phrase_mining, rans_files, separator_scan, simhash_trie, string_kernel, token_mix, zone_clusters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {("d4",): 1.0, ("d5",): 2.0, ("d4", "en"): 3.0, ("d5", "en"): 2.0, ("d4", "en", "src0"): 2.0}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 42
LM_ORDER = 3


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(documents(spark, sf_dir))


@query
def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return adaptive_scan.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op3_token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("domain", F.concat(F.lit("d"), F.length("source").cast("string")))
    return token_mix.mixed(docs, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


@query
def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = string_kernel.train(docs, ~string_kernel.held_out())
    return string_kernel.predict(docs.select("doc_id", "text"), model).select("doc_id", string_kernel.held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op6_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = lpt_shards.shard_groups(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash_trie.simhash_components(documents(spark, sf_dir))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = string_kernel.held_out(7)
    model = ngram_lm.train(docs.where(~held), LM_ORDER)
    return ngram_lm.score(docs, model).withColumn("held_out", held)


@query
def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.packed_batches(documents(spark, sf_dir)).drop("text")


@query
def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.token_counts(documents(spark, sf_dir))


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))


@query
def op12_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    back = rans_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op5_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id"""

ORACLES["op10_separator_scan"] = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents"""

ORACLES["op11_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a
  FROM places, (VALUES (1), (2), (3), (4), (5)) AS s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM grams WHERE size = 1 GROUP BY lang
), cand AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE size >= 2 AND a >= 100
), inside AS (
  SELECT c.lang, array_to_string(c.w[i:i + size_in - 1], ' ') AS phrase, max(c.a) AS longer
  FROM cand c, (VALUES (2), (3), (4)) AS s(size_in), (VALUES (1), (2), (3), (4)) AS p(i)
  WHERE size_in < c.size AND i + size_in - 1 <= c.size GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(c.w[1:k], ' ') AS head, array_to_string(c.w[k + 1:], ' ') AS rest
  FROM cand c LEFT JOIN inside USING (lang, phrase), (VALUES (1), (2), (3), (4)) AS s(k)
  WHERE k < c.size AND (longer IS NULL OR 100 * longer < 100 * c.a)
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, h.a AS l, t.a AS r, x.n, (1000 * CAST(u.a AS HUGEINT) * x.n) // (CAST(h.a AS HUGEINT) * t.a) AS score
  FROM cuts u JOIN grams h ON h.lang = u.lang AND h.phrase = u.head JOIN grams t ON t.lang = u.lang AND t.phrase = u.rest JOIN totals x ON x.lang = u.lang
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS low FROM scored
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM lowest WHERE low = 1)
SELECT lang, CAST(place AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 2000"""


def cluster_sql(clusters: int = 16, rounds: int = 3) -> str:
    """Every distance of every round; numbered common tables a0, c1, a1, ... stand for the rounds."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {clusters})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, code % {clusters} AS c, code // {clusters} AS d FROM (
    SELECT k.rid, min(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) * {clusters} + c.c) AS code
    FROM kept k CROSS JOIN c{k} c GROUP BY k.rid))""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{k} JOIN kept USING (rid), range(1, 65) AS r(i) GROUP BY c, i),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(CAST(m.v AS BIGINT[]), o.v) AS v FROM c{k} o LEFT JOIN m{k} m ON m.c = o.c)""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} f USING (c)"""


ORACLES["op13_zone_clusters"] = cluster_sql()

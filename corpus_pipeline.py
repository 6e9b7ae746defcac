"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bandweave.llm import length_buckets, line_dedup, near_dups, string_kernel, token_mix
from bandweave.llm.text import word_count
from bandweave.session import cut_lineage, shared_dir

MIN_LANGUAGE_SCORE = 0.3
MIX_LEVELS = ["__domain", "lang", "source"]
MIX_WEIGHTS = {("d4",): 1.0, ("d5",): 2.0}
MIX_SHARE = 0.9


def shielded(docs: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but those ``used`` under a name of no meaning, and the name each given column has in it.

    A stage works on such a table and gives the columns their names back, so no given column can clash with its own.
    """
    names = {c: c if c in used else f"other{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(f"`{now}`").alias(given) for given, now in names.items()])


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The doc_ids of more than one row, null among them, as ``often_id``."""
    return cut_lineage(docs.groupBy(F.col("doc_id").alias("often_id")).count().where("count > 1").select("often_id"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays unclear; fitted on a bounded sample of labelled rows.

    Null, empty and blank texts have no letter. Repeated rows and rows with a null doc_id are decided each on its own text;
    a null lang is not learned from. Empty table: no rows. Every column of a kept row stays as it is.
    """
    rows, names = shielded(docs, ["text", "lang"])
    model = string_kernel.train(rows, F.lit(True))
    named = string_kernel.predict(rows, model)
    return restored(named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)), names)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of at least one code point that ten documents or more share; no document goes.

    A null text becomes an empty one. Repeated rows of a doc_id count as one document; a null doc_id is a document of its
    own for each distinct text. Empty table: no rows. ``n_chars`` is counted anew; other columns stay as they are.
    """
    rows, names = shielded(docs, ["doc_id", "text", "n_chars"])
    kept = line_dedup.drop_common_lines(rows, carry=[now for now in names.values() if now not in ("doc_id", "text", "n_chars")])
    return restored(kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, similarity 0.8): a row of the least doc_id, an integer.

    Of several rows of the kept doc_id the one of the least text stays (null first; of equal texts any). Rows with a null
    doc_id are not compared and all stay. Null, empty and blank texts are duplicates of each other. Empty table: no rows.
    """
    rows, names = shielded(docs, ["doc_id", "text"])
    gone = cut_lineage(near_dups.near_duplicates(rows).where(F.col("doc_id") != F.col("group")).select("doc_id"))
    kept = rows.join(gone, "doc_id", "left_anti")
    often = repeated_ids(rows.where(F.col("doc_id").isNotNull()))
    if often.isEmpty():
        return restored(kept, names)
    once = kept.join(often, F.col("doc_id") == F.col("often_id"), "left_anti")
    again = kept.join(often, F.col("doc_id") == F.col("often_id"), "left_semi")
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col("text").isNotNull(), "text"))
    return restored(once.unionByName(again.groupBy("doc_id").agg(first.alias("row")).select("row.*")), names)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes MIX_SHARE of the tokens by weight; a document is read once at most, and whole.

    Rows with a null doc_id and rows that repeat a doc_id are documents of their own: as many of them stay as were
    selected with their doc_id, levels and number of tokens, those of the least texts. Texts without words have no tokens
    and go. Null lang and source are names of their own. Empty table: no rows.
    """
    docs, names = shielded(docs, ["doc_id", "text", "lang", "source"])
    tree = docs.withColumn("__domain", F.concat(F.lit("d"), F.length("source").cast("string")))
    taken = token_mix.mixed(tree, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, max_epochs=1)
    leaf = [F.col(c).cast("string").alias(f"__t{k}") for k, c in enumerate(MIX_LEVELS)]
    taken = cut_lineage(taken.groupBy(F.col("doc_id").alias("__id"), *leaf, F.col("n_tokens").alias("__n")).agg(F.count(F.lit(1)).alias("__m")))
    often = repeated_ids(docs)
    single = taken.join(often, F.col("__id").eqNullSafe(F.col("often_id")), "left_anti").select("__id")
    several = cut_lineage(taken.join(often, F.col("__id").eqNullSafe(F.col("often_id")), "left_semi"))
    once = docs.join(single, docs["doc_id"].eqNullSafe(single["__id"]), "left_semi")
    again = tree.join(several.select("__id").distinct(), tree["doc_id"].eqNullSafe(F.col("__id")), "left_semi").withColumn("__words", word_count(F.col("text")))
    same = [F.col("doc_id").eqNullSafe(F.col("__id")), F.col("__words") == F.col("__n"), *[F.col(c).cast("string").eqNullSafe(F.col(f"__t{k}")) for k, c in enumerate(MIX_LEVELS)]]
    place = F.row_number().over(Window.partitionBy("__id", *[f"__t{k}" for k in range(len(MIX_LEVELS))], "__n").orderBy("text"))
    again = again.join(several, same).withColumn("__place", place).where("__place <= __m")
    return restored(once.select(docs.columns).unionByName(again.select(docs.columns)), names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of one length bucket each; nulls, empty texts and repeats as in ``packed_batches``."""
    return length_buckets.packed_batches(docs)


STAGES = [("language_id", language_id), ("line_dedup", common_lines), ("simhash_near_dedup", near_duplicates), ("target_mix", target_mix), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

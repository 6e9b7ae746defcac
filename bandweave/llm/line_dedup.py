"""Line dedup: drop lines found in many documents, reassemble the rest by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case: ``lower`` does that to plain ASCII and is faster."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept text of each row of ``docs``.

    Lines are exploded with their positions and hashed (MD5 of the key); a key of at least
    ``min_length`` code points found in at least ``min_docs`` distinct documents loses all its
    lines. The dropped positions go back to their document as one list, and the document is put
    together from the other positions.

    Null or empty text: one empty line. Repeated rows of a doc_id count as one document and get
    the same answer. A null doc_id is a document of its own for each distinct text. Only doc_id, text
    and the columns in ``carry`` are read; carried columns come out under their names, whatever
    they are. Empty table: no rows.
    """
    held = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held.alias("held")).withColumn("text_key", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_key").cast("string")))
    hashed = keyed.select("doc_id", "text_key", "pos", who.alias("who"), F.unhex(F.md5("key")).alias("hash"))
    common = hashed.groupBy("hash").agg(F.countDistinct("who").alias("found")).where(F.col("found") >= min_docs).select("hash")
    dropped = (hashed.join(common, "hash", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
               .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "gone"))
    whole = rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["id"]) & (rows["text_key"] == dropped["key"]), "left")
    parts = F.split("text", "\n", -1)
    rest = F.transform(F.array(parts), lambda p: F.array_join(F.transform(  # binds the split lines once for all positions
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda at: F.get(p, at)), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.get(rest, F.lit(0)))
    return whole.select("doc_id", F.size(parts).cast("long").alias("n_lines"),
                        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"),
                        *[F.col("held")[c].alias(c) for c in carry or []])

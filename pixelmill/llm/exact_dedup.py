"""Exact dedup by skew-safe combining, in DataFrame operations only.

Rows are deduplicated where they are read (the partial aggregate), groups are
merged per salted digest, and the winners of the salts are combined for all;
every stage groups by the digest and the full content. The documents then find
their group by digest, which the last stage has shown to stand for one content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most 63: the salts that a group has are bits of one long.
SALTS = 60


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when identical; the row with the
    largest doc_id stays (nulls lose; in a group of null ids keep_id is null and
    the rows are kept). Rows that repeat an id count each for the group's size and
    are kept together. Extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = docs.select("doc_id", text.alias("content")).withColumn("digest", F.sha2("content", 256))
    salted = rows.withColumn("salt", salt)
    merged = salted.groupBy("digest", "content", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = merged.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    # A digest of two contents would be a SHA-256 collision: the job fails rather than merge different texts.
    clash = F.raise_error(F.concat(F.lit("two texts share the digest "), "digest")).cast("bigint")
    alone = groups.groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("n"), F.bit_or("salts").alias("salts"))
    alone = alone.select("digest", "keep_id", F.when(F.col("contents") > 1, clash).otherwise(F.col("n")).alias("group_size"), "salts")
    # A row for each salt that the group has, so that a hot group's documents meet it in many tasks.
    alone = alone.select("digest", "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (salts & shiftleft(1L, s)) <> 0)")).alias("salt"))
    ids = docs.select("doc_id", F.sha2(text, 256).alias("digest"), salt.alias("salt"))
    found = ids.join(alone, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "digest")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))

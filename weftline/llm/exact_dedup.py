"""Exact deduplication: 128-bit content hash, byte comparison within equal hashes, smallest id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, Scratch, small, table


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of white space by one space; a null text is an empty one.
    The row with the smallest doc_id stays (null ids come last); of rows that repeat id and text too, exactly one stays.
    No rows give no rows; other columns of docs are not looked at.

    Only hashes are grouped over all rows (partial aggregation first, so that a group of a third of all rows is a few rows
    for each map task). Texts are compared only where a 128-bit hash occurs again: those rows are grouped by hash and
    bytes, again with partial aggregation, so that copies never gather in one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " ")
    hashed = docs.select("doc_id", norm.alias("t")).select("doc_id", "t", F.unhex(F.md5("t")).alias("h"))
    rows = scratch.save(hashed.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    again = scratch.save(rows.groupBy("h").count().where("count > 1").select("h"))
    # bytes decide: equal hashes over different texts make different classes
    classes = (
        hashed.join(small(again), "h", "left_semi")
        .groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep"))
        .select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "n", "keep")
    )
    classes = scratch.save(classes.where("n > 1"))
    # rows that repeat both id and text: all but the first of them go
    first = rows.join(small(again), "h", "left_semi").groupBy("h", "sha", "doc_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"))
    first = scratch.save(first.where("c > 1").select("h", "sha", F.col("doc_id").alias("id2"), "first"))
    out = rows.join(small(classes, 200_000), ["h", "sha"], "left")
    out = out.join(small(first, 200_000), (rows.h == first.h) & (rows.sha == first.sha) & rows.doc_id.eqNullSafe(first.id2), "left")
    own = F.col("n").isNull() | rows.doc_id.eqNullSafe(F.col("keep"))
    return out.select(
        rows.doc_id,
        F.when(F.col("n").isNull(), rows.doc_id).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (own & (F.col("first").isNull() | (F.col("row") == F.col("first")))).alias("kept"),
        F.lower(F.hex(rows.sha)).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

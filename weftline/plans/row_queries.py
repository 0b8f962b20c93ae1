"""Order, shares, samples and sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import rows
from weftline.plans.registry import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a dense index; their keys are one."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("key")).transform(_dense)


def _dense(df: DataFrame) -> DataFrame:
    return rows.with_row_idx(df.sort("key").drop("key"))


_IDX = "WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () AS n FROM orders) "


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def doc_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.dedup_first(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["text"], "doc_id")


@query(_IDX + "SELECT o_orderkey, row_idx FROM o WHERE row_idx < n / 4 + (CASE WHEN n % 4 > 0 THEN 0 ELSE 0 END) AND row_idx < n // 4 + (CASE WHEN n % 4 > 0 THEN 1 ELSE 0 END)")
def shard_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.shard_contiguous(_orders(spark, sf_dir), 4, 0).select("o_orderkey", "row_idx")


@query(_IDX + "SELECT o_orderkey, row_idx FROM o WHERE row_idx % 7 = 3")
def fold_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.fold(_orders(spark, sf_dir), 7, 3).select("o_orderkey", "row_idx")


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INTEGER AS chunk FROM orders")
def chunk_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.chunked(_orders(spark, sf_dir), 7).select("o_orderkey", "chunk")


@query(_IDX + "SELECT o_orderkey, (row_idx // ((n + 6) // 7))::INTEGER AS chunk FROM o")
def chunk_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.chunked_ceil(_orders(spark, sf_dir), 7).select("o_orderkey", "chunk")


@query(_IDX + "SELECT row_idx // 64 AS batch, count(*) AS n, min(o_orderkey) AS least FROM o GROUP BY 1")
def batch_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.batched(_orders(spark, sf_dir), 64).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat_ws(':', o_orderkey::VARCHAR, '7')), o_orderkey LIMIT 50")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sample_hashed(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), 50, F.col("o_orderkey"), 7)


@query(_IDX + "SELECT o_orderkey, row_idx FROM o WHERE row_idx = n - 2")
def row_lookup_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.lookup(_orders(spark, sf_dir), -2).select("o_orderkey", "row_idx")


@query(_IDX + "SELECT o_orderkey FROM o WHERE row_idx < 10")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_rows(_orders(spark, sf_dir), 10).select("o_orderkey")


@query("SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return rows.offsets(d, F.col("n_chars"), "doc_id", ["source"]).drop("n_chars")


@query("""
WITH s AS (SELECT source, n, sum(n) OVER (ORDER BY source) - n AS a FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))
SELECT doc_id AS idx, source AS split, (doc_id - a)::BIGINT AS local_idx FROM documents d JOIN (SELECT source, a, n FROM s) t USING (source) WHERE false
UNION ALL SELECT d.doc_id, s.source, (d.doc_id - s.a)::BIGINT FROM documents d JOIN s ON d.doc_id >= s.a AND d.doc_id < s.a + s.n
""")
def split_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    splits = d.groupBy(F.col("source").alias("split")).agg(F.count(F.lit(1)).alias("len")).withColumn("position", F.col("split"))
    return rows.split_lookup(d.select(F.col("doc_id").alias("idx")), splits)


@query("SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem WHERE l_linestatus IN ('F', 'O')")
def concat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_linestatus")
    return rows.concat([li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")])


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_orderkey % 5 = 0 OR o_orderstatus = 'P'")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    mirror = o.where("o_orderkey % 5 <> 0 AND o_orderstatus <> 'P'")
    return rows.changed(o, mirror, ["o_orderkey", "o_totalprice"]).drop("o_orderstatus")


@query("SELECT c_nationkey, arg_min(c_name, (CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END) * 1000000000 + c_custkey) AS c_name FROM customer GROUP BY 1")
def model_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return rows.preferred(c, ["c_nationkey"], rank, "c_custkey", "c_name")

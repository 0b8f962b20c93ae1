"""Nested values, mapped functions, reports and streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import mapping, tree
from weftline.plans.registry import query
from weftline.streaming.streams import rate_limited


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def doc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = d.select("doc_id", F.lit("").alias("key"), F.lit("").alias("path"), F.col("text").alias("value"))
    return tree.search(leaves, "tion").select("doc_id")


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def event_props_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.explode(tree.flat(F.col("props"))).alias("key", "value"))


@query("SELECT event_id, len(json_keys(props))::INTEGER AS size, array_to_string(json_keys(props)[:3], ', ') AS keys FROM events")
def event_props_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tree.top(F.col("props"))
    return _events(spark, sf_dir).select("event_id", F.size(m).alias("size"), F.array_join(F.slice(F.map_keys(m), 1, 3), ", ").alias("keys"))


@query("SELECT event_id, len(json_keys(props)) + 1 AS nodes, 1 AS deepest FROM events")
def event_props_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tree.nodes(_events(spark, sf_dir), "event_id", "props")
    return n.groupBy("event_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"))


@query("WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT event_id, key, '/' || key AS path, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, json_extract(props, '$.' || key)::VARCHAR AS value FROM k")
def event_props_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.inline(tree.children(F.col("props"))))
    return rows.select("event_id", "key", "path", "kind", "value")


@query("SELECT event_id, '{' || '\"' || array_to_string(json_keys(props)[:3], '\", \"') || '\"' || CASE WHEN len(json_keys(props)) > 3 THEN ', …' ELSE '' END || '}  (' || len(json_keys(props)) || ' keys)' AS line, '[…]  (2 items)' AS listed FROM events")
def event_props_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))
    return _events(spark, sf_dir).select("event_id", tree.collapsed(F.col("props")).alias("line"), tree.collapsed(pair).alias("listed"))


@query("SELECT event_id, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || ',\"in\":{\"k\":' || json_extract(props, '$.k')::VARCHAR || ',\"none\":null}}' AS kept, '{\"in\":{}}' AS rest FROM events")
def event_props_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    x = F.concat(F.lit('{"k": '), k, F.lit(', "in": {"k": '), k, F.lit("}}"))
    return _events(spark, sf_dir).select("event_id", tree.keep_paths(x, ["k", "in.k", "in.none"]).alias("kept"), tree.drop_paths(x, ["k", "in.k", "no.k"]).alias("rest"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def event_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", tree.structured(F.col("props"), "k bigint", on_error="ignore")["k"].alias("k"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def key_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("SELECT CASE n_chars % 2 WHEN 0 THEN 'ValueError' ELSE 'KeyError' END AS error_type, count(*) AS errors, count(*) / (SELECT count(*) FROM documents) AS share FROM documents WHERE n_chars % 5 = 0 GROUP BY 1")
def doc_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fails(row: dict) -> int:
        if row["n_chars"] % 5 == 0:
            raise (ValueError if row["n_chars"] % 2 == 0 else KeyError)("five")
        return row["n_chars"]

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return mapping.error_report(mapping.map_rows(d, fails, "long", "ignore")).drop("examples")


@query("SELECT doc_id, CASE WHEN n_chars % 5 <> 0 THEN n_chars * 2 END AS result, CASE WHEN n_chars % 5 = 0 THEN 'ValueError' END AS error_type FROM documents")
def doc_map_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def twice(row: dict) -> int:
        if row["n_chars"] % 5 == 0:
            raise ValueError("five")
        return 2 * row["n_chars"]

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return mapping.map_rows(d, twice, "long", "log").select("doc_id", "result", "error_type")


@query("SELECT event_id, length(event_type) AS result FROM events")
def event_map_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "event_type")
    return mapping.map_distinct(e, ["event_type"], lambda r: len(r["event_type"]), "long").select("event_id", "result")


@query("WITH t AS (SELECT event_type AS task, count(*) AS total FROM events GROUP BY 1) SELECT task, total, 100.0 * total / sum(total) OVER () AS percent, CASE WHEN 100.0 * total / sum(total) OVER () >= 75 THEN 'high' WHEN 100.0 * total / sum(total) OVER () >= 50 THEN 'medium' WHEN 100.0 * total / sum(total) OVER () >= 25 THEN 'low' ELSE 'minor' END AS grade FROM t")
def task_time_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.task_table(_events(spark, sf_dir).withColumn("one", F.lit(1).cast("long")), "event_type", "one").select("task", "total", F.round("percent", 10).alias("percent"), "grade")


@query("""
WITH RECURSIVE passed AS (
    SELECT user_id, min(ts) AS ts FROM events WHERE ts IS NOT NULL GROUP BY user_id
    UNION ALL SELECT p.user_id, min(e.ts) FROM passed p JOIN events e ON e.user_id IS NOT DISTINCT FROM p.user_id AND e.ts >= p.ts + INTERVAL 1 HOUR GROUP BY p.user_id, p.ts)
SELECT min(event_id) AS event_id, e.ts, e.user_id FROM events e JOIN passed p ON e.ts = p.ts AND e.user_id IS NOT DISTINCT FROM p.user_id GROUP BY e.ts, e.user_id
UNION ALL SELECT event_id, ts, user_id FROM events WHERE ts IS NULL
""")
def event_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limited(_events(spark, sf_dir).select("event_id", "ts", "user_id"), "user_id", "ts", 3600.0, "event_id")

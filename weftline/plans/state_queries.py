"""Caches over events, and rows kept in folders of Arrow files, stores of blobs and results, and mirrors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.operators import memo, rows
from weftline.sources import arrow, blobs, mirror
from weftline.sources.tables import shared_dir
from weftline.streaming import caches


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), e AS (SELECT *, lag(pos) OVER (PARTITION BY user_id, event_type ORDER BY pos) AS prev FROM n),
b AS (SELECT e.event_id, count(DISTINCT x.event_type) AS between_ FROM e JOIN e x ON x.user_id = e.user_id AND x.pos > e.prev AND x.pos < e.pos GROUP BY e.event_id)
SELECT e.event_id, e.user_id, e.prev IS NOT NULL AND coalesce(between_, 0) < 2 AS hit FROM e LEFT JOIN b USING (event_id)
""")
def event_lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a cache of two event types for each user would have held."""
    return caches.requests(_asked(spark, sf_dir), "user_id", "event_type", "ts", most=2, tie="event_id").select("event_id", "user_id", "hit")


@query("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
a AS (SELECT event_id, pos, min(pos) OVER (PARTITION BY user_id, event_type) AS first FROM e)
SELECT event_id, pos > first AS hit FROM a
""")
def event_kept_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a cache without bounds would have held."""
    return caches.requests(_asked(spark, sf_dir), "user_id", "event_type", "ts", policy="added", tie="event_id").select("event_id", "hit")


@query("""
WITH RECURSIVE added AS (
    SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
    UNION ALL SELECT a.user_id, a.event_type, min(e.ts) FROM added a JOIN events e ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 12 HOUR GROUP BY a.user_id, a.event_type, a.ts),
first AS (SELECT min(e.event_id) AS event_id FROM events e JOIN added a ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.ts = a.ts GROUP BY e.user_id, e.event_type, e.ts)
SELECT event_id, event_id NOT IN (SELECT event_id FROM first) AS hit FROM events
""")
def event_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a cache whose entries live for twelve hours would have held."""
    return caches.requests(_asked(spark, sf_dir), "user_id", "event_type", "ts", ttl=12 * 3600.0, tie="event_id").select("event_id", "hit")


@query("SELECT c_custkey, c_name, c_acctbal, n.n_name AS split FROM customer JOIN nation n ON c_nationkey = n_nationkey WHERE n.n_name IN ('NATION_3', 'NATION_7')")
def customer_arrow_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two nations, kept as the splits of a folder of Arrow files and read again."""
    path = f"{shared_dir(spark)}/weftline-arrow-{uuid.uuid4().hex}"
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    for split in ("NATION_3", "NATION_7"):
        arrow.write_arrow(own.where(F.col("n_name") == split).select("c_custkey", "c_name", "c_acctbal"), path, split)
    return arrow.read_arrow(spark, path).select("c_custkey", "c_name", "c_acctbal", "split")


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, text IS NULL AS none, strlen(text) AS bytes FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def doc_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts kept as blobs, and those that are labelled read again by range."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("data"))
    store = blobs.Blobs(spark, _new(spark, "blobs"))
    store.build(d)
    got = store.fetch(spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id")))
    return got.select(F.col("id").alias("doc_id"), F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("sha256"), F.col("data").isNull().alias("none"), F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT event_id, length(event_type) * 100 + (event_id % 7) AS result FROM events")
def event_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of event type and number, called once for each of their combinations; the second half finds the first's."""
    m = memo.Memo(spark, _new(spark, "memo"), "sum-1", "long", buckets=8)
    call = lambda row: len(row["event_type"]) * 100 + row["n"]
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", (F.col("event_id") % 7).alias("n"))
    half = e.agg(F.percentile_approx("event_id", 0.5).alias("h")).first().h  # about: where the halves part changes no result
    one, two = (m.map(e.where(c), ["event_type", "n"], call) for c in (F.col("event_id") <= half, F.col("event_id") > half))
    return one.unionByName(two).select("event_id", "result")


@query("SELECT c_custkey, c_name FROM customer")
def customer_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers read from a mirror of the folder that they were written to."""
    source, target = _new(spark, "source"), _new(spark, "target")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").write.parquet(source)
    mirror.mirror(spark, source, target)
    return spark.read.parquet(target)


@query("SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles, (SELECT sum(len(string_split(text, ' '))) FROM conversations c WHERE c.conv_id = r.conv_id)::INT AS words FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) r GROUP BY conv_id")
def conv_roles_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different roles in order, and all words of all turns as one list."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    words = F.transform("t", lambda x: F.split(x["text"], " ", -1))
    return t.select("conv_id", F.array_join(rows.unique(F.transform("t", lambda x: x["role"])), ",").alias("roles"), F.size(rows.flat_list(words)).alias("words"))

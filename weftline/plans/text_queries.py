"""Text functions and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import identity, text
from weftline.plans.registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 200) || chr(10) || '... [truncated ' || (length(text) - 400) || ' chars] ...' || chr(10) || right(text, 200) ELSE text END AS short FROM documents")
def doc_truncate_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_middle(F.col("text")).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 90) || chr(10) || '...' || chr(10) || right(text, 210) ELSE text END AS short FROM documents")
def doc_truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.truncate_head_tail(F.col("text"), 300).alias("short"))


@query("SELECT doc_id, '<think>' || chr(10) || CASE WHEN length(text) > 300 THEN left(text, 90) || chr(10) || '...[SKIP ' || (length(text) - 300) || ' chars]...' || chr(10) || right(text, 210) ELSE text END || chr(10) || '</think>' AS block FROM documents")
def doc_reasoning_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.reasoning_block(F.col("text"), 300).alias("block"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 30 THEN left(t, 27) || '...' ELSE t END AS title FROM (SELECT doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS t FROM documents)")
def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.title(F.col("text")).alias("title"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages")
def page_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.escape_html(F.col("html")).alias("safe"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>'), chr(9), '&nbsp;&nbsp;&nbsp;&nbsp;'), '  ', '&nbsp;&nbsp;') AS shown FROM pages")
def page_display_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.escape_display(F.col("html")).alias("shown"))


@query("SELECT conv_id, turn, 'why ' || turn AS reasoning, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS content, true AS think_done FROM conversations WHERE role = 'assistant'")
def assistant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    made = text.assistant_prefix(F.concat(F.lit("why "), F.col("turn").cast("string")), F.col("text"), F.lit(True))
    return c.select("conv_id", "turn", text.assistant_split(made).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT conv_id, turn, '<|im_start|>assistant' || chr(10) || text AS wrapped, text AS bare FROM conversations")
def assistant_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.wrap_assistant(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", w.alias("wrapped"), text.unwrap_assistant(w).alias("bare"))


@query("SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f B', b::DOUBLE) END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)")
def doc_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.human_bytes(F.octet_length("text")).alias("size"))


@query("SELECT doc_id, replace(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''), chr(13), '') AS tight FROM documents")
def doc_minified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.minified(F.col("text")).alias("tight"))


@query("SELECT doc_id, regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", identity.content_uuid(F.col("text")).alias("uuid"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("SELECT DISTINCT event_type, upper(event_type[1]) || event_type[2:] AS title FROM events WHERE NOT contains(event_type, '_')")
def key_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(~F.contains("event_type", F.lit("_")))
    return e.select("event_type", text.key_title(F.col("event_type")).alias("title")).distinct()

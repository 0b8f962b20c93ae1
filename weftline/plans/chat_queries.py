"""Conversations and tokenized rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import chat, tokens
from weftline.plans.registry import query

_TURNS = "conversations"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collect(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chatml FROM conversations GROUP BY 1")
def chatml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", chat.to_text(F.col("messages")).alias("chatml"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY 1")
def chatml_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", chat.to_text(F.col("messages"), True).alias("prompt"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' WHEN 'system' THEN 'System' ELSE role END || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY 1")
def simulated_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", chat.to_simulated(F.col("messages")).alias("chat"))


@query("SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ':' || chr(9) || text, chr(10) || '---' || chr(10) ORDER BY turn) AS outline FROM conversations GROUP BY 1")
def chat_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", chat.to_outline(F.col("messages")).alias("outline"))


@query("SELECT conv_id, string_agg(role || chr(10) || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def role_content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", chat.to_lines(F.col("messages")).alias("body"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, min(turn) OVER (PARTITION BY conv_id) AS lead FROM conversations)
SELECT conv_id, coalesce(max(CASE WHEN turn = lead AND role = 'system' THEN trim(text) END), 'You are a helpful assistant.') AS system,
       coalesce(string_agg(role || '=' || text, '|' ORDER BY turn) FILTER (NOT (turn = lead AND role = 'system')), '') AS pairs FROM c GROUP BY 1
""")
def sharegpt_split_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _messages(spark, sf_dir).select("conv_id", chat.to_pairs(F.col("messages")).alias("s"))
    return s.select("conv_id", "s.system", F.array_join(F.transform("s.conversations", lambda p: F.concat_ws("=", p["from"], p["value"])), "|").alias("pairs"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, role, text AS content FROM conversations")
def turns_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _messages(spark, sf_dir).select("conv_id", chat.from_text(chat.to_text(F.col("messages"))).alias("m"))
    return t.select("conv_id", F.posexplode("m").alias("pos", "x")).select("conv_id", "pos", "x.role", "x.content")


@query("SELECT conv_id, role, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def last_k_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", F.explode(chat.last(F.col("messages"), 2)).alias("x")).select("conv_id", "x.role", "x.content")


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT conv_id, count(*)::INTEGER AS n, bool_or(contains(text, '<think>') OR contains(text, '<|im_start|>')) AS marked FROM conversations GROUP BY 1")
def conv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", F.size("messages").alias("n"), chat.has_markup(F.col("messages")).alias("marked"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 50) || chr(10) || '... [truncated ' || (length(text) - 100) || ' chars] ...' || chr(10) || right(text, 50) ELSE text END AS content FROM conversations")
def truncated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.struct("role", F.col("text").alias("content")))
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", chat.truncated(one, 50).alias("m"))
    return t.select("conv_id", "turn", F.get("m", F.lit(0))["content"].alias("content"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos, role, text AS content FROM conversations")
def normalized_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written in five forms, and read again."""
    pairs = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    forms = [
        F.to_json("messages"), F.to_json(F.struct("messages")), F.to_json(F.struct(F.to_json("messages").alias("messages"), F.lit("no").alias("conversations"))),
        F.to_json(F.struct(pairs.alias("conversations"))), F.to_json(F.struct(F.lit("no list").alias("outbound_messages"), F.col("messages").alias("input_messages"))),
    ]
    made = _messages(spark, sf_dir).select("conv_id", F.get(F.array(*forms), F.pmod("conv_id", F.lit(5)).cast("int")).alias("row"))
    m = made.select("conv_id", F.posexplode(chat.normalize_messages(F.col("row"))).alias("pos", "m"))
    return m.select("conv_id", "pos", "m.role", "m.content")


@query("SELECT user_id, event_type, min(pos) AS \"begin\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, island, event_type")
def event_type_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tokens.islands(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.select("user_id", "event_type", F.col("begin").cast("long").alias("begin"), "n")


def _sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    halved = lambda ids, n: F.transform(ids, lambda x, k: F.when(k < n / 2, F.lit(tokens.MASKED)).otherwise(x))
    row = lambda ids: F.struct(ids.alias("input_ids"), text.let(F.size(ids), lambda n: halved(ids, n)).alias("labels"))
    return d.select("doc_id", text.let(F.transform(F.split("text", " "), F.char_length), row).alias("row"))


@query("SELECT doc_id, len(w)::INTEGER AS total, ceil(len(w) / 2.0)::INTEGER AS masked, (len(w) - ceil(len(w) / 2.0))::INTEGER AS trainable, CASE WHEN len(w) > 1 THEN 2 ELSE 1 END AS regions FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def doc_sft_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda r: F.struct(F.size(r["input_ids"]).alias("total"), tokens.masked(r["labels"]).alias("masked"), F.size(tokens.boundaries(tokens.sft_regions(r["input_ids"], r["labels"]))).alias("regions"))
    n = _sft(spark, sf_dir).select("doc_id", text.let(F.col("row"), told).alias("n"))
    return n.select("doc_id", "n.*").withColumn("trainable", F.col("total") - F.col("masked"))


@query("SELECT doc_id, array_to_string(list_slice(w, least(5, greatest(len(w) - 1, 0)) + 1, least(least(5, greatest(len(w) - 1, 0)) + 12, len(w))), ' ') AS part FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def doc_token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.array_join(tokens.window(F.split("text", " "), F.lit(5), F.lit(12)), " ").alias("part"))


@query("""
WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS a FROM documents),
b AS (SELECT doc_id, a, list_concat(a, a) AS t, a[:3] AS r, least(7, greatest(2 * len(a) - 1, 0))::INTEGER AS s FROM w),
c AS (SELECT *, least(s + 20, len(t))::INTEGER AS e FROM b)
SELECT doc_id, s AS "start", e AS "end", array_to_string(a[s + 1:e], ' ') AS student, array_to_string(t[s + 1:e], ' ') AS teacher, array_to_string(r[s + 1:e], ' ') AS response FROM c
""")
def doc_sdd_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.transform(F.split("text", " "), lambda w: F.char_length(w)).alias("a"))
    d = d.select("doc_id", "a", F.concat("a", "a").alias("t"), F.slice("a", 1, 3).alias("r"))
    w = d.select("doc_id", tokens.sdd_window(F.col("a"), F.col("t"), F.col("r"), F.lit(7), F.lit(20)).alias("w"))
    text = lambda k: F.array_join(F.transform(f"w.{k}", lambda x: x.cast("string")), " ")
    return w.select("doc_id", "w.start", "w.end", text("student_ids").alias("student"), text("teacher_ids").alias("teacher"), text("response_ids").alias("response"))


@query("SELECT conv_id, turn, '<think>' || chr(10) || 'turn ' || turn || chr(10) || '</think>' AS reasoning, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS answer FROM conversations WHERE role = 'assistant'")
def assistant_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{_TURNS}.parquet").where("role = 'assistant'")
    made = F.concat(F.lit("<think> turn "), F.col("turn").cast("string"), F.lit(" </think>"), F.col("text"))
    return t.select("conv_id", "turn", text.assistant_parts(made, F.lit(None).cast("string")).alias("p")).select("conv_id", "turn", "p.*")


@query("SELECT conv_id, turn, 'said: ' || text AS prefix, text AS generated, text <> '' AND turn % 2 = 0 AS done FROM conversations")
def turn_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{_TURNS}.parquet")
    none = F.lit(None).cast("string")
    state = F.struct(F.lit("said: ").alias("prefix"), F.lit("").alias("generated"), none.alias("stop"), none.alias("stop_reason"))
    done = text.content_done(F.col("text"), F.when(F.col("turn") % 2 == 0, "stop").otherwise("length"))
    said = text.continued(state, text.wrap_assistant(F.col("text"), "<|im_start|>assistant"))
    return t.select("conv_id", "turn", said["prefix"].alias("prefix"), said["generated"].alias("generated"), done.alias("done"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, '.') THEN text ELSE text || '.' END AS text, '.' AS matched FROM conversations")
def turn_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{_TURNS}.parquet")
    return t.select("conv_id", "turn", text.with_stop(F.col("text"), F.lit("stop"), F.array(F.lit("."))).alias("s")).select("conv_id", "turn", "s.*")


@query("WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) SELECT doc_id, 'tokens' AS mode, 'sft' AS kind, n::INTEGER AS total, least(1000, n - 1)::INTEGER AS start, least(least(1000, n - 1) + 256, n)::INTEGER AS \"end\" FROM d")
def doc_row_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " ", -1), lambda w: F.char_length(w))
    row = F.to_json(F.struct(ids.alias("input_ids"), ids.alias("labels")))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", row.alias("row"))
    return d.select("doc_id", tokens.mode(F.col("row")).alias("mode"), tokens.row_chunk(F.col("row"), F.lit(1000), F.lit(256)).alias("c")).select("doc_id", "mode", "c.*")


@query("SELECT conv_id, turn, conv_id::VARCHAR AS a, role AS b FROM conversations")
def turn_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/{_TURNS}.parquet")
    say = lambda who, **data: F.struct(F.lit(who).alias("role"), F.to_json(F.struct(*(v.alias(k) for k, v in data.items()))).alias("content"))
    m = F.array(say("user", a=F.col("conv_id"), b=F.col("turn")), say("assistant", b=F.col("role")), say("user", a=F.col("turn")))
    return t.select("conv_id", "turn", chat.fields(m).alias("f")).select("conv_id", "turn", F.col("f")["a"].alias("a"), F.col("f")["b"].alias("b"))

"""Tables written to files of other forms and read again, and operators on token rows, chats and maps made from them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import chat, mapping, rows, tokens, tree
from weftline.plans.registry import query
from weftline.sources import files
from weftline.sources.tables import shared_dir


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}-{name}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES = "WITH l AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN '{\"id\": ' || event_id ELSE '{\"id\":' || event_id || ',\"props\":' || props || '}' END AS line FROM events) "


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines, some blank, some cut off, in one file."""
    i = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 5 == 0, " ").when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"id": '), i)).otherwise(F.concat(F.lit('{"id":'), i, F.lit(',"props":'), "props", F.lit("}")))
    path = _new(spark, "lines.jsonl")
    _table(spark, sf_dir, "events").orderBy("event_id").select(line.alias("value")).coalesce(1).write.text(path)
    return path


@query(_LINES + "SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, CASE WHEN event_id % 7 <> 0 THEN event_id END AS id, CASE WHEN event_id % 7 = 0 THEN line END AS error FROM l WHERE true QUALIFY event_id % 5 <> 0")
def jsonl_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.load_jsonl(spark, _lines(spark, sf_dir), "keep")
    return r.select("line", F.try_variant_get("row", "$.id", "bigint").alias("id"), "error")


@query(_LINES + "SELECT event_id AS id, json_extract(json_extract(line, '$.props'), '$.k')::BIGINT AS k FROM l WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def jsonl_good_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.load_jsonl(spark, _lines(spark, sf_dir), "skip")
    return r.select(F.variant_get("row", "$.id", "bigint").alias("id"), F.variant_get("row", "$.props.k", "bigint").alias("k"))


@query(_LINES + ", n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS line_no, sum(strlen(line) + 1) OVER (ORDER BY event_id) - strlen(line) - 1 AS pos FROM l) SELECT line_no AS line, pos::BIGINT AS \"offset\", strlen(line) AS length FROM n WHERE trim(line) <> ''")
def jsonl_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.line_index(spark, _lines(spark, sf_dir)).select("line", "offset", "length")


@query("SELECT count(*) AS lines FROM events")
def jsonl_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, sf_dir)
    return spark.range(1).select(F.lit(files.count_lines(spark, path)).cast("long").alias("lines"))


@query("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment FROM customer")
def customer_jsonl_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with nulls as compressed JSON lines."""
    path = _new(spark, "customer.jsonl")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    c.write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    return files.load_by_ext(spark, path).select("c_custkey", "c_name", "c_acctbal", "segment")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def nation_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new(spark, "nation.tsv")
    files.write_by_ext(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.load_by_ext(spark, path).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_index FROM orders")
def orders_data_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a file of JSON lines, numbered by their lines."""
    path = _new(spark, "orders.jsonl")
    files.write_jsonl(_table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").coalesce(1), path)
    one = [f for f in files.expanded(spark, f"{path}/*.json")]
    return files.load_objects(spark, one).select(F.variant_get("row", "$.o_orderkey", "bigint").alias("o_orderkey"), "row_index")


@query("SELECT c_custkey, 2 * c_custkey AS twice FROM customer")
def customer_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of customers that are processed apart and put together as one data set."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b["c_custkey"].to_pylist()
            yield pa.RecordBatch.from_pydict({"c_custkey": k, "twice": [2 * x for x in k]}, schema=pa.schema([("c_custkey", pa.int64()), ("twice", pa.int64())]))

    c = rows.with_row_idx(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey")).sort("c_custkey"))
    return spark.read.parquet(mapping.process_shards(c, twice, "c_custkey long, twice long", _new(spark, "shards"), 5))


@query("""
WITH d AS (SELECT doc_id, len(string_split(text, ' ')) AS n, doc_id % 4 AS form FROM documents),
t AS (SELECT doc_id, form, CASE form WHEN 0 THEN n WHEN 1 THEN 2 * n + least(n, 2) ELSE 2 * n END AS total FROM d)
SELECT doc_id, CASE form WHEN 3 THEN 'sdd' ELSE 'tokens' END AS mode, CASE form WHEN 0 THEN 'sft' WHEN 1 THEN 'dpo' WHEN 2 THEN 'kto' ELSE 'sdd' END AS kind,
       total::INT AS total, least(5, total - 1)::INT AS start, least(least(5, total - 1) + 12, total)::INT AS "end" FROM t
""")
def doc_row_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of token rows of all families."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " ", -1), F.char_length).alias("a"))
    a, few, twice = F.col("a"), F.slice("a", 1, 2), F.concat("a", "a")
    forms = [
        F.to_json(F.struct(a.alias("input_ids"), a.alias("labels"))), F.to_json(F.struct(a.alias("prompt_ids"), a.alias("chosen_ids"), few.alias("rejected_ids"))),
        F.to_json(F.struct(a.alias("prompt_ids"), a.alias("completion_ids"), F.lit(1).alias("encourage_label"))),
        F.to_json(F.struct(F.lit(tokens.SDD_FORMAT).alias("format"), a.alias("student_ids"), twice.alias("teacher_ids"), few.alias("response_ids"))),
    ]
    form = F.pmod("doc_id", F.lit(4))
    row = F.when(form == 0, forms[0]).when(form == 1, forms[1]).when(form == 2, forms[2]).otherwise(forms[3])
    told = lambda r: F.struct(tokens.mode(r).alias("mode"), tokens.row_chunk(r, F.lit(5), F.lit(12)).alias("c"))
    return d.select("doc_id", text.let(row, told).alias("x")).select("doc_id", "x.mode", "x.c.*")


@query("SELECT doc_id, (n - k)::INT AS trainable, k::INT AS masked, (n + 2 * least(n, 3))::INT AS pairs FROM (SELECT doc_id, len(string_split(text, ' ')) AS n, least(len(string_split(text, ' ')), 3) AS k FROM documents)")
def doc_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids of each region rows for tuning and for preferences have."""
    ids = F.transform(F.split("text", " ", -1), F.char_length)

    def told(a):
        r = tokens.counts(tokens.sft_regions(a, F.transform(a, lambda x, k: F.when(k < 3, tokens.MASKED).otherwise(x))))
        p = tokens.counts(tokens.dpo_regions(a, F.slice(a, 1, 3), F.slice(a, 1, 3)))
        zero = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
        return F.struct(zero(r, "trainable").alias("trainable"), zero(r, "masked").alias("masked"), (zero(p, "prompt") + zero(p, "chosen") + zero(p, "rejected")).alias("pairs"))

    return _table(spark, sf_dir, "documents").select("doc_id", text.let(ids, told).alias("x")).select("doc_id", "x.*")


@query("""
WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1)
SELECT c.conv_id, string_agg(role || '=' || CASE WHEN turn = asked THEN text || chr(10) || chr(10) || '<reference_answer>' || chr(10) || 'yes' || chr(10) || '</reference_answer>' ELSE text END, '|' ORDER BY turn) AS teacher,
       'chatml' AS form, 1 AS tools FROM conversations c JOIN l USING (conv_id) GROUP BY c.conv_id
""")
def conv_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that a teacher sees; the form of the row that they come in, and its tools."""
    m = chat.collect(_table(spark, sf_dir, "conversations")).withColumn("row", F.to_json(F.struct("messages", F.lit('[{"name":"f"}]').alias("tools"))))
    said = F.array_join(F.transform(chat.with_reference(F.col("messages"), F.lit("yes")), lambda x: F.concat_ws("=", x["role"], x["content"])), "|")
    tools = F.size(F.try_variant_get(chat.tools(F.get_json_object("row", "$.tools")), "$", "array<variant>"))
    return m.select("conv_id", said.alias("teacher"), chat.chat_format(F.json_object_keys("row")).alias("form"), tools.alias("tools"))


@query("""
SELECT conv_id, turn, string_agg(part, '|' ORDER BY k) AS body FROM (
    SELECT conv_id, turn, 0 AS k, 'system=' || role AS part FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 1, 'user=' || text FROM conversations
    UNION ALL SELECT conv_id, turn, 2, 'assistant=' || turn FROM conversations WHERE turn % 3 = 0) GROUP BY ALL
""")
def one_turn_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    m = chat.one_turn(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("text"), F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")))
    return c.select("conv_id", "turn", F.array_join(F.transform(m, lambda x: F.concat_ws("=", x["role"], x["content"])), "|").alias("body"))


@query("SELECT event_id, '{\"event_type\":\"new\",\"k\":\"' || json_extract(props, '$.k')::VARCHAR || '\",\"value\":\"v\"}' AS merged, '[\"event_type\"]' AS found, true AS has FROM events")
def event_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps that are put together, searched by key and compared by keys."""
    left = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event_type"), F.col("event_type"))
    right = F.create_map(F.lit("event_type"), F.lit("new"), F.lit("value"), F.lit("v"))
    keys = lambda m: F.to_json(F.array_sort(F.map_keys(m)))
    both = tree.merged(left, right)
    in_order = F.map_from_entries(F.array_sort(F.map_entries(both)))
    has = F.size(F.array_except(F.array(F.lit("k"), F.lit("value")), F.map_keys(both))) == 0
    return _table(spark, sf_dir, "events").select("event_id", F.to_json(in_order).alias("merged"), keys(tree.grep_keys(both, "event")).alias("found"), has.alias("has"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def event_kinds_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind of a user."""
    first = rows.dedup_first(_table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")
    return first.select("user_id", "event_type")


@query("SELECT conv_id, turn, role, coalesce(nullif(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), ''), '<empty>') AS shown, lower(regexp_replace('Role' || upper(role[1]) || role[2:], '([A-Z])', '_\\1', 'g'))[2:] AS snake, upper(role[1]) || role[2:] || 'Turn' AS pascal FROM conversations")
def turn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from their first letters, contents as they are shown, and names in two styles."""
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.role(F.left("role", F.lit(1))).alias("role"), text.content_or_empty(F.col("text")).alias("shown"), text.snake_case(F.concat(F.lit("Role"), F.initcap("role"))).alias("snake"), text.pascal_case(F.concat("role", F.lit("_turn"))).alias("pascal"))

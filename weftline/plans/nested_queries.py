"""Identities, walks and repairs of nested values, and differences of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import diff, identity, lenient, text, walk
from weftline.operators import chat, tree
from weftline.plans.registry import query
from weftline.sources.tables import parts, spread


#: Rows of a part whose texts are compared character by character, some milliseconds each.
COMPARED = 2000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props"))


def _text(*parts: str | Column) -> Column:
    """JSON text of literal pieces and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _say(x: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


@query("""
WITH e AS (SELECT event_id, '/1:p' AS p, json_extract(props, '$.k')::VARCHAR AS k, to_json(event_type)::VARCHAR AS t FROM events),
l AS (SELECT event_id, k, list_sort(['/1:p/1:k=i:' || k, '/4:type=s:' || t, '/4:more/[0]=n:', '/4:more/[1]/1:a=f:1.5', '/4:more/[1]/2:no=o:', '/4:more/[2]=b:true', '/4:more/[3]=a:']) AS lines FROM e)
SELECT event_id, sha256(array_to_string(lines, chr(10))) AS id, true AS same, true AS apart, sha256('/2:c0/1:a=i:' || k || chr(10) || '/2:c0/1:b/[0]=n:') AS value FROM l
""")
def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of props within a larger value: whatever the order of keys, and apart from others that look alike."""
    e = _events(spark, sf_dir)
    one = _text('{"p":', F.col("props"), ',"type":', _say(F.col("event_type")), ',"more":[null,{"a":1.5,"no":{}},true,[]]}')
    other = _text('{"more": [null, {"no": {}, "a": 15e-1}, true, []], "type": ', _say(F.col("event_type")), ', "p": ', F.col("props"), "}")
    like = _text('{"p":', F.col("props"), ',"type":', _say(F.col("event_type")), ',"more":["null",{"a":1.5,"no":{}},true,[]]}')
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.struct(F.array(F.lit(None).cast("int")).alias("b"), k.alias("a"))
    ids = e.select("event_id", *(identity.json_ids(x).alias(n) for x, n in ((one, "id"), (other, "other"), (like, "like"))), identity.value_ids(value).alias("value"))
    return ids.select("event_id", "id", (F.col("id") == F.col("other")).alias("same"), (F.col("id") != F.col("like")).alias("apart"), "value")


@query("""
WITH e AS (SELECT event_id, event_id::VARCHAR AS i, json_extract(props, '$.k')::VARCHAR AS k, to_json(event_type)::VARCHAR AS t FROM events),
n AS (SELECT event_id, unnest([
    {place: 0, path: '', depth: 0, kind: 'object', value: NULL, size: 2}, {place: 1, path: '/id', depth: 1, kind: 'number', value: i, size: 0},
    {place: 2, path: '/in', depth: 1, kind: 'array', value: NULL, size: 3}, {place: 3, path: '/in/0', depth: 2, kind: 'object', value: NULL, size: 1},
    {place: 4, path: '/in/0/k', depth: 3, kind: 'number', value: k, size: 0}, {place: 5, path: '/in/1', depth: 2, kind: 'string', value: t, size: 0},
    {place: 6, path: '/in/2', depth: 2, kind: 'array', value: NULL, size: 0}]) AS x FROM e)
SELECT event_id, x.place AS node, x.path, x.depth, x.kind, x.value, x.size FROM n
""")
def event_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(_nested(spark, sf_dir), "event_id", "x").drop("key")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", _text('{"id":', F.col("event_id").cast("string"), ',"in":[', F.col("props"), ",", _say(F.col("event_type")), ",[]]}").alias("x"))


@query("""
WITH e AS (SELECT event_id, event_id::VARCHAR AS i, json_extract(props, '$.k')::VARCHAR AS k, to_json(event_type)::VARCHAR AS t FROM events),
h AS (SELECT *, contains(i, '7') AS a, contains(k, '7') AS b FROM e),
n AS (SELECT event_id, a, b, unnest([
    {path: '', kind: 'object', value: NULL, hit: false, seen: a OR b}, {path: '/id', kind: 'number', value: i, hit: a, seen: a OR b}, {path: '/in', kind: 'array', value: NULL, hit: false, seen: a OR b},
    {path: '/in/0', kind: 'object', value: NULL, hit: false, seen: b}, {path: '/in/0/k', kind: 'number', value: k, hit: b, seen: b}, {path: '/in/1', kind: 'string', value: t, hit: false, seen: b},
    {path: '/in/2', kind: 'array', value: NULL, hit: false, seen: b}]) AS x FROM h)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY x.path) - 1 AS place, x.path, x.kind, x.value,
       CASE WHEN x.hit AND x.path = '/id' THEN 0 WHEN x.hit THEN a::INT END AS "match" FROM n WHERE x.seen
""")
def event_tree_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.find(_nested(spark, sf_dir), "event_id", "x", "7").select("event_id", "place", "path", "kind", "value", "match")


@query("SELECT event_id, '{\"k\":' || json_extract(props, '$.k')::VARCHAR || ',\"t\":' || to_json(event_type)::VARCHAR || CASE event_id % 4 WHEN 0 THEN ',\"l\":[1,{\"a\":null}]}' WHEN 1 THEN ',\"l\":[true,\"x\"]}' ELSE '}' END AS read FROM events")
def event_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in forms that are not quite JSON, read as what they are meant to be."""
    k, t = F.get_json_object("props", "$.k"), F.col("event_type")
    forms = [
        _text("Here it is:\n```json\n{'k': ", k, ", 't': '", t, "', 'l': [1, {a: None"), _text('{"k": ', k, ' "t": "', t, '", "l": [True, x,],} // done'),
        _text('{k: ', k, ', "t: ', _say(t), ","), _text('{"k": ', k, ",, /* kind */ “t”: '", t, "'}}"),
    ]
    return _events(spark, sf_dir).select("event_id", lenient.lenient(F.get(F.array(*forms), F.pmod("event_id", F.lit(4)).cast("int"))).alias("read"))


@query("SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, text AS after, text = coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS same FROM conversations")
def turn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text and the one before it, put together from the steps that lead from one to the other."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    pairs = c.select("conv_id", "turn", "text", last.alias("last")).repartition(parts(c, COMPARED))  # else as few parts as the window's bytes fill
    d = pairs.withColumn("ops", diff.opcodes(F.col("last"), F.col("text")))
    same = F.forall("ops", lambda s: s["tag"] == "equal")
    return d.select("conv_id", "turn", diff.rebuilt(F.col("ops"), F.col("last"), F.col("text")).alias("x"), same.alias("same")).select("conv_id", "turn", "x.*", "same")


@query("""
SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '<mark class="token-privileged"> &lt;ref&gt;</mark>' AS marked,
       text || '<span style="background-color:#d6ffd6; color:#006600;"> <ref></span>' AS shown FROM conversations
""")
def turn_privileged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a teacher's text has beyond a student's, marked."""
    c = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", F.concat("text", F.lit(" <ref>")).alias("more")), COMPARED)
    d = c.withColumn("ops", diff.opcodes(F.col("text"), F.col("more")))
    return d.select("conv_id", "turn", diff.privileged(F.col("ops"), F.col("more")).alias("marked"), diff.highlighted(F.col("ops"), F.col("text"), F.col("more")).alias("shown"))


@query("""
WITH t AS (SELECT conv_id, turn, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS said, turn % 3 AS form FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE form WHEN 0 THEN '' ELSE 'why ' || turn END AS reasoning, CASE form WHEN 2 THEN '' ELSE said END AS content, form <> 2 AS think_done FROM t
""")
def assistant_split_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole assistant turns, with their marks: without reasoning, with it, and while it is still going on."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    why = F.concat(F.lit("<think>\nwhy "), F.col("turn").cast("string"))
    body = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" \n<|im_end|>"))).when(F.col("turn") % 3 == 1, F.concat(why, F.lit("\n</think>\n\n"), "text", F.lit("<|im_end|>\n"))).otherwise(why)
    return c.select("conv_id", "turn", text.assistant_split(F.concat(F.lit("<|im_start|>assistant\n"), body)).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT event_id, depth::INT AS depth FROM (SELECT event_id, 3 + event_id % 5 AS depth FROM events)")
def event_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep values are nested, and that the deepest leaf is reached."""
    n = (F.col("event_id") % 5 + 1).cast("int")
    deep = F.concat(F.repeat(F.lit('[{"]":'), n), F.col("props"), F.repeat(F.lit("}]"), n))
    e = _events(spark, sf_dir).select("event_id", deep.alias("x"), n.alias("n"))
    at = F.array_max(F.transform(walk.nodes(F.col("x")), lambda d: d["depth"]))
    return e.where(walk.nesting(F.col("x")) == 2 * F.col("n") + 1).select("event_id", (at - F.col("n") + 1).alias("depth"))


@query("""
SELECT conv_id, turn, role, text AS content, CASE WHEN turn % 2 = 0 THEN '[{"id":' || turn || ',"name":"f"}]' END AS calls, CASE turn % 3 WHEN 0 THEN role || ' speaks' END AS name,
       (CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE turn % 3 WHEN 0 THEN 1 ELSE 0 END)::INT AS extras FROM conversations
""")
def messages_with_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of tool users: what is beside role and content stays with them."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    calls = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(',"tool_calls":[{"name":"f","id":'), F.col("turn").cast("string"), F.lit("}]"))).otherwise("")
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(',"name":'), _say(F.concat("role", F.lit(" speaks"))))).otherwise("")
    pair = F.when(F.col("turn") % 5 == 0, _text('{"from":', _say(F.col("role")), ',"value":', _say(F.col("text")))).otherwise(_text('{"role":', _say(F.col("role")), ',"content":', _say(F.col("text"))))
    row = F.concat(F.lit('{"messages":['), pair, calls, name, F.lit("}]}"))
    m = c.select("conv_id", "turn", chat.normalize_whole(row).alias("m")).select("conv_id", "turn", F.get("m", F.lit(0)).alias("m"), F.get(chat.said(F.col("m")), F.lit(0)).alias("s"))
    extra = lambda k: F.try_element_at(F.col("m.extra"), F.lit(k))
    return m.select("conv_id", "turn", "s.role", "s.content", F.to_json(extra("tool_calls")).alias("calls"), F.try_variant_get(extra("name"), "$", "string").alias("name"), F.size("m.extra").alias("extras"))


@query("""
WITH e AS (SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events)
SELECT event_id, k::BIGINT AS digit_key, k::BIGINT AS blank_key, k::BIGINT AS in_list, true AS null_there, false AS missing, 2 AS below FROM e
""")
def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through keys of digits, blanks and quotes, and places of lists."""
    x = _text('{"a b":{"0":', F.get_json_object("props", "$.k"), ',"it\'s":[', F.col("props"), ',null]},"7":{"n":null,"m":1}}')
    at = lambda path: tree.resolve(F.col("x"), path, "bigint")
    e = _events(spark, sf_dir).select("event_id", x.alias("x"))
    r = e.select("event_id", at("/a b/0").alias("d"), at("/a b/it's/0/k").alias("l"), at("/7/n").alias("n"), at("/7/0").alias("m"), F.size(tree.children(F.col("x"), "/7")).alias("below"))
    return r.select("event_id", F.col("d.value").alias("digit_key"), F.col("d.value").alias("blank_key"), F.col("l.value").alias("in_list"), F.col("n.exists").alias("null_there"), F.col("m.exists").alias("missing"), "below")


@query("SELECT event_id, array_to_string(list_transform(string_split(event_type || '_' || event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM events")
def key_titles_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of keys of several words."""
    return _events(spark, sf_dir).select("event_id", text.key_title(F.concat("event_type", F.lit("_"), "event_type")).alias("title"))

"""Messages with all they hold, paths into nested values, and patterns of files."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import chat, tree
from weftline.sources import files


def whole(spark, row, one=chat.normalize_whole):
    df = spark.createDataFrame([(row if isinstance(row, (str, type(None))) else json.dumps(row),)], "t string")
    m = df.select(one(F.col("t")).alias("m")).select(F.transform("m", lambda x: F.struct(x["role"], F.to_json(x["content"]).alias("content"), F.to_json(F.transform_values(x["extra"], lambda _, v: F.to_json(v))).alias("extra"))).alias("m")).first().m
    return m and [(x.role, json.loads(x.content), {k: json.loads(v) for k, v in json.loads(x.extra).items()}) for x in m]


CALLS = [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image"}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": 1, "args": {"z": 1, "a": [1.5]}}], "reasoning": "why"}, {"role": "tool", "content": "é\n", "name": "f", "ok": True}, {"role": "assistant"}]


def test_messages_keep_what_they_hold(spark):
    want = [(m["role"], m.get("content", ""), {k: v for k, v in m.items() if k not in ("role", "content")}) for m in CALLS]
    for row in (CALLS, {"messages": CALLS}, {"messages": json.dumps(CALLS)}, {"outbound_messages": CALLS, "input_messages": []}, {"conversations": CALLS}):
        assert whole(spark, row) == want
    pairs = [{"from": "human", "value": "a", "role": "x", "content": "y", "weight": 0}, {"from": "gpt", "role": "assistant", "content": "b"}]
    assert whole(spark, pairs) == [("human", "a", {"weight": 0}), ("assistant", "b", {})]
    assert whole(spark, [{"role": 5, "content": 7}]) == [("5", 7, {})]
    assert whole(spark, {"messages": []}) == [] and whole(spark, None) is None


@pytest.mark.parametrize("bad", [[{"content": "x"}], ["text"], {"foo": "bar"}, {"messages": "no list"}])
def test_messages_that_are_none(spark, bad):
    with pytest.raises(Exception, match="message"):
        whole(spark, bad)


def test_said(spark):
    df = spark.createDataFrame([(json.dumps(CALLS),)], "t string")
    got = df.select(chat.said(chat.messages_whole(F.col("t"))).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [("user", '[{"text":"hi","type":"text"},{"image":"x"}]'.replace('{"image":"x"}', '{"type":"image"}')), ("assistant", None), ("tool", "é\n"), ("assistant", "")]


DOC = {"a": {"0": {"b": 1}}, "a b": {"0": 1, "it's": [10, [20, None]]}, "": 5, "l": [{"x": "1"}], "n": None, "q\"uote": {"k": 2}}


@pytest.mark.parametrize(("path", "kind", "value", "exists"), [("/a/0/b", "int", 1, True), ("/a b/0", "int", 1, True), ("/a b/it's/1/0", "int", 20, True), ("/a b/it's/1/1", "int", None, True), ("/l/0/x", "string", "1", True), ("/n", "string", None, True), ('/q"uote/k', "int", 2, True), ("/a/1", "int", None, False), ("/l/1", "int", None, False), ("/l/x", "int", None, False), ("/a/0/b/c", "int", None, False), ("/zz", "int", None, False), ("/l/0/x", "int", 1, True)])
def test_resolve(spark, path, kind, value, exists):
    df = spark.createDataFrame([(json.dumps(DOC),)], "t string")
    got = df.select(tree.resolve(F.col("t"), path, kind).alias("r")).first().r
    assert (got.value, got.exists) == (value, exists)


def test_children_of_digit_keys(spark):
    df = spark.createDataFrame([(json.dumps(DOC),)], "t string")
    got = lambda path: [(c.key, c.path, c.kind, c.size) for c in df.select(tree.children(F.col("t"), path).alias("c")).first().c]
    assert got("/a/0") == [("b", "/a/0/b", "number", 0)] and got("/a b/it's") == [("[0]", "/a b/it's/0", "number", 0), ("[1]", "/a b/it's/1", "array", 2)]
    assert got("/l/0") == [("x", "/l/0/x", "string", 0)] and got("/a/0/b") == got("/nowhere") == []


def test_patterns_of_files(spark, tmp_path):
    for name in ("a/1.jsonl", "a/b/2.jsonl", "a/b/c/0.jsonl", "a/.hidden/9.jsonl", "a/b/.x.jsonl", "z 1.jsonl", "z[1].jsonl", "z2.json"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps({"n": name}) + "\n")
    import glob

    short = lambda paths: [p.split(str(tmp_path))[-1] for p in paths]
    for pattern in ("a/*.jsonl", "a/**/*.jsonl", "**/*.jsonl", "*.jsonl", "z?1*", "a/*/*.jsonl", "z[0-9].json", "z[!2]*", "none*", "a/**"):
        want = sorted(p for p in glob.glob(f"{tmp_path}/{pattern}", recursive=True) if not p.endswith("/") and "." in p.rsplit("/", 1)[-1]) or [f"{tmp_path}/{pattern}"]
        assert short(files.expanded(spark, f"{tmp_path}/{pattern}")) == short(want), pattern
    assert files.load_jsonl_files(spark, f"{tmp_path}/z?1*").count() == 2
    paths = [f"{tmp_path}/z 1.jsonl", f"{tmp_path}/a/**/*.jsonl", f"{tmp_path}/a/1.jsonl"]
    got = files.load_jsonl_files(spark, paths).select("file", F.variant_get("row", "$.n", "string").alias("n")).orderBy("file").collect()
    assert [(r.file, r.n) for r in got] == [(0, "z 1.jsonl"), (1, "a/1.jsonl"), (2, "a/b/2.jsonl"), (3, "a/b/c/0.jsonl"), (4, "a/1.jsonl")]

"""Work, tasks and memory that grow no faster than the tables."""

import datetime
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import diff, identity
from weftline.llm import packing
from weftline.operators import memo, tree
from weftline.plans import nested_queries
from weftline.sources import files, tables

TEXTS = ["1", "1.0", "-0", "0.0", "-0.0", "1e400", "1e22", "15e-1", "1.50", str(10**17), str(10**18), str(-(2**63)), str(2**63), str(10**30), str(10**45), "12345678.5", "0.0001", "0.1234567890123", "null", "true", '"a\\nb\\"\\\\/"', '"\\u0001"', '"\u007f é 😀"', '"\\ud83d"', '"\\/"', "[]", "{}", " [1, {}, [], null] ", '{"b":{"é":[1.5,"x"]},"a/":false,"":0}', '{"a":1,"a":2}', "", "{", "nope", "NaN", "01", None, "[" * 300 + "]" * 300, '{"k\\n":1}', '{"k\\u0000":1}']


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_identities_in_batches_are_the_same(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, t string")
    got = df.select("t", identity.json_id(F.col("t")).alias("a"), identity.json_ids(F.col("t")).alias("b")).collect()
    assert [(x.t, x.a) for x in got] == [(x.t, x.b) for x in got]
    assert sum(identity._digest(t) is not None for t in TEXTS) > 12  # most plain ones are told in batches


def test_identities_of_values_in_batches_are_the_same(spark):
    row = spark.createDataFrame([(1, "x", 1.0, datetime.date(2020, 1, 1), [1, None], {"b": 1, "a": 2}), (None, "é\n", float("nan"), None, [], {})], "i int, s string, d double, t date, a array<int>, m map<string,int>")
    for names in (["i", "s"], ["d"], ["t"], ["a", "m"], ["m"], ["i", "t", "a"], ["i", "s", "d"]):
        columns = [F.col(n) for n in names]
        assert all(x.a == x.b for x in row.select(identity.value_id(*columns).alias("a"), identity.value_ids(*columns).alias("b")).collect()), names


def test_tables_are_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(tables, "DEALT", 100)
    dealt = tables.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000


def test_memo_names_combinations_not_rows(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("n"), F.when(F.col("id") % 2 == 0, "x").alias("s"))
    got = memo.Memo(spark, str(tmp_path), "f", "string", buckets=2).map(df, ["n", "s"], lambda r: f"{r['n']}{r['s']}")
    assert "sha2" not in plan(got) and sorted((x.id, x.result) for x in got.collect()) == [(k, f"{k % 3}{'x' if k % 2 == 0 else None}") for k in range(60)]
    odd = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "d double")
    said = memo.Memo(spark, str(tmp_path), "g", "string", buckets=2).map(odd, ["d"], lambda r: str(r["d"]))
    assert sorted(x.result for x in said.collect()) == ["-0.0", "0.0", "None", "nan"]


def test_paths_go_into_variants(spark):
    text = '{"a":{"it\'s":[10,{"0":null}],"q\\"":1,"b\'\\"":2,"x?":3,"0":4,"":{"":5}},"l":[[1,2],[3]],"d":1,"d":2}'
    df = spark.createDataFrame([(text,)], "t string")
    want = {"/a/it's/0": (10, True), "/a/it's/1/0": (None, True), "/a/it's/1/1": (None, False), '/a/q"': (1, True), "/a/b'\"": (2, True), "/a/x?": (3, True), "/a/0": (4, True), "/l/0/1": (2, True), "/l/00/1": (None, False), "/l/1/0": (3, True), "/l/1/1": (None, False), "/d": (2, True), "/d/0": (None, False), "/l": (None, True)}
    got = df.select(*(tree.resolve(F.col("t"), p, "bigint").alias(str(k)) for k, p in enumerate(want)))
    assert [tuple(x) for x in got.first()] == list(want.values())
    assert "from_json" not in plan(got)


def test_lines_are_numbered_without_sorting_blocks(spark, tmp_path):
    names = []
    for k, n in enumerate((1000, 7)):
        names.append(f"{tmp_path}/{k}.jsonl")
        open(names[-1], "w").write("".join(f'{{"i":{i}}}\n' if i % 5 else "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = files.load_objects(spark, names)
        got = sorted((x.source[-7:], x.row_index, x.i) for x in df.select("source", "row_index", F.variant_get("row", "$.i", "int").alias("i")).collect())
        assert got == sorted((f"{k}.jsonl", i, i) for k, n in enumerate((1000, 7)) for i in range(n) if i % 5)
        assert "at#" not in "".join(x for x in plan(df).splitlines() if "Window" in x or "Sort" in x)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_words_are_learned_once_whatever_their_case():
    words, learned = packing.WordIds(packing.word_bpe()), []
    learn = words._learn
    words._learn = lambda found: learned.extend(found) or learn(found)
    texts = ["École ÉCOLE école Straße ñandú, Ñandú.", "µm MM mm ª º × ÷ ß ẞ Ÿ ÿ ΑΣ Σ ﬁ İi e\u0301 É naïve's x_y 12ab", "", "École école"]
    ids, begin = words.encode(pa.array(texts))
    assert [list(ids[a:z]) for a, z in zip(begin, begin[1:], strict=False)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w for w in learned if w in ("École", "ÉCOLE", "école", "Ñandú", "ñandú", "É", "é")] == ["école", "ñandú", "é"]
    before = len(learned)
    words.encode(pa.array(texts))
    assert len(learned) == before


def test_search_stays_within_rows(spark):
    wide = json.dumps({"l": [{"k": i % 7} for i in range(3000)], "z": [[7], [0]]})
    df = spark.createDataFrame([(1, '{"a":[7,{"b":8}]}'), (1, '{"c":{"d":7},"e":[1]}'), (None, "[7]"), (None, "7"), (2, "1"), (3, wide)], "id int, t string")
    found = tree.find(df, "id", "t", "7")
    assert "Exchange" not in plan(found) and "Window" not in plan(found)
    want = [(0, "", 0, -1), (0, "", 0, 0), (0, "/0", 1, 0), *((1, *x) for x in (("", 0, -1), ("/a", 1, -1), ("/a/0", 2, 0), ("/a/1", 3, -1), ("", 0, -1), ("/c", 1, -1), ("/c/d", 2, 0), ("/e", 3, -1)))]
    got = found.where("id IS NULL OR id < 3").collect()  # rows of one id stay apart
    assert sorted((x.id or 0, x.path, x.place, -1 if x["match"] is None else x["match"]) for x in got) == sorted(want)
    rows = found.where("id = 3").collect()
    at = [i for i in range(3000) if "7" in str(i)]  # by their paths
    assert sum(x["match"] is not None for x in rows) == 2 * len(at) + 1 and [x.place for x in rows] == list(range(len(rows)))
    assert len(rows) == 3 + 3000 + len(at) + 2 + 1


def test_steps_of_many_pairs_are_those_of_each(monkeypatch):
    r = random.Random(4)
    said = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(0, 50)))
    pairs = [(said(x), said(x)) for x in ("a", "ab", "abc ", "aé中😀\ud83d", "abcdefgh\n") for _ in range(60)] + [("", ""), ("ab" * 150, "ba" * 150), ("x" * 300, "x" * 200)]
    monkeypatch.setattr(diff, "TOGETHER", 20000)
    got = [diff.steps_together(pairs, popular) for popular in (True, False)]
    monkeypatch.setattr(diff, "AREA", -1)  # automata only
    assert got == [[diff.steps(a, b, popular) for a, b in pairs] for popular in (True, False)]


def test_turns_are_compared_on_all_cores(spark, tmp_path, monkeypatch):
    turns = [(c, t, f"turn {t} of {c}", "user") for c in range(30) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string, role string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for rows, n in ((2000, spark.sparkContext.defaultParallelism), (10, 9)):
        monkeypatch.setattr(nested_queries, "COMPARED", rows)
        for q in (nested_queries.turn_diff, nested_queries.turn_privileged):
            got = q(spark, str(tmp_path))
            assert got.rdd.getNumPartitions() == n and got.count() == 90

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import identity, text
from weftline.operators import chat, mapping, rows, tokens, tree
from weftline.sources import files
from weftline.streaming import streams


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(*columns).first()


def test_sample_is_pythons(spark):
    df = rows.with_row_idx(spark.range(20).coalesce(1))
    assert [r.row_idx for r in rows.sample(df, 5, 3).collect()] == sorted(random.Random(3).sample(range(20), 5))
    assert rows.sample(df, 99, 1).count() == 20 and rows.sample(df, 0, 1).count() == 0
    with pytest.raises(ValueError):
        rows.sample(df, -1, 1)


def test_chunks_and_shards(spark):
    df = rows.with_row_idx(spark.range(8).coalesce(1))
    assert [r["count"] for r in rows.chunked(df, 3).groupBy("chunk").count().orderBy("chunk").collect()] == [3, 3, 2]
    assert [r.row_idx for r in rows.shard_contiguous(df, 3, 2).collect()] == [6, 7]
    assert rows.lookup(df, -1).first().row_idx == 7 and rows.lookup(df, 9).count() == 0


def test_dedup_first_wins_and_nulls_are_a_key(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, None, "d"), (4, None, "e")], "row_idx long, id int, v string")
    assert sorted(r.v for r in rows.dedup_first(df, ["id"]).collect()) == ["a", "b", "d"]


def test_split_lookup(spark):
    parts = spark.createDataFrame([("train", 0, 3), ("test", 1, 2)], "split string, position int, len long")
    got = rows.split_lookup(spark.range(6).withColumnRenamed("id", "idx"), parts).orderBy("idx").collect()
    assert [(r.split, r.local_idx) for r in got] == [("train", 0), ("train", 1), ("train", 2), ("test", 0), ("test", 1)]


def test_sharegpt_and_back(spark):
    m = F.from_json(F.lit('[{"role":"system","content":" be kind "},{"role":"user","content":"hi"}]'), chat.MESSAGES)
    r = one(spark, chat.to_pairs(m).alias("p"), chat.from_text(chat.to_text(m)).alias("t"))
    assert r.p.system == "be kind" and r.p.conversations[0]["from"] == "user" and [x.role for x in r.t] == ["system", "user"]
    pairs = F.from_json(F.lit('[{"from":"human","value":"hi"}]'), "array<struct<from:string,value:string>>")
    got = one(spark, chat.from_pairs(pairs, F.lit("")).alias("a"), chat.from_pairs(pairs, F.lit(""), "D").alias("b"))
    assert [x.role for x in got.a] == ["human"] and got.b[0].content == "D"


def test_text_functions(spark):
    r = one(
        spark, text.truncate_middle(F.lit("a" * 401)).alias("cut"), text.truncate_head_tail(F.lit("x" * 11), 10, 1.0).alias("head"),
        text.think_split(F.lit("<think>why</think> so")).alias("t"), text.assistant_split(F.lit("<think>open")).alias("a"), text.display_width(F.lit("Tiếng 漢字")).alias("w"),
        text.snake_case(F.lit("PetStoreApi")).alias("s"), text.pascal_case(F.lit("pet_store")).alias("p"), text.human_bytes(F.lit(1536)).alias("b"), text.with_stop(F.lit("x"), F.lit("stop"), F.array(F.lit("!")))["text"].alias("m"),
    )
    assert "truncated 1 chars" in r.cut and r.head == "x" * 10 + "\n...\n"
    assert (r.t.reasoning, r.t.answer) == ("why", "so") and not r.a.think_done and r.a.content == ""
    assert (r.w, r.s, r.p, r.b, r.m) == (10, "pet_store_api", "PetStore", "1.5 KB", "x!")


def test_window_bounds(spark):
    r = random.Random(8)
    cases = [(n, r.randrange(-5, 2 * n + 5), r.randrange(-3, n + 40)) for n in (0, 1, 2, 37, 1500) for _ in range(12)]
    df = spark.createDataFrame(cases, "total int, off int, lim int").select("*", tokens.window_bounds(F.col("total"), F.col("off"), F.col("lim"), 32).alias("b"))
    for x in df.collect():
        start, end = x.b
        assert 0 <= start <= end <= x.total and (end > start or x.total == 0) and end - start <= 32
        if 0 <= x.off < x.total:
            assert start == x.off and end - start == min(32, max(1, x.lim), x.total - x.off)


def test_map_rows_keeps_integers(spark):
    df = spark.createDataFrame([(9007199254740993, None), (None, "x")], "k long, v string")
    got = mapping.map_rows(df, lambda row: row["k"] and row["k"] + 1, "long").collect()
    assert [(x.k, x.v, x.result) for x in got] == [(9007199254740993, None, 9007199254740994), (None, "x", None)]


def test_think_and_case(spark):
    ask = lambda t: tuple(one(spark, text.think_split(F.lit(t)).alias("t")).t)
    assert ask("pre <think>a</think> b") == ("a", "b") and ask("x </think> <think>z</think> w") == ("z", "w")
    assert ask("no mark") == (None, "no mark") and ask("<think> open") == ("open", "")
    r = one(spark, text.snake_case(F.lit("HTTPServer")).alias("a"), text.snake_case(F.lit("petId")).alias("b"), text.pascal_case(F.lit("pet-store_api")).alias("c"))
    assert (r.a, r.b, r.c) == ("h_t_t_p_server", "pet_id", "PetStoreApi")


def test_normalize_messages(spark):
    say = '[{"role":"user","content":"hi","x":1},{"from":"gpt","value":"yo"}]'
    read = lambda t, form="auto": [tuple(m) for m in one(spark, chat.normalize_messages(F.lit(t), form).alias("m")).m]
    want = [("user", "hi"), ("gpt", "yo")]
    rows = (say, f'{{"messages":{say}}}', json.dumps({"messages": say}), f'{{"outbound_messages":5,"input_messages":{say}}}', f'{{"messages":{say},"conversations":[]}}')
    assert all(read(t) == want for t in rows)
    assert read('{"system":"s","conversations":[{"from":"human","value":"q"}]}') == [("system", "s"), ("human", "q")]
    assert one(spark, chat.normalize_messages(F.lit(None).cast("string")).alias("m")).m is None
    for bad in ('{"a":1}', '[{"content":"x"}]'):
        with pytest.raises(Exception, match="(?i)no messages|without role"):
            read(bad)


def test_sdd(spark):
    row = {"format": tokens.SDD_FORMAT, "student_ids": [1], "teacher_ids": [1, 2, 3], "response_ids": []}
    ask = lambda x: one(spark, tokens.is_sdd(F.lit(json.dumps(x))).alias("s")).s
    assert ask(row) and not ask(row | {"format": "x"}) and not ask(row | {"teacher_ids": 3}) and not ask([])
    ids = lambda k: F.array(*map(F.lit, k)) if k else F.expr("array()").cast("array<int>")
    w = one(spark, tokens.sdd_window(ids([1]), ids([1, 2, 3]), ids([]), F.lit(1), F.lit(9)).alias("w")).w
    assert (w.start, w.end, w.student_ids, w.teacher_ids, w.response_ids) == (1, 3, [], [2, 3], [])


def test_regions(spark):
    ids, labels = F.array(*map(F.lit, (10, 11, 12, 13))), F.array(*map(F.lit, (-100, -100, 12, 13)))
    r = one(spark, tokens.counts(tokens.sft_regions(ids, labels)).alias("c"), tokens.boundaries(tokens.sft_regions(ids, labels)).alias("b"), tokens.family(F.array(*map(F.lit, ("input_ids", "labels")))).alias("f"))
    assert r.c == {"masked": 2, "trainable": 2} and [(x.offset, x.region) for x in r.b] == [(0, "masked"), (2, "trainable")] and r.f == "sft"


def test_map_policies(spark):
    def fails_at_3(row):
        if row["x"] == 3:
            raise ValueError("three")
        return row["x"] ** 2

    df = spark.createDataFrame([(k,) for k in range(5)], "x long")
    got = mapping.map_rows(df, fails_at_3, "long", "ignore").orderBy("x").collect()
    assert [r.result for r in got] == [0, 1, 4, None, 16] and got[3].error_type == "ValueError"
    assert mapping.error_report(mapping.map_rows(df, fails_at_3, "long", "log")).first().errors == 1
    with pytest.raises(Exception, match="three"):
        mapping.map_rows(df, fails_at_3, "long").collect()


def test_tree(spark):
    df = spark.createDataFrame([(1, json.dumps({"b": [1, {"c": "Hit"}], "a": None})), (2, "not json"), (3, None)], "id long, j string")
    n = tree.nodes(df, "id", "j")
    assert [r.path for r in n.orderBy("node").collect()] == ["", "/b", "/b/0", "/b/1", "/b/1/c", "/a"]
    assert [r.path for r in tree.search(n, "hit").collect()] == ["/b/1/c"]
    r = df.where("id = 1").select(tree.resolve(F.col("j"), "/b/1/c").alias("x"), tree.resolve(F.col("j"), "/z").alias("y"), tree.resolve(F.col("j"), "/a").alias("n")).first()
    assert (r.x.value, r.x.exists, r.y.exists, r.n.exists) == ("Hit", True, False, True)


def test_flat_goes_into_objects(spark):
    texts = ['{"b":{"y":{"z":1.50,"w":"{}"},"e":{}},"a":[1,{"c":2}],"n":null,"t":true,"b.y":{"w":"é"}}', "[1]", "not json", None, "{}"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, j string").select("id", tree.flat(F.col("j")).alias("m")).orderBy("id").collect()
    assert [r.m for r in got] == [{"b.y.z": "1.50", "b.y.w": "é", "a": '[1,{"c":2}]', "n": None, "t": "true"}, None, None, None, {}]


def test_identity(spark):
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    r = one(spark, identity.canonical_map(m("a", 1, "b", 2)).alias("a"), identity.canonical_map(m("b", 2, "a", 1)).alias("b"), identity.content_id(F.lit(None).cast("string")).alias("n"), identity.content_id(F.lit("null")).alias("s"))
    assert r.a == r.b and r.n != r.s


def test_files(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n\n   \nnot json\n{"a":2}\n')
    assert files.load_jsonl(spark, str(p), "skip").count() == 2 and files.load_jsonl(spark, str(p), "keep").where("error IS NOT NULL").count() == 1
    assert files.load_jsonl(spark, str(p), "skip", max_lines=4).count() == 1
    with pytest.raises(Exception, match="(?i)json|malformed"):
        files.load_jsonl(spark, str(p)).collect()
    (tmp_path / "y.tsv").write_text("a\tb\n1\t2\n")
    assert files.load_by_ext(spark, str(tmp_path / "y.tsv")).first().b == 2
    with pytest.raises(ValueError):
        files.load_by_ext(spark, "x.jsonl.xz")
    store = files.ResultStore(spark, str(tmp_path / "store"))
    assert [store.get("k", lambda: spark.range(3)).count(), store.get("k", lambda: spark.range(9)).count()] == [3, 3]


def test_rate_limit_is_greedy(spark):
    ev = spark.sql("SELECT k, timestamp_seconds(s) AS ts FROM VALUES ('a', 0), ('a', 6), ('a', 10), ('a', 15), ('b', 1) AS t(k, s)")
    assert sorted((r.k, r.ts.second) for r in streams.rate_limited(ev, "k", "ts", 10).collect()) == [("a", 0), ("a", 10), ("b", 1)]


def test_watch_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("1\n2\n")
    q = streams.watch_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("watched").count() == 2


def test_load_data(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 3}\n')
    (tmp_path / "list.json").write_text('[{"k": 5}, {"k": null}]')
    (tmp_path / "one.json").write_text('{"k": [7]}')
    (tmp_path / "bad.json").write_text("[1]")
    (tmp_path / "b.txt").write_text("x")
    for name, files_ in {"some": {"y": '{"k": 1}', "x": '{"k": 2}'}, "none": {}, "arrow": {"state": "{}"}, "odd": {"z": "[]"}}.items():
        (tmp_path / name).mkdir()
        for stem, body in files_.items():
            (tmp_path / name / f"{stem}.json").write_text(body)
    read = lambda name: sorted(tuple(r) for r in files.load_data(spark, str(tmp_path / name)).select("source", "row_index", F.to_json("row")).collect())
    assert read("a.jsonl") == [(None, 0, '{"k":1}'), (None, 2, '{"k":3}')]
    assert read("list.json") == [(None, 0, '{"k":5}'), (None, 1, '{"k":null}')]
    assert read("one.json") == [(None, 0, '{"k":[7]}')]
    assert read("some") == [("x", 0, '{"k":2}'), ("y", 0, '{"k":1}')]
    for name, error in {"gone.json": FileNotFoundError, "b.txt": ValueError, "none": ValueError, "arrow": ValueError}.items():
        with pytest.raises(error):
            read(name)
    for name in ("bad.json", "odd"):
        with pytest.raises(Exception, match="not an object"):
            read(name)


def test_children(spark):
    doc = '{"b": [1, {"c": 2, "a": null}, []], "a": "x\\"y", "n": null, "t": true, "f": 1.5, "o": {}}'
    got = lambda path, text=doc: one(spark, tree.children(F.col("x"), path).alias("c"), x=text).c
    assert [tuple(r) for r in got("")] == [
        ("b", "/b", "array", None, 3), ("a", "/a", "string", '"x\\"y"', 0), ("n", "/n", "null", "null", 0),
        ("t", "/t", "bool", "true", 0), ("f", "/f", "number", "1.5", 0), ("o", "/o", "object", None, 0),
    ]
    assert [tuple(r) for r in got("/b")] == [("[0]", "/b/0", "number", "1", 0), ("[1]", "/b/1", "object", None, 2), ("[2]", "/b/2", "array", None, 0)]
    assert [r.path for r in got("/b/1")] == ["/b/1/c", "/b/1/a"]
    assert got("/gone") == got("/a") == got("/o") == got("", "{oops") == got("", "7") == []
    assert spark.range(1).select(tree.children(F.lit(None).cast("string")).alias("c")).first().c is None
    inside = [one(spark, tree.under(F.col("x"), "/a/b").alias("u"), x=p).u for p in ("/a/b", "/a/b/0", "/a/bc", "/a")]
    assert inside == [True, True, False, False]


def test_structured(spark):
    parse = lambda x, how="ignore": one(spark, tree.structured(F.col("x"), "name string, n int", ("name",), how).alias("s"), x=x).s
    assert tuple(parse('{"name": "a", "n": 3, "more": 1}')) == ("a", 3)
    assert tuple(parse('{"name": "a"}', "raise")) == ("a", None)
    for wrong in ('{"n": 3}', '{"name": null}', '{"name": "a", "n": "b"}', "oops", "[1]", ""):
        assert parse(wrong) is None
        with pytest.raises(Exception, match="valid JSON"):
            parse(wrong, "raise")
    with pytest.raises(Exception, match="empty content"):
        spark.range(1).select(tree.structured(F.lit(None).cast("string"), "a int")).collect()


@pytest.mark.parametrize("value", [{"b": "é", "a": [1, 2.5, None, {}]}, [], "x", {"k": {"l": [[]]}}])
def test_dumps(spark, value):
    assert one(spark, tree.dumps(F.col("x")).alias("t"), x=json.dumps(value)).t == json.dumps(value, ensure_ascii=False, indent=2)
    assert one(spark, tree.dumps(F.col("x")).alias("t"), x="{oops").t is None


def test_row_modes_and_chunks(spark):
    sdd = {"format": "sdd_prompt_response_v1", "student_ids": [1], "teacher_ids": [1, 2, 3], "response_ids": []}
    dpo = {"prompt_ids": [1, 2], "chosen_ids": [3], "rejected_ids": [4, 5]}
    kto = {"prompt_ids": [1], "completion_ids": [2, 3], "encourage_label": 1}
    sft = {"input_ids": [1, 2, 3, 4], "labels": [-100, 2, 3, 4]}
    mode = lambda row: one(spark, tokens.mode(F.col("x")).alias("m"), x=json.dumps(row)).m
    assert [mode(r) for r in (sdd, {"messages": [], "teacher_messages": []}, {"messages_with_ref": []})] == ["sdd"] * 3
    assert [mode(r) for r in (dpo, kto, sft, {"input_ids": 1, "labels": 2})] == ["tokens"] * 4
    assert [mode(r) for r in ({"messages": []}, {"messages_with_ref": "x"}, [1], {**sdd, "format": "other"})] == ["generic"] * 4
    has = lambda row: one(spark, tokens.is_tokenized(F.col("x")).alias("m"), x=json.dumps(row)).m
    assert [has(sft), has({"input_ids": 1}), has(dpo), has([])] == [True, False, False, False]
    chunk = lambda row, a, n: tuple(one(spark, tokens.row_chunk(F.col("x"), F.lit(a), F.lit(n)).alias("c"), x=json.dumps(row)).c)
    assert chunk(sdd, 1, 9) == ("sdd", 3, 1, 3) and chunk(dpo, 0, 2) == ("dpo", 5, 0, 2)
    assert chunk(kto, 2, 1) == ("kto", 3, 2, 3) and chunk(sft, 9, 5) == ("sft", 4, 3, 4)
    with pytest.raises(Exception, match="not a recognized"):
        chunk({"messages": []}, 0, 1)


def test_assistant_texts(spark):
    parts = lambda c, r, most=None: tuple(spark.createDataFrame([(c, r)], "c string, r string").select(text.assistant_parts(F.col("c"), F.col("r"), most).alias("p")).first().p)
    assert parts("a <think> why </think> b", None) == ("<think>\nwhy\n</think>", "b")
    assert parts("a <think>why</think> b", "said") == ("<think>\nsaid\n</think>", "a <think>why</think> b")
    assert parts("x <think>y</think>", "") == (None, "x <think>y</think>")
    assert parts(None, None) == (None, "") and parts("plain ", None) == (None, "plain ")
    assert parts("", "0123456789", 5) == ("<think>\n0\n...[SKIP 5 chars]...\n6789\n</think>", "")
    done = spark.createDataFrame([("a", "stop"), ("", "stop"), (None, "stop"), ("a", "length"), ("a", None)], "c string, s string")
    assert [r.d for r in done.select(text.content_done(F.col("c"), F.col("s")).alias("d")).collect()] == [True, False, False, False, False]


def test_continuation_and_stops(spark):
    state = F.struct(F.lit("P").alias("prefix"), F.lit("G").alias("generated"), F.lit("S").alias("stop"), F.lit("stop").alias("stop_reason"))
    go = lambda x: tuple(spark.createDataFrame([(x,)], "x string").select(text.continued(state, F.col("x")).alias("s")).first().s)
    assert go("") == go(None) == ("P", "G", "S", "stop")
    assert go("<|im_start|>assistant\n hi <|im_end|>") == ("P\n hi ", "G\n hi ", None, None)
    assert go(" <|im_start|>assistant") == ("P <|im_start|>assistant", "G <|im_start|>assistant", None, None)
    with_stop = lambda x, why, stops, add=True: tuple(one(spark, text.with_stop(F.col("x"), F.lit(why), F.array(*map(F.lit, stops)), add).alias("s"), x=x).s)
    assert with_stop("a", "stop", ["."]) == ("a.", ".") and with_stop("a.b", "stop", ["."]) == ("a.b", ".")
    assert with_stop("a", "stop", ["."], False) == ("a", ".")
    assert with_stop("a", "length", ["."]) == with_stop("a", "stop", [".", "!"]) == ("a", None)
    given = lambda stops: spark.createDataFrame([(stops,)], "s array<string>").select(text.stop_list(F.col("s")).alias("s")).first().s
    assert given(["a", "b"]) == ["a", "b"]
    for bad in ([], ["a", ""], [None], None):
        with pytest.raises(Exception, match="non-empty"):
            given(bad)


def test_count_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_text("a\n\nb\r\nc")
    (tmp_path / "b.txt").write_text("")
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("{}\n" * 5)
    assert [files.count_lines(spark, str(tmp_path / n)) for n in ("a.txt", "b.txt", "c.jsonl.gz", "gone")] == [4, 0, 5, 0]


def test_process_shards(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.compute as pc

    def totals(batches):
        seen = [b.column("row_idx") for b in batches]
        every = pa.chunked_array(seen).to_pylist()
        assert every == sorted(every)
        yield pa.RecordBatch.from_pydict({"least": [every[0]], "n": [len(every)], "total": [pc.sum(pa.array(every)).as_py()]})

    df = rows.with_row_idx(spark.range(103).repartition(5).sortWithinPartitions("id"))
    for _ in range(2):
        path = mapping.process_shards(df, totals, "least long, n long, total long", str(tmp_path / "out"), 4)
        assert path.endswith("/out_size4")
        assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(0, 26, 325), (26, 26, 1001), (52, 26, 1677), (78, 25, 2250)]

    def fails(batches):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        mapping.process_shards(df, fails, "n long", str(tmp_path / "bad"), 4)
    empty = mapping.process_shards(df.limit(0), totals, "least long, n long, total long", str(tmp_path / "none"), 4)
    assert spark.read.parquet(empty).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none_size0", "out_size4"]


def test_paths_of_a_tree(spark):
    doc = {"a": "x\ny", "b": [{"c": "\\n"}, "z\n"], "n": 1}
    nodes = tree.nodes(spark.createDataFrame([(1, json.dumps(doc))], "id int, t string"), "id", "t")
    assert [r.path for r in tree.containers(nodes).collect()] == ["", "/b", "/b/0"]
    assert [r.path for r in tree.multiline(nodes).collect()] == ["/a", "/b/1"]


def test_dotted_paths(spark):
    doc = '{"a": {"b": {"c": 9007199254740993, "d": 2}}, "x": 1.5, "é": [1]}'
    keep = lambda *keys, t=doc: one(spark, tree.keep_paths(F.col("x"), list(keys)).alias("j"), x=t).j
    assert keep("x", "a.b.c") == '{"x":1.5,"a":{"b":{"c":9007199254740993}}}'
    assert keep("é", "gone", "a.gone.c", "x.y") == '{"é":[1],"gone":null,"a":{},"x":{}}'
    drop = lambda *keys, t=doc: one(spark, tree.drop_paths(F.col("x"), list(keys)).alias("j"), x=t).j
    assert drop("a.b.c", "x", "gone.c", "x.y", "é.0") == '{"a":{"b":{"d":2}},"é":[1]}'
    assert drop("a") == '{"x":1.5,"é":[1]}'
    for t in ("[1]", "oops", ""):
        assert keep("a", t=t) is None and drop("a", t=t) is None


def test_collapsed_and_pretty(spark):
    line = lambda x: one(spark, tree.collapsed(F.col("x")).alias("l"), x=x).l
    assert line('{"a": 1, "b\\"c": 2}') == '{"a", "b\\"c"}  (2 keys)'
    assert line('{"a": 1, "b": 2, "c": {}, "d": 4}') == '{"a", "b", "c", …}  (4 keys)'
    assert [line(x) for x in ("{}", "[]", "[1, [2]]", ' "x" ', "7", "{oops")] == ["{}", "[]", "[…]  (2 items)", '"x"', "7", None]
    assert [one(spark, tree.pretty(F.col("x")).alias("l"), x=x).l for x in ('{"a":[1]}', "{oops", "")] == ['{\n  "a": [\n    1\n  ]\n}', "{oops", ""]


def test_fields_of_messages(spark):
    def of(*m):
        return spark.createDataFrame([(list(m),)], f"m {chat.MESSAGES}").select(chat.fields(F.col("m")).alias("f")).first().f

    asked, said = ("user", '{"q": 1, "t": "x"}'), ("assistant", '{"t": [2]}')
    assert of(("system", "s"), asked, said, ("user", "more")) == {"q": "1", "t": "[2]"}
    for wrong, error in (((asked,), "no assistant"), ((said,), "no user"), ((("user", "hi"), said), "user message holds"), ((asked, ("assistant", None)), "assistant message holds")):
        with pytest.raises(Exception, match=error):
            of(*wrong)


def test_memoised(spark, tmp_path):
    folder, calls = str(tmp_path / "kept"), tmp_path / "calls"

    def fn(row):
        with open(calls, "a") as f:
            f.write("x\n")
        return None if row["k"] is None else len(row["k"])

    def run(values):
        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, k string")
        got = mapping.memoised(df, ["k"], fn, "int", folder)
        return [r.result for r in got.orderBy("n").collect()], len(calls.read_text().split())

    assert run(["a", "bb", None, "a"]) == ([1, 2, None, 1], 3)
    assert run([None, "bb", "ccc", "ccc"]) == ([None, 2, 3, 3], 4)
    assert run(["a"]) == ([1], 4)

    def fails(row):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        mapping.memoised(spark.createDataFrame([("new",)], "k string"), ["k"], fails, "int", folder)
    assert run(["a", "new"]) == ([1, 3], 5)

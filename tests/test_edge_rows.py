"""Nulls, clashing names and odd files for row operators, readers, mapped functions and rate limits."""

import datetime as dt
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import mapping, rows
from weftline.sources import files
from weftline.streaming import streams


def test_row_index_is_dense_whatever_the_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("at"), F.lit(1).alias("part"), F.lit(2).alias("before"))
    got = rows.with_row_idx(df.repartition(13).sort("k"))
    assert got.columns == ["k", "at", "part", "before", "row_idx"]
    assert sorted((r.k, r.row_idx) for r in got.collect()) == [(k, k) for k in range(1000)]
    empty = rows.with_row_idx(df.limit(0))
    assert empty.collect() == [] and empty.columns == got.columns
    odd = rows.with_row_idx(df.repartition(13).where("k < 2"))  # most partitions have no rows
    assert sorted(r.row_idx for r in odd.collect()) == [0, 1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_row_index_of_nulls_and_nested_columns(spark):
    df = spark.createDataFrame([(None, [1, None], {"a": None}), (2**53 + 1, None, None), (None, [1, None], {"a": None})], "a long, b array<int>, c map<string,int>")
    got = rows.with_row_idx(df, "b_idx").orderBy("b_idx").collect()
    assert [r.a for r in got] == [None, 2**53 + 1, None] and [r.b_idx for r in got] == [0, 1, 2] and got[0].c == {"a": None}


def test_first_of_rows_without_order(spark):
    df = spark.createDataFrame([("a", 5, None), ("b", 1, 2), ("b", 7, 1), ("b", 9, None)], "k string, v int, row_idx int")
    assert sorted(map(tuple, rows.dedup_first(df, ["k"]).collect())) == [("a", 5, None), ("b", 7, 1)]


def test_changed_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (None, None)], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (3, "y"), (None, None)], "k int, v string")
    assert [tuple(r) for r in rows.changed(a, b, ["k", "v"]).collect()] == [(2, "x")]
    assert rows.changed(a, a, ["k", "v"]).count() == 0


def test_errors_are_counted_from_one_run(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def fails(row):
        with open(seen, "a") as f:
            f.write("x")
        if row["result"] % 4 == 0:
            raise ValueError(f"bad {row['result']:03}")
        if row["result"] % 10 == 1:
            raise KeyError("one")
        return row["result"]

    df = spark.range(40).select(F.col("id").alias("result"), F.lit("kept").alias("Error_Type"), F.col("id").alias("other"))
    mapped = mapping.map_rows(df, fails, "long", "log")
    assert mapped.columns == ["other", "result", "error_type", "error_message"]  # fn sees the columns that its own replace
    got = {r.error_type: (r.errors, r.share, r.examples) for r in mapping.error_report(mapped).collect()}
    assert got == {"ValueError": (10, 0.25, ["bad 000", "bad 004", "bad 008"]), "KeyError": (4, 0.1, ["'one'"])}
    assert len(open(seen).read()) == 40


def test_shards_replace_a_data_set_or_leave_it(spark, tmp_path):
    df = rows.with_row_idx(spark.range(20))
    twice = lambda batches: (pa.RecordBatch.from_pydict({"id": [2 * x for x in b["id"].to_pylist()]}) for b in batches)
    for _ in range(2):
        final = mapping.process_shards(df, twice, "id long", f"file://{tmp_path}/out", 3)
        assert sorted(r.id for r in spark.read.parquet(final).collect()) == list(range(0, 40, 2))

    def broken(batches):
        raise RuntimeError("no")
        yield

    with pytest.raises(Exception, match="no"):
        mapping.process_shards(df, broken, "id long", f"file://{tmp_path}/out", 3)
    assert spark.read.parquet(final).count() == 20 and [p.name for p in tmp_path.iterdir()] == ["out_size20"]


def at(seconds):
    return None if seconds is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_rate_limit_with_nulls(spark):
    made = [(2**53 + 1, "a", 0), (2, "a", 5), (3, "a", None), (4, "a", 10), (5, None, 0), (6, None, 3), (7, None, 11), (8, "b", 1), (9, "a", 25), (10, None, None), (11, "b", 1)]
    df = spark.createDataFrame([(i, k, at(s)) for i, k, s in made], "id long, k string, ts timestamp").repartition(3)
    got = sorted(r.id for r in streams.rate_limited(df, "k", "ts", 10, "id").collect())
    assert got == [3, 4, 5, 7, 8, 9, 10, 2**53 + 1]
    assert streams.rate_limited(df.limit(0), "k", "ts", 10).collect() == []


@pytest.mark.parametrize("content", [b"one\r\ntwo\r\n\r\nthree\r\n", b"\xef\xbb\xbfone\ntwo\n", b"\xef\xbb\xbfone\n\n \ntwo", b"a\n\nb\rc\n", "é\nüü\n".encode(), b"", b"\n\n", b"last without feed"])
def test_line_index(spark, tmp_path, content):
    (tmp_path / "x.jsonl").write_bytes(content)
    got = sorted((r.line, r.offset, r.length) for r in files.line_index(spark, str(tmp_path / "x.jsonl")).collect())
    want, place = [], 0
    for k, line in enumerate(content.split(b"\n")):
        mark = 3 if k == 0 and line.startswith(b"\xef\xbb\xbf") else 0
        if line[mark:].strip():
            want.append((k, place + mark, len(line) - mark))
        place += len(line) + 1
    assert got == want
    assert all(content[o : o + n].strip() for _, o, n in got)


def test_lines_of_a_file_in_blocks(spark, tmp_path):
    lines = [json.dumps({"k": k, "pad": "x" * (k % 50)}) if k % 7 else "" for k in range(3000)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "y.jsonl").write_text('{"k": 1}\n')
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = sorted((r.source[-7:], r.line, r.k) for r in files.load_jsonl(spark, [str(tmp_path / n) for n in ("x.jsonl", "y.jsonl")]).select("source", "line", F.try_variant_get("row", "$.k", "int").alias("k")).collect())
        assert got == sorted([("x.jsonl", k, k) for k in range(3000) if k % 7] + [("y.jsonl", 0, 1)])
        whole = (tmp_path / "x.jsonl").read_bytes()
        index = files.line_index(spark, str(tmp_path / "x.jsonl")).collect()
        assert len(index) == len(got) - 1 and all(json.loads(whole[r.offset : r.offset + r.length])["k"] == r.line for r in index)
        assert files.load_jsonl(spark, str(tmp_path / "x.jsonl"), max_lines=100).count() == 85
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_assistant_split_and_stops(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["<|im_start|>assistant\n<think>\nwhy\n</think>\n\nso <|im_end|>", "<|im_start|>assistant\nplain\n<|im_end|>\n", "<|im_start|>assistant\n <think>still", "<think>a</think>b</think>c<|im_end|>", " bare ", "", None])], "id int, t string")
    got = [r.s and tuple(r.s) for r in df.orderBy("id").select(text.assistant_split(F.col("t")).alias("s")).collect()]
    assert got[:6] == [("why", "so", True), ("", "plain", True), ("still", "", False), ("a", "b</think>c", True), ("", "bare", True), ("", "", True)]
    stop = lambda x, s: tuple(spark.range(1).select(text.with_stop(F.lit(x), F.lit("stop"), F.array(F.lit(s))).alias("s")).first().s)
    assert stop("done", "<|im_end|>") == ("done", "<|im_end|>") and stop("done", "###") == ("done###", "###")


def test_lists_and_order(spark):
    df = spark.createDataFrame([([[1, 2], None, [], [2, None]], ["b", "a", "b", None])], "x array<array<int>>, y array<string>")
    got = df.select(rows.flat_list(F.col("x")).alias("x"), rows.unique(F.col("y")).alias("y")).first()
    assert got.x == [1, 2, 2, None] and got.y == ["b", "a", None]
    mixed = rows.with_row_idx(spark.range(500)).repartition(7, F.xxhash64("id"))
    assert [r.id for r in rows.in_order(mapping.map_rows(mixed, lambda r: r["id"], "long")).collect()] == list(range(500))

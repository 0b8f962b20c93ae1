"""Deadlines, memo stores, mirrors and blob stores."""

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import deadline, memo
from weftline.sources import blobs, mirror


def slow(row):
    time.sleep(20)


def test_jobs_end_at_the_deadline(spark):
    began = time.time()
    with pytest.raises(TimeoutError, match="not done"), deadline.Deadline(spark, 1.5):
        deadline.map_rows(spark.range(4), slow, "long").collect()
    assert time.time() - began < 1.5 + 3  # the job is cancelled at once; a busy machine needs a moment to say so
    with deadline.Deadline(spark, 60):
        assert spark.range(10).count() == 10
    assert spark.range(5).count() == 5 and not spark.sparkContext.getJobTags()


def test_other_jobs_go_on(spark):
    done = []

    def work():
        done.append(deadline.map_rows(spark.range(2), lambda r: time.sleep(3) or r["id"], "long").count())

    other = threading.Thread(target=work)
    other.start()
    with pytest.raises(TimeoutError), deadline.Deadline(spark, 1):
        deadline.map_rows(spark.range(2), slow, "long").collect()
    other.join()
    assert done == [2]


def test_an_interrupt_cancels(spark):
    with pytest.raises(KeyboardInterrupt), deadline.Deadline(spark, 60):
        raise KeyboardInterrupt
    assert not spark.sparkContext.getJobTags()


def test_rows_under_a_deadline(spark):
    def some(row):
        if row["id"] % 4 == 3:
            time.sleep(30)
        if row["id"] == 4:
            raise ValueError("four")
        return row["id"] * 2

    began = time.time()
    got = deadline.map_until(spark.range(8).repartition(8, "id"), some, "long", 60, each=0.5)
    rows = {r.id: (r.result, r.error_type) for r in got.collect()}
    assert rows == {k: (None, "TimeoutError") if k % 4 == 3 else (None, "ValueError") if k == 4 else (2 * k, None) for k in range(8)}
    assert time.time() - began < 25 and sorted(r.id for r in deadline.late(got).collect()) == [3, 7]
    none = deadline.map_until(spark.range(5), lambda r: 1, "long", -1)
    assert deadline.late(none).count() == 5
    long = deadline.map_until(spark.range(3).coalesce(1), lambda r: time.sleep(30 * r["id"]) or 1, "long", 4)
    assert {r.id: r.error_type for r in long.collect()} == {0: None, 1: "TimeoutError", 2: "TimeoutError"}


class RateLimitError(Exception):
    pass


class Answer(Exception):
    def __init__(self, status):
        self.status_code = status


def test_retries():
    seen = []

    def fails(error, times):
        def fn(row):
            seen.append(row)
            if len(seen) <= times:
                raise error
            return "done"

        return fn

    for error, times, calls, ends in [(RateLimitError(), 2, 3, "done"), (ConnectionResetError(), 9, 3, ConnectionResetError), (Answer(429), 1, 2, "done"), (Answer(404), 1, 1, Answer), (TypeError(), 1, 1, TypeError), (ValueError(), 1, 1, ValueError), (TimeoutError(), 1, 2, "done")]:
        seen.clear()
        fn = deadline.retried(fails(error, times), 3, 0.001, 0.002)
        if ends == "done":
            assert fn({"k": 1}) == "done"
        else:
            with pytest.raises(ends):
                fn({"k": 1})
        assert len(seen) == calls, error
    assert deadline.waits(5, 0.1, 0.3, 7) == deadline.waits(5, 0.1, 0.3, 7) != deadline.waits(5, 0.1, 0.3, 8)
    assert all(lo <= w <= hi for w, (lo, hi) in zip(deadline.waits(5, 0.1, 0.3, 7), [(0.05, 0.1), (0.1, 0.2), (0.15, 0.3), (0.15, 0.3)], strict=True))


@pytest.fixture
def counted(tmp_path):
    path = str(tmp_path / "calls")

    def fn(row):
        with open(path, "a") as f:
            f.write("x")
        if row["k"] == 666:
            raise ValueError("no")
        return None if row["k"] is None else row["k"] * 10

    return fn, lambda: os.path.getsize(path) if os.path.exists(path) else 0


def keys(spark, *ks):
    return spark.createDataFrame([(k, n) for n, k in enumerate(ks)], "k long, result int")


def test_memo_calls_once_for_each_key(spark, tmp_path, counted):
    fn, calls = counted
    m = memo.Memo(spark, str(tmp_path / "store"), "tens-1", "long", buckets=8)
    got = m.map(keys(spark, 1, 2, 1, None, None), ["k"], fn)
    assert got.columns == ["k", "result"] and sorted((r.k or 0, r.result) for r in got.collect()) == [(0, None), (0, None), (1, 10), (1, 10), (2, 20)] and calls() == 3
    assert sorted(r.result or 0 for r in m.map(keys(spark, 2, 3, None), ["k"], fn).collect()) == [0, 20, 30] and calls() == 4
    other = memo.Memo(spark, str(tmp_path / "store"), "tens-2", "long", buckets=8)
    assert other.map(keys(spark, 2), ["k"], fn).first().result == 20 and calls() == 5
    with pytest.raises(Exception, match="no"):
        m.map(keys(spark, 4, 666), ["k"], fn)
    assert m.map(keys(spark, 1), ["k"], fn).first().result == 10 and m.map(keys(spark).limit(0), ["k"], fn).collect() == []
    with pytest.raises(ValueError, match="name"):
        memo.Memo(spark, str(tmp_path), "a/b", "long")


def test_one_key_reads_one_bucket(spark, tmp_path, counted):
    fn, calls = counted
    m = memo.Memo(spark, str(tmp_path / "store"), "tens", "long", buckets=16)
    m.map(spark.range(200).select(F.col("id").alias("k")), ["k"], fn).collect()
    assert calls() == 200 and len(list((tmp_path / "store" / "tens").glob("bucket=*"))) == 16
    one = m.map(keys(spark, 77), ["k"], fn)
    assert one.first().result == 770 and calls() == 200
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles() if "bucket=" in f}) == 1


def test_memo_is_made_small_and_bounded(spark, tmp_path, counted):
    fn, calls = counted
    m = memo.Memo(spark, str(tmp_path / "store"), "tens", "long", buckets=1, files=2, most=5)
    for k in range(4):
        got = m.map(keys(spark, *range(3 * k, 3 * k + 3)), ["k"], fn)
        assert sorted(r.result for r in got.collect()) == [30 * k, 30 * k + 10, 30 * k + 20]
    bucket = tmp_path / "store" / "tens" / "bucket=0"
    assert len(list(bucket.glob("*.parquet"))) <= 2 and calls() == 12
    assert spark.read.parquet(str(bucket)).count() <= 5 + 3
    os.rename(bucket, bucket.with_name("_before=0"))  # as a run that ended within the exchange leaves it
    assert m.map(keys(spark, 11), ["k"], fn).first().result == 110 and calls() == 12


def tree_of(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("*") if p.is_file() and not any(x.startswith(("_", ".")) for x in p.relative_to(path).parts)}


def test_mirror(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for name, body in {"x.bin": b"x" * 100_000, "d/e/y.txt": "é".encode(), "d/empty": b""}.items():
        (a / name).parent.mkdir(parents=True, exist_ok=True)
        (a / name).write_bytes(body)
    copied = lambda: {r.name: r.copied for r in mirror.mirror(spark, str(a), str(b)).collect()}
    assert copied() == {"x.bin": True, "d/e/y.txt": True, "d/empty": True} and tree_of(a) == tree_of(b)
    assert set(copied().values()) == {False}
    (a / "x.bin").write_bytes(b"z" * 100_000)  # as long, but later
    (a / "new").write_bytes(b"n")
    (b / "d/e/y.txt").write_bytes(b"longer than it was")  # somebody else's
    assert {n for n, c in copied().items() if c} == {"x.bin", "new", "d/e/y.txt"} and tree_of(a) == tree_of(b)
    assert set(mirror.mirror(spark, str(a), str(a)).select("copied").distinct().collect()[0]) == {False}
    with pytest.raises(NotADirectoryError):
        mirror.mirror(spark, str(a / "x.bin"), str(b))


def test_a_broken_copy_leaves_the_old_file(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    (a / "one").write_bytes(b"1")
    (a / "two").write_bytes(b"2")
    mirror.mirror(spark, str(a), str(b)).collect()
    (a / "one").write_bytes(b"one")
    (a / "two").unlink()
    (a / "two").mkdir()  # what was a file is a folder now, which the mirror's file is in the way of
    (a / "two" / "in").write_bytes(b"x")
    with pytest.raises(OSError, match="mirror incomplete: two/in"):
        mirror.mirror(spark, str(a), str(b))
    assert tree_of(b) == {"one": b"one", "two": b"2"} and not [p for p in b.rglob(".*") if p.parent.name != mirror.NOTES]
    (b / "two").unlink()
    assert {r.name: r.copied for r in mirror.mirror(spark, str(a), str(b)).collect()} == {"one": False, "two/in": True}


def test_blobs(spark, tmp_path):
    r = np.random.default_rng(1)
    arrays = {k: r.integers(0, 255, (k % 5, 3, 1 + k % 2), np.uint8) for k in range(200)}
    rows = [(k, x.tobytes(), list(x.shape)) for k, x in arrays.items()] + [(500, None, None), (501, b"", [0])]
    df = spark.createDataFrame(rows, "id long, data binary, shape array<long>")
    store = blobs.Blobs(spark, str(tmp_path / "store"))
    assert store.build(df.repartitionByRange(3, "id")) and not store.build(df.coalesce(1))
    got = {x.id: x for x in store.fetch(spark.createDataFrame([(k,) for k in [3, 3, 77, 199, 500, 501, 9999]], "id long")).collect()}
    assert sorted(got) == [3, 77, 199, 500, 501] and got[500].data is None and got[501].data == b""
    for k in (3, 77, 199):
        assert (np.frombuffer(got[k].data, np.uint8).reshape(got[k].shape) == arrays[k]).all()
    index = store.index().orderBy("part", "offset").collect()
    ends = {}
    for x in index:
        assert x.offset == ends.get(x.part, 0)
        ends[x.part] = x.offset + (x.length or 0)
    assert sorted(os.listdir(tmp_path / "store" / "parts")) == sorted(ends)
    changed = df.where("id <> 5").coalesce(1)
    assert store.build(changed) and store.fetch(spark.range(5, 7)).count() == 1
    assert store.build(changed.orderBy(F.desc("id")))  # another order
    assert len(os.listdir(tmp_path / "store" / "parts")) == store.index().select("part").distinct().count()


def test_blobs_of_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", b"1", 1), ("b", b"2", 1)], "id string, data binary, modified int").coalesce(1)
    store = blobs.Blobs(spark, str(tmp_path / "store"))
    assert store.build(df, "modified") and not store.build(df, "modified")
    assert store.build(df.withColumn("modified", F.col("modified") + 1), "modified")
    assert [x.shape for x in store.fetch(df).collect()] == [[1], [1]]

"""Caches and rate limits on tables and streams, against plain ones."""

import datetime as dt
import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from weftline.streaming import caches, streams

START = dt.datetime(2024, 1, 1)


def at(s):
    return None if s is None else START + dt.timedelta(seconds=s)


def made(n, seed, nulls=True):
    r = random.Random(seed)
    rows = [(k + 2**53 + 1, r.choice("abc"), r.choice("vwxyz"), r.randrange(600)) for k in range(n)]
    return rows + ([(1, None, "v", 5), (2, None, None, 6), (3, None, None, 7), (4, "a", None, 3), (5, "a", "v", None), (6, "a", "v", None)] if nulls else [])


def plain(rows, most, ttl, policy):
    """ids of the requests that hit, taken one scope after the other."""
    hits, scopes = set(), {}
    for i, s, k, t in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
        held = scopes.setdefault(s, OrderedDict())
        if k in held and not (ttl and t is not None and held[k] is not None and t - held[k] >= ttl):
            hits.add(i)
            if policy == "used":
                held.move_to_end(k)
        else:
            held.pop(k, None)
            held[k] = t
            if most and len(held) > most:
                held.popitem(last=False)
    return hits


def frame(spark, rows):
    return spark.createDataFrame([(i, s, k, at(t)) for i, s, k, t in rows], "id long, s string, k string, ts timestamp").repartition(3)


@pytest.mark.parametrize(("most", "ttl", "policy"), [(2, None, "used"), (2, None, "added"), (None, 40, "used"), (3, 100, "used"), (1, 30, "added"), (None, None, "used")])
def test_requests(spark, most, ttl, policy):
    rows = made(400, 5)
    got = caches.requests(frame(spark, rows).withColumn("hit", F.lit("old")), "s", "k", "ts", most, ttl, policy, "id")
    assert got.columns == ["id", "s", "k", "ts", "hit"]
    assert {r.id for r in got.collect() if r.hit} == plain(rows, most, ttl, policy)
    assert caches.misses(got).count() == len(rows) - len(plain(rows, most, ttl, policy))
    assert caches.requests(frame(spark, rows).limit(0), "s", "k", "ts", most, ttl).collect() == []


def test_bad_bounds(spark):
    for bad in ({"most": 0}, {"ttl": 0}, {"policy": "x"}):
        with pytest.raises(ValueError, match="policy"):
            caches.requests(frame(spark, made(1, 1)), "s", "k", "ts", **bad)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over lots of rows that come one after the other; what comes out, and the state's size after each."""
    spark.conf.set(*caches.STATE_STORE)
    source, n = tmp_path / "in", [0]
    source.mkdir()

    def run(build, lots):
        rows = spark.readStream.schema("id long, s string, k string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        q = build(rows).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        sizes = []
        try:
            for lot in lots:
                n[0] += 1
                (source / f"{n[0]}.json").write_text("\n".join(json.dumps({"id": i, "s": s, "k": k, "ts": t if t is None else at(t).isoformat()}) for i, s, k, t in lot))
                q.processAllAvailable()
                sizes.append(json.loads(q.lastProgress.json)["stateOperators"][0]["numRowsTotal"])
            return spark.table("out").collect(), sizes
        finally:
            q.stop()

    yield run
    spark.conf.unset(caches.STATE_STORE[0])


def lots_of(rows, n):
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


def test_stream_agrees_with_table_and_state_is_bounded(spark, stream):
    lots = [lot for lot in lots_of([(i, s, k, 5 * t) for i, s, k, t in made(120, 8, False)], 4)]
    got, sizes = stream(lambda rows: caches.requests_stream(rows, "s", "k", "ts", most=2, ttl=200.0, watermark="1 second"), [*lots, [(7, "z", "v", 100_000)], [(8, "z", "w", 200_000)]])
    rows = [r for lot in lots for r in lot]
    assert {r.id for r in got if r.hit} == plain(rows, 2, 200, "used") and len(got) == len(rows) + 2
    assert max(sizes) <= 3 * 2 + 1 and sizes[-1] <= 2  # two keys for each scope; then time has taken all but the last


def test_limited_stream_agrees_with_table_and_forgets(spark, stream):
    rows = [(i, s, "v", 3 * t) for i, s, _, t in made(120, 9, False)]
    rows = list({(s, t): (i, s, k, t) for i, s, k, t in rows}.values())  # one event of a time
    got, sizes = stream(lambda r: streams.rate_limited_stream(r, "s", "ts", 60.0, "1 second"), [*lots_of(rows, 3), [(7, "z", "v", 100_000)], [(8, "z", "v", 200_000)]])
    want = {r.id for r in streams.rate_limited(frame(spark, rows), "s", "ts", 60.0).collect()}
    assert {r.id for r in got} == want | {7, 8}
    assert sizes[-1] <= 1

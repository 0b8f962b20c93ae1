"""Exact top-k by integer inner product: a KD-tree for each shard, best-first, with a kth score passed on."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, table

#: Vectors of a shard, of a leaf, and queries of a block. They bound what a task holds, not what is searched.
SHARD, LEAF, BLOCK = 8192, 128, 512
EXACT = 2.0**53


def build(x: np.ndarray) -> dict[str, np.ndarray]:
    """Median splits on the widest side down to leaves; every node has the tight box of its rows."""
    order, nodes = np.arange(len(x)), []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, z, parent, side = todo.pop()
        rows = x[order[a:z]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        me = len(nodes)
        nodes.append([a, z, -1, -1, lo, hi])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if z - a > LEAF and (hi > lo).any():
            mid = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(rows[:, int((hi - lo).argmax())], mid)]
            todo += [(a, a + mid, me, 0), (a + mid, z, me, 1)]
    cols = list(zip(*nodes, strict=True))
    return {"order": order, "span": np.array(cols[:2]).T, "kids": np.array(cols[2:4]).T, "lo": np.array(cols[4]), "hi": np.array(cols[5])}


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where all sums stay below 2**53, else in Python's integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], dtype=object)


def search(tree: dict, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int, k: int, floor, leaves: int | None = None) -> list[tuple]:
    """The k best (score, -id, -row) of a shard that may still be among the query's k best, given a kth score so far.

    leaves: stop after so many, for a first kth score."""
    bound = np.maximum(q * tree["lo"], q * tree["hi"]).sum(axis=1)  # of all boxes at once; the order of visits is best first
    slack = 1e-9 * np.abs(bound) + 1.0
    best: list[tuple] = []
    heap = [(-bound[0], 0)]
    seen = 0
    while heap:
        top, node = heapq.heappop(heap)
        kth = best[0][0] if len(best) == k else None
        kth = floor if kth is None or floor is not None and floor > kth else kth
        if kth is not None and -top + slack[node] < kth:
            break
        a, b = tree["kids"][node]
        if a >= 0:
            heapq.heappush(heap, (-bound[a], int(a)))
            heapq.heappush(heap, (-bound[b], int(b)))
            continue
        lo, hi = tree["span"][node]
        at = tree["order"][lo:hi]
        got = scores(x[at], q)
        ok = rows[at] != own
        if kth is not None:
            ok &= got >= kth
        for s, i, r in zip(got[ok].tolist(), ids[at][ok].tolist(), rows[at][ok].tolist(), strict=True):
            item = (s, -i, -r)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        seen += 1
        if leaves and seen >= leaves:
            break
    return sorted(best, reverse=True)


def packed(df: DataFrame, by: str) -> DataFrame:
    """Vectors of each value of by as one row: ids and rows as 64-bit, components as doubles, all in bytes."""

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t["v"].to_pylist(), dtype=np.float64)
        cols = [np.array(t[c].to_pylist(), dtype=np.int64).tobytes() for c in ("id", "row")]
        return pa.table({by: pa.array([t[by][0].as_py()], pa.int64()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": [cols[0]], "rows": [cols[1]], "data": [x.tobytes()]}, schema=_PACKED.insert(0, pa.field(by, pa.int64())))

    return df.groupBy(by).applyInArrow(run, f"{by} long, dim int, ids binary, rows binary, data binary")


_PACKED = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("data", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best other rows by inner product of floor(scale * x).

    vectors: vec_id, embedding. Ties go to the smaller vec_id. Vectors that are null, empty, without a vec_id, or hold
    null or non-finite components take no part; queries meet the vectors of their own length. Repeated rows are rows:
    a query skips itself alone. Fewer than k candidates give fewer rows, no rows give none; components so large that a
    product leaves the 64-bit range are not defined.

    Rows are dealt into shards of bounded size by hash, queries into blocks; every pair of the two meets once, as two
    packed rows. A first pass looks at the best leaf of every tree: the kth score found is passed to the full searches,
    which prune whole boxes by it.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), is_query.alias("asks"), F.size("embedding").alias("dim"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / SHARD).alias("shards"), F.ceil(F.greatest("q", F.lit(1)) / BLOCK).alias("blocks"))
    sizes = scratch.save(sizes)  # a row for each length of vector
    lane = lambda parts: F.pmod(F.xxhash64("row"), F.col(parts)) * 100_000 + F.col("dim")
    dealt = rows.join(sizes, "dim")
    shards = scratch.save(packed(dealt.select(lane("shards").alias("shard"), "id", "row", "v"), "shard"))
    blocks = scratch.save(packed(dealt.where("asks").select(lane("blocks").alias("block"), "id", "row", "v"), "block"))
    names = {c: f"q_{c}" for c in ("ids", "rows", "data")}
    asked = blocks.withColumnsRenamed(names).join(sizes, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    asked = asked.select((F.col("shard") * 100_000 + F.col("dim")).alias("shard"), "block", *names.values())
    pairs = shards.join(asked, "shard")

    def searched(leaves: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, tree = None, None
            for batch in batches:
                for b in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    x = np.frombuffer(b["data"]).reshape(-1, b["dim"])
                    ids, at = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["rows"], np.int64)
                    if last != b["shard"]:
                        last, tree = b["shard"], build(x)
                    q = np.frombuffer(b["q_data"]).reshape(-1, b["dim"])
                    qi, qr = np.frombuffer(b["q_ids"], np.int64), np.frombuffer(b["q_rows"], np.int64)
                    floors = dict(zip(b["floor_own"] or [], b["floor"] or [], strict=True)) if "floor" in b else {}
                    out = [(int(i), int(r), -f[1], -f[2], f[0]) for i, r, one in zip(qi, qr, q, strict=True) for f in search(tree, x, ids, at, one, int(r), k, floors.get(int(r)), leaves)]
                    cols = list(zip(*out, strict=True)) if out else [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_FOUND)

        return run

    schema = "query_id long, own long, vec_id long, row long, score long"
    best = Window.partitionBy("own").orderBy(F.col("score").desc(), "vec_id", "row")
    first = pairs.mapInArrow(searched(1), schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("own", F.col("score").alias("floor"))
    block_of = dealt.where("asks").select(F.col("row").alias("own"), lane("blocks").alias("block"))
    floors = first.join(block_of, "own").groupBy("block").agg(F.collect_list("own").alias("floor_own"), F.collect_list("floor").alias("floor"))
    floors = scratch.save(floors)  # at most BLOCK or so of them a row
    found = pairs.join(floors, "block", "left").mapInArrow(searched(None), schema)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 10
"""

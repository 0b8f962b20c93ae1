"""Order, shares and samples of rows."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import free, written


def with_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Adds the position in the frame's order, from 0, dense.

    The rows are written once with their partition's number and their place in it; then a count of each partition and its
    prefix sums, a row for each partition, make places positions. Partitions of a frame that is computed twice need not be
    the same (a sort samples its bounds), which is why it is written. No row moves, none goes through Python."""
    at, part, before = free(df.columns, "at", "part", "before")
    held = written(df.withColumn(at, F.monotonically_increasing_id()))
    where, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(where.alias(part)).agg((F.max(place) + 1).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    placed = held.join(F.broadcast(sizes), where == F.col(part))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col(before) + place).alias(name))


def dedup_first(df: DataFrame, keys: list[str] | None = None, order: str = "row_idx") -> DataFrame:
    """The first row of each key in order, rows without an order last. Partial aggregation: a frequent key is one row for
    each task."""
    names = keys or [c for c in df.columns if c != order]
    rest = [c for c in df.columns if c not in names]
    first = F.struct(F.col(order).isNull(), F.col(order))
    best = df.groupBy(*names).agg(F.min_by(F.struct(*rest), first).alias("__first"))
    return best.select(*[F.col(f"__first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def lookup(df: DataFrame, index: int, order: str = "row_idx") -> DataFrame:
    """The row at an index; negative ones count from the end. Out of range gives no row."""
    at = index if index >= 0 else df.count() + index
    return df.where(F.col(order) == at)


def first_rows(df: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    return df.where(F.col(order) < n)


def sample(df: DataFrame, count: int, seed: int, order: str = "row_idx") -> DataFrame:
    """count rows without replacement, in order: the indices that Python's seeded sample draws. Needs a dense row_idx."""
    if count < 0:
        raise ValueError("count must not be negative")
    n = df.count()
    if count >= n:
        return df.orderBy(order)
    drawn = df.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(range(n), count)], f"{order} long")
    return df.join(drawn, order, "left_semi").orderBy(order)


def sample_hashed(df: DataFrame, count: int, key: Column, seed: int) -> DataFrame:
    """count rows by least hash: the same rows on any cluster, without a global number."""
    return df.orderBy(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), key).limit(count)


def shuffled(df: DataFrame, seed: int, order: str = "row_idx") -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(order), F.lit(seed)), order)


def shard_contiguous(df: DataFrame, shards: int, index: int, order: str = "row_idx") -> DataFrame:
    """Of rows in order, the shard index; the first shards have one row more where they don't divide."""
    n = df.count()
    least, extra = divmod(n, shards)
    a = index * least + min(index, extra)
    return df.where(F.col(order).between(a, a + least + (index < extra) - 1))


def fold(df: DataFrame, folds: int, index: int, order: str = "row_idx") -> DataFrame:
    return df.where(F.pmod(F.col(order), F.lit(folds)) == index)


def chunked(df: DataFrame, chunks: int, n: int | None = None, order: str = "row_idx") -> DataFrame:
    """Adds chunk: balanced contiguous chunks, the first ones larger by one; computed from the index, without a window."""
    n = df.count() if n is None else n
    chunks = max(1, min(chunks, n))
    least, extra = divmod(n, chunks)
    edge, i = extra * (least + 1), F.col(order)
    return df.withColumn("chunk", F.when(i < edge, F.floor(i / (least + 1))).otherwise(extra + F.floor((i - edge) / max(1, least))).cast("int"))


def chunked_ceil(df: DataFrame, chunks: int, order: str = "row_idx") -> DataFrame:
    each = -(-df.count() // chunks) or 1
    return df.withColumn("chunk", F.floor(F.col(order) / each).cast("int"))


def batched(df: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(order) / size).cast("long"))


def offsets(df: DataFrame, length: Column, order: str, within: list[str] | None = None, name: str = "offset") -> DataFrame:
    """Adds the sum of the lengths before a row."""
    w = Window.partitionBy(*(within or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)))


def split_lookup(indices: DataFrame, splits: DataFrame) -> DataFrame:
    """Global indices (idx) to split and local index. splits: split, position, len; one row for each split, so few."""
    parts = offsets(splits, F.col("len"), "position")
    hit = (F.col("idx") >= F.col("offset")) & (F.col("idx") < F.col("offset") + F.col("len"))
    return indices.join(F.broadcast(parts), hit).select("idx", "split", (F.col("idx") - F.col("offset")).alias("local_idx"))


def concat(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def changed(source: DataFrame, mirror: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source that mirror lacks or has differently; null equals null."""
    theirs = free(source.columns, *(f"{k}_there" for k in keys))
    held = mirror.select(*(F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)))
    return source.join(held, [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)], "left_anti")


def unique(x: Column) -> Column:
    """The different entries of an array, in the order of their first places."""
    return F.array_distinct(x)


def flat_list(x: Column) -> Column:
    """Lists in a list as one list, in order; null lists among them are left out, one level is taken off."""
    return F.flatten(F.array_compact(x))


def in_order(mapped: DataFrame, order: str = "row_idx") -> DataFrame:
    """Results in the order of the rows that they came from, whichever task was done first; rows of errors keep their
    places. A distributed sort by ranges of the index."""
    return mapped.orderBy(F.col(order).asc_nulls_last())


def preferred(df: DataFrame, group: list[str], rank: Column, position: str, value: str) -> DataFrame:
    """The value of best rank in each group, by position among equals."""
    return df.groupBy(*group).agg(F.min_by(value, F.struct(rank, F.col(position))).alias(value))

"""A function over rows, with what became of each; retries; expensive functions once for each distinct input."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.operators.rows import chunked
from weftline.sources.tables import written

NEVER_RETRIED = (SyntaxError, NameError, ImportError, TypeError)


def retrying(fn: Callable, attempts: int = 3, wait: float = 0.1) -> Callable:
    """fn with exponential waits between attempts; errors of the program itself are not tried again."""

    def run(row):
        for k in range(attempts):
            try:
                return fn(row)
            except NEVER_RETRIED:
                raise
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)

    return run


def map_rows(df: DataFrame, fn: Callable[[dict], object], result: str, on_error: str = "raise") -> DataFrame:
    """df with result, error_type and error_message of fn for each row (a dict). result: a Spark type.

    on_error: raise fails the job at the first error, ignore and log keep the row with a null result and its error: a
    function that returns None is not a failure. Rows keep their place and never share an error. fn sees integers as
    integers and nulls as None; the columns of df pass through as they are, but for those that have one of the three names,
    which only fn sees."""
    if on_error not in ("raise", "ignore", "log"):
        raise ValueError(f"unknown policy {on_error}")

    own = ("result", "error_type", "error_message")
    passed = [f for f in df.schema.fields if f.name.lower() not in own]
    names = [*(f.name for f in passed), *own]
    kind = to_arrow_type(T._parse_datatype_string(result))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, kinds, said = [], [], []
            for row in b.to_pylist():
                try:
                    got = fn(row), None, None
                except Exception as e:
                    if on_error == "raise":
                        raise
                    got = None, type(e).__name__, str(e)
                for a, x in zip((out, kinds, said), got, strict=True):
                    a.append(x)
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in passed), pa.array(out, kind), pa.array(kinds, pa.string()), pa.array(said, pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed)
    return df.mapInArrow(run, f"{fields}{', ' if passed else ''}result {result}, error_type string, error_message string")


def process_shards(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, out: str, shards: int, order: str = "row_idx") -> str:
    """Deals rows into balanced contiguous shards, hands each one's batches in order to fn, and writes what it yields as one
    data set, <out>_size<n> for n rows, whose path is returned; one of that name is replaced.

    A shard streams through its task. Until all shards are done rows are written beside out; that folder then becomes the
    data set, or is deleted after an error, so that a failed run leaves neither."""
    spark, work = df.sparkSession, f"{out.rstrip('/')}_shards-{uuid.uuid4().hex[:12]}"
    place = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place(work).getFileSystem(spark._jsc.hadoopConfiguration())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.drop_columns(["chunk"]) for b in batches)

    placed = chunked(df, shards, order=order).repartition(shards, "chunk").sortWithinPartitions("chunk", order)
    try:
        placed.groupBy("chunk").applyInArrow(run, schema).write.parquet(work)
        final = f"{out.rstrip('/')}_size{spark.read.parquet(work).count()}"
        aside = f"{work}-before"
        had = fs.exists(place(final))
        if had and not fs.rename(place(final), place(aside)):
            raise OSError(f"{final} could not be renamed to {aside}")
        if not fs.rename(place(work), place(final)):
            if had:
                fs.rename(place(aside), place(final))
            raise OSError(f"{work} could not be renamed to {final}")
        fs.delete(place(aside), True)
    finally:
        fs.delete(place(work), True)
    return final


def good(mapped: DataFrame) -> DataFrame:
    return mapped.where("error_type IS NULL").drop("error_type", "error_message")


def quarantine(mapped: DataFrame) -> DataFrame:
    return mapped.where("error_type IS NOT NULL").drop("result")


def map_distinct(df: DataFrame, keys: list[str], fn: Callable[[dict], object], result: str, on_error: str = "raise") -> DataFrame:
    """As map_rows, but fn sees each combination of keys once."""
    once = map_rows(df.select(*keys).distinct(), fn, result, on_error)
    same = [df[k].eqNullSafe(once[k]) for k in keys]
    return df.join(once, same, "left").select(*(df[c] for c in df.columns), "result", "error_type", "error_message")


def memoised(df: DataFrame, keys: list[str], fn: Callable[[dict], object], result: str, folder: str) -> DataFrame:
    """df with result of fn for each row; results are kept by keys in a folder, and fn sees only keys that it doesn't hold.

    A folder is for one function and one choice of keys, both the caller's to name; see memo.Memo, whose store it is."""
    from weftline.operators.memo import Memo

    at, _, name = folder.rstrip("/").rpartition("/")
    return Memo(df.sparkSession, at or ".", name, result).map(df, keys, fn)


def error_report(mapped: DataFrame, examples: int = 3) -> DataFrame:
    """For each kind of error: how often, its share of all rows, and the least few messages.

    The mapped rows are computed once: a count of each kind and message is written, and all else is taken from that."""
    by = written(mapped.groupBy("error_type", "error_message").agg(F.count(F.lit(1)).alias("n")))
    total = by.agg(F.sum("n").alias("total"))
    bad = by.where("error_type IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("error_type").orderBy(F.col("error_message").asc_nulls_last()))
    few = bad.withColumn("place", place).where(F.col("place") <= examples).groupBy("error_type").agg(F.sort_array(F.collect_list("error_message")).alias("examples"))
    kinds = bad.groupBy("error_type").agg(F.sum("n").alias("errors")).join(few, "error_type")
    return kinds.join(F.broadcast(total)).select("error_type", "errors", (F.col("errors") / F.nullif("total", F.lit(0))).alias("share"), "examples")


def task_table(events: DataFrame, task: str, seconds: str) -> DataFrame:
    """Time for each task, its percentage and its grade by quarters."""
    by = events.groupBy(F.col(task).alias("task")).agg(F.sum(seconds).alias("total"))
    part = 100 * F.col("total") / F.nullif(F.lit(1.0) * F.col("all_"), F.lit(0.0))
    by = by.join(F.broadcast(by.agg(F.sum("total").alias("all_")))).withColumn("percent", part).drop("all_")
    return by.withColumn("grade", F.when(F.col("percent") >= 75, "high").when(F.col("percent") >= 50, "medium").when(F.col("percent") >= 25, "low").otherwise("minor"))

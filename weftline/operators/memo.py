"""Results kept by key in a store that grows by appending, is read by bucket and is made small again."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.identity import value_id
from weftline.operators.mapping import map_rows
from weftline.sources.tables import free, written


def _exact(kind: T.DataType) -> bool:
    """Whether rows of equal values of a type, and no others, have one identity: not so with -0.0 and NaN, or in maps."""
    if isinstance(kind, T.ArrayType):
        return _exact(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_exact(f.dataType) for f in kind.fields)
    plain = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    return isinstance(kind, plain) or kind == T.StringType()


class Memo:
    """The results of one function, by the identity of its arguments.

    A store is a folder of buckets; a key belongs to one of them. Each run appends a file for each bucket in which it has
    new results; a run reads those buckets only in which its keys are. A bucket of more than files files is written anew,
    with one row for each key, and with the most newest of them if that is given. Until the new bucket is in its place the old
    one is beside it, from where the next run takes it back if need be.

    name: of the function, and of its version: functions of different names never share results. Runs at the same time may
    both compute a key; the one that was first appended counts, whoever reads."""

    def __init__(self, spark: SparkSession, folder: str, name: str, result: str, buckets: int = 64, files: int = 8, most: int | None = None):
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError("a name has letters, digits, points and dashes")
        self.spark, self.path, self.result, self.buckets, self.files, self.most = spark, f"{folder.rstrip('/')}/{name}", result, buckets, files, most
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.schema = f"id string, result {result}, run string, at timestamp"

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _names(self, buckets: list[int]) -> list[str]:
        """Folders of the buckets that there are; one that was being written anew when a run ended is put back."""
        out = []
        for b in buckets:
            name, aside = f"bucket={b}", f"_before={b}"
            if self.fs.exists(self._at(aside)):
                if self.fs.exists(self._at(name)):
                    self.fs.delete(self._at(aside), True)
                else:
                    self.fs.rename(self._at(aside), self._at(name))
            if self.fs.exists(self._at(name)):
                out.append(name)
        return out

    def held(self, buckets: list[int]) -> DataFrame:
        """id and result of what the buckets hold: of equal keys the one that was first there."""
        names = self._names(buckets)
        if not names:
            return self.spark.createDataFrame([], f"id string, result {self.result}")
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names))
        return rows.groupBy("id").agg(F.min_by(F.struct("result"), F.struct("at", "run")).alias("r")).select("id", "r.result")

    def map(self, df: DataFrame, keys: list[str], fn: Callable[[dict], object]) -> DataFrame:
        """df with result of fn for each row; fn sees the keys only, once for each combination that the store doesn't hold.

        Null keys are keys, null results are results; an error fails the run, which then keeps nothing. Columns pass
        through as they are, but for one named result, which is replaced."""
        own, bucket = free([*df.columns, "result"], "id", "bucket")
        kept = [c for c in df.columns if c.lower() != "result"]
        named = [F.col(f"`{k}`") for k in keys]
        grouped = all(_exact(df.schema[k].dataType) for k in keys)  # rows meet their answers by their keys
        asked = df if grouped else df.withColumn(own, value_id(*named))
        every = written(df.select(*named).distinct().withColumn(own, value_id(*named))) if grouped else asked.select(*named, own)
        once = written(every.dropDuplicates([own]).withColumn(bucket, self._bucket(F.col(own))))
        buckets = sorted(r[0] for r in once.select(bucket).distinct().collect())  # at most so many numbers
        new = once.join(self.held(buckets).select(F.col("id").alias(own)), own, "left_anti")
        run = uuid.uuid4().hex
        call = lambda row: fn({k: row[k] for k in keys})
        made = map_rows(new, call, self.result).select(F.col(own).alias("id"), "result", F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.col(bucket).alias("bucket"))
        made = written(made)
        made.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(self.path)
        self.compact(buckets)
        answers = self.held(buckets).select(F.col("id").alias(own), "result")
        if self.most is not None:  # a bounded store may have let go of some already
            answers = answers.unionByName(once.join(answers, own, "left_anti").select(own).join(made.select(F.col("id").alias(own), "result"), own))
        if not grouped:
            return asked.select(*(f"`{c}`" for c in kept), own).join(answers, own).select(*(f"`{c}`" for c in kept), "result")
        (got,) = free([*df.columns, own], "got")
        answers = every.join(answers, own).select(F.struct(*named).alias(own), F.col("result").alias(got))
        return df.join(answers, F.struct(*named).eqNullSafe(F.col(own))).select(*(f"`{c}`" for c in kept), F.col(got).alias("result"))

    def compact(self, buckets: list[int] | None = None) -> int:
        """Writes buckets of too many files anew; how many there were."""
        done = 0
        for name in self._names(list(range(self.buckets)) if buckets is None else buckets):
            parts = [f for f in self.fs.listStatus(self._at(name)) if f.getPath().getName().endswith(".parquet")]
            if len(parts) <= self.files:
                continue
            rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
            first = rows.groupBy("id").agg(F.min_by(F.struct("result", "run", "at"), F.struct("at", "run")).alias("r")).select("id", "r.*")
            if self.most is not None:
                first = first.orderBy(F.col("at").desc(), "id").limit(self.most)
            new, aside = f"_new-{uuid.uuid4().hex}", f"_before={name.partition('=')[2]}"
            first.repartition(1).write.parquet(f"{self.path}/{new}")
            if not (self.fs.rename(self._at(name), self._at(aside)) and self.fs.rename(self._at(new), self._at(name))):
                raise OSError(f"{self.path}/{name} could not be replaced")
            self.fs.delete(self._at(aside), True)
            done += 1
        return done

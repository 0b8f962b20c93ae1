"""Helpers shared by the corpus operators: intermediate tables, checked broadcasts, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every contract here means: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of fixed-width keys is broadcast (8 to 32 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and one
    machine runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder. They cut lineage and survive the loss of executors.

    Tables that a returned DataFrame reads stay until the driver's process ends; drop() removes others early."""

    def __init__(self, spark: SparkSession, name: str):
        self.tables: dict[str, str] = {}
        self.spark, self.root, self.n, self.paths = spark, f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}", 0, {}
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def bucketed(self, df: DataFrame, by: str, codec: str = "zstd") -> DataFrame:
        """As save, in files dealt out by a column: joins on it leave these rows where they are."""
        self.n += 1
        path, name = f"{self.root}/{self.n}", f"weftline_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", codec).option("path", path).bucketBy(parts, by).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)], self.tables[path] = path, name
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                if name := self.tables.pop(path, None):
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self._remove(path)

    def clear(self) -> None:
        """Deletes every table of this scratch."""
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        try:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM is gone at exit; the folder is the cluster's to clean then
            pass

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of frames that are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame of narrow rows, marked for broadcast if its counted size allows it; otherwise the join shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trimmed(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{x}`") for x in names]


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and idle ones would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut into pieces of few rows, so that very long texts don't meet in Python memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        del batch
    release()

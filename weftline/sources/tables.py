"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where that is unset and one machine runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM is gone at exit; the folder is the cluster's to clean then
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, computed once: readers see the same rows however often they read, and a lost executor
    takes nothing with it. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that spread deals out, about; a task's time and memory don't grow with the table.
DEALT = 100_000


def parts(df: DataFrame, rows: int) -> int:
    """Parts of about so many rows, no fewer than cores. Rows are counted, those of a file from its own figures."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of a table dealt out over all cores and in parts of some DEALT rows, or so many, for expressions that cost more
    than a shuffle of the rows; what has partitions enough stays as it is."""
    n = parts(df, rows or DEALT)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def free(columns: list[str], *stems: str) -> list[str]:
    """Names made of the stems that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for s in stems:
        while s.lower() in taken:
            s += "_"
        taken.add(s.lower())
        out.append(s)
    return out

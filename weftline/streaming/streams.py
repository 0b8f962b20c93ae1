"""Directories as streams, and state over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.streaming.caches import limited_stream as rate_limited_stream  # noqa: F401


def watch_lines(spark: SparkSession, folder: str, suffix: str = "*.jsonl") -> DataFrame:
    """Lines of files as they appear. Files that vanish are not taken back; list again for that."""
    return spark.readStream.option("pathGlobFilter", suffix).text(folder).select(F.col("_metadata.file_path").alias("source"), "value")


def _emitted(times: list, last, interval: float) -> tuple[list[bool], object]:
    """Which of the times in order are let through, and the last that was; events without a time pass and change nothing."""
    out = []
    for t in times:
        ok = t is None or last is None or (t - last).total_seconds() >= interval
        out.append(ok)
        last = t if ok and t is not None else last
    return out, last


def rate_limited(events: DataFrame, key: str, time: str, interval: float, tie: str | None = None) -> DataFrame:
    """Events of each key that come at least interval seconds after the last one let through; by key and in order, and
    by tie among those of one time. Null is a key like any other; events without a time are let through and hold none up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), None
        for b in batches:
            keep = []
            for k, t in zip(b[key].to_pylist(), b[time].to_pylist(), strict=True):
                if k != at:  # keys come one after the other
                    at, last = k, None
                ok, last = _emitted([t], last, interval)
                keep += ok
            yield b.filter(pa.array(keep, pa.bool_()))

    # streamed in order instead of gathered by group: a key of any size needs one batch of memory
    return events.repartition(key).sortWithinPartitions(key, time, *([tie] if tie else [])).mapInArrow(run, events.schema)


def once_per_key(events: DataFrame, key: str) -> DataFrame:
    return events.dropDuplicates([key])

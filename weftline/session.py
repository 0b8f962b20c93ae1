"""Sessions with the settings that the package's results rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; conf adds to them or replaces them."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    return ship((builder.master(master) if master else builder).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import the package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])
    return spark

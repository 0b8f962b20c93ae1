"""Connected components in DataFrames: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) to (id, comp): comp is the smallest id reachable. Ids without a link are not listed.

    Every round hooks neighbours to the smallest one around them, first those above a node, then those below; the links
    become stars within few rounds. Stars are partial minima and joins: a node with very many links is not gathered."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = scratch.save(links.select(low.alias("a"), high.alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = scratch.save(large)
        least = large.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("m"))
        own = least.select(F.col("m").alias("a"), F.col("x").alias("b"))
        rest = large.join(least, F.col("b") == F.col("x")).select(F.col("m").alias("a"), F.col("a").alias("b"))
        new = scratch.save(own.unionByName(rest).where("a < b").distinct())
        scratch.drop(e, large)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("b").alias("id"), F.col("a").alias("comp")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
        before = now

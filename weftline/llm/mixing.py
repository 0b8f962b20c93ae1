"""Mixing sources to target weights: entropy balancing by distributed Newton steps, rounded into copies.

Main path in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORD, Scratch, small, table

#: Rows of one source that are rounded together; a source of any size is cut into buckets of about so many.
BUCKET = 4096
STEPS = 60
SWAPS = 8


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds sid, weight and target to one row per source (source, source_size).

    Sources are weighted in code-point order (null last). They divide share times the total by weight; where a target
    would pass cap times its source, the excess goes to the others by weight until none passes. The fixed point is
    min(cap * size, weight * level): sources are filled in the order of cap * size / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("sid", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("limit", cap * F.col("source_size"))
    all_, before = Window.partitionBy(), Window.orderBy(F.col("limit") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", share * F.sum("source_size").over(all_))
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("full", F.col("limit") * open_ <= F.col("weight") * left)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(all_)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(all_)
    return s.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * rest / F.nullif(free, F.lit(0.0))))


def balance(hist: DataFrame, sources: DataFrame, cap: float, scratch: Scratch) -> DataFrame:
    """Adds lam to the sources: document rates min(cap, exp(lam * size / scale)) take the target in expectation.

    The dual of "closest rates to one in relative entropy, at most cap, whose words meet the target" has one multiplier
    for each source. Every Newton step is one aggregation over the histogram of sizes (sid, size, n); a bracket guards
    it. hist holds all rows exactly, and no step reads the documents."""
    up = F.col("target") > F.col("source_size")
    state = sources.select(
        "sid", "target", "scale", "full", F.lit(0.0).alias("lam"), F.lit(False).alias("done"),
        F.when(up, F.lit(0.0)).otherwise(F.col("scale") * F.log(F.col("target") / F.col("source_size"))).alias("lo"),
        F.when(up, F.col("scale") * F.log(F.lit(cap))).otherwise(F.lit(0.0)).alias("hi"),
    ).where("NOT full AND target > 0")
    state = scratch.save(state)
    for _ in range(STEPS):
        z = F.col("size") / F.col("scale")
        e = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        took = F.col("n") * F.col("size") * F.least(e, F.lit(cap))
        slope = F.when(e < cap, F.col("n") * F.col("size") * z * e).otherwise(0.0)
        sums = hist.join(small(state.where("NOT done").select("sid", "scale", "lam")), "sid").groupBy("sid").agg(F.sum(took).alias("f"), F.sum(slope).alias("g"))
        near = F.abs(F.col("f") - F.col("target")) <= F.greatest(F.lit(0.25), 1e-9 * F.col("target"))
        lo, hi = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("f") - F.col("target")) / F.nullif(F.col("g"), F.lit(0.0))
        stepped = state.join(sums, "sid", "left").withColumns({"lo2": lo, "hi2": hi, "step": step, "near": F.coalesce(near, F.lit(True)) | F.col("done")})
        guarded = F.when(F.col("step").isNull() | (F.col("step") <= F.col("lo2")) | (F.col("step") >= F.col("hi2")), (F.col("lo2") + F.col("hi2")) / 2).otherwise(F.col("step"))
        new = scratch.save(stepped.select("sid", "target", "scale", "full", F.when(F.col("near"), F.col("lam")).otherwise(guarded).alias("lam"), F.col("near").alias("done"), F.when(F.col("near"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"), F.when(F.col("near"), F.col("hi")).otherwise(F.col("hi2")).alias("hi")))
        scratch.drop(state)
        state = new
        if state.where("NOT done").isEmpty():
            break
    return sources.join(small(state.select("sid", "lam")), "sid", "left")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, rate, copies, taken.

    size counts words (null text: 0); a null source is a source of its own, last in order; a document without words has
    rate 1. Rates become copies by systematic rounding in order of size, in buckets of bounded size, with offsets from
    hashes: reruns agree. Then, source by source, copies are added or withdrawn where that brings the words taken closer
    to the target, however far rounding of long documents has left them. copies is at most cap. No rows give no rows; other columns are not looked at.

    The documents are read once; all later steps read narrow rows, and the Newton steps a histogram of sizes. A source
    that holds a third of all rows is cut into buckets; per-source tables have one row per source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rows = scratch.save(docs.select("doc_id", "source", words.alias("size"), F.monotonically_increasing_id().alias("row")))
    hist = scratch.save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size") * F.col("size").cast("double") * F.col("n")).alias("squares"), F.sum("n").alias("rows"))
    sources = targets(per, weights, share, float(cap))
    sources = sources.withColumns({"scale": F.coalesce(F.col("squares") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(1.0)), "buckets": F.ceil(F.col("rows") / BUCKET)})
    sources = scratch.save(sources.select("source", "sid", "source_size", "target", "full", "scale", "buckets"))
    named = sources.select(F.col("source").alias("source2"), "sid")
    hist = scratch.save(hist.join(small(named), F.col("source").eqNullSafe(F.col("source2"))).select("sid", "size", "n"))
    solved = scratch.save(balance(hist, sources, float(cap), scratch))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).when(F.col("lam").isNull(), 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    key = F.xxhash64("doc_id", "size")
    at = rows.join(small(solved.withColumnRenamed("source", "source2")), F.col("source").eqNullSafe(F.col("source2")))
    at = at.select("sid", "row", "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), key.alias("key"), F.pmod(key, F.col("buckets")).alias("bucket"))
    part = F.col("rate") - F.floor("rate")
    sum_ = F.sum(part).over(Window.partitionBy("sid", "bucket").orderBy("size", "key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    shift = F.pmod(F.xxhash64("sid", "bucket"), F.lit(1 << 20)) / float(1 << 20)
    at = at.withColumn("sum", sum_).withColumn("copies", (F.floor("rate") + F.floor(F.col("sum") + shift) - F.floor(F.col("sum") - part + shift)).cast("int"))
    at = scratch.save(at.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.lit(cap)))).drop("sum"))
    return adjust(at, cap, scratch)


def filled(at: DataFrame, gaps: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """Moves (sid, row, by, size) of one copy each that bring every source nearer to its target and not beyond it.

    Copies are added, or withdrawn, from the largest sizes that fit the gap down, by a prefix sum over the histogram of
    sizes that can move; of the size at which the gap ends only as many as fit, those of least bucket and hash. What is
    left is less than half of the gap, unless no size that fits can move."""
    tries = at.where("size > 0").join(small(gaps.where("gap <> 0")), "sid").withColumn("by", F.signum("gap").cast("int"))
    tries = tries.where((F.col("copies") + F.col("by")).between(0, cap) & (F.col("size") <= F.abs("gap")))
    hist = tries.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n"), F.first(F.abs("gap")).alias("open"))
    larger = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    fits = F.floor((F.col("open") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))) / F.col("size"))
    hist = scratch.save(hist.withColumn("pick", F.least("n", fits)).where("pick > 0").select("sid", "size", "n", "pick"))
    rows = tries.join(small(hist), ["sid", "size"]).select("sid", "row", "by", "size", "n", "pick", "bucket", "key", "doc_id")
    part = rows.where("pick < n")
    lower = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("sid", "bucket").agg(F.count(F.lit(1)).alias("m")).select("sid", "bucket", F.coalesce(F.sum("m").over(lower), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "row"))
    some = part.withColumn("place", place).join(starts, ["sid", "bucket"]).where(F.col("start") + F.col("place") <= F.col("pick"))
    whole = rows.where("pick = n")
    return scratch.save(whole.select("sid", "row", "by", "size").unionByName(some.select("sid", "row", "by", "size")))


def adjust(at: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """Moves each source to its target: by the one copy that brings the words taken closest, which takes back what the
    rounding of a long document did, then by many at once, as long as whole documents fit the gap; and so again, until
    no single copy brings a source closer."""
    gaps = scratch.save(at.groupBy("sid").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("took")).select("sid", (F.col("t") - F.col("took")).alias("gap")))
    moves: list[DataFrame] = []

    def now() -> DataFrame:
        if not moves:
            return at
        done = reduce(DataFrame.unionByName, moves).groupBy(F.col("row").alias("row2")).agg(F.sum("by").alias("by"))
        return at.join(small(done), F.col("row") == F.col("row2"), "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0)).cast("int")).drop("row2", "by")

    def moved(gaps: DataFrame, by: DataFrame) -> DataFrame:
        moves.append(by.select("row", "by"))
        sums = by.groupBy("sid").agg(F.sum(F.col("by") * F.col("size")).alias("by"))
        return scratch.save(gaps.join(sums, "sid", "left").select("sid", (F.col("gap") - F.coalesce("by", F.lit(0))).alias("gap")))

    for _ in range(SWAPS):
        tries = now().where("size > 0").join(small(gaps), "sid")
        tries = tries.withColumn("by", F.explode(F.array(F.lit(1), F.lit(-1)))).where((F.col("copies") + F.col("by")).between(0, cap))
        left = F.abs(F.col("gap") - F.col("by") * F.col("size"))
        best = tries.where(left < F.abs("gap")).groupBy("sid").agg(F.min(F.struct(left.alias("left"), "size", "by", "key", "doc_id", "row")).alias("b"))
        best = scratch.save(best.select("sid", "b.row", "b.by", "b.size"))
        if best.isEmpty():
            break
        gaps = moved(gaps, best)
        while not (best := filled(now(), gaps, cap, scratch)).isEmpty():  # every pass halves what is left
            gaps = moved(gaps, best)
    return now().select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")

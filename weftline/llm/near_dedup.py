"""Near-duplicates: bottom-k sketches of one hash, inverted lists, union-sketch filter, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, small, table
from weftline.llm.graph import components

#: Values of a sketch; lists that a candidate pair must share, while they are short; length of a long list, in which hubs
#: are tried first; hub rounds.
K, COUNT, LONG, ROUNDS = 64, 8, 32, 3
#: Rounds in which large groups are told apart by differences from a hub.
LEVELS = 4
#: Comparisons by their numbers of differences that each member of a group may take.
COMPARED = 512
#: Partners that each unit is compared with before the others.
FIRST = 4
#: Differences that a task lists.
VALUES = 1 << 16
#: Long lists of a unit that hubs are looked for in, and how many of them must name the same hub.
TRIED, AGREE = 8, 3
#: A pair is dropped unseen only if its sketch estimate lies so many standard deviations under the wanted similarity.
DOUBT = 6


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; A-Z lower-cased, words between white space.

    With fewer words the whole sequence is one shingle; without words there is none."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.int64)
    runs = set(zip(*(w[k:] for k in range(words)), strict=False)) or {tuple(w)}
    h = xxhash.xxh3_64_intdigest
    a = np.fromiter((h(b" ".join(r)) for r in runs), dtype=np.uint64, count=len(runs))
    a.sort()
    return (a ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the same order


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, n, set_key, sketch of each row; set_key is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            n, key, sketch = [], [], []
            for t in b["text"].to_pylist():
                a = shingle_hashes(t, words)
                n.append(len(a))
                key.append(xxhash.xxh3_128_digest(a.tobytes()) if len(a) else None)
                sketch.append(a[:K])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "set_key", "sketch"])

    d = keyed(docs)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_key long, n long, set_key binary, sketch array<long>")


def bound(n: Column, percent: int) -> Column:
    """Share of a union sketch that a similar pair has in common, if its smaller set has n values.

    Its union has at most 100 * n / percent values. A sketch that holds them all is exact; one that draws K of them
    without replacement deviates the less, the fewer are left out."""
    p, most = percent / 100, n * 100 / percent
    left = F.greatest(F.lit(0.0), most - K) / F.greatest(F.lit(1.0), most - 1)
    return F.greatest(F.lit(0.0), p - DOUBT * (p * (1 - p) / K) ** 0.5 * F.sqrt(left) - 1e-9)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def full_sets(asked: DataFrame, units: DataFrame, docs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """uid, hashes: the full sets of the units asked for, made again from whole texts."""
    asked = scratch.save(units.join(small(scratch.save(asked)), "uid").select("uid", "text_key", "set_key"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            got = [shingle_hashes(t, words) for t in b["text"].to_pylist()]
            keep = [k for k, (g, key) in enumerate(zip(got, b["set_key"].to_pylist(), strict=True)) if xxhash.xxh3_128_digest(g.tobytes()) == key]
            yield pa.RecordBatch.from_arrays([b["uid"].take(pa.array(keep, pa.int64())), pa.array([got[k].tobytes() for k in keep], pa.binary())], names=["uid", "hashes"])

    # one text of each unit: copies are folded before they are dealt out
    text = keyed(docs).join(small(asked.select("text_key").distinct()), "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    sets = scratch.save(text.join(asked, "text_key").select("uid", "set_key", "text").mapInArrow(full, "uid long, hashes binary"))
    scratch.drop(asked)
    return sets


def differences(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members (hub, uid, comp, hub_comp, score) with what their full sets and their hub's don't share: linked, near, most, asks, d, n.

    near units are linked to the hub or have its component already. Let two similar sets differ from the hub's by da and
    db values, of which they have s in common: their own difference is da + db - 2 * s. If one of them is not similar to
    the hub, s exceeds half of db - (n - n_hub) * (100 - percent) / (100 + percent), as follows from the definition of
    similar. most is how many of its values, whichever come first, a unit is to be listed under for that; asks is how many
    one that is not near looks among for units that are, since it has at least da - n * (100 - percent) / percent in common
    with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            linked, most, asks, d, n = [], [], [], [], []
            for x, y in zip(b["own"].to_pylist(), b["its"].to_pylist(), strict=True):
                own, its = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                other = np.setxor1d(own, its, assume_unique=True)
                linked.append((100 - percent) * (len(own) + len(its)) >= (100 + percent) * len(other))
                shared = ((100 + percent) * len(other) - (100 - percent) * (len(own) - len(its))) // (2 * (100 + percent)) + 1
                most.append(len(other) - shared + 1)
                asks.append(len(other) - max(1, -((100 - percent) * len(own) - percent * len(other)) // percent) + 1)
                d.append(other.tobytes())
                n.append(len(own))
            cols = [*(b[c] for c in ("hub", "uid", "comp", "hub_comp", "score")), pa.array(linked, pa.bool_()), pa.array(most, pa.int64()), pa.array(asks, pa.int64()), pa.array(d, pa.binary()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["hub", "uid", "comp", "hub_comp", "score", "linked", "most", "asks", "d", "n"])

    own, its = (sets.select(F.col("uid").alias(k), F.col("hashes").alias(v)) for k, v in (("uid", "own"), ("hub", "its")))
    found = members.join(own, "uid").join(its, "hub").mapInArrow(run, "hub long, uid long, comp long, hub_comp long, score double, linked boolean, most long, asks long, d binary, n long")
    found = found.withColumn("near", F.col("linked") | (F.col("comp") == F.col("hub_comp")))
    return scratch.save(found.withColumn("comp", F.when(F.col("near"), F.col("hub_comp")).otherwise(F.col("comp"))).drop("hub_comp"))


def relisted(found: DataFrame) -> DataFrame:
    """Groups (g, uid, comp, score, role, n, d, at) of units that share a difference from a hub; see differences.

    Under the rarest of its differences, as many as most says, a unit is listed; near ones have role 0, others role 1.
    The others ask under more of theirs, with role 2. Two near units are connected already. d is how many differences a
    unit has, at how many of them come before this one."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for hub, uid, x in zip(b["hub"].to_pylist(), b["uid"].to_pylist(), b["d"].to_pylist(), strict=True):
                d = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), hub)), pa.array(np.full(len(d), uid)), pa.array(d)], names=["hub", "uid", "v"])

    total = found.agg(F.sum(F.octet_length("d"))).first()[0] or 0
    even = found.select("hub", "uid", "d").repartition(-(-total // (8 * VALUES)) or 1)  # a hub's members are not left in one task
    every = even.mapInArrow(values, "hub long, uid long, v long")
    often = every.groupBy("hub", "v").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    hits = every.join(often, ["hub", "v"]).groupBy("hub", "uid").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("hits"))  # of one set
    hits = found.select("hub", "uid", "comp", "score", "near", "most", "asks", "n", (F.octet_length("d") / 8).cast("long").alias("d")).join(hits, ["hub", "uid"])
    hits = hits.withColumn("alone", F.col("d") - F.size("hits"))  # values that only it has come first
    upto = F.greatest(F.lit(0), F.greatest("most", F.when(~F.col("near"), F.col("asks"))) - F.col("alone")).cast("int")
    hits = hits.select("*", F.posexplode(F.slice("hits", F.lit(1), upto)).alias("nth", "hit")).withColumn("at", F.col("alone") + F.col("nth"))
    role = F.when(F.col("near"), 0).when(F.col("at") < F.col("most"), 1).otherwise(2)
    return hits.select(F.xxhash64("hub", "hit.v").alias("g"), "uid", "comp", "score", role.alias("role"), "n", "d", "at")


def told_apart(groups: DataFrame, units: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b) and pairs (a, b) still to confirm, for groups (g, uid, comp, score, role, n, d, at) of units that may be similar.

    The members of a group are paired where that takes up to LONG comparisons for each, or COMPARED where their numbers of
    differences tell most pairs apart. In another one they are compared with one hub only, the one of largest score: those that are
    not connected to it must share differences from it with any partner, which makes new and smaller groups. Differences
    are from full sets and nothing is left out; after LEVELS rounds what is still large is paired as it is."""
    links, pairs, sets = [], [], None
    for level in range(LEVELS + 1):
        asked = F.expr("count_if(role = 0) * count_if(role > 0) + count_if(role = 1) * (count_if(role = 1) - 1) / 2")
        sized = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.max_by(F.struct("uid", "comp"), F.struct("score", "uid")).alias("h"), asked.alias("asked"))
        sized = small(scratch.save(sized.where("asked > 0 AND m > 1")))
        last, fits = level == LEVELS, F.col("asked") <= (COMPARED if level else LONG) * F.col("m")
        few = groups.join(sized.where(F.lit(last) | fits).select("g"), "g").drop("score")
        other = few.select("g", *(F.col(x).alias(f"{x}2") for x in ("uid", "comp", "role", "n", "d", "at")))
        # if this is the first difference that two have in common, they have no more in common than what follows it in either
        share = 2 * (100 + percent) * F.least(F.col("d") - F.col("at"), F.col("d2") - F.col("at2")) >= (100 + percent) * (F.col("d") + F.col("d2")) - (100 - percent) * (F.col("n") + F.col("n2"))
        size = F.greatest("n", "n2") * percent <= F.least("n", "n2") * 100
        met = few.join(other, "g").where(F.expr("uid < uid2 AND comp <> comp2 AND role + role2 BETWEEN 1 AND 2") & share & size)
        pairs.append(scratch.save(met.select(F.col("uid").alias("a"), F.col("uid2").alias("b")).distinct()))
        large = sized.where(~fits)
        if last or large.isEmpty():
            break
        ours = groups.join(large, "g").groupBy(F.col("h.uid").alias("hub"), "uid").agg(F.min("comp").alias("comp"), F.min("h.comp").alias("hub_comp"), F.min("score").alias("score"))
        ours = scratch.save(ours)
        if sets is None:
            sets = full_sets(ours.select("uid").distinct(), units, docs, words, scratch)
        found = differences(ours, sets, percent, scratch)
        links.append(found.where("linked AND uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")))
        groups = scratch.save(relisted(found))
        scratch.tidy()
    return links, pairs


def confirm(pairs: DataFrame, units: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of units whose full sets are similar enough.

    The union sketch of a pair estimates its similarity and removes what is far below; the full sets of the others are
    made again from the whole texts and compared."""
    side = lambda x: units.select(F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    p = p.withColumn("union", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K))
    both = F.size(F.array_intersect("union", F.array_intersect("sa", "sb")))
    p = p.where(both >= bound(F.least("na", "nb"), percent) * F.size("union"))
    p = scratch.save(p.select("a", "b"))
    made = sets is None
    if made:
        sets = full_sets(members(p), units, docs, words, scratch)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keep = []
            for k, (x, y) in enumerate(zip(b["ha"].to_pylist(), b["hb"].to_pylist(), strict=True)):
                m, n = len(x) // 8, len(y) // 8
                same = len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                if 100 * same >= percent * (m + n - same):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b["a"].take(at), b["b"].take(at)], names=["a", "b"])

    side = lambda x: sets.select(F.col("uid").alias(x), F.col("hashes").alias(f"h{x}"))
    out = scratch.save(p.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a long, b long"))
    scratch.drop(p, *([sets] if made else []))
    return out


def members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. component_id is the smallest
    doc_id reachable, kept says that it is the row's own. Null, empty and blank texts have no shingles and no links; a
    null doc_id is never smaller than another and stays in its own component if it has no partner. Repeated rows are
    members like any others. No rows give no rows; other columns are not looked at.

    Rows with equal sets become one unit, so that copies cost one row. A similar pair shares a known part of its two
    K-value sketches (see bound); each unit is therefore listed under its rarest retained values
    only, as many as make a similar pair meet in one list, in up to COUNT if the further ones are short, and values of a
    single unit under none. A unit with too few values that others have is not listed at all. In long lists,
    one hub a round, the one of largest score first, is compared with the members, which joins large groups of near copies at one pair for
    each member. Then the pairs of different components in short lists are confirmed, and long lists are told apart by
    their members' differences from a hub (see told_apart): no list is cut, and none is paired out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = scratch.save(sketches(docs, words))
    units = rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("text_key").alias("text_key"))
    # min text_key: the smallest of all keys whose text has this set
    units = scratch.save(units.withColumn("uid", F.monotonically_increasing_id()))
    index = scratch.save(inverted(units, percent))
    scratch.tidy()
    size = F.greatest("n", "n2") * percent <= F.least("n", "n2") * 100
    long_ = scratch.save(index.groupBy("v").count().where(F.col("count") > LONG).select("v", "count"))
    tried = index.join(small(long_), "v").groupBy("uid", "n", "score").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "v"))), 1, TRIED).alias("l"))
    tried = scratch.save(tried.select("uid", "n", "score", F.explode("l.v").alias("v")))
    comp, links = None, []
    for turn in range(ROUNDS):
        lists = at(tried, comp)
        by = F.struct("score", "uid") if turn == 0 else F.struct(F.xxhash64("uid", F.lit(turn)))
        hubs = lists.groupBy("v").agg(F.max_by(F.struct("uid", "n", "comp"), by).alias("h"))
        tries = lists.join(hubs, "v").select("uid", "n", "comp", F.col("h.uid").alias("hub"), F.col("h.n").alias("n2"), F.col("h.comp").alias("comp2"))
        tries = tries.where((F.col("comp") != F.col("comp2")) & size).groupBy("uid", "hub").agg(F.count(F.lit(1)).alias("met"), F.min("comp2").alias("comp2"))
        tries = scratch.save(tries.where(F.col("met") >= AGREE).groupBy(F.col("uid").alias("a")).agg(F.max_by(F.struct(F.col("hub").alias("b"), "comp2"), F.struct("met", -F.col("hub"))).alias("t")).select("a", "t.*"))
        if tries.isEmpty():
            break
        found = confirm(tries.select("a", "b"), units, docs, words, percent, scratch)
        links.append(found)
        # a unit takes the component that its hub had: equal names are connected, though not all that are have one name
        new = found.join(tries, ["a", "b"]).select(F.col("a").alias("id"), F.col("comp2").alias("comp"), F.lit(turn).alias("turn"))
        new = new if comp is None else new.unionByName(comp.withColumn("turn", F.lit(-1)))
        comp = scratch.save(new.groupBy("id").agg(F.max_by("comp", "turn").alias("comp")))
        scratch.tidy()
    lists = at(index, comp)
    mixed = lists.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("v")
    lists = scratch.save(lists.join(mixed, "v", "left_semi"))
    long_ = scratch.save(lists.groupBy("v").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > LONG).select("v"))
    inside = scratch.save(lists.join(small(long_), "v").groupBy("uid").agg(F.count(F.lit(1)).alias("l")))
    short = lists.join(small(long_), "v", "left_anti").join(small(inside), "uid", "left").withColumn("l", F.coalesce("l", F.lit(0).cast("long")))
    other = short.select("v", *(F.col(x).alias(f"{x}2") for x in ("uid", "n", "comp", "c", "l")))
    pairs = short.join(other, "v").where((F.col("uid") < F.col("uid2")) & (F.col("comp") != F.col("comp2")) & size)
    pairs = pairs.groupBy(F.col("uid").alias("a"), F.col("uid2").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("c", "c2") - F.least("l", "l2")).alias("least"))
    pairs = scratch.save(pairs.where("shared >= least").select("a", "b"))  # of the lists that they must share, so many are short
    # in long lists, similar sizes are in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    groups = lists.join(small(long_), "v").withColumn("band", F.explode(F.array(band, band - 1)))
    groups = scratch.save(groups.select(F.xxhash64("v", "band").alias("g"), "uid", "comp", "score", F.lit(1).alias("role"), "n", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("at")))
    scratch.tidy()
    more, apart = told_apart(groups, units, docs, words, percent, scratch)
    links += more
    for x in apart:
        pairs = pairs.unionByName(x)
    pairs = scratch.save(pairs.distinct())
    sets = full_sets(members(pairs), units, docs, words, scratch)
    comp = settled(pairs, links, lambda x: confirm(x, units, docs, words, percent, scratch, sets), scratch)
    least = comp.join(units.select(F.col("uid").alias("id"), "first"), "id").groupBy("comp").agg(F.min("first").alias("component_id"))
    known = comp.join(small(scratch.save(least)), "comp").select(F.col("id").alias("uid"), F.col("component_id"), F.lit(True).alias("linked"))
    named = units.select("uid", "set_key", "first").join(known, "uid", "left")
    named = scratch.save(named.select("set_key", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")))
    out = rows.select("doc_id", "n", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def inverted(units: DataFrame, percent: int) -> DataFrame:
    """v, uid, n, c, score: the rarest retained values of each unit, and how many lists a similar pair shares at least.

    score is how common a unit's retained values are: in a group of near copies it is largest in their midst."""
    values = units.select("uid", F.explode("sketch").alias("v"))
    often = values.groupBy("v").count().where("count >= 2")
    hits = values.join(often, "v").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("count", "v"))).alias("hits"))  # at most K
    at_ = units.select("uid", "n", F.size("sketch").alias("len")).join(hits, "uid")
    at_ = at_.withColumn("score", F.aggregate("hits", F.lit(0.0), lambda a, x: a + F.log2(x["count"].cast("double"))) / F.col("len"))
    shared = F.greatest(F.lit(1), F.ceil(bound(F.col("n"), percent) * F.col("len"))).cast("int")
    # one list that a similar pair shares needs all but shared - 1 of the hits; each further one needs the next hit
    at_ = at_.withColumn("shared", shared).withColumn("need", F.size("hits") - F.col("shared") + 1).where("need > 0")
    more = F.filter(F.slice("hits", F.col("need") + 1, F.least(F.lit(COUNT), F.col("shared")) - 1), lambda x: x["count"] <= LONG)
    at_ = at_.withColumn("c", F.size(more) + 1)
    return at_.select("uid", "n", "c", "score", F.explode(F.slice("hits", 1, F.col("need") + F.col("c") - 1)).alias("hit")).select("hit.v", "uid", "n", "c", "score")


def at(frame: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Adds the component so far of each uid; without a link it is its own."""
    if comp is None:
        return frame.withColumn("comp", F.col("uid"))
    return frame.join(comp, frame.uid == comp.id, "left").withColumn("comp", F.coalesce("comp", "uid")).drop("id")


def settled(pairs: DataFrame, links: list[DataFrame], check, scratch: Scratch) -> DataFrame:
    """Components (id, comp) of the links and of those pairs that check finds to be links.

    Each unit is compared with its FIRST partners of smallest uid first. What that connects needs no further comparison;
    all other pairs are checked, so that no link between components is missed."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("nth") <= FIRST)
    best = scratch.save(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links.append(check(best))
    comp = joined(links, scratch)
    name = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    left = pairs.join(best, ["a", "b"], "left_anti").join(name("a"), "a", "left").join(name("b"), "b", "left")
    pairs = scratch.save(left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    scratch.tidy()
    links.append(check(pairs))
    return joined(links, scratch)


def joined(links: list[DataFrame], scratch: Scratch) -> DataFrame:
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return scratch.save(components(every, scratch))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)

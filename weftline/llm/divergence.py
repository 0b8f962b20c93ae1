"""Source divergence audit: chi-square divergences of word distributions between the sources of a language."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, release, small, table

#: Documents of a language that a term must occur in; the unit of probabilities; ranks of terms that are listed.
LEAST_DOCS, UNIT, RANKS = 3, 1_000_000_000, 200
#: Counts that a task holds before it hands them on; bytes of a text that are split at a time.
HELD, PIECE = 400_000, 4 << 20
#: Bytes of a term: A-Z as a-z, a-z and all of letters beyond ASCII; the others are blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, a few MB at a time."""
    raw = text.translate(TERM_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold the term); term null, for each group, however empty.

    Counted within tasks first: what is shuffled is a group's vocabulary of a task, not words. It is dealt out by language
    and term, so that what a language says of a term needs no other shuffle; a term has a row for each task and source at
    most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs, holds, held, groups = defaultdict(Counter), defaultdict(Counter), 0, set()

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in occurs.items():
                terms, docs = list(found), holds[lang, source]
                for k in range(0, len(terms), 20_000):
                    some = terms[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode("utf-8", "replace") for t in some], pa.string()),
                         pa.array([found[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            occurs.clear(), holds.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
                group, own = (lang, source), Counter()
                groups.add(group)
                for some in pieces(text.as_py()):
                    own.update(some)
                held -= len(occurs[group])
                occurs[group].update(own)
                holds[group].update(own.keys())
                held += len(occurs[group])
                if held > HELD:
                    yield from given()
                    held = 0
        yield from given()
        if groups:
            langs, sources = zip(*sorted(groups), strict=True)
            none = [0] * len(langs)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.nulls(len(langs), pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        release()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    parts = docs.select(text("lang"), text("source"), raw).mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, exactly: 1 + floor(UNIT * (count + 1) / (total + terms)); null without terms. Decimals are for counts
    whose product a long can't hold."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = F.lit(UNIT).cast("decimal(10,0)") * wide(count + 1), F.nullif(wide(total + terms), F.lit(0).cast("decimal(19,0)"))
    narrow = F.call_function("div", F.lit(UNIT).cast("long") * (count + 1), F.nullif(total + terms, F.lit(0).cast("long")))
    return F.lit(1) + F.when(count < 2**63 // UNIT - 1, narrow).otherwise(F.call_function("div", top, bottom))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most UNIT + 1, so that a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's words are from the other sources of its language.

    Part pair: for each other source of the language, the sum of price(p, q) over all kept terms. Part term: a group's
    terms of p above the language's q, by price, ranks up to ranks. Null text, lang and source are empty strings; every
    row is a document, repeated or not; a language without kept terms has pairs of value 0; one source alone has none; no
    rows give no rows; ties go by item; columns other than lang, source and text are not looked at.

    Of a pair (g, h) with V kept terms, let z be the p of count 0. If every term were of one side only,
        V * price(zg, zh) + sum over g's terms of (price(p, zh) - price(zg, zh)) + sum over h's of (price(zg, q) - price(zg, zh))
    would be the sum: the first part is for the terms of neither, the others need the histogram of counts of a group only.
    A term of both is in both sums; what it has too much or too little comes from a join of the postings by term, which
    makes rows for terms and pairs of sources that hold them, never for terms that a side lacks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"all": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    counts = scratch.save(counts.where(F.col("term").isNull() | (F.col("docs") >= LEAST_DOCS)).drop("docs"))
    rows = counts.where("term IS NOT NULL")
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = rows.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(terms, "lang", "left").join(sizes, ["lang", "source"], "left")
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("terms", "total", "lang_total")))
    groups = scratch.save(groups.withColumn("z", share(none, F.col("total"), F.col("terms"))))
    known = small(groups, 100_000)
    rows = rows.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    postings = scratch.save(rows.select("lang", "source", "term", "n", "p", "z", share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")))

    side = lambda df, s, *names: df.select("lang", *(F.col(n).alias(f"{n}_{s}") for n in names))
    both = lambda left, right: F.explode(F.array(*(F.struct(F.col(f"source_{a}").alias("source"), F.col(f"source_{b}").alias("item"), v.alias("v")) for a, b, v in (("a", "b", left), ("b", "a", right))))).alias("x")
    z_a, z_b, p_a, p_b = (F.col(c) for c in ("z_a", "z_b", "p_a", "p_b"))
    # terms of one side: a histogram of counts, priced against each other source's z
    hist = scratch.save(postings.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("m")))
    one = side(hist, "a", "source", "p", "z", "m").join(small(side(groups, "b", "source", "z"), 100_000), "lang").where("source_a <> source_b")
    one = one.groupBy("lang", "source_a", "source_b").agg(
        F.sum(F.col("m_a") * (price(p_a, z_b) - price(z_a, z_b))).alias("as_p"), F.sum(F.col("m_a") * (price(z_b, p_a) - price(z_b, z_a))).alias("as_q")
    )
    one = one.select("lang", both(F.col("as_p"), F.col("as_q"))).select("lang", "x.*")
    # terms of both: postings met by term
    met = side(postings, "a", "term", "source", "p", "z").withColumnRenamed("term_a", "term").join(side(postings, "b", "term", "source", "p", "z").withColumnRenamed("term_b", "term"), ["lang", "term"]).where("source_a < source_b")
    fix = lambda p, q, zp, zq: price(p, q) - price(p, zq) - price(zp, q) + price(zp, zq)
    met = met.groupBy("lang", "source_a", "source_b").agg(F.sum(fix(p_a, p_b, z_a, z_b)).alias("ab"), F.sum(fix(p_b, p_a, z_b, z_a)).alias("ba"))
    met = met.select("lang", both(F.col("ab"), F.col("ba"))).select("lang", "x.*")
    # terms of neither: a constant a pair
    zero = side(groups, "a", "source", "z", "terms").join(small(side(groups, "b", "source", "z"), 100_000), "lang").where("source_a <> source_b")
    zero = zero.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.coalesce(F.col("terms_a") * price(z_a, z_b), none).alias("v"))
    pairs = zero.unionByName(one).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("v").alias("value")).withColumn("part", F.lit("pair"))
    told = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", ranked).select(columns).unionByName(told.withColumn("rank", ranked).where(F.col("rank") <= ranks).select(columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.n AS n_lang, count(w.term) AS n
      FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL),
p AS (SELECT *, 1 + 1000000000 * (n + 1)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
             1 + 1000000000 * (n_lang + 1)::HUGEINT // (sum(n_lang) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q FROM c),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

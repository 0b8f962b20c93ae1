"""Personal data: base patterns, and terms that disclose protected entities by corpus co-occurrence.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, small, table

#: Fixed patterns of the base kinds, in the order in which spans are listed. Repetitions that can't be given back are
#: possessive and runs begin at their first character (or where the last match ended), so that long runs cost no squares.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9][\x20().0-9-]{8}"}
BASE = tuple(PATTERNS)
TERM = "term"
KINDS = (*BASE, TERM)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Letters of a term; documents of different content in which an entity and a term must meet; shares of an entity's
#: information that a term may disclose before it is generalised, and before it is removed.
LETTERS, CONTEXTS, GENERALISE, REMOVE = 4, 3, 0.9, 0.98
#: Pieces by which running sums over an array are taken.
STEP = 256


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lens: Column) -> Column:
    """Sums of the earlier elements of an array of longs; in pieces, so that long arrays don't cost squares."""
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(lens) / STEP).cast("int") - 1))
    piece = lambda c: F.slice(lens, c * STEP + 1, STEP)
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    sums = F.transform(cuts, lambda c: F.aggregate(piece(c), F.lit(0).cast("long"), lambda a, x: a + x))
    heads = F.aggregate(sums, F.array(F.lit(0).cast("long")), grow)
    within = lambda h: F.transform(cuts, lambda c: F.aggregate(piece(c), F.array(F.element_at(h, c + 1)), grow))
    return F.flatten(F.transform(let(heads, within), lambda w: F.slice(w, 1, F.size(w) - 1)))


def matches(text: Column, kind: str, pattern: str) -> Column:
    """start, k, end, kind, value, share of all leftmost matches that don't overlap, in code points; k is the kind's place."""
    both, k = F.lit(rf"(?s)\G(.*?)({pattern})"), KINDS.index(kind)
    found = F.struct(F.transform(F.regexp_extract_all(text, both, F.lit(1)), lambda g: F.length(g).cast("long")).alias("gap"), F.regexp_extract_all(text, both, F.lit(2)).alias("hit"))

    def placed(f: Column) -> Column:
        begin = lambda lens: F.zip_with(running(lens), f["gap"], lambda a, g: a + g)
        begins = let(F.zip_with(f["gap"], f["hit"], lambda g, h: g + F.length(h)), begin)
        return F.zip_with(begins, f["hit"], lambda b, h: F.struct(b.alias("start"), F.lit(k).alias("k"), (b + F.length(h)).alias("end"), F.lit(kind).alias("kind"), h.alias("value"), F.lit(None).cast("double").alias("share")))

    return let(found, placed)


SPANS = "array<struct<start:bigint,k:int,end:bigint,kind:string,value:string,share:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the check: every second from the right is doubled, its digits summed."""
    d = F.transform(F.split(F.reverse(x), ""), lambda c: F.ascii(c) - 48)
    total = F.aggregate(F.transform(d, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def valid(kind: str, s: Column) -> Column:
    v = s["value"]
    if kind == "ip":
        return v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits(v)).between(14, 19) & luhn(digits(v))
    return F.length(digits(v)).between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    none = F.expr(f"CAST(array() AS {SPANS})")
    of = lambda kind: lambda s: valid(kind, s)
    kinds = [F.when(text.rlike(HINTS[k]), F.filter(matches(text, k, p), of(k))).otherwise(none) for k, p in PATTERNS.items()]
    return F.array_sort(F.concat(*kinds))


def entity(s: Column) -> Column:
    """What a base span names, however it is written."""
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(digits(s["value"])))


def terms(text: Column) -> Column:
    """Distinct words of letters, lower-cased."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= LETTERS)


def different(rows: DataFrame, *keys: str) -> DataFrame:
    """n: how many different contents each key has, where rows hold all copies of a content and state their number."""
    of = rows.groupBy(*keys, "copies").agg(F.count(F.lit(1)).alias("rows"))
    return of.groupBy(*keys).agg(F.sum(F.expr("rows DIV copies")).alias("n"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, k, end, kind, value, share) of each row of docs (doc_id, text), in code points, end exclusive.

    Base spans are the patterns' matches. A term is added where it discloses an entity that its document names: if
    pointwise mutual information of term and entity reaches GENERALISE of the entity's information content, counted over
    all documents of different content: exact copies are one, near copies are not. Fewer than CONTEXTS common documents
    prove nothing. A term's share is the largest of the entities that its document names; base spans have none. Null and
    empty texts have no spans; repeated rows and null ids are kept as they are; no rows give no rows; other columns are
    not looked at.

    The base pass reads the documents once and writes spans, and texts only of documents that name an entity. All counts
    are by partial aggregation. Corpus counts of terms are taken over all documents, for the terms that some entity has
    in common often enough.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select("doc_id", text.alias("text"))
    hashes = lambda t: F.transform(terms(t), lambda w: F.xxhash64(w))
    content = F.when(F.col("text") != "", F.unhex(F.md5("text"))).alias("content")
    rows = whole.select("doc_id", "text", base_spans(F.col("text")).alias("spans"), content)
    rows = scratch.save(rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))).withColumn("row", F.monotonically_increasing_id()))
    contents = scratch.save(rows.where("content IS NOT NULL").groupBy("content").agg(F.count(F.lit(1)).alias("copies")))
    copied = small(contents.where("copies > 1"))
    weighed = lambda df: df.join(copied, "content", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    named = weighed(rows.where("text IS NOT NULL").select("row", "content", F.array_distinct(F.transform("spans", entity)).alias("entities")))
    named = scratch.save(named.select("row", "copies", F.explode("entities").alias("entity")))
    often = scratch.save(different(named, "entity").withColumnRenamed("n", "n_e").where(F.col("n_e") >= CONTEXTS))
    shown = named.join(small(often), "entity").join(rows.select("row", "text"), "row")
    met = different(shown.select("entity", "n_e", "copies", F.explode(terms(F.col("text"))).alias("term")), "entity", "n_e", "term").withColumnRenamed("n", "n_et")
    met = scratch.save(met.where(F.col("n_et") >= CONTEXTS).withColumn("h", F.xxhash64("term")))
    if met.isEmpty():  # no term meets an entity often enough: nothing to weigh, whatever the corpus counts
        return rows.select("doc_id", "spans")
    n = F.lit(contents.count())
    heard = weighed(whole.select(content, hashes(F.col("text")).alias("h"))).select("copies", F.explode("h").alias("h"))
    heard = different(heard.join(small(met.select("h").distinct()), "h", "left_semi"), "h").withColumnRenamed("n", "n_t")
    shares = met.join(heard, "h")
    pmi = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    shares = shares.withColumn("share", pmi / F.nullif(F.log2(n / F.col("n_e")), F.lit(0.0))).where(F.col("share") >= GENERALISE)
    flagged = scratch.save(shares.select("entity", "term", "share"))
    own = named.join(flagged, "entity").groupBy("row", "term").agg(F.max("share").alias("share"))  # words of a document's own
    own = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    out = rows.join(own, "row", "left")
    words = F.filter(matches(F.col("text"), TERM, r"\p{L}{" + str(LETTERS) + ",}"), lambda s: F.map_contains_key("told", F.lower(s["value"])))
    words = F.transform(words, lambda s: s.withField("share", F.element_at("told", F.lower(s["value"]))))
    clear = F.filter(words, lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.when(F.col("told").isNotNull(), F.array_sort(F.concat("spans", clear))).otherwise(F.col("spans"))
    return out.select("doc_id", spans.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in brackets, and terms whose share reaches REMOVE left out;
    overlapping spans give way to the first of them."""
    shown = lambda s: F.when(s["share"] >= REMOVE, F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), shown(s))).alias("out"))
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""The pipeline's stages on documents: each returns the rows that it keeps, with their columns, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, small, table
from weftline.llm.exact_dedup import exact_dedup
from weftline.llm.mixing import mix_sources
from weftline.llm.near_dedup import near_dedup
from weftline.llm.packing import pack_documents, word_bpe
from weftline.llm.toxicity import THRESHOLD, score, train


def free(docs: DataFrame, stem: str) -> str:
    """A name that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model doesn't reject. It is fitted on the labelled rows of docs.

    A null text is scored as an empty one; rows of null or repeated ids are scored as any other; no rows give no rows;
    other columns stay, whatever their names."""
    name = free(docs, "score")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), name=name).where(F.col(name) < THRESHOLD).drop(name)


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a number of each row beside their columns, so that repeated and null ids are rows; the number's name."""
    number = free(docs, "row")
    return Scratch(spark, name).save(docs.withColumn(number, F.monotonically_increasing_id())), number


def _dropped(docs: DataFrame, number: str, decided: DataFrame) -> DataFrame:
    """docs without the rows that decided (doc_id, kept; a row for each row) drops; by numbers, which are unique."""
    out = decided.where("NOT kept").select(F.col("doc_id").alias(number))
    return docs.join(small(Scratch(docs.sparkSession, "drop").save(out)), number, "left_anti").drop(number)


def _in_order(docs: DataFrame, number: str) -> DataFrame:
    """doc_id, text with ids that order rows as their ids do and tell repeated rows apart: (id, number)."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(number).alias("row")).alias("doc_id"), "text")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of equal texts.

    Null ids come last, of repeated ids one row stays, null texts are empty ones; no rows give no rows; other columns
    stay, whatever their names."""
    docs, number = _numbered(spark, docs, "exact-stage")
    decided = exact_dedup(_in_order(docs, number)).select(F.col("doc_id.row").alias("doc_id"), "kept")
    return _dropped(docs, number, decided)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each class of near-duplicates: shingles of five words, similarity 0.8.

    Rows without words have no partners and stay; null ids come last, of repeated ids one row stays; no rows give no
    rows; other columns stay, whatever their names."""
    docs, number = _numbered(spark, docs, "near-stage")
    decided = near_dedup(_in_order(docs, number)).select(F.col("doc_id.row").alias("doc_id"), "kept")
    return _dropped(docs, number, decided)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as the mix takes them; rows that it doesn't take go.

    A null source is one of its own, a row without words is taken once; null and repeated ids are rows like any others;
    no rows give no rows; other columns stay, whatever their names."""
    docs, number = _numbered(spark, docs, "mix-stage")
    times = free(docs, "times")
    ids = F.struct("doc_id", F.col(number).alias("row")).alias("doc_id")
    copies = mix_sources(docs.select(ids, "text", "source")).where("copies <> 1").select(F.col("doc_id.row").alias(number), F.col("copies").alias(times))
    copies = Scratch(spark, "mix-copies").save(copies)
    taken = docs.join(small(copies), number, "left").withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(number, times)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the rows with their places in sequences of at most 4096 tokens.

    A null text is an empty one, which has its end token; null and repeated ids are rows like any others; no rows give no
    rows; other columns are not looked at."""
    return pack_documents(docs.select("doc_id", "text"), word_bpe(), keep=[F.crc32("ids").alias("ids_crc32")])

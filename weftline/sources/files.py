"""Readers by suffix, JSON-lines with a policy for bad lines, sinks, and listings of files."""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources import arrow

#: Compressions that Spark's readers know; others would be read as text of no sense.
READABLE = ("", ".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _suffixes(path: str) -> tuple[str, str]:
    stem, last = os.path.splitext(path.lower())
    return (os.path.splitext(stem)[1], last) if last in (*READABLE[1:], ".xz", ".lzma") else (last, "")


def load_by_ext(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """csv, tsv, txt, json, jsonl and parquet, by the suffix of the first path; compressed files by the second suffix."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kind, packed = _suffixes(paths[0])
    if packed not in READABLE:
        raise ValueError(f"{packed} can't be read here")
    read = spark.read
    if kind in (".csv", ".tsv"):
        return read.csv(paths, header=True, inferSchema=True, sep="\t" if kind == ".tsv" else ",")
    if kind in (".txt", ".text"):
        return read.text(paths)
    if kind == ".json":
        return read.json(paths, multiLine=True)
    if kind in (".jsonl", ".ndjson"):
        return read.json(paths)
    if kind == ".parquet":
        return read.parquet(*paths)
    raise ValueError(f"no reader for {kind or paths[0]}")


def expanded(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Files of paths and patterns, in the order given and, of a pattern, by name; a pattern without a match, and a path
    that isn't there, stay as they are. * and ? stay within a folder, ** goes into all of them."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        fixed = p[: re.search(r"[*?\[]", p).start()].rpartition("/")[0] if re.search(r"[*?\[]", p) else None
        if fixed is None:
            out.append(p)
            continue
        top = spark._jvm.org.apache.hadoop.fs.Path(fixed or ("/" if p.startswith("/") else "."))
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        base = fs.makeQualified(top).toUri().getPath().rstrip("/")
        found, rest = [], p[len(fixed) :].lstrip("/")
        match = re.compile(_pattern(rest)).fullmatch
        files = fs.listFiles(top, "**" in rest or "/" in rest) if fs.exists(top) else None
        while files is not None and files.hasNext():
            path = files.next().getPath()
            if match(path.toUri().getPath()[len(base) :].lstrip("/")):
                found.append(path.toString())
        out += sorted(found) or [p]
    return out


def _pattern(glob: str) -> str:
    """A pattern of file names as a regular expression; names that begin with a dot match only a dot."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        start = k == 0 or glob[k - 1] == "/"
        if glob[k : k + 3] == "**/" and start:
            out, k = out + r"(?:(?!\.)[^/]+/)*", k + 3
        elif glob[k:] == "**" and start:
            out, k = out + r"(?:(?!\.)[^/]+/)*(?!\.)[^/]*", k + 2
        elif c in "*?":
            out, k = out + (r"(?!\.)" if start else "") + ("[^/]*" if c == "*" else "[^/]"), k + 1
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            out, k = out + "[" + glob[k + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if glob[k + 1] == "!" else 0) + "]", end + 1
        else:
            out, k = out + re.escape(c), k + 1
    return out


def load_jsonl_files(spark: SparkSession, paths: str | list[str], on_error: str = "raise") -> DataFrame:
    """As load_jsonl, of paths and patterns, with file, the place of a row's file in the order of expanded. A file that
    is named twice has its rows twice."""
    files = expanded(spark, paths)
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    whole = [path(p).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path(p)) for p in files]
    places = [(re.sub("^file:/+", "file:/", p.toUri().toString()), k) for k, p in enumerate(whole)]
    places = spark.createDataFrame(places, "path string, file int")  # a row for each file
    literal = lambda p: re.sub(r"([\[\]{}*?\\])", r"\\\1", p)
    rows = load_jsonl(spark, sorted({literal(p.toString()) for p in whole}), on_error)
    return rows.join(places, F.regexp_replace("source", "^file:/+", "file:/") == F.col("path")).drop("path")


def load_jsonl(spark: SparkSession, paths: str | list[str], on_error: str = "raise", max_lines: int | None = None) -> DataFrame:
    """source, line (from 0, of the file's physical lines), row (VARIANT) and error of each line that isn't blank.

    on_error: raise fails, skip drops bad lines, keep leaves them with a null row and their text as error. max_lines
    counts physical lines, blank and bad ones too. Lines are numbered only where line or max_lines is asked for."""
    if on_error not in ("raise", "skip", "keep"):
        raise ValueError(f"unknown policy {on_error}")
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    lines = _numbered(lines.select(*(F.col(c).alias(n) for n, c in _PLACE.items()), F.monotonically_increasing_id().alias("at"), "value"))
    if max_lines is not None:
        lines = lines.where(F.col("line") < max_lines)
    parsed = lines.where(F.regexp_replace("value", r"\s+", "") != "").withColumn("row", F.try_parse_json("value"))
    bad = F.col("row").isNull()
    if on_error == "raise":
        parsed = parsed.withColumn("row", F.when(bad, F.parse_json("value")).otherwise(F.col("row")))
    elif on_error == "skip":
        parsed = parsed.where(~bad)
    return parsed.select("source", "line", "row", F.when(bad, F.col("value")).alias("error"))


def load_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON lines that must all be objects, with their index; anything else fails."""
    return load_jsonl(spark, paths).select("source", F.col("line").alias("row_index"), _objects("row").alias("row"))


def load_json_folder(spark: SparkSession, path: str) -> DataFrame:
    """A row for each JSON file of a folder: its name without suffix, and the value."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("source"), F.parse_json("value").alias("row"))


def _objects(row: str) -> Column:
    """A VARIANT column that must hold objects only; anything else fails."""
    ok = F.startswith(F.schema_of_variant(row), F.lit("OBJECT"))
    return F.when(ok, F.col(row)).otherwise(F.raise_error(F.lit("row is not an object")).cast("variant"))


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """source, row_index and row (VARIANT, an object) of a data set, by what its path is.

    A folder has a row for each of its JSON files, under the file's name; JSON lines and a JSON file with an object or an
    array of objects have no source, and rows numbered from 0; a folder of Arrow files has its splits as sources, and rows
    numbered through all of them. A missing path, a folder without JSON files and another suffix are errors."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    none = F.lit(None).cast("string").alias("source")
    if fs.getFileStatus(at).isDirectory():
        names = {f.getPath().getName() for f in fs.listStatus(at)}
        if names & {arrow.SPLITS, arrow.STATE, arrow.INFO}:
            rows = arrow.read_arrow(spark, path)
            own = F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in rows.columns[3:])))
            index = _by_block(rows.select(F.lit("").alias("source"), F.struct("split", "place").alias("block"), F.col("row_index").alias("at"), "split", own.alias("row")), row_index=F.lit(1))
            return index.select(F.nullif("split", F.lit("")).alias("source"), "row_index", "row")
        if not any(n.endswith(".json") for n in names):
            raise ValueError(f"no JSON files in {path}")
        return load_json_folder(spark, path).select("source", F.lit(0).cast("long").alias("row_index"), _objects("row").alias("row"))
    kind = _suffixes(path)[0]
    if kind == ".jsonl":
        return load_objects(spark, path).select(none, "row_index", "row")
    if kind != ".json":
        raise ValueError(f"unsupported file type {kind or path}")
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    items = F.when(listed, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return whole.select(F.posexplode(items).alias("at", "item")).select(none, F.col("at").cast("long").alias("row_index"), _objects("item").alias("row"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a text file or folder, blank ones included, be it compressed; 0 where it can't be read."""
    try:
        return spark.read.text(path, lineSep="\n").count()
    except (PySparkException, Py4JJavaError):
        return 0


def _by_block(lines: DataFrame, **sums: Column) -> DataFrame:
    """lines (source, block, at, ...) with running sums over the lines of a file before each: within a block of the file by
    a window, before the block by the prefix sums of the blocks' totals. A file of any size is as many tasks as blocks."""
    keys = ["source", "block"]
    within = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    totals = lines.groupBy(*keys).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    totals = totals.select(*keys, *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    own = lines.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(totals, keys)
    return own.withColumns({n: (F.col(n) + F.col(f"_{n}")).cast("long") for n in sums}).drop(*(f"_{n}" for n in sums))


def _numbered(lines: DataFrame) -> DataFrame:
    """lines (source, block, at, ...) with line, the number of each in its file. at grows by one from line to line of a
    block, so that no task sorts or holds one: a row for each block says where it begins."""
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    first = lines.groupBy("source", "block").agg(F.min("at").alias("_at"), F.count(F.lit(1)).alias("_n"))
    first = first.select("source", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_at")).alias("_more"))
    return lines.join(F.broadcast(first), ["source", "block"]).withColumn("line", F.col("at") + F.col("_more")).drop("_more")


_PLACE = {"source": "_metadata.file_path", "block": "_metadata.file_block_start"}


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """source, line (from 0), offset and length in bytes of each line of files that isn't blank. Lines end with a line
    feed, which isn't part of them; a carriage return before it is, and a byte order mark counts as bytes before the first
    line. Of compressed files, offsets are into the plain bytes."""
    raw = spark.read.text(path, lineSep="\n")
    size = F.when(F.lower("_metadata.file_path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$"), F.lit(None)).otherwise(F.col("_metadata.file_size"))
    lines = raw.select(*(F.col(c).alias(n) for n, c in _PLACE.items()), size.alias("bytes"), F.monotonically_increasing_id().alias("at"), F.octet_length("value").cast("long").alias("length"), (F.regexp_replace("value", r"\s+", "") != "").alias("full"))
    lines = _by_block(lines, line=F.lit(1), offset=F.col("length") + 1)
    mark = lines.groupBy("source").agg((F.max("bytes") - F.sum(F.col("length") + 1) >= 2).alias("marked"))  # else 0, or -1 without a last line feed
    out = lines.where("full").join(mark, "source")
    return out.select("source", "line", (F.col("offset") + F.when(F.col("marked"), 3).otherwise(0)).alias("offset"), "length")


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, length and time of files that aren't empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime").where("length > 0")
    for k, s in enumerate(suffixes):
        hit = F.endswith("path", F.lit(s))
        cond = hit if k == 0 else cond | hit  # noqa: F821
    return files.where(cond) if suffixes else files


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_ext(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kind = os.path.splitext(path)[1].lower()
    if kind in (".json", ".jsonl"):
        write_jsonl(df, path, mode)
    elif kind in (".csv", ".tsv"):
        df.write.mode(mode).csv(path, header=True, sep="\t" if kind == ".tsv" else ",")
    else:
        df.write.mode(mode).parquet(path)


class ResultStore:
    """Results kept under a key in a folder; a result of nulls is a result."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def has(self, key: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, key: str, make) -> DataFrame:
        """The kept result, or that of make(), which is written first. make() is never called again after an error."""
        if not self.has(key):
            make().write.mode("overwrite").parquet(f"{self.folder}/{key}")
        return self.spark.read.parquet(f"{self.folder}/{key}")

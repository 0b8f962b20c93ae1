"""Tokenized training rows: families, regions, boundaries, segments and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import let

MASKED = -100
#: Keys that a family needs; the first that fits is taken.
FAMILIES = {"kto": ("prompt_ids", "completion_ids", "encourage_label"), "dpo": ("prompt_ids", "chosen_ids", "rejected_ids"), "sft": ("input_ids", "labels")}


def family(keys: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, need in reversed(FAMILIES.items()):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, need)), keys)) == 0, name).otherwise(out)
    return out


def sft_regions(ids: Column, labels: Column) -> Column:
    """masked or trainable for each id; arrays of different lengths are an error."""
    same = F.when(F.size(ids) == F.size(labels), F.transform(labels, lambda x: F.when(x == MASKED, "masked").otherwise("trainable")))
    return F.coalesce(same, F.raise_error(F.lit("input_ids and labels differ in length")).cast("array<string>"))


def dpo_regions(prompt: Column, chosen: Column, rejected: Column) -> Column:
    return F.concat(F.array_repeat(F.lit("prompt"), F.size(prompt)), F.array_repeat(F.lit("chosen"), F.size(chosen)), F.array_repeat(F.lit("rejected"), F.size(rejected)))


def kto_regions(prompt: Column, completion: Column, label: Column) -> Column:
    name = F.when(label == 1, "encourage").when(label == -1, "discourage").when(label == 0, "neutral").otherwise(F.raise_error(F.lit("label must be -1, 0 or 1")).cast("string"))
    return F.concat(F.array_repeat(F.lit("masked"), F.size(prompt)), F.array_repeat(name, F.size(completion)))


def counts(regions: Column) -> Column:
    def of(r: Column) -> Column:
        names = F.array_sort(F.array_distinct(r))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(r, lambda x: x == n))))

    return let(regions, of)


def boundaries(regions: Column) -> Column:
    """offset and region wherever a region begins."""
    begins = lambda r: F.transform(r, lambda x, k: F.when((k == 0) | (x != F.get(r, k - 1)), F.struct(k.alias("offset"), x.alias("region"))))
    return F.array_compact(let(regions, begins))


def masked(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x == MASKED))


def window_bounds(total: Column, offset: Column, limit: Column, most: int = 1024) -> Column:
    """start and end of a window: the offset is kept within the row, the limit between 1 and most."""
    start = F.least(F.greatest(offset, F.lit(0)), F.greatest(total - 1, F.lit(0)))
    size = F.least(F.greatest(limit, F.lit(1)), F.lit(most))
    return F.struct(start.alias("start"), F.least(start + size, total).alias("end"))


def window(items: Column, offset: Column, limit: Column, most: int = 1024) -> Column:
    b = window_bounds(F.size(items), offset, limit, most)
    return F.slice(items, b["start"] + 1, b["end"] - b["start"])


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: by, value, begin (position from 0), n."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("pos", F.row_number().over(w) - 1)
    d = d.withColumn("new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col("pos") == 0)).cast("int"))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "island").agg(F.first(value).alias(value), F.min("pos").alias("begin"), F.count(F.lit(1)).alias("n"))


SDD_FORMAT = "sdd_prompt_response_v1"  # fixed value of the row format
SDD_KEYS = ("student_ids", "teacher_ids", "response_ids")


#: What is read of a row, all at once: its format and the JSON texts of its lists.
LISTS = (*SDD_KEYS, "input_ids", "prompt_ids", "chosen_ids", "rejected_ids", "completion_ids", "messages", "teacher_messages", "messages_with_ref")


def _read(row: Column) -> Column:
    """The fields of a row given as JSON text, as texts, and its keys; a text that is no object has neither."""
    return F.struct(F.from_json(row, ", ".join(f"{k} string" for k in ("format", *LISTS))).alias("f"), F.json_object_keys(row).alias("keys"))


def _listed(r: Column, key: str) -> Column:
    return F.coalesce(F.startswith(r["f"][key], F.lit("[")), F.lit(False))


def _sdd(r: Column) -> Column:
    out = F.coalesce(r["f"]["format"] == SDD_FORMAT, F.lit(False))
    for k in SDD_KEYS:
        out = out & _listed(r, k)
    return out


def _family(r: Column) -> Column:
    return F.when(r["keys"].isNotNull(), family(r["keys"]))


def _length(r: Column) -> Column:
    n = lambda k: F.coalesce(F.json_array_length(r["f"][k]), F.lit(0))
    unknown = F.raise_error(F.lit("row is not a recognized tokenized schema")).cast("int")

    def of(kind: Column) -> Column:
        out = F.when(_sdd(r), F.greatest(*map(n, SDD_KEYS))).when(kind == "sft", n("input_ids"))
        out = out.when(kind == "dpo", n("prompt_ids") + n("chosen_ids") + n("rejected_ids")).when(kind == "kto", n("prompt_ids") + n("completion_ids"))
        return out.otherwise(unknown)

    return let(_family(r), of)


def is_sdd(row: Column) -> Column:
    """Whether a row, as JSON text, is a student, teacher and response row: its format by name, and three lists."""
    return let(_read(row), _sdd)


def is_tokenized(row: Column) -> Column:
    """Whether a row, as JSON text, has a list of input_ids."""
    return let(_read(row), lambda r: _listed(r, "input_ids"))


def row_family(row: Column) -> Column:
    """The training family of a row given as JSON text."""
    return let(_read(row), _family)


def mode(row: Column) -> Column:
    """How a row, as JSON text, is shown: sdd before tokens before generic. Messages of student and teacher, or with a
    reference, are sdd as well."""

    def of(r: Column) -> Column:
        pair = _listed(r, "messages") & _listed(r, "teacher_messages")
        return F.when(_sdd(r) | pair | _listed(r, "messages_with_ref"), "sdd").when(_family(r).isNotNull(), "tokens").otherwise("generic")

    return let(_read(row), of)


def row_length(row: Column) -> Column:
    """How many positions a tokenized row, as JSON text, has: the longest list of student, teacher and response, otherwise
    all ids of its training family. Any other row is an error."""
    return let(_read(row), _length)


def row_chunk(row: Column, offset: Column, limit: Column, most: int = 1024) -> Column:
    """kind (sdd or a training family), total, start and end of the next chunk of a tokenized row given as JSON text."""

    def of(r: Column) -> Column:
        kind = F.when(_sdd(r), "sdd").otherwise(_family(r))
        told = lambda x: F.struct(x["kind"].alias("kind"), x["total"].alias("total"), window_bounds(x["total"], offset, limit, most).alias("b"))
        flat = lambda x: F.struct(x["kind"].alias("kind"), x["total"].alias("total"), x["b"]["start"].alias("start"), x["b"]["end"].alias("end"))
        return let(let(F.struct(kind.alias("kind"), _length(r).alias("total")), told), flat)

    return let(_read(row), of)


def sdd_window(student: Column, teacher: Column, response: Column, offset: Column, limit: Column, most: int = 1024) -> Column:
    """start and end of a window over the longest of three lists, and the part of each list that lies in it."""
    total = F.greatest(*(F.size(x) for x in (student, teacher, response)))
    part = lambda x, b: F.slice(x, b["start"] + 1, F.greatest(F.least(b["end"], F.size(x)) - b["start"], F.lit(0)))
    parts = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), *(part(x, b).alias(k) for x, k in zip((student, teacher, response), SDD_KEYS, strict=True)))
    return let(window_bounds(total, offset, limit, most), parts)


def valid_ids(ids: Column) -> Column:
    return (F.size(ids) > 0) & F.forall(ids, lambda x: x >= 0)

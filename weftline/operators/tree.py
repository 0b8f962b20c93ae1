"""Nested JSON: leaves, paths, search and summaries. Keys keep the order of the text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import walk
from weftline.functions.text import let

CHILDREN = "array<struct<key:string,path:string,kind:string,value:string,size:int>>"


def nodes(df: DataFrame, row: str, text: str) -> DataFrame:
    """A row for each node of the JSON in a column, depth first; JSON that doesn't parse has none."""
    found = df.select(row, F.posexplode(walk.nodes(F.col(text))).alias("node", "n"))
    return found.select(row, "node", *(F.col(f"n.{c}").alias(c) for c in ("path", "key", "depth", "kind", "value", "size")))


def find(df: DataFrame, row: str, text: str, needle: str) -> DataFrame:
    """What is seen of a nested value once all matches of a text are opened up: a row for each node whose containers are
    all open, with its place (from 0, depth first), and match, the number of the match in that order (null: none).

    A node matches by its key ([0], [1] ... in lists), its path without the first slash, or the JSON text of a scalar, in
    any case; the root by its value only. Every container on the way to a match is open. A row without a match shows nothing,
    and an empty text matches nothing.

    All of it is told within a row, without a shuffle, so that rows of equal or null ids stay apart. Depth first, what lies
    below a container stands together: the container of a node is open if the last match before the node or the first one
    from it on lies below it, so that each node looks at two matches, however many there are."""
    q = F.lower(F.lit(needle))

    def hit(n: Column) -> Column:
        shown = F.when(n["item"], F.concat(F.lit("["), n["key"], F.lit("]"))).otherwise(n["key"])
        found = F.contains(F.lower(shown), q) | F.contains(F.lower(F.substring(n["path"], 2, 1 << 30)), q) | F.contains(F.lower(F.coalesce(n["value"], F.lit(""))), q)
        return found & F.lit(needle != "")

    def before(all_: Column, hits: Column) -> Column:
        """For each node the number of matches before it."""
        upto = F.transform(hits, lambda h, k: F.array_repeat(k, h - F.coalesce(F.get(hits, k - 1), F.lit(-1))))
        behind = F.array_repeat(F.size(hits), F.size(all_) - 1 - F.get(hits, F.size(hits) - 1))
        return F.flatten(F.concat(upto, F.array(behind)))

    def seen(all_: Column, hits: Column, k: Column, n: Column) -> Column:
        outer = F.size(n["ord"]) - 1
        way = lambda ord_: F.slice(ord_, 1, F.greatest(outer, F.lit(0)))
        below = lambda ord_: F.coalesce((F.size(ord_) > outer) & (way(ord_) == way(n["ord"])), F.lit(False))
        return (outer < 0) | below(F.get(all_, F.get(hits, k - 1))["ord"]) | below(F.get(all_, F.get(hits, k))["ord"])

    def shown(all_: Column, hits: Column) -> Column:
        told = lambda ks: F.transform(all_, lambda n, i: F.struct(n.alias("n"), F.get(ks, i).alias("k"), (F.get(hits, F.get(ks, i)) == i).alias("hit")))
        return let(before(all_, hits), lambda ks: F.filter(told(ks), lambda e: seen(all_, hits, e["k"], e["n"])))

    def of(all_: Column) -> Column:
        hits = F.filter(F.transform(all_, lambda n, i: F.when(hit(n), i)), lambda i: i.isNotNull())
        return let(hits, lambda h: F.when(F.size(h) > 0, shown(all_, h)))

    out = df.select(row, F.posexplode(let(walk.nodes(F.col(text)), of)).alias("place", "e"))
    return out.select(row, "place", *(F.col(f"e.n.{c}").alias(c) for c in ("path", "key", "depth", "kind", "value", "size")), F.when(F.col("e.hit"), F.col("e.k")).alias("match"))


def search(tree: DataFrame, needle: str) -> DataFrame:
    """Nodes whose key, path or scalar holds a text, in any case."""
    q = F.lower(F.lit(needle))
    return tree.where(F.contains(F.lower("key"), q) | F.contains(F.lower("path"), q) | F.contains(F.lower(F.coalesce("value", F.lit(""))), q))


def containers(tree: DataFrame) -> DataFrame:
    """Nodes that are objects or lists, the root too."""
    return tree.where(F.col("kind").isin("object", "array"))


def multiline(tree: DataFrame) -> DataFrame:
    """Nodes that are strings of several lines."""
    said = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    return tree.where((F.col("kind") == "string") & F.contains(said, F.lit("\n")))


def _edited(x: Column, edit) -> Column:
    """edit of the object that a JSON text holds, as JSON text; null where it holds none."""

    def text(t: str | None) -> str | None:
        try:
            found = json.loads(t) if t is not None else None
        except ValueError:
            return None
        return json.dumps(edit(found), ensure_ascii=False, separators=(",", ":")) if isinstance(found, dict) else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(text)

    return run(x)


def keep_paths(x: Column, keys: list[str]) -> Column:
    """Of a JSON object as text, the named keys only, in the order of naming; dots lead into objects.

    A last key that is missing is null. Where an object on the way is missing, the ones before it stay."""
    paths = [k.split(".") for k in keys]

    def edit(whole: dict) -> dict:
        out: dict = {}
        for *way, name in paths:
            source, to = whole, out
            for step in way:
                if not isinstance(source, dict) or step not in source:
                    break
                source, to = source[step], to.setdefault(step, {})
                if not isinstance(to, dict):
                    break
            else:
                if isinstance(source, dict):
                    value = source.get(name)
                    to[name] = dict(value) if isinstance(value, dict) else value
        return out

    return _edited(x, edit)


def drop_paths(x: Column, keys: list[str]) -> Column:
    """A JSON object as text without the named keys; dots lead into objects, and keys that aren't there are no error."""
    paths = [k.split(".") for k in keys]

    def edit(whole: dict) -> dict:
        for *way, name in paths:
            at = whole
            for step in way:
                at = at.get(step) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(name, None)
        return whole

    return _edited(x, edit)


def collapsed(x: Column, shown: int = 3) -> Column:
    """One line for a JSON text: the first keys of an object and how many there are, the number of a list's items, and a
    scalar as it is. Null where it is no JSON."""

    def of(t: Column) -> Column:
        keys = F.json_object_keys(t)
        names = F.array_join(F.transform(F.slice(keys, 1, shown), lambda k: F.get(F.regexp_extract_all(F.to_json(F.array(k)), F.lit(r"^\[(.*)\]$"), F.lit(1)), F.lit(0))), ", ")
        more = F.when(F.size(keys) > shown, ", …").otherwise("")
        held = F.concat(F.lit("{"), names, more, F.lit("}  ("), F.size(keys).cast("string"), F.lit(" keys)"))
        n = F.json_array_length(t)
        items = F.when(n == 0, "[]").otherwise(F.concat(F.lit("[…]  ("), n.cast("string"), F.lit(" items)")))
        return F.when(F.size(keys) == 0, "{}").when(keys.isNotNull(), held).when(n.isNotNull(), items).otherwise(t)

    return let(F.when(F.try_parse_json(x).isNotNull(), F.trim(x)), of)


def pretty(x: Column) -> Column:
    """A JSON text indented, any other text as it is."""
    return F.coalesce(dumps(x), x)


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix itself or lies below it; all paths lie below an empty one."""
    p = prefix.rstrip("/")
    return (path == p) | F.startswith(path, F.lit(f"{p}/"))


def _at(x: Column, path: str) -> Column:
    """key, v and text of what is at /a/0/b of a JSON text: a step is a key of an object or a place of a list, as what is
    there asks for. Null where nothing is there."""
    out = let(F.try_parse_json(x), lambda v: F.when(v.isNotNull(), F.struct(F.lit("").alias("key"), v.alias("v"), F.trim(x).alias("text"))))
    below = lambda p: lambda e: F.when(walk.variant_kind(e["v"]).isin("array", "object"), F.try_element_at(F.filter(walk.entries(e["text"]), lambda c: c["key"] == p), F.lit(-1)))
    for step in (p for p in path.strip("/").split("/") if p):
        out = let(out, below(step))
    return out


def children(x: Column, path: str = "") -> Column:
    """What lies directly below a path of a JSON text, without what lies deeper: key, path, kind, value, size.

    In the order of the text; entries of a list are named [0], [1] and so on. value is the JSON text of a scalar and null of
    a container, size the number of a container's entries. A scalar, an empty container, a path that isn't there and text
    that is no JSON have none; null stays null."""
    at = _at(x, path)["text"] if path.strip("/") else F.when(F.try_parse_json(x).isNotNull(), F.ltrim(x))
    parent = path.rstrip("/")

    def entry(key: Column, step: Column, v: Column) -> Column:
        kind = walk.variant_kind(v)
        inner = F.when(kind == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).when(kind == "object", F.size(F.try_variant_get(v, "$", "map<string,variant>")))
        value = F.when(kind == "null", F.lit("null")).when(~kind.isin("array", "object"), F.to_json(v))
        return F.struct(key.alias("key"), F.concat(F.lit(f"{parent}/"), step).alias("path"), kind.alias("kind"), value.alias("value"), F.coalesce(inner, F.lit(0)).alias("size"))

    def of(t: Column) -> Column:
        fields = F.map_entries(F.from_json(t, "map<string,variant>"))
        items = F.from_json(t, "array<variant>")
        named = F.transform(fields, lambda e: entry(e["key"], e["key"], e["value"]))
        numbered = F.transform(items, lambda v, k: entry(F.concat(F.lit("["), k.cast("string"), F.lit("]")), k.cast("string"), v))
        listed = F.when(F.startswith(t, F.lit("{")), named).when(F.startswith(t, F.lit("[")), numbered)
        return F.coalesce(listed, F.array().cast(CHILDREN))

    return F.when(x.isNotNull(), let(at, of))


def structured(x: Column, schema: str, required: tuple[str, ...] = (), on_error: str = "raise") -> Column:
    """A model's answer, a JSON object as text, as a struct of a schema.

    No answer, no JSON, a value of another type and a required field that is missing or null are errors: they fail the job
    with the text (raise) or give null (ignore). Fields that the schema doesn't name are left out."""
    if on_error not in ("raise", "ignore"):
        raise ValueError(f"unknown policy {on_error}")
    bad = "_not_read"

    def checked(got: Column) -> Column:
        fits = got.isNotNull() & got[bad].isNull() & F.startswith(F.ltrim(x), F.lit("{"))
        for k in required:
            fits = fits & got[k].isNotNull()
        wrong = F.when(x.isNull(), F.lit("Model returned empty content")).otherwise(F.concat(F.lit("Model did not return valid JSON:\n---\n"), x))
        out = got.dropFields(bad)
        kept = F.when(F.coalesce(fits, F.lit(False)), out)
        return kept if on_error == "ignore" else F.when(F.coalesce(fits, F.lit(False)), out).otherwise(F.raise_error(wrong))

    return let(F.from_json(x, f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad}), checked)


def dumps(x: Column, indent: int | None = 2) -> Column:
    """A JSON text written anew, indented, with keys in their order and letters as they are; null where it is no JSON."""

    def text(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=indent)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(text)

    return run(x)


def top(x: Column) -> Column:
    """Top-level keys of a JSON object, and scalar or JSON texts of their values."""
    return F.from_json(x, "map<string,string>")


class _Number(float):
    """A number that keeps its text."""

    def __new__(cls, text: str) -> _Number:
        self = super().__new__(cls, text)
        self.text = text
        return self


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return v.text if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _flat(t: str | None) -> dict | None:
    try:
        found = json.loads(t, parse_float=_Number) if t is not None else None
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    out, todo = {}, list(reversed(found.items()))
    while todo:
        k, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{k}.{n}" if k else n, x) for n, x in reversed(v.items())]
        else:
            out[k] = _text(v)
    return out


def flat(x: Column) -> Column:
    """Dotted keys and texts of the leaves of a JSON object: objects are gone into, arrays are leaves, empty objects have
    none. Of equal keys the last one's value. Null where the text is no JSON object."""

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_flat)

    return run(x)


def _below(v: Column, step: str) -> Column:
    """The entry of a VARIANT that a step names, a key of an object or a place of a list; null where there is none."""
    mark = next((q for q in "'\"" if step and q not in step and "?" not in step), None)
    named = lambda v: F.try_variant_get(v, f"$[{mark}{step}{mark}]", "variant") if mark else F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(step))
    if not re.fullmatch("0|[1-9][0-9]{0,8}", step):
        return named(v)
    return let(v, lambda v: F.coalesce(named(v), F.try_variant_get(v, f"$[{step}]", "variant")))


def resolve(x: Column, path: str, kind: str = "string") -> Column:
    """value at /a/0/b, and whether the path is there: a JSON null is there, a missing key is not. The text is parsed once,
    and each step goes into the VARIANT."""
    v = F.try_parse_json(x)
    for step in (p for p in path.strip("/").split("/") if p):
        v = _below(v, step)
    return F.struct(F.try_variant_get(v, "$", kind).alias("value"), v.isNotNull().alias("exists"))


def summary(m: Column, shown: int = 3) -> Column:
    """{a, b, c, … (n keys)}."""
    keys = F.map_keys(m)
    more = F.when(F.size(keys) > shown, F.lit(", …")).otherwise(F.lit(""))
    return F.concat(F.lit("{"), F.array_join(F.slice(keys, 1, shown), ", "), more, F.lit(" ("), F.size(keys).cast("string"), F.lit(" keys)}"))


def keep_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def drop_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def grep_keys(m: Column, part: str) -> Column:
    return F.map_filter(m, lambda k, _: F.contains(k, F.lit(part)))


def merged(left: Column, right: Column) -> Column:
    """Of keys in both, the right one's value."""
    mine = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(mine, right)

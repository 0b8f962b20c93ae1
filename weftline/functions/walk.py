"""Walks over nested values of any depth, level by level, as expressions of one row: no Python and no join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import let

_OPEN = "array<struct<ord:array<int>,path:string,key:string,item:boolean,text:string,v:variant>>"
NODE = "struct<ord:array<int>,path:string,key:string,depth:int,kind:string,value:string,size:int,item:boolean>"


def nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text are nested, strings left out. No group repeats, so that long texts don't
    exhaust the stack."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    move = lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1)
    step = lambda acc, c: F.struct((acc["at"] + move(c)).alias("at"), F.greatest(acc["most"], acc["at"] + move(c)).alias("most"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))
    return F.when(bare == "", F.lit(0)).otherwise(F.aggregate(F.split(bare, ""), zero, step, lambda acc: acc["most"]))


def levels(start: Column, rounds: Column, visit: Callable[[Column], Column], kind: str) -> Column:
    """told of all that is reached from start: visit gives told of an entry and open, the entries below it, which are the
    next level's. kind: the type of the array of what is told. Rounds beyond the value's depth find nothing open and leave
    what there is as it is, so that any bound of the depth will do."""
    zero = F.struct(start.alias("open"), F.array().cast(kind).alias("done"))
    below = lambda seen: F.flatten(F.transform(seen, lambda m: m["open"]))
    after = lambda s: lambda seen: F.struct(below(seen).alias("open"), F.concat(s["done"], F.transform(seen, lambda m: m["told"])).alias("done"))
    step = lambda s, _: F.when(F.size(s["open"]) == 0, s).otherwise(let(F.transform(s["open"], visit), after(s)))
    return F.aggregate(F.sequence(F.lit(1), rounds), zero, step, lambda s: s["done"])


def _rounds(json: Column) -> Column:
    """No fewer than a JSON text has levels: one more than it has opening brackets."""
    return F.size(F.split(json, r"[\[{]", -1))


def variant_kind(v: Column) -> Column:
    """null, string, bool, number, array or object; dates, times and bytes by their own names."""

    def of(name: Column) -> Column:
        plain = F.when(v.isNull() | (name == "VOID"), "null").when(name == "STRING", "string").when(name == "BIGINT", "number").when(name == "BOOLEAN", "bool")
        plain = plain.when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array")
        return plain.when(F.regexp_like(name, F.lit("^(DECIMAL|DOUBLE|FLOAT)")), "number").otherwise(F.lower(name))

    return let(F.schema_of_variant(v), of)


def entries(text: Column) -> Column:
    """key, v, text of the fields of an object or the items of a list, given as JSON text, in the order of the text."""
    paired = lambda m: F.zip_with(F.map_entries(m), F.map_values(F.from_json(text, "map<string,string>")), lambda e, t: F.struct(e["key"].alias("key"), e["value"].alias("v"), t.alias("text")))
    last = lambda m, all_: F.transform(F.array_distinct(F.map_keys(m)), lambda k: F.element_at(F.filter(all_, lambda e: e["key"] == k), -1))
    fields = lambda m: F.when(F.size(F.array_distinct(F.map_keys(m))) == F.size(m), paired(m)).otherwise(let(paired(m), lambda all_: last(m, all_)))
    both = F.arrays_zip(F.from_json(text, "array<variant>").alias("v"), F.from_json(text, "array<string>").alias("text"))
    items = F.transform(both, lambda e, k: F.struct(k.cast("string").alias("key"), e["v"].alias("v"), e["text"].alias("text")))
    return F.when(F.startswith(text, F.lit("{")), let(F.from_json(text, "map<string,variant>"), fields)).otherwise(items)


def nodes(json: Column) -> Column:
    """All nodes of a JSON text, depth first: ord (places on the way from the root), path, key, depth, kind, value (JSON
    text of a scalar), size (entries) and item (whether it is one of a list). Null where it is no JSON.

    Keys keep the order of the text; of equal keys the last one counts where the session allows them at all."""

    def visit(e: Column) -> Column:
        def of(kind: Column) -> Column:
            exact = kind.isin("number", "bool") & e["text"].isNotNull()
            value = F.when(exact, e["text"]).when(kind == "null", F.lit("null")).when(~kind.isin("array", "object"), F.to_json(e["v"]))
            child = lambda c, k: F.struct(F.concat(e["ord"], F.array(k)).alias("ord"), F.concat(e["path"], F.lit("/"), c["key"]).alias("path"), c["key"].alias("key"), (kind == "array").alias("item"), c["text"].alias("text"), c["v"].alias("v"))
            inner = F.when(kind.isin("array", "object"), F.transform(entries(e["text"]), child))
            told = lambda size: F.struct(e["ord"].alias("ord"), e["path"].alias("path"), e["key"].alias("key"), F.size(e["ord"]).alias("depth"), kind.alias("kind"), value.alias("value"), size.alias("size"), e["item"].alias("item"))
            return let(F.coalesce(inner, F.array().cast(_OPEN)), lambda open_: F.struct(told(F.size(open_)).alias("told"), open_.alias("open")))

        return let(variant_kind(e["v"]), of)

    def of(v: Column) -> Column:
        root = F.struct(F.array().cast("array<int>").alias("ord"), F.lit("").alias("path"), F.lit("").alias("key"), F.lit(False).alias("item"), F.trim(json).alias("text"), v.alias("v"))
        return F.when(v.isNotNull(), F.sort_array(levels(F.array(root), _rounds(json), visit, f"array<{NODE}>")))

    return let(F.try_parse_json(json), of)


_PARTS = "array<struct<path:string,v:variant>>"


def leaves(v: Column) -> Column:
    """path=tag:value of every scalar and every empty container of a VARIANT, in order.

    Keys are led by their length, so that no two trees have the same lines. Tags: i whole numbers, f other numbers by their
    value as a double, s strings as JSON, b, n (null), o and a (empty object and list), or a type's name. Beyond 64 bits a
    number without a fraction counts as whole, beyond 38 digits as a double."""

    def visit(e: Column) -> Column:
        def scalar(name: Column) -> Column:
            double = F.try_variant_get(e["v"], "$", "double")
            whole = name.rlike(r"^DECIMAL\([0-9]+,0\)$") & (F.abs(double) >= float(2**63))
            number = F.when(whole, F.concat(F.lit("i:"), F.to_json(e["v"]))).otherwise(F.concat(F.lit("f:"), double.cast("string")))
            tag = F.when(name == "STRING", "s:").when(name == "BOOLEAN", "b:")
            other = F.when(F.regexp_like(name, F.lit("^(DECIMAL|DOUBLE|FLOAT)")), number).otherwise(F.concat(F.lower(name), F.lit(":"), F.to_json(e["v"])))
            whole64 = F.concat(F.lit("i:"), F.try_variant_get(e["v"], "$", "bigint").cast("string"))
            return F.when(e["v"].isNull() | (name == "VOID"), F.lit("n:")).when(name == "BIGINT", whole64).otherwise(F.coalesce(F.concat(tag, F.to_json(e["v"])), other))

        def of(inner: Column) -> Column:
            empty = F.when(F.try_variant_get(e["v"], "$", "array<variant>").isNull(), "o:").otherwise("a:")
            tagged = F.when(inner.isNull(), let(F.schema_of_variant(e["v"]), scalar)).when(F.size(inner) == 0, empty)
            return F.struct(F.concat(e["path"], F.lit("="), tagged).alias("told"), F.coalesce(inner, F.array().cast(_PARTS)).alias("open"))

        fields = F.map_entries(F.try_variant_get(e["v"], "$", "map<string,variant>"))
        named = F.transform(fields, lambda f: F.struct(F.concat(e["path"], F.lit("/"), F.char_length(f["key"]).cast("string"), F.lit(":"), f["key"]).alias("path"), f["value"].alias("v")))
        items = F.try_variant_get(e["v"], "$", "array<variant>")
        numbered = F.transform(items, lambda x, k: F.struct(F.concat(e["path"], F.lit("/["), k.cast("string"), F.lit("]")).alias("path"), x.alias("v")))
        return let(F.coalesce(named, numbered), of)

    root = F.struct(F.lit("").alias("path"), v.alias("v"))
    return F.sort_array(F.array_compact(levels(F.array(root), _rounds(F.to_json(v)), visit, "array<string>")))

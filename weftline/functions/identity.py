"""Content identities: equal for equal content whatever the order of keys, apart for different types."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import walk
from weftline.functions.text import let


def canonical_map(m: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})


def content_id(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON; null is not the text 'null'."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def content_uuid(x: Column) -> Column:
    """128 bits of content in the form of a UUID."""
    return F.regexp_replace(F.md5(x), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def cache_key(transform: str, *columns: Column) -> Column:
    """Identity of a call: the transform's name is part of it, so that two transforms never share a result."""
    return F.sha2(F.concat_ws("\x1f", F.lit(transform), content_id(*columns)), 256)


def canonical(v: Column) -> Column:
    """A nested value, a VARIANT, as text: equal for equal content, whatever the order of keys at any depth, and apart for
    1, 1.0, "1", true and null, for empty and missing containers, and for lists of another order. A line for each leaf."""
    return F.array_join(walk.leaves(v), "\n")


def json_id(x: Column) -> Column:
    """SHA-256 of what a JSON text says; null where it is no JSON."""
    return let(F.try_parse_json(x), lambda v: F.when(v.isNotNull(), F.sha2(canonical(v), 256)))


class _Other(ValueError):
    """A JSON text of a kind that is left to the expressions of walk."""


class _Float(float):
    """A number with a point or an exponent, apart from whole ones; of few digits, which print alike everywhere."""

    def __new__(cls, text: str) -> _Float:
        self = super().__new__(cls, text)
        said = repr(float(self))
        if len(said) > 12 or "e" in said or not (1e-3 <= abs(self) < 1e7 or text == "0.0"):
            raise _Other(text)
        return self


def _whole(text: str) -> int:
    if len(text) > 18 or text == "-0":
        raise _Other(text)
    return int(text)


_READ = json.JSONDecoder(parse_float=_Float, parse_int=_whole)
_SAY = json.JSONEncoder(ensure_ascii=False).encode
_ODD = re.compile("[\x00-\x07\x0b\x0e-\x1f\ud800-\udfff]")  # written otherwise by other writers


def _digest(text: str | None) -> str | None:
    """SHA-256 of canonical for plain JSON texts; None for all else."""
    if text is None:
        return None
    try:
        value = _READ.decode(text)
    except (ValueError, RecursionError):
        return None
    lines, todo = [], [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{path}/{len(k)}:{k}", x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(f"{path}/[{k}]", x) for k, x in enumerate(v)]
        elif isinstance(v, str):
            lines.append(f"{path}=s:{_SAY(v)}")
        elif isinstance(v, _Float):
            lines.append(f"{path}=f:{float(v)!r}")
        elif isinstance(v, bool):
            lines.append(f"{path}=b:{'true' if v else 'false'}")
        else:
            lines.append(f"{path}=n:" if v is None else f"{path}=o:" if v == {} else f"{path}=a:" if v == [] else f"{path}=i:{v}")
    whole = "\n".join(sorted(lines))
    if _ODD.search(whole) or _ODD.search(text) or "\\u" in text:
        return None
    return hashlib.sha256(whole.encode()).hexdigest()


def json_ids(x: Column) -> Column:
    """As json_id, the same identities, in Arrow batches: several times as fast on long tables of short texts. What isn't
    plain (control characters, escapes by number, numbers of many digits) goes to json_id itself."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_digest)

    return F.coalesce(run(F.when(F.try_parse_json(x).isNotNull(), x)), json_id(x))


def value_id(*columns: Column) -> Column:
    """SHA-256 of columns of any nested type: structs and maps by key (maps with text as keys), whatever their order."""
    whole = F.to_variant_object(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))))
    return let(whole, lambda v: F.sha2(canonical(v), 256))


def value_ids(*columns: Column) -> Column:
    """As value_id, the same identities, in Arrow batches where all values are of the types that JSON has too."""
    whole = F.to_variant_object(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns))))
    plain = ~F.schema_of_variant(whole).rlike("DECIMAL|DOUBLE|FLOAT|DATE|TIME|BINARY|UUID|VARIANT|INTERVAL")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_digest)

    return F.coalesce(run(F.when(plain, F.to_json(whole))), value_id(*columns))

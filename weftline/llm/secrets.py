"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import slices, table

BASE = ("assign", "access", "hex")
#: Kinds that the method adds to the base ones; each carries a checksum of its own.
KINDS = (*BASE, "github", "npm")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def checksum62(token: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of the random part, as in tokens that embed one."""
    body, tail = token[4:-6], token[-6:]
    n = 0
    for c in tail:
        n = n * 62 + DIGITS62.index(c)
    return n == zlib.crc32(body.encode())


def find_secrets(text: str | None) -> list[tuple[str, int, int, str]]:
    """All spans of a whole text, by start, then kind. A null or empty text has none."""
    if not text:
        return []
    low = text.replace("İ", "i").lower()  # the one letter that two replace; offsets stay those of text
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(low):
        starts.setdefault(kind, []).append(end - n + 1)
    found = []
    for kind, at in starts.items():
        expr = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}[kind]
        last = 0
        for k in sorted(at):
            if k < last or not (m := expr.match(text, k)):
                continue
            last = m.end()
            if kind == "assign" and len(m[1]) >= 12 or kind == "access" and len(m[0]) >= 18 or kind in ("github", "npm") and checksum62(m[0]):
                found.append((kind, k, last, m[1] if kind == "assign" else m[0]))
    # a run of hex digits has no keyword: the run's class itself is the anchor
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and secrets (kind, start, end, value; code points, end exclusive) for each row of docs (doc_id, text).

    Null and empty texts have an empty list, repeated rows and null ids are kept as they are, no rows give no rows.
    One pass without a shuffle; a task holds a few hundred texts at a time, whatever their number.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in find_secrets(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(got, type=_SPAN)], names=["doc_id", "secrets"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, secrets {SPANS}")


def joined(spans, kinds=None):
    """kind:start:end of the spans, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan_secrets(table(spark, sf_dir, "documents"))
    return s.select("doc_id", *(counted(s.secrets, k).alias(f"n_{k}") for k in BASE), F.sha2(joined(s.secrets, BASE), 256).alias("base_sha256"), joined(s.secrets).alias("spans"))

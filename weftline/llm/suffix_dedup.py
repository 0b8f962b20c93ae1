"""Repeated passages by blockwise suffix sorting: one bucket of suffixes at a time, ties by ranks of cover samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, release, slices, small, table

DEPTH = 400
#: Order of the plane that the difference cover comes from: its period is q*q + q + 1, with q + 1 residues.
ORDER = 5
PERIOD = ORDER * ORDER + ORDER + 1
#: Depth to which samples are ranked: with any shift below PERIOD before them, a suffix is never judged beyond DEPTH.
SAMPLED = DEPTH - PERIOD + 1
#: Lengths of the strings whose least hash names a suffix's bucket; the next length splits a bucket that is too large.
GRAMS = (128, 384, DEPTH)
#: Bytes of a bucket, and of one hash beyond which its suffixes are dealt out anew by the next length.
BUCKET, HOT = 2 << 20, 4 << 20
#: Suffixes of a piece at most, and bytes that are looked at together.
PIECE, BLOCK = 2048, 1 << 20
BASE = 0x9E3779B97F4A7C15
PAIR = np.dtype("<i8")


@cache
def cover(order: int = ORDER) -> np.ndarray:
    """The residues of a perfect difference cover: exponents of a cubic field's generator with no square term."""
    q, period = order, order * order + order + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                x, found = (1, 0, 0), []  # constant, x, x*x
                for k in range(period):
                    if x[2] == 0:
                        found.append(k)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(i - j) % period for i in found for j in found}) == period:
                    return np.array(found)
    raise AssertionError("no cover")


@cache
def shifts() -> np.ndarray:
    """For two residues the least shift that brings both into the cover."""
    inside = np.isin(np.arange(PERIOD), cover())
    both = np.array([[inside[(a + np.arange(PERIOD)) % PERIOD] & inside[(b + np.arange(PERIOD)) % PERIOD] for b in range(PERIOD)] for a in range(PERIOD)])
    return both.argmax(axis=2)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
    return grow(BASE), grow(pow(BASE, -1, 1 << 64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the gram bytes at every position. They only say which suffixes meet, never which are equal."""
    n = len(data) - gram + 1
    up, down = powers(1 << max(21, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by running minima from both ends of blocks."""
    if w == 1:
        return h
    n = len(h) - w + 1
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(hit: np.ndarray) -> np.ndarray:
    """Rows of start and end of the runs of a mask."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def pieces(units: list[tuple], kind: pa.DataType, gram: int) -> pa.RecordBatch:
    """id, start, n, h, digest, again: runs of neighbouring suffixes, of units (id, start, bytes), with one least hash h.

    Suffixes that agree on DEPTH bytes have the same h. digest names the piece's n + DEPTH - 1 bytes. again: the least
    hash occurs more than once in it, so that its suffixes may repeat each other; otherwise they can't."""
    lens = np.array([len(x) for _, _, x in units], np.int64)
    body = b"".join(x for _, _, x in units)
    data = np.frombuffer(body, np.uint8)
    h = gram_hashes(data, gram)
    low = sliding_min(h, w := DEPTH - gram + 1)
    ends = np.cumsum(lens)
    at = np.arange(len(low))
    valid = at + DEPTH <= np.repeat(ends, lens)[: len(low)]
    follows = np.concatenate([[False], (low[1:] == low[:-1]) & valid[:-1]])
    first = np.flatnonzero(valid & ~follows)
    stop = np.concatenate([first[1:], [len(low)]])
    closed = np.flatnonzero(~np.concatenate([valid[1:], [False]]) & valid) + 1  # behind the last suffix of each unit
    stop = np.minimum(stop, closed[np.searchsorted(closed, first, side="right")]) if len(first) else stop[:0]
    most = PIECE if w > 1 else 1
    parts = -(-(stop - first) // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, stop = np.repeat(first, parts) + nth * most, np.repeat(stop, parts)
    n = np.minimum(stop - first, most)
    owner = np.searchsorted(ends, first, side="right")
    begin = np.array([u[1] for u in units], np.int64)
    value = low[first]
    digest, again = [], []
    for a, k, v in zip(first.tolist(), n.tolist(), value, strict=True):
        digest.append(hashlib.sha256(body[a : a + k + DEPTH - 1]).digest()[:16])
        again.append(k > 1 and np.count_nonzero(h[a : a + k + w - 1] == v) > 1)
    cols = [pa.array([u[0] for u in units], kind).take(pa.array(owner)), pa.array(first - (ends - lens)[owner] + begin[owner]), pa.array(n.astype(np.int32)), pa.array(value.view(np.int64)), pa.array(digest, pa.binary()), pa.array(again, pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "start", "n", "h", "digest", "again"])


def cut(texts: DataFrame, gram: int) -> DataFrame:
    """The pieces of texts (id, data). A text of any length is looked at in blocks that overlap by DEPTH - 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, 64):
            kind = b.schema.field("id").type
            for key, x in zip(b["id"].to_pylist(), b["data"].to_pylist(), strict=True):
                for a in range(0, len(x) - DEPTH + 1, BLOCK):
                    part = x[a : a + BLOCK + DEPTH - 1]
                    held.append((key, a, part))
                    size += len(part)
                    if size >= BLOCK:
                        yield pieces(held, kind, gram)
                        held, size = [], 0
        if held:
            yield pieces(held, kind, gram)

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, start long, n int, h long, digest binary, again boolean")


def named(key: np.ndarray) -> np.ndarray:
    """Ranks of the different keys, from 0."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]), dtype=np.uint32)
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a.astype(np.uint64)
    key <<= np.uint64(32)
    key |= b
    return named(key)


def padded(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, np.zeros(DEPTH + 64, np.uint32)])


def equal_suffixes(bodies: list[bytes]) -> list[np.ndarray]:
    """For each body the mask of its suffixes (of at least DEPTH bytes) whose first DEPTH bytes begin elsewhere in the bucket.

    The suffixes are sorted by their first DEPTH bytes: by PERIOD bytes first. Those that tie are compared with a pivot
    of their group, all groups at once: the least shift that makes samples of both is looked up, and the samples' ranks
    to a depth of SAMPLED bytes decide, then the last PERIOD bytes. All ranks come from the bytes themselves."""
    lens = np.array([len(x) for x in bodies], np.int64)
    text = np.frombuffer(b"".join(bodies) + bytes(DEPTH + 64), np.uint8)
    n = int(lens.sum())
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word <<= np.uint64(8)
        word |= text[k : k + n]
    r8 = padded(named(word))
    del word
    r16 = padded(paired(r8[:n], r8[8 : 8 + n]))
    whole = padded(paired(r16[:n], r16[15 : 15 + n]))  # ranks of PERIOD bytes
    s = (np.arange(-(-n // PERIOD))[:, None] * PERIOD + cover()).ravel()
    s = s[s < n]
    ranks, depth = whole, PERIOD
    at = {PERIOD: whole}
    while 2 * depth <= SAMPLED:
        ranks = np.zeros(n + DEPTH + 64, np.uint32)
        ranks[s] = paired(at[depth][s], at[depth][s + depth])
        depth *= 2
        at[depth] = ranks
    left = SAMPLED - SAMPLED % PERIOD  # whole periods; then the rest of less than a period
    half = next(d for d in sorted(at) if depth + d >= left)
    upto = paired(at[depth][s], at[half][s + left - half])
    rest = SAMPLED - left
    sample = np.zeros(n + DEPTH + 64, np.uint32)
    sample[s] = paired(upto, paired(r16[s + left], r16[s + left + rest - 16]))
    del at, ranks, r8, r16, text
    begin = np.cumsum(lens) - lens
    count = lens - DEPTH + 1
    where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    head, tail = whole[where], whole[where + DEPTH - PERIOD]
    residue, table_ = where % PERIOD, shifts()
    kind = np.arange(len(where), dtype=np.int32)  # the class of a suffix: its pivot
    order = np.argsort(head, kind="stable")
    group = head[order]
    while len(order):
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, len(order)))
        more = np.repeat(size > 1, size)
        order, size = order[more], size[size > 1]
        if not len(order):
            break
        edge = np.cumsum(size) - size
        pivot = np.repeat(order[edge + size // 2], size)
        d = table_[residue[order], residue[pivot]]
        x, y = sample[where[order] + d], sample[where[pivot] + d]
        same = x == y
        above = np.where(same, tail[order] > tail[pivot], x > y)
        same &= tail[order] == tail[pivot]
        kind[order[same]] = pivot[same]
        key = (2 * np.repeat(np.arange(len(size)), size) + above)[~same]
        order = order[~same]
        by = np.argsort(key, kind="stable")
        order, group = order[by], key[by]
    again = np.bincount(kind, minlength=len(where))[kind] > 1
    return np.split(again, np.cumsum(count)[:-1])


def packed(runs: np.ndarray) -> bytes:
    return runs.astype(PAIR).tobytes()


def repeated(texts: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame:
    """id, at (start, runs): the suffixes of texts (id, data) whose first DEPTH bytes begin elsewhere in texts too.

    Pieces whose least hash occurs once can't repeat and are left out first. Pieces of equal bytes (by 128 bits of SHA-256) are one body. Where a body occurs twice, all its suffixes repeat.
    Bodies that share a least hash with other bodies, or may repeat themselves, are cut out of the texts once and sorted
    in buckets of about BUCKET bytes. A hash that more than HOT bytes share is dealt out by longer strings instead. At the
    last length a string is the suffix itself and a piece is one suffix: equal ones are one body, and others don't meet."""
    every = scratch.save(cut(texts, GRAMS[level]))
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("all"), F.max("again").alias("any")).where("any OR all > 1").select("h")
    marks = scratch.save(every.join(small(scratch.save(shared)), "h", "left_semi"))
    scratch.drop(every)
    bodies = marks.groupBy("digest", "h").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "start", "n")).alias("one"), F.max("again").alias("again"))
    bodies = scratch.save(bodies)
    heads = bodies.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.n") + DEPTH - 1).alias("bytes"), F.max("again").alias("any"))
    heads = scratch.save(heads.select("h", "bytes", (F.col("any") | (F.col("kinds") > 1)).alias("sorts")))  # saved: a hash of many bodies is not split under an aggregate
    bodies = bodies.join(heads, "h").select("digest", "h", "one", "sorts", (F.col("k") > 1).alias("whole"), (F.col("bytes") > HOT).alias("hot") if level + 1 < len(GRAMS) else F.lit(False).alias("hot"))
    bodies = scratch.save(bodies.withColumn("body", F.monotonically_increasing_id()))
    width = bodies.where("sorts AND NOT hot").agg(F.sum(F.col("one.n") + DEPTH - 1)).first()[0] or 0
    buckets = -(-width // BUCKET) or 1
    wanted = bodies.where("sorts").select(F.col("one.id").alias("id"), F.struct("one.start", "one.n", "body", "hot", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).alias("w"))
    wanted = wanted.groupBy("id").agg(F.collect_list("w").alias("w"))  # no more than a text has pieces

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
        for b in slices(batches, 64):
            rows = [(w["body"], -1 if w["hot"] else w["bucket"], x[w["start"] : w["start"] + w["n"] + DEPTH - 1]) for x, ws in zip(b["data"].to_pylist(), b["w"].to_pylist(), strict=True) for w in ws]
            for k in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024], strict=True), schema.types, strict=True)], schema=schema)

    def sort(t: pa.Table) -> pa.Table:
        ids, got = [], []
        for key, again in zip(t["id"].to_pylist(), equal_suffixes(t["data"].to_pylist()), strict=True):
            if again.any():
                ids.append(key)
                got.append(packed(runs_of(again)))
        release()
        return pa.table({"body": pa.array(ids, pa.int64()), "runs": pa.array(got, pa.binary())})

    out = scratch.save(texts.join(wanted, "id").mapInArrow(take, "id long, bucket long, data binary"))
    found = scratch.save(out.where("bucket >= 0").groupBy("bucket").applyInArrow(sort, "body long, runs binary"))
    if not (hot := out.where("bucket < 0").drop("bucket")).isEmpty():
        found = found.unionByName(united(repeated(hot, scratch, level + 1)).withColumnRenamed("id", "body"))
    found = bodies.join(found, "body", "left").where("whole OR runs IS NOT NULL").select("digest", F.when(~F.col("whole"), F.col("runs")).alias("runs"))
    return marks.join(scratch.save(found), "digest").select("id", F.struct("start", "n", "runs").alias("at"))


def united(found: DataFrame, ahead: int = 0) -> DataFrame:
    """id, runs: the union of the suffixes found, each with so many bytes after its start; packed starts and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for at in b["at"].to_pylist():
                r = np.concatenate([(np.frombuffer(x["runs"], PAIR).reshape(-1, 2) if x["runs"] is not None else np.array([[0, x["n"]]])) + x["start"] for x in at])
                r = r[np.argsort(r[:, 0], kind="stable")]
                lo, hi = r[:, 0], np.maximum.accumulate(r[:, 1] + ahead)
                first = np.concatenate([[True], lo[1:] > hi[:-1]])
                out.append(packed(np.stack([lo[first], hi[np.concatenate([first[1:], [True]])]], axis=1)))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.binary())], names=["id", "runs"])

    kind = found.schema["id"].dataType.simpleString()
    return found.groupBy("id").agg(F.collect_list("at").alias("at")).mapInArrow(run, f"id {kind}, runs binary")  # its pieces


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, spans (start, end in bytes), n_removed, n_spans, kept_sha256.

    spans cover every byte of a DEPTH-byte string that starts anywhere else too, in the UTF-8 bytes of all texts as they
    came, the same text included; matches never cross texts. kept_sha256 is the digest of the bytes outside the spans. A
    null text is an empty one; empty and short texts have no spans; repeated rows and texts of equal bytes are matches of
    each other and lose all their bytes if they have DEPTH of them; null ids are kept as they are. No rows give no rows;
    other columns are not looked at.

    Texts of equal bytes (by 128 bits of SHA-256) are folded into one. Suffixes are dealt into buckets by the least hash among the
    strings within their first DEPTH bytes, so that equal ones meet and neighbours mostly stay together: a run of them
    travels as its bytes, once for each different run. Buckets are sorted one at a time, by bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    keyed = docs.select("doc_id", data.alias("data")).withColumn("sha", F.unhex(F.sha2("data", 256))).withColumn("id", F.substring("sha", 1, 16))
    rows = scratch.save(keyed.select("doc_id", "id", "sha", F.octet_length("data").cast("long").alias("n_bytes")))
    texts = keyed.where(F.octet_length("data") >= DEPTH).groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min("data").alias("data"))
    texts = scratch.bucketed(texts, "id")  # dealt out once; whatever is joined to them comes to them
    scratch.tidy()
    found = scratch.save(united(repeated(texts.select("id", "data"), scratch), DEPTH - 1))
    scratch.tidy()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches, 64):
            spans, sha = [], []
            for x, runs in zip(b["data"].to_pylist(), b["runs"].to_pylist(), strict=True):
                r = np.frombuffer(runs, PAIR).reshape(-1, 2)
                edges = [0, *r.ravel().tolist(), len(x)]
                sha.append(hashlib.sha256(b"".join(x[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))).hexdigest())
                spans.append([{"start": a, "end": z} for a, z in r.tolist()])
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(spans, span), pa.array(sha, pa.string())], names=["id", "spans", "kept"])

    cuts = texts.where("copies = 1").join(found, "id").select("id", "data", "runs").mapInArrow(keep, "id binary, spans array<struct<start:bigint,end:bigint>>, kept string")
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("data").cast("long").alias("end")))
    done = scratch.save(cuts.unionByName(texts.where("copies > 1").select("id", all_.alias("spans"), F.sha2(F.lit(""), 256).alias("kept"))))
    scratch.drop(texts)
    out = rows.join(done, "id", "left")
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    out = out.select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", "spans", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

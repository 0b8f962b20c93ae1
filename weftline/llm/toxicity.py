"""Toxicity: a logistic model on words and their beginnings, regularised by identity swaps."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, release, slices, table

#: Labelled rows that the model is fitted on, at most, of either class; the rows of smallest hash are taken.
SAMPLE = {1: 4000, 0: 8000}
THRESHOLD = 0.7
#: Mentions of groups. A sentence that says one of them must score as it does with another in its place.
IDENTITIES = (
    "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "gays", "lesbians", "immigrants", "refugees",
    "muslim", "christian", "jewish", "hindu", "gay", "lesbian", "black", "white", "asian", "latino", "disabled", "transgender",
    "frauen", "juden", "muslime", "femmes", "juifs", "musulmans", "mujeres", "judíos", "musulmanes",
)
_WORD = re.compile(r"\w+")
_STARTS = (4, 5, 6)
_REMEMBERED = 300_000


def word_features(word: str) -> list[int]:
    """32-bit ids of a lower-case word and of its beginnings."""
    out = [zlib.crc32(b"w" + word.encode())]
    return out + [zlib.crc32(b"p" + word[:k].encode()) for k in _STARTS if len(word) > k]


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), dtype=np.uint32))


def swapped(text: str | None) -> str | None:
    """The text with every group mention replaced by the next one in the list; None if it has none."""
    if not text:
        return None
    nxt = dict(zip(IDENTITIES, IDENTITIES[1:] + IDENTITIES[:1], strict=True))
    words = _WORD.findall(text.lower())
    return " ".join(nxt.get(w, w) for w in words) if not nxt.keys().isdisjoint(words) else None


@dataclass
class Model:
    """Feature ids (sorted) with their weights; no features: every text scores as the bias says."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0


def _gather(features: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the chosen features, looked up few rows at a time."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(features) if len(chosen) else 0, 256):
        block = features[at : at + 256]
        flat = np.concatenate(block)
        col = np.searchsorted(chosen, flat)
        hit = chosen[np.minimum(col, len(chosen) - 1)] == flat
        rows.append(np.repeat(np.arange(at, at + len(block)), [len(f) for f in block])[hit])
        cols.append(col[hit])
    return np.concatenate(rows), np.concatenate(cols)


def _counted(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different features in order, and in how many rows each is."""
    flat = np.concatenate([*features, np.zeros(0, np.uint32)])
    flat.sort()
    first = np.flatnonzero(np.concatenate([[True] * bool(len(flat)), flat[1:] != flat[:-1]]))
    return flat[first], np.diff(np.append(first, len(flat)))


def fit(features: list[np.ndarray], swaps: list[np.ndarray | None], labels: np.ndarray, steps: int = 400, fair: float = 1.0, ridge: float = 2e-4) -> Model:
    """Features are kept where they go with the label beyond noise (chi-square). The loss is the class-balanced log loss, a ridge, and
    fair times the squared change of the score under identity swaps. A single class gives a constant model."""
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        return Model(bias=20.0 if len(y) and y[0] else -20.0)
    ids, all_ = _counted(features)
    own, times = _counted([f for f, k in zip(features, y, strict=True) if k])
    pos = np.zeros(len(ids))
    pos[np.searchsorted(ids, own)] = times
    neg, p, q = all_ - pos, y.sum(), len(y) - y.sum()
    excess = pos * q - neg * p  # the sign of the association, and with the margins its chi-square
    chi = len(y) * excess**2 / (all_ * np.maximum(1, len(y) - all_) * p * q)
    chosen = ids[(excess > 0) & (chi > 10) & (pos >= 3)]
    del ids, all_, pos, neg, excess, chi
    row, col = _gather(features, chosen)
    pair = [k for k, s in enumerate(swaps) if s is not None]
    srow, scol = _gather([swaps[k] for k in pair], chosen)
    brow, bcol = _gather([features[k] for k in pair], chosen)
    weight = np.where(y == 1, 0.5 / p, 0.5 / q)
    w, b, m, v = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        s = np.bincount(row, w[col], len(y)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        g = np.bincount(col, e[row], len(chosen)) + ridge * w
        if pair:
            d = np.bincount(brow, w[bcol], len(pair)) - np.bincount(srow, w[scol], len(pair))
            g += 2 * fair / len(pair) * (np.bincount(bcol, d[brow], len(chosen)) - np.bincount(scol, d[srow], len(chosen)))
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        w, b = w - move[:-1], b - move[-1]
    return Model(chosen, w, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """Fits a model on labelled docs (doc_id, text; labels: doc_id, toxic) that are not held out.

    Ids are held out where crc32(id as text) mod 3 is 1. Null ids or labels teach nothing; an id labelled twice counts
    as toxic if either says so. At most sample[class] rows, those whose ids hash smallest, are fitted on, by one task: that
    bound does not depend on the size of the corpus. Only the model reaches the driver."""
    bound = sample or SAMPLE
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    scratch = Scratch(docs.sparkSession, "toxicity")
    picked = scratch.save(own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound[1]).unionByName(own.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b["text"].to_pylist()
            other = [swapped(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array([text_features(t).tobytes() for t in texts], pa.binary()), pa.array([o and text_features(o).tobytes() for o in other], pa.binary())], names=["doc_id", "toxic", "f", "s"])

    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fitted(got: pa.Table) -> pa.Table:
        got = got.sort_by([("doc_id", "ascending"), ("f", "ascending")])
        f, s = ([np.frombuffer(x.as_buffer(), np.uint32) if x.is_valid else None for x in got[c]] for c in ("f", "s"))  # no copies
        model = fit(f, s, got["toxic"].to_numpy())
        del got, f, s
        release()  # the worker goes on; what the fit took shall not stay with it
        return pa.table({"ids": pa.array([model.ids.tobytes()], pa.binary()), "weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias]})

    got = text.join(F.broadcast(picked), "doc_id").mapInArrow(run, f"doc_id {kind}, toxic int, f binary, s binary")  # at most sum(sample.values()) ids
    found = got.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "ids binary, weights binary, bias double").collect()
    scratch.drop(picked)
    return Model(np.frombuffer(found[0].ids, np.uint32), np.frombuffer(found[0].weights), found[0].bias) if found else Model()


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score of each whole text (null: empty) as a last column; one pass, no shuffle, rows as they are.

    A column that has the score's name already is replaced; no rows give no rows; repeated rows and nulls elsewhere stay."""
    df = df.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
        seen: dict[str, tuple[int, ...]] = {}
        for b in slices(batches):
            out = []
            for t in b[text].to_pylist():
                hit: set[int] = set()
                for w in _WORD.findall(t.lower()) if t else ():
                    got = seen.get(w)
                    if got is None:
                        if len(seen) >= _REMEMBERED:
                            seen.clear()
                        got = seen[w] = tuple(f for f in word_features(w) if f in known)
                    hit.update(got)
                s = model.bias + sum(known[f] for f in sorted(hit))
                out.append(1 / (1 + np.exp(-min(40.0, max(-40.0, s)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{name}` double")


def held_out(doc_id):
    """Whether an id is kept from training; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

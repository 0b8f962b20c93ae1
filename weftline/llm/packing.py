"""Best-fit packing: exact complements by single, pair and triple sums under counts, then best fit."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, slices, small, table

LIMIT = 4096
#: Words of which a Python worker remembers the ids, in each of two generations.
REMEMBERED = 200_000


#: Fixed value: the split of the vocabularies whose words can be encoded apart. No alternative reaches over white space.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters with one mark behind them, which that split takes apart.
MARKED = r"^\pL+[.,;:!?]$"
#: Texts in which small letters are told by a table of a letter each, and words that no normal form and no case changes.
LATIN, PLAIN = r"^[\x00-\x7F\x{C0}-\x{FF}]*$", re.compile("[a-zß-öø-ÿ]+")


class WordIds:
    """Ids of whole texts. Where the vocabulary's own split never reaches over white space, each word between spaces, tabs
    and line ends is encoded once and remembered, apart from a mark behind it, and from its case if the vocabulary lower-cases; two
    generations bound the memory. With any other vocabulary, texts are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old = Tokenizer.from_file(path), {}, {}
        made = json.loads(self.tokenizer.to_str())
        inner = lambda x, name: (x or {}).get(name) or [x or {}]
        steps, forms = inner(made["pre_tokenizer"], "pretokenizers"), inner(made["normalizer"], "normalizers")
        self.apart = steps[0].get("pattern") == {"Regex": APART} and steps[0].get("invert") and [x.get("type") for x in steps[1:]] in ([], ["ByteLevel"])
        self.apart = bool(self.apart and {x.get("type") for x in forms} <= {None, "NFC", "Replace", "Lowercase"} and not made["post_processor"])
        self.apart = self.apart and all(x.get("type") != "Replace" or x["pattern"] == {"Regex": "\\s+"} for x in forms) and not any(x["normalized"] for x in made["added_tokens"])
        self.folds = any(x.get("type") == "Lowercase" for x in forms)
        bare = made | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *steps[1:]]}}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if self.apart else None
        tail, vocabulary = made["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if tail and w.endswith(tail)]] = True

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words. Those of letters alone go to the tokenizer as one text: each ends where a token does that
        ends a word, as long as there are as many of these as words. Plain ones need no normal form and no split."""
        known, kinds = {}, ([], [], [])
        for w in words:
            kinds[0 if PLAIN.fullmatch(w) else 1 if w.isalpha() else 2].append(w)
        plain, letters, other = kinds
        for tokenizer, block in [(t, x[at : at + 512]) for t, x in ((self.bare, plain), (self.tokenizer, letters)) for at in range(0, len(x), 512)]:
            ids = np.asarray(tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(block):
                other += block
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            known |= {w: raw[a:z] for w, a, z in zip(block, cuts, cuts[1:])}  # noqa: B905
        for at in range(0, len(other), 2048):
            block = other[at : at + 2048]
            for w, e in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False), strict=True):
                known[w] = np.asarray(e.ids, dtype="<u4").tobytes()
        return known

    def _pool(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words one after the other, and the length of each."""
        new, old = self.new, self.old
        missing = [w for w in words if w and w not in new and w not in old]
        got = self._learn(missing) if missing else {}
        each = [new[w] if w in new else got[w] if w in got else old[w] if w else b"" for w in words]
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        self.new |= got
        return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) one after the other, and where each text begins."""
        if not self.apart:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for x in ids for i in x), "<u4"), np.cumsum([0, *map(len, ids)])
        for mark in "\n\t\r":
            texts = pc.replace_substring(texts, mark, " ")
        split = pc.split_pattern(texts, " ")
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary
        if self.folds:
            words = pc.if_else(pc.match_substring_regex(words, LATIN), pc.utf8_lower(words), words)
        marked = pc.match_substring_regex(words, MARKED)
        heads = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(words, -1), "")
        both = pa.concat_arrays([heads, marks]).dictionary_encode()
        pool, size = self._pool(both.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool, ends = gathered(pool, size, both.indices.to_numpy().reshape(2, -1).T.ravel())  # of words with their marks
        ids, ends = gathered(pool, np.diff(ends[::2]), flat.indices.to_numpy())
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def gathered(pool: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a pool, of the sizes given, in another order, and where each begins."""
    begin, n = (np.cumsum(size) - size)[which], size[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])], ends


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = 1) -> DataFrame:
    """Pieces of at most limit tokens: part, pos, nth, doc_id, piece, start, length, ids (little-endian 32-bit).

    part and pos name a piece; nth counts the earlier pieces of its length in its part. Write the result before it is
    used twice: part and nth are of one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, pos, part = encoder(tokenizer), np.zeros(limit + 1, dtype=np.int64), 0, TaskContext.get().partitionId()
        for b in slices(batches, 1024):
            ids, begin = words.encode(b["text"].cast(pa.string()).fill_null(""))
            k = np.arange(b.num_rows)
            begin = begin + np.arange(b.num_rows + 1)  # with an end id behind every text
            full = np.full(begin[-1], end, "<u4")
            own = np.ones(len(full), bool)
            own[begin[1:] - 1] = False
            full[own] = ids
            size = np.diff(begin)
            parts = -(-size // limit)
            text, piece = np.repeat(k, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * limit
            length = np.minimum(size[text] - start, limit)
            order = np.argsort(length, kind="stable")
            first = np.concatenate([[True], np.diff(length[order]) > 0]) if len(order) else np.zeros(0, bool)
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            nth += seen[length]
            seen += np.bincount(length, minlength=limit + 1)
            edges = pa.array((4 * np.append(begin[text] + start, len(full))).astype(np.int32))
            cut = pa.Array.from_buffers(pa.binary(), len(text), [None, edges.buffers()[1], pa.py_buffer(full)])
            cols = [np.full(len(text), part, np.int32), pos + np.arange(len(text)), nth, b["doc_id"].take(pa.array(text)), piece.astype(np.int32), start, length, cut]
            pos += len(text)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["part", "pos", "nth", "doc_id", "piece", "start", "length", "ids"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"part int, pos long, nth long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


def patterns(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences and how many sequences have them, for counts[length] pieces of each length.

    From the longest length on, the gap that a piece leaves is looked up among the single lengths, the sums of two and
    the sums of three that the counts allow, and filled exactly as often as they last. What finds no exact complement is
    packed best fit, longest first. Time and memory depend on limit, not on the number of pieces."""
    c = counts.astype(np.int64).copy()
    c.resize(limit + 1, refcheck=False)
    out: list[tuple[tuple[int, ...], int]] = []
    if c[limit]:
        out.append(((limit,), int(c[limit])))
    c[limit] = c[0] = 0
    have = (c > 0).astype(np.int64)
    sums = np.convolve(have, have)[: limit + 1]  # ordered pairs of different or equal lengths, by their sum
    alone = np.flatnonzero(c == 1)
    np.subtract.at(sums, 2 * alone[2 * alone <= limit], 1)

    def use(parts: tuple[int, ...], times: int) -> None:
        out.append((parts, times))
        for x, k in Counter(parts).items():
            before = c[x]
            c[x] -= k * times
            if before >= 2 > c[x] and 2 * x <= limit:
                sums[2 * x] -= 1
            if c[x] == 0:
                have[x] = 0
                others = np.flatnonzero(have[: limit + 1 - x])
                sums[others + x] -= 2

    def most(parts: tuple[int, ...]) -> int:
        return min(int(c[x]) // k for x, k in Counter(parts).items())

    def two(gap: int, rest: tuple[int, ...]) -> tuple[int, ...] | None:
        if gap < 2 or sums[gap] <= 0:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(have[a] > 0) & (have[gap - a] > 0)]:
            if most(parts := (*rest, int(x), gap - int(x))):
                return parts
        return None

    def fill(first: int) -> tuple[int, ...] | None:
        gap = limit - first
        if have[gap] and most(parts := (first, gap)):
            return parts
        if parts := two(gap, (first,)):
            return parts
        if gap >= 3:
            a = np.arange(gap - 2, 0, -1)
            for x in a[(have[a] > 0) & (sums[gap - a] > 0)]:
                if parts := two(gap - int(x), (first, int(x))):
                    return parts
        return None

    rest: list[tuple[int, int]] = []
    for first in range(limit - 1, 0, -1):
        while c[first] and (parts := fill(first)):
            use(parts, most(parts))
        if c[first]:
            rest.append((first, int(c[first])))
            c[first] = 0
            have[first] = 0
            others = np.flatnonzero(have[: limit + 1 - first])
            sums[others + first] -= 2
            if 2 * first <= limit:
                sums[2 * first] = max(0, sums[2 * first] - 1)
    return out + best_fit(rest, limit)


def best_fit(rest: list[tuple[int, int]], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room; equal sequences are kept as one with a count."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    open_ = np.zeros(limit + 1, dtype=bool)

    def put(parts: tuple[int, ...], gap: int, times: int) -> None:
        kinds = bins.setdefault(gap, {})
        kinds[parts] = kinds.get(parts, 0) + times
        open_[gap] = True

    for x, n in rest:
        while n:
            room = np.flatnonzero(open_[x:])
            if not len(room):
                each = limit // x
                if n >= each:
                    put((x,) * each, limit - each * x, n // each)
                if n % each:
                    put((x,) * (n % each), limit - n % each * x, 1)
                break
            gap = int(room[0]) + x
            parts, times = bins[gap].popitem()
            k = min(n, times)
            if times > k:
                bins[gap][parts] = times - k
            elif not bins[gap]:
                open_[gap] = False
            put((*parts, x), gap - x, k)
            n -= k
    return [(parts, k) for kinds in bins.values() for parts, k in kinds.items()]


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """By length and rank: where the pieces of a length go. One entry for each place of a pattern."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for parts, times in found:
        at = 0
        for x in parts:
            rows.append((x, used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    a = np.array(rows or [(0, 0, 0, 0)], dtype=np.int64)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = 1, keep: list[Column] | None = None) -> DataFrame:
    """All pieces of docs (doc_id, text) with their places: doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its ids and then the id end; a null or empty text is the end id alone. Documents longer than limit are
    cut into pieces of limit tokens, the last may be shorter. Repeated rows and null ids are packed like any others;
    no rows give no rows; other columns are not looked at. keep: columns to return in place of ids.

    Texts are tokenized once, into a written table. Only the histogram of piece lengths (at most limit numbers) reaches
    the driver; the plan has an entry for each place of a pattern and does not grow with the pieces. A piece finds its
    place by its rank among the pieces of its length: its count within its part plus the counts of the parts before.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(tokenize(docs, tokenizer, limit, end))
    counts = scratch.save(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")))
    hist = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most limit rows
        hist[length] = n
    plan = slots(patterns(hist, limit))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = scratch.save(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")))
    fields = pieces.select("part", "length", "doc_id", "piece", "start", "nth", *(keep or [F.col("ids")]))
    names = fields.columns[6:]
    ranked = fields.join(small(before), ["part", "length"]).select("doc_id", "piece", "start", "length", *names, (F.col("nth") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b["rank"].to_numpy()
            k = np.searchsorted(plan["key"], (b["length"].to_numpy() << 48) + rank, side="right") - 1
            cols = [b[n] for n in b.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(plan["sequence"][k] + rank - plan["rank"][k]), pa.array(plan["offset"][k])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe(), keep=[F.crc32("ids").alias("ids_crc32")])

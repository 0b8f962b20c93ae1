"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat_format, common, exact_dedup, graph, mixing, near_dedup, packing, pii, secrets, suffix_dedup, topk, toxicity

DOCS = "doc_id long, text string, source string, kept boolean, n long, v string"


def docs(spark, texts, ids=None, sources=None):
    ids, sources = ids or range(len(texts)), sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, s, True, 1, "x") for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def prose(seed, n, words=60):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", *("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(words))]) for _ in range(n))


def test_exact(spark):
    texts = ["a  b", "a b", "a\tb", None, "", "c", "c", None]
    got = exact_dedup.exact_dedup(docs(spark, texts, [5, 3, 9, 2, 1, 7, 7, None])).orderBy("doc_id").collect()
    by = {(r.doc_id, r.keep_id, r.group_size): r for r in got}
    assert set(by) == {(5, 3, 3), (3, 3, 3), (9, 3, 3), (2, 1, 3), (1, 1, 3), (7, 7, 2), (None, 1, 3)}
    assert sum(r.kept for r in got) == 3 and by[3, 3, 3].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_near_against_brute_force(spark):
    base = [prose(k, 80) for k in range(6)]
    texts = [t for k, b in enumerate(base) for t in (b, b + " extra words here", b.replace("the", "THE", 3), prose(100 + k, 30))]
    texts += [None, "", " \t", "one", "ONE", "one", base[0]]
    sets = [set(zip(w, w[1:], strict=False)) or {tuple(w)} if w else set() for w in ((t or "").lower().split() for t in texts)]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_dedup.near_dedup(docs(spark, texts), words=2).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == comp and [r.n_shingles for r in got] == [len(s) for s in sets]
    assert [r.kept for r in got] == [k == c for k, c in enumerate(comp)]


def linked(texts, words):
    """The component of each text, by comparing all pairs."""
    sets = [set(zip(*(w[k:] for k in range(words)), strict=False)) or {tuple(w)} if w else set() for w in ((t or "").lower().split() for t in texts)]
    comp = list(range(len(texts)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                comp[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize(("words", "length", "long", "levels"), [(2, 60, 32, 4), (2, 60, 3, 4), (2, 60, 3, 1), (5, 150, 8, 4)])
def test_near_tells_large_groups_apart(spark, monkeypatch, words, length, long, levels):
    monkeypatch.setattr(near_dedup, "LONG", long)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    r, base = random.Random(long), prose(7, length, 900).split()
    texts = []
    for k in range(160):  # about the threshold from each other: words changed, left out, put in, ends cut off, own text added
        w = list(base)
        for _ in range(r.randrange(1 + length // 12)):
            at = r.randrange(len(w))
            w[at : at + r.choice((0, 1, 1, 1, 2))] = [f"w{r.randrange(400)}"] * r.choice((0, 1, 1, 1))
        if k % 5 == 0:
            w = w[: r.randrange(length // 2, len(w))]
        if k % 7 == 0:
            w += [f"own{k // 14}x{x}" for x in range(r.randrange(20))]
        texts.append(" ".join(w))
    got = near_dedup.near_dedup(docs(spark, texts), words=words).orderBy("doc_id").collect()
    want = linked(texts, words)
    assert 20 < len(set(want)) < 150
    assert [g.component_id for g in got] == want


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)]
    at = {x: x for e in edges for x in e}
    for _ in at:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "test")).collect()
    assert {x.id: x.comp for x in got} == {x: c for x, c in at.items() if x in linked}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>[]/sINTSYROLED\x1b01 ok", max_size=40))
def test_escape_round_trip(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROLS)


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "</s>[INST] \x1b"), (1, 2, "assistant", "é<s>" * 30), (1, 3, "assistant", ""), (2, None, "tool[END]", None), (2, 1, None, "x"), (None, 0, "user", "n"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(c, chat_format.byte_bpe()), chat_format.byte_bpe()).collect()}
    for conv in (1, 2, None, 3):
        own = [(r or "", t or "") for k, _, r, t in rows if k == conv]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest() and got[conv].n_turns == len(own)
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_toxicity(spark):
    r = random.Random(1)
    texts = [prose(k, 40) + (" " + r.choice(["scum", "moron"]) if k % 3 == 0 else "") for k in range(300)] + [None, ""]
    d = docs(spark, texts, [*range(301), None])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.train(d, labels)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == 302 and all(0 <= x.score <= 1 for x in got)
    assert all((x.score >= 0.7) == (x.doc_id % 3 == 0) for x in got if x.doc_id is not None and x.doc_id < 300 and x.held)
    assert all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got if x.doc_id is not None)
    flat = toxicity.fit([np.array([1], np.uint32)] * 2, [None, None], np.array([0, 0]))
    assert flat.bias < 0 and not len(flat.ids)


def test_identity_swaps_narrow_the_gap():
    f = lambda *x: np.array(sorted(x), np.uint32)
    features = [f(1, 9)] * 20 + [f(1)] * 10 + [f(2)] * 40
    swaps = [f(3, 9)] * 20 + [f(3)] * 10 + [None] * 40
    labels = np.array([1] * 30 + [0] * 40)
    weight = lambda m: dict(zip(m.ids.tolist(), m.weights, strict=True)).get(1, 0.0)
    assert weight(toxicity.fit(features, swaps, labels, fair=5.0)) < 0.5 * weight(toxicity.fit(features, swaps, labels, fair=0.0))


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8)).round(2)
    x[7] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(301, None), (302, [None] * 8), (303, [float("nan")] * 8), (100, x[100].tolist()), (None, x[0].tolist()), (400, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=5).collect()
    v = np.floor(1024 * x).astype(int)
    for q in (0, 200):
        all_ = sorted([(-int(v[q] @ v[k]), k) for k in range(300) if k != q] + [(-int(v[q] @ v[100]), 100)])[:5]
        assert [(-s, k) for s, k in all_] == [(g.score, g.vec_id) for g in sorted(got, key=lambda g: g.rank) if g.query_id == q]
    assert sum(g.query_id == 100 for g in got) == 10 and not any(g.query_id == 400 for g in got)


def removed(texts):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by a count of all its strings of 400 bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        yield len(b), gone.sum(), (np.diff(gone.astype(int), prepend=0) == 1).sum(), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [None, 1])
def test_suffix_against_brute_force(spark, monkeypatch, hot):
    part, r = prose(1, 120), random.Random(3)
    texts = [part[:390] + "q", "x " + part, prose(2, 50) + part[5:], part[:450] + "é" + part[:450], None, "", "short", prose(3, 90), prose(3, 90), "ab" * 400, "a" * 399, "a" * 400, "z" * 5000]
    line = prose(5, 60)[:300]  # every text has it, each between texts of its own
    texts += [f"{prose(20 + k, 60)}{r.choice('xyz ') * r.randrange(3)}{line}{r.choice('pq') * r.randrange(60)}{prose(40 + k, 60)}" for k in range(12)]
    texts += [prose(60 + k % 3, 200).replace("the", "they" if k == 4 else "the", 1) for k in range(6)]
    if hot:  # every hash that bodies share is dealt out anew
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "BUCKET", 2000)
    got = suffix_dedup.suffix_dedup(docs(spark, texts)).orderBy("doc_id").collect()
    for k, (want, g) in enumerate(zip(removed(texts), got, strict=True)):
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want, k


def test_suffix_joins_on_hashes_read_no_aggregate(spark, monkeypatch):
    plans, save = [], common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df, *a))
    line = prose(5, 90)  # its hashes are shared by a body of each text
    texts = [f"{prose(20 + k, 30)} {line} {prose(60 + k, 30)}" for k in range(30)]
    got = suffix_dedup.suffix_dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == list(removed(texts))
    joins = [p for p in plans if re.search(r"Join \w+, \(h#", p)]
    assert len(joins) == 2 and not any("Aggregate" in p for p in joins)  # under one, a hash of many bodies is one task's


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from(["ab", "abc", "\0a", "abcdefgh"]), st.integers(1, 6))
def test_equal_suffixes_of_structured_bytes(seed, letters, n):
    r = random.Random(seed)
    unit = "".join(r.choice(letters) for _ in range(r.randrange(1, 500)))
    bodies = []
    for _ in range(n):
        b = bytearray((unit * 40)[(a := r.randrange(50)) : a + r.randrange(400, 900)].ljust(400, "z").encode())
        if r.random() < 0.5:
            b[r.randrange(len(b))] = 33
        bodies.append(bytes(b))
    seen = Counter(b[k : k + 400] for b in bodies for k in range(len(b) - 399))
    assert [m.tolist() for m in suffix_dedup.equal_suffixes(bodies)] == [[seen[b[k : k + 400]] > 1 for k in range(len(b) - 399)] for b in bodies]


def test_suffix_tells_colliding_hashes_apart(spark):
    d = np.ones(1, np.int64)  # a difference of texts that is a product of x**k - 1, and so 0 modulo 2**64 at any odd x
    for k in (128, 128, 64, 32, 16, 8, 8, 4, 4, 2, 2, 1, 1):
        d = np.convolve(d, [-1] + [0] * (k - 1) + [1])
    d = np.pad(d, (0, 400 - len(d)))
    a, b = (bytes((40 + np.maximum(x, 0)).astype(np.uint8)) for x in (d, -d))
    hashes = [suffix_dedup.gram_hashes(np.frombuffer(x, np.uint8), 400) for x in (a, b)]
    assert a != b and hashes[0] == hashes[1]
    texts = [x.decode("ascii") for x in (a, b, a[:399] + b"~", b[:399] + b"~", a + prose(1, 90).encode(), b + prose(2, 90).encode())]
    got = suffix_dedup.suffix_dedup(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == list(removed(texts))


def test_cover():
    c, p = suffix_dedup.cover(), suffix_dedup.PERIOD
    assert {(a - b) % p for a in c for b in c} == set(range(p))
    assert all((a + d) % p in c and (b + d) % p in c for a, row in enumerate(suffix_dedup.shifts()) for b, d in enumerate(row))


def test_secrets():
    body = "a" * 30
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        tail = secrets.DIGITS62[k] + tail
    text = f"İ PassWord=abcdefghijkl token: short api_key='AKIA{'Z' * 16}' ghp_{body}{tail} ghp_{body}000000 deadbeefdeadbeef secret=token=abcdefghijkl"
    got = secrets.find_secrets(text)
    base = [(m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 12]
    assert [(s, e) for k, s, e, _ in got if k == "assign"] == base and Counter(k for k, *_ in got) == {"assign": 3, "access": 1, "github": 1, "hex": 1 + (len(re.findall(r"[0-9a-f]{16,}", text)) - 1)}
    assert secrets.find_secrets(None) == secrets.find_secrets("") == []


def test_pii_against_brute_force(spark):
    texts = ["a.b@c.d_e@f.gh x@y 1.2.3.4.5.6.7.8 300.1.1.1", "card 4111 1111 1111 1111, +49 (0)30 1234567-8 +1 2", None, "", "1" * 3000 + " a" * 300 + "@", "é😀 a@b.co " * 300]
    from tests.llm.plain import base_spans

    got = pii.find_pii(docs(spark, texts)).orderBy("doc_id").select("*", pii.sanitised(F.lit(texts[0]), F.col("spans")).alias("clean")).collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in got] == [base_spans(t or "") for t in texts]
    assert got[0].clean.startswith("[email][email] x@y [ip].")


def test_pii_terms_disclose(spark):
    texts = [f"{prose(k, 30)} call bob@corp.com about nightingale" for k in range(8)] + [prose(50 + k, 40) for k in range(40)]
    got = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    assert all(any(s.kind == "term" and s.value == "nightingale" for s in r.spans) for r in got[:8]) and not any(r.spans for r in got[8:])


def told(texts):
    """Entity and term pairs that disclose, by plain counts over different texts."""
    own = [(set(re.findall(r"[a-z0-9.]+@[a-z.]+[a-z]", t)), {w for w in re.findall(r"[a-z]+", t) if len(w) >= pii.LETTERS}) for t in set(texts)]
    n_e, n_t, n_et = Counter(e for es, _ in own for e in es), Counter(w for _, ws in own for w in ws), Counter((e, w) for es, ws in own for e in es for w in ws)
    share = lambda e, w: np.log2(n_et[e, w] * len(own) / (n_e[e] * n_t[w])) / np.log2(len(own) / n_e[e])
    return {(e, w): share(e, w) for (e, w), k in n_et.items() if k >= pii.CONTEXTS and share(e, w) >= pii.GENERALISE}


def test_pii_terms_against_brute_force(spark):
    common = prose(9, 400)  # every text has the same 400 words, and so mostly the same least hash
    who = ["bob@corp.com", "eve@corp.org", "joe@home.net"]
    pets = dict(zip(who, ("nightingale", "salamander", "wolverine"), strict=True))
    texts = [f"{common} {prose(200 + k, 9)} {who[k % 3]} {pets[who[k % 3]]}" for k in range(24)]
    texts += [f"{common} {prose(600 + k, 9)}" + (" wolverine" if k % 9 == 0 else "") for k in range(90)]
    texts += texts[:6] * 3 + texts[30:60] * 2
    want = told(texts)
    assert {w for _, w in want} >= {"nightingale", "salamander"} and not {w for _, w in want} & set(common.split())
    got = pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()
    for t, g in zip(texts, got, strict=True):
        assert {s.value for s in g.spans if s.kind == "term"} == {w for e, w in want if e in t and re.search(rf"\b{w}\b", re.sub(r"\S+@\S+", " ", t))}


def test_pii_terms_generalised_or_removed(spark):
    texts = [f"{prose(k, 30)} bob@corp.com nightingale wolverine" for k in range(8)] + [prose(50 + k, 40) + " wolverine" * (k == 0) for k in range(40)]
    assert {w for _, w in told(texts)} >= {"nightingale", "wolverine"}  # shares of 1 and of 1 - log2(9 / 8) / log2(6) = 0.934
    got = pii.find_pii(docs(spark, texts)).where("doc_id = 0").select(pii.sanitised(F.lit(texts[0]), F.col("spans")).alias("clean"), "spans").first()
    assert got.clean.endswith(" [email]  [term]") and all(s.share is None for s in got.spans if s.kind == "email")


@pytest.mark.parametrize(("n", "found"), [(4961, False), (4962, True)])  # 30 * (5 / 3) ** 10 = 4961.5 texts reach the share
def test_pii_counts_the_corpus_exactly(spark, n, found):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    texts = [f"{name(k)} {'bob@ab.com' if k < 30 else ''} {'nightingale' if k < 50 else ''}" for k in range(n)] * 2
    got = pii.find_pii(docs(spark, texts)).where("doc_id < 30").collect()
    assert [any(s.value == "nightingale" for s in r.spans) for r in got] == [found] * 30


def test_packing(spark):
    texts = [prose(k, 300 + 97 * k % 900) for k in range(40)] + [None, "", "x " * 9000, "x"]
    got = packing.pack_documents(docs(spark, texts), packing.word_bpe()).collect()
    tk = packing.encoder(packing.word_bpe()).tokenizer
    want = {k: [*tk.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    for g in got:
        assert np.frombuffer(g.ids, "<u4").tolist() == want[g.doc_id][g.start : g.start + g.length] and g.start == 4096 * g.piece
    ends = Counter()
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert g.offset == ends[g.sequence_id]
        ends[g.sequence_id] += g.length
    assert max(ends.values()) <= 4096 and sum(ends.values()) == sum(map(len, want.values())) 
    gaps = []  # plain best fit, longest first
    for n in sorted((g.length for g in got), reverse=True):
        fit = min((x for x in gaps if x >= n), default=None)
        if fit is None:
            gaps.append(4096 - n)
        else:
            gaps[gaps.index(fit)] -= n
    assert len(ends) <= len(gaps)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_patterns_use_every_piece_once(counts):
    c = np.zeros(65, np.int64)
    for k, n in counts.items():
        c[k] = n
    used = Counter()
    for parts, times in packing.patterns(c, 64):
        assert sum(parts) <= 64 and times > 0
        for x in parts:
            used[x] += times
    assert used == Counter(counts)


def test_mixing(spark):
    r = random.Random(2)
    texts = [" ".join(["w"] * r.randrange(1, 90)) for _ in range(240)] + [None, "", "a b"]
    sources = [r.choice(["a", "b", None, "ä"]) for _ in range(243)]
    d = docs(spark, texts, sources=sources)
    got, again = (mixing.mix_sources(d).collect() for _ in range(2))
    assert sorted((g.doc_id, g.taken) for g in got) == sorted((g.doc_id, g.taken) for g in again)
    size, want = Counter(), {}
    for t, s in zip(texts, sources, strict=True):
        size[s] += len((t or "").split())
    weight = dict(zip(sorted((s for s in size if s), key=str) + [None], (3, 1, 2, 3), strict=False))
    left, open_ = 1.5 * sum(size.values()), dict(weight)
    while over := [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * size[s]]:
        for s in over:
            want[s] = 2 * size[s]
        left -= sum(2 * size[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    took = Counter()
    for g in got:
        took[g.source] += g.taken
        assert g.taken <= 2 * g.size and g.target == pytest.approx(want[g.source]) and g.source_size == size[g.source]
    assert all(abs(took[s] - want[s]) <= 2 for s in want)


def test_empty_tables(spark):
    d = docs(spark, [])
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, suffix_dedup.suffix_dedup, secrets.scan_secrets, pii.find_pii, mixing.mix_sources):
        assert f(d).count() == 0
    assert packing.pack_documents(d, packing.word_bpe()).count() == 0
    assert toxicity.score(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") > 0).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), chat_format.byte_bpe()).count() == 0

"""Whitening, license scan and divergence audit against plain computations, with nulls, repeats, ties and empty tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftline.llm import divergence, licenses, queries, whitening


def vectors(spark, rows, **extra):
    """vec_id, embedding and extra columns of names that the operator uses itself."""
    names = ["vec_id", "embedding", *extra]
    return spark.createDataFrame([(i, v, *extra.values()) for i, v in rows], f"vec_id long, embedding array<double>{''.join(f', `{n}` int' for n in names[2:])}").repartition(3)


def whitened(df, **args):
    return {(r.vec_id, k): r for k, r in enumerate(whitening.whiten(df, **args).collect())}


def plain_whitening(rows, most=32):
    """x of the rows that count, deviations, eigenvalues, trace and components."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in v] + [1000000] * (dims - len(v)) for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    v = (d.T @ d).astype(float) / n**3
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    return [i for i, _ in good], x, (d * d).sum(axis=1), values[order], np.trace(v), ((d / n).astype(float) @ vectors[:, order]) / np.sqrt(values[order])


@pytest.mark.parametrize(("n", "dims"), [(400, 5), (9000, 70)])
def test_whitening_against_plain(spark, n, dims):
    r = np.random.default_rng(n)
    mix = r.normal(size=(dims, dims)) * np.linspace(1, 30, dims)
    rows = [(k, (r.normal(size=dims) @ mix + 40).round(2).tolist()) for k in range(n)]
    rows += [(n, None), (n + 1, [None, *rows[0][1][1:]]), (n + 2, [float("nan"), *rows[0][1][1:]]), (n + 3, [float("-inf"), *rows[0][1][1:]]), (7, rows[7][1]), (n + 4, rows[3][1][: dims - 2])]
    ids, x, deviation, values, trace, want = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows, x=1, n=2, block=3, tile=4)).toPandas()
    assert sorted(got.vec_id) == sorted(ids) and set(got.n) == {len(x)}
    at = {}
    for k, i in enumerate(ids):
        at.setdefault(i, k)  # vec_id 7 is there twice, with the same vector
    rows_at = [at[i] for i in got.vec_id]
    assert list(got.deviation) == [int(deviation[k]) for k in rows_at]
    w = np.array(got.whitened.tolist())
    assert np.allclose(np.abs(w), np.abs(want[rows_at]), rtol=1e-6, atol=1e-6)
    signs = np.sign((w * want[rows_at]).sum(axis=0))
    assert np.allclose(w, want[rows_at] * signs, rtol=1e-6, atol=1e-6)  # one sign for all rows
    assert np.allclose(got.explained[0], values / trace, rtol=1e-9)
    assert np.abs(w.T @ w / len(w) - np.eye(w.shape[1])).max() <= got.identity_error[0] + 1e-9 <= 1e-4


def test_whitening_without_variance(spark):
    same = [(k, [1.0, 2.0]) for k in range(4)]
    assert whitening.whiten(vectors(spark, same)).collect() == whitening.whiten(vectors(spark, same[:1])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(50)]  # one component only
    got = whitening.whiten(vectors(spark, line)).collect()
    assert len(got) == 50 and {len(r.whitened) for r in got} == {1} and got[0].explained == pytest.approx([1.0])


def test_whitening_of_huge_entries(spark):
    rows = [(k, [1e300 if k == 0 else float(k), float(k % 3)]) for k in range(20)]
    got = {r.vec_id: r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert len(got) == 20 and got[0].deviation is None  # 2**40 is where entries stop; its square times n**2 is beyond a long


def test_deviations_are_exact():
    fit = whitening.Fit(3, [3 * 10**6 + 1, 3 * 10**6 - 1], np.zeros((0, 2)), np.zeros(0), 0.0)
    x = np.array([[10**6 + 2**29, 10**6], [10**6, 10**6 - 10**9], [10**6, 10**6 + 2**31]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, fit.sums, strict=True)) for row in x]
    assert whitening.deviations(x, fit) == [w if w < 2**63 else None for w in want] and want[2] > 2**63 > want[1]


def test_op11(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=40).tolist()) for k in range(300)] + [(300, None)]
    pq.write_table(pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64()))}), tmp_path / "embeddings.parquet")
    got = queries.QUERIES["op11_whitening"](spark, str(tmp_path)).toPandas()
    ids, _, deviation, values, trace, want = plain_whitening(rows)
    assert len(got) == 300 * 32 and set(got.component) == set(range(1, 33))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(want), atol=1e-8)
    assert (got.groupby("vec_id").deviation.first().loc[ids].to_numpy() == deviation).all()
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(values / trace)


PLAIN_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def plain_licenses(text):
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    found = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


LICENSED = {
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache,apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "GNU\tGeneral-Public_License v2 only": "gpl,gpl-2.0",
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "cc-by cc by ccby cc bye": "cc-by",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: MPL-2.0\nlicense: ISC": "isc,mpl-2.0",
    "GNU Lesser General Public License v2.1": "lgpl-2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and": "mit",
    "available under the terms of the Mozilla Public License": "mpl",
    "see http://www.apache.org/licenses/LICENSE-2.0.txt": "apache-2.0",
    "er ging mit der Lizenz, mitlicense, apache licenses": "",
    "a mi̇t license, gnu general public liçense": "",
}


def test_licenses(spark, tmp_path):
    r = random.Random(2)
    texts = [*LICENSED, None, "", "---", "CC BY", " MIT  License MIT license.mit LICENSE ", "x " * 3000 + "mit license " * 3000, "İ MIT LICENSE K"]
    bits = ["gnu", "general", "public", "license", "Apache", "LICENSE", "cc", "by", "mit", "é", "2.0", "under", "licensed", "-", "nc"]
    texts += [" ".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(300)]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts, "n_words": [1] * len(texts), "x": [2] * len(texts)}), tmp_path / "documents.parquet")
    got = {g.doc_id: g for g in queries.QUERIES["op12_licenses"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        g = got[k]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain_licenses(t), t
        labels = set(filter(None, g.labels.split(",")))
        assert labels >= set(filter(None, g.base_labels.split(","))) and g.labels == ",".join(sorted(labels))
        assert (g.score > 0) == bool(labels) and 0 <= g.score <= 1
    assert {t: got[k].labels for k, t in enumerate(LICENSED)} == LICENSED
    assert len(got) == len(texts)


def expanded(pattern):
    """All texts that a pattern of literals, choices and options matches."""
    out = [""]
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "IN":
            parts = [chr(c) for o, x in arg for c in ([x] if str(o) == "LITERAL" else range(x[0], x[1] + 1))]
        elif name == "BRANCH":
            parts = [t for way in arg[1] for t in expanded(way)]
        elif name == "SUBPATTERN":
            parts = expanded(arg[3])
        else:
            assert name == "MAX_REPEAT" and arg[1] <= 2, name
            parts = [""] if arg[0] == 0 else []
            once = expanded(arg[2])
            parts += once if arg[0] <= 1 else []
            parts += [x + y for x in once for y in once] if arg[1] == 2 else []
        out = [a + b for a in out for b in parts]
    return out


def test_rules_hold_their_literals():
    """The prefilters never hide a match: each rule's literals, and one of the hints, are in every text that it matches."""
    rules = licenses.rules()
    assert len(rules) > 300 and len({(r.label, r.pattern, r.keyword) for r in rules}) == len(rules)
    for r in rules:
        for text in expanded(re._parser.parse(r.pattern)):
            assert r.keyword in text and r.second in text and any(h in text for h in licenses.HINTS), (r, text)
            assert text == text.strip() and "  " not in text and not re.search("[^a-z0-9 ]", text), (r, text)


def test_settled_against_plain(spark):
    """Of random intervals those stay that no other of the same or a better priority holds; base phrases stay."""
    r, rows = random.Random(5), []
    for k in range(60):
        some = []
        for rank in range(r.choice([0, 1, 3, 20, 700])):
            a, n = r.randrange(200), r.randrange(1, 12)
            some.append((a, -(a + n), r.randrange(3), rank, a + n, "x", 0.5, r.random() < 0.1))
        rows.append((k, some))
    df = spark.createDataFrame(rows, f"k int, d {licenses.DETECTIONS}").select("k", licenses.settled(F.col("d")).alias("d"))
    for g in df.collect():
        some = dict(rows)[g.k]
        inside = lambda x, y: x is not y and y[2] <= x[2] and y[0] <= x[0] and y[4] >= x[4] and ((y[0], y[4]) != (x[0], x[4]) or (y[2], y[3]) < (x[2], x[3]))
        want = {x[3] for x in some if x[7] or not any(inside(x, y) for y in some)}
        assert {x["rank"] for x in g.d} == want


def plain_audit(rows):
    """All parts by summing over all kept terms, as the contract words it."""
    group, by, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        group[lang, source].update(terms)
        by[lang].update(terms)
        held[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in held[lang].items() if n >= 3) for lang in by}
    p = lambda counts, terms: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in terms) + len(terms)) for t in terms}
    probs = {g: p(c, kept[g[0]]) for g, c in group.items()}
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for (lang, source), own in probs.items():
        parts = {"pair": [(sum(f(own[t], other[t]) for t in own), s) for (g, s), other in probs.items() if g == lang and s != source]}
        q = p(by[lang], kept[lang])
        parts["term"] = [(f(own[t], q[t]), t) for t in own if group[lang, source][t] and own[t] > q[t]]
        for part, some in parts.items():
            some.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(some) if part == "pair" or k < 200]
    return sorted(out)


def made_corpus():
    r = random.Random(4)
    some = [f"W{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), " ".join(r.choices(some, k=r.randrange(5, 600)))) for _ in range(90)]
    rows += [("en", "a", rows[0][2])] * 3 + [("en", "only", None), ("en", "blank", " 1 2 "), ("fr", "a", "un deux"), ("fr", "b", "un"), ("es", "a", "uno " * 3), ("", "", "x")]
    return rows + [("en", "b", "ÉCOLE École İ İx a'b_c9d \x00zero " * 3)] * 4


def test_audit(spark, tmp_path):
    rows = made_corpus()
    lang, source, text = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": [1] * len(rows), "lang": lang, "source": source, "text": text, "term": [0] * len(rows), "n": [0] * len(rows)}), tmp_path / "documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op13_divergence"](spark, str(tmp_path)).collect()))
    want = plain_audit(rows)
    assert got == want and {x[2] for x in want} == {"pair", "term"} and max(x[5] for x in want) == 200
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(con.execute(divergence.OP13_SQL).fetchall()) == want


def test_audit_of_little(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(none).collect() == []
    two = spark.createDataFrame([("en", "a", None), ("en", "b", "rare words")], none.schema)
    assert sorted(map(tuple, divergence.audit(two).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts_are_counted_in_pieces():
    text = ("Aa bbé " * 1_000_000).encode()
    parts = list(divergence.pieces(text))
    assert len(parts) > 1 and Counter(t for p in parts for t in p) == Counter({b"aa": 1_000_000, "bbé".encode(): 1_000_000})
    assert list(divergence.pieces(b"")) == []

"""Every registered corpus query, and the pipeline, on a small folder of tables against plain computations of its rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.plain import base_secrets, base_spans
from tests.llm.test_corpus_operators import linked, prose, removed
from weftline.llm import packing, queries

SOURCES = ["web", "books", None, "code"]


def made_documents():
    """doc_id, text, source of texts with copies, near copies, personal data, secrets, insults, nulls and long texts."""
    r = random.Random(11)
    texts = [prose(k, r.randrange(40, 160)) for k in range(120)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:12]] + texts[:6] * 2
    texts += [f"{t} one more ending" for t in texts[12:30]] + [" ".join(t.split()[: len(t.split()) // 2]) for t in texts[30:36]]
    texts += [f"{texts[k]} you {r.choice(['scum', 'moron'])}" for k in range(40, 90)]
    texts += [f"mail a{k}.b@c{k}.org or 10.0.{k}.25{k} or +49 30 12345{k}67, card 4111 1111 1111 1111" for k in range(8)]
    texts += [f"Password = 'abc/{k}defGHIjkl' AKIA{'Q' * 14}{k} deadbeef{k}deadbeef api-key: short TOKEN:ünï sekret" for k in range(8)]
    texts += [None, None, "", " \t", "one", "ONE", prose(500, 9000), prose(501, 9000), prose(500, 9000)]
    return [(k + 3, t, SOURCES[k % 4]) for k, t in enumerate(texts)]


def is_toxic(text):
    return bool(re.search(r"\b(scum|moron)\b", text or ""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rows, r = tmp_path_factory.mktemp("tables"), made_documents(), np.random.default_rng(5)
    ids, texts, sources = zip(*rows, strict=True)
    documents = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts), "lang": pa.array(["en"] * len(ids)), "source": pa.array(sources), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    named = [i for i, _, _ in rows if i % 5]
    by = {i: t for i, t, _ in rows}
    labels = {"doc_id": pa.array(named, pa.int64()), "quality": pa.array([1] * len(named), pa.int32()), "toxic": pa.array([int(is_toxic(by[i])) for i in named], pa.int32())}
    turns = [(c, t, ("system", "user", "assistant")[t % 3], None if c == 4 and t == 2 else f"[INST]{prose(c * 9 + t, 20)} é") for c in range(12) for t in range(1 + c % 5)]
    conversations = dict(zip(("conv_id", "turn", "role", "text"), (pa.array(x) for x in zip(*turns, strict=True)), strict=True))
    embeddings = {"vec_id": pa.array(range(250), pa.int64()), "embedding": pa.array([v.tolist() for v in r.normal(size=(250, 8)).round(1)], pa.list_(pa.float32()))}
    for name, columns in {"documents": documents, "labels": labels, "conversations": conversations, "embeddings": embeddings}.items():
        pq.write_table(pa.table(columns), out / f"{name}.parquet")
    return str(out)


def asked(spark, folder, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op1_pii", base_spans, ("email", "ip", "card", "phone")), ("op8_secrets", base_secrets, ("assign", "access", "hex"))])
def test_spans(spark, folder, name, plain, kinds):
    got, seen = asked(spark, folder, name), Counter()
    for i, text, _ in made_documents():
        want = plain(text or "")
        seen.update(k for k, _, _ in want)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(w[0] == k for w in want) for k in kinds], i
        assert got[i].base_sha256 == digest(want)
        spans = [s for s in got[i].spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in kinds] == [f"{k}:{a}:{z}" for k, a, z in want]
    assert all(seen[k] >= 5 for k in kinds) and len(got) == len(made_documents())


def test_near(spark, folder):
    rows, got = made_documents(), asked(spark, folder, "op2_near_dedup")
    for (i, text, _), c in zip(rows, linked([t for _, t, _ in rows], 2), strict=True):
        w = (text or "").lower().split()
        assert (got[i].component_id, got[i].kept) == (rows[c][0], rows[c][0] == i)
        assert got[i].n_shingles == (len(set(zip(w, w[1:], strict=False))) or min(len(w), 1))


def test_chat(spark, folder):
    turns = defaultdict(list)
    for r in sorted(pq.read_table(f"{folder}/conversations.parquet").to_pylist(), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    got = {r.conv_id: r for r in queries.QUERIES["op3_chat_format"](spark, folder).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars > sum(len(t) for _, t in own)


def test_toxicity(spark, folder):
    got = asked(spark, folder, "op4_toxicity")
    assert len(got) == len(made_documents())
    for i, text, _ in made_documents():
        g = got[i]
        assert 0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) and g.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert g.predicted == is_toxic(text), i


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    want = sorted((tuple(str(r[k]) for k in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(str(r[n]) for n in names) for r in df.collect()), key=str) == want


def test_suffixes(spark, folder):
    rows, got = made_documents(), asked(spark, folder, "op7_suffix_dedup")
    for (i, _, _), want in zip(rows, removed([t for _, t, _ in rows]), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i


def ids_of(text):
    return [*packing.encoder(packing.word_bpe()).tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packed(pieces, ids):
    """Every piece's ids and place; ids: of each document."""
    ends, lengths = Counter(), Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        part = ids[p.doc_id][4096 * p.piece : 4096 * (p.piece + 1)]
        assert (p.start, p.length, p.ids_crc32) == (4096 * p.piece, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
        lengths[p.doc_id, p.piece] += 1
    assert max(ends.values()) <= 4096
    return lengths, ends


def test_packing(spark, folder):
    ids = {i: ids_of(t) for i, t, _ in made_documents()}
    lengths, ends = check_packed(queries.QUERIES["op9_packing"](spark, folder).collect(), ids)
    assert lengths == Counter((i, k) for i, x in ids.items() for k in range(-(-len(x) // 4096)))
    assert len(ends) <= 1.05 * sum(map(len, ids.values())) / 4096 + 1


def mix_targets(size):
    """Words to take of each source, by filling up the sources one after the other that reach their limit."""
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    open_, left, want = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), {}
    while over := [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * size[s]]:
        want |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    return want | {s: left * w / sum(open_.values()) for s, w in open_.items()}


def check_mixed(taken, rows):
    """taken: words of each document; rows: doc_id, size, source of all that could be taken."""
    size, took, gap = Counter(), Counter(), defaultdict(list)
    for i, n, s in rows:
        assert taken[i] % n == 0 and taken[i] <= 2 * n if n else taken[i] == 0
        size[s] += n
        took[s] += taken[i]
        gap[s].append(n)
    want = mix_targets(size)
    for s, w in want.items():
        assert abs(took[s] - w) <= min(n for n in gap[s] if n), s
    return size, want


def test_mixing(spark, folder):
    got = asked(spark, folder, "op10_mixing")
    rows = [(i, len((t or "").split()), s) for i, t, s in made_documents()]
    size, want = check_mixed({i: g.taken for i, g in got.items()}, rows)
    for i, n, s in rows:
        assert (got[i]["size"], got[i].source_size) == (n, size[s]) and got[i].target == pytest.approx(want[s])


def test_pipeline(spark, folder):
    """All five stages: toxic texts go, then copies, then near copies; the mix takes its targets of what is left; all of
    it is packed."""
    rows = [x for x in made_documents() if not is_toxic(x[1])]
    first = {}
    for x in rows:
        first.setdefault(re.sub(r"[ \t-\r]+", " ", x[1] or ""), x)
    rows = sorted(first.values(), key=lambda x: x[0])
    comp = linked([t for _, t, _ in rows], 5)
    kept = [x for k, x in enumerate(rows) if comp[k] == k]
    assert 100 < len(kept) < len(rows) < len(made_documents()) - 60
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids = {i: ids_of(t) for i, t, _ in kept}
    lengths, _ = check_packed(pieces, ids)
    copies = {i: lengths[i, 0] for i in ids}
    assert lengths == Counter({(i, k): c for i, c in copies.items() for k in range(-(-len(ids[i]) // 4096)) if c})
    check_mixed({i: copies[i] * len((t or "").split()) for i, t, _ in kept if (t or "").split()} | {i: 0 for i, t, _ in kept if not (t or "").split()}, [(i, len((t or "").split()), s) for i, t, s in kept])


def odd_documents(spark):
    """documents with repeated rows, nulls in every column, and columns of names that stages and operators use themselves."""
    rows = [(i, t, s) for i, t, s in made_documents()[:60]] + [(None, "no id at all here", None), (3, None, None), (5, "", "web"), *[(9, prose(9, 60), "web")] * 3]
    names = ["copies", "__weftline", "kept", "rank", "ids", "score", "row", "times", "Row_", "h", "keep_id"]
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), *range(len(names))) for i, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{n}` int' for n in names)}")
    return df, rows


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_names(spark, folder, stage):
    docs, rows = odd_documents(spark)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert stage == "packing" or out.columns == docs.columns
    got = out.collect()
    if stage == "packing":
        assert Counter(g.doc_id for g in got if g.piece == 0) == Counter(i for i, _, _ in rows)
        return
    assert all(tuple(g[c] for c in docs.columns[5:]) == tuple(range(11)) for g in got)
    found, given = Counter((g.doc_id, g.text, g.source) for g in got), Counter(rows)
    assert set(found) <= set(given)
    if stage == "exact_dedup":
        key = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
        assert Counter(key(g.text) for g in got) == Counter({key(t): 1 for _, t, _ in rows})
    if stage == "mixing":
        check_mixed(Counter(), []) if not got else None
        assert all(n <= 2 * given[x] for x, n in found.items())
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), folder).collect() == []

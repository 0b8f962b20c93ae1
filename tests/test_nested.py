"""Identities, walks, repairs and differences against plain computations."""

import json
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import diff, identity, lenient, walk
from weftline.operators import tree


def rnd(r, depth, odd='ab ,:"\\{é\n'):
    k = r.randrange(7 if depth else 4)
    if k == 0:
        return r.choice([None, True, False])
    if k == 1:
        return r.choice([0, -5, 1.5, 1e30, 10**22])
    if k in (2, 3):
        return "".join(r.choice(odd) for _ in range(r.randrange(8)))
    if k == 4:
        return [rnd(r, depth - 1, odd) for _ in range(r.randrange(4))]
    return {"".join(r.choice(odd) for _ in range(r.randrange(1, 5))): rnd(r, depth - 1, odd) for _ in range(r.randrange(4))}


def shuffled(r, v):
    if isinstance(v, dict):
        items = [(k, shuffled(r, x)) for k, x in v.items()]
        r.shuffle(items)
        return dict(items)
    return [shuffled(r, x) for x in v] if isinstance(v, list) else v


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def plain_nodes(v):
    """path, key, depth, kind, value and size of all nodes, depth first."""
    out = []

    def visit(v, path, key, depth):
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        inner = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        out.append((path, key, depth, kind, None if kind in ("array", "object") else v, len(inner)))
        for k, x in inner:
            visit(x, f"{path}/{k}", str(k), depth + 1)

    visit(v, "", "", 0)
    return out


def test_nodes_against_plain(spark):
    r = random.Random(7)
    values = [rnd(r, 4) for _ in range(150)] + [{"a": {"0": 1}, "b": [[], {}]}, {}, [], "", 0]
    got = {}
    for n in tree.nodes(frame(spark, [json.dumps(v) for v in values]), "id", "t").collect():
        got.setdefault(n.id, []).append((n.node, n.path, n.key, n.depth, n.kind, None if n.value is None else json.loads(n.value), n.size))
    for k, v in enumerate(values):
        assert sorted(got[k]) == [(i, *n) for i, n in enumerate(plain_nodes(v))], v


def test_nodes_of_odd_texts(spark):
    got = tree.nodes(frame(spark, [None, "", "{", '{"a":1,"b":2,"a":{"c":3}}', "[" * 300 + "]" * 300]), "id", "t").collect()
    assert [(n.path, n.value, n.size) for n in got if n.id == 3] == [("", None, 2), ("/a", None, 1), ("/a/c", "3", 0), ("/b", "2", 0)]  # the last a counts, at the first's place
    assert {n.id for n in got} == {3, 4} and max(n.depth for n in got) == 299


def plain_find(v, needle):
    """Visible nodes and matches once the ancestors of all matches are open."""
    rows, q = [], needle.lower()

    def visit(v, at, key, item):
        shown = f"[{key}]" if item else key
        hit = q in shown.lower() or q in "/".join(map(str, at)).lower() or (not isinstance(v, (dict, list)) and q in json.dumps(v, ensure_ascii=False).lower())
        rows.append((at, hit))
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            visit(x, (*at, k), str(k), isinstance(v, list))

    visit(v, (), "", False)
    hits = [at for at, hit in rows if hit]
    opened = {at[:k] for at in hits for k in range(len(at))}
    seen = [at for at, _ in rows if hits and (not at or at[:-1] in opened)]
    return [("".join(f"/{p}" for p in at), hits.index(at) if at in hits else None) for at in seen]


@pytest.mark.parametrize("needle", ["a", "B", "[1", "1", "/", "null", "nowhere"])
def test_find_against_plain(spark, needle):
    r = random.Random(3)
    values = [rnd(r, 4, "abcXYé1") for _ in range(60)] + [{"a": {"0": [1, {"b": "a"}]}}, [[["x"]]], "abc", {}]
    df = frame(spark, [json.dumps(v) for v in values]).withColumn("id", F.when(F.col("id") > 0, F.col("id")))  # one null id
    got = {}
    for x in tree.find(df, "id", "t", needle).orderBy("id", "place").collect():
        own = got.setdefault(x.id, [])
        assert x.place == len(own)
        own.append((x.path, x["match"]))
    assert got == {k or None: w for k, v in enumerate(values) if (w := plain_find(v, needle))}
    assert tree.find(df, "id", "t", "").count() == 0


def test_identity(spark):
    r = random.Random(1)
    values = [rnd(r, 4) for _ in range(200)]
    twins = [shuffled(r, v) for v in values]
    ids = [[x.i for x in frame(spark, [json.dumps(v, indent=n) for v in vs]).orderBy("id").select(identity.json_id(F.col("t")).alias("i")).collect()] for vs, n in ((values, None), (twins, 2))]
    assert ids[0] == ids[1]
    text = [json.dumps(v, sort_keys=True) for v in values]
    assert len(set(ids[0])) == len(set(text)) == len(set(zip(ids[0], text, strict=True)))


def test_identity_tells_types_apart(spark):
    apart = ["1", "1.0", '"1"', "true", '"true"', "null", '"null"', "[]", "{}", "[null]", "[[]]", '{"a":null}', '{"a":{}}', '{"a":[]}', "[1,2]", "[2,1]", "[[1],2]", "[1,[2]]", '{"a":1,"b":2}', '{"a":2,"b":1}', '{"a/1:b":1}', '{"a":{"b":1}}', '{"[0]":1}', "[1.5]", '["1.5"]', str(10**20), str(10**20 + 1), '"a\\nb"', '""', '" "']
    same = [('{"a":1,"b":[{"c":2,"d":3}]}', '{"b":[{"d":3,"c":2}],"a":1}'), ("1.50", "15e-1"), ("1.0", "1e0"), ('"é"', '"\\u00e9"')]
    ids = [x.i for x in frame(spark, apart).orderBy("id").select(identity.json_id(F.col("t")).alias("i")).collect()]
    assert len(set(ids)) == len(apart) and None not in ids
    for a, b in same:
        one = frame(spark, [a, b]).select(identity.json_id(F.col("t")).alias("i")).distinct().collect()
        assert len(one) == 1, a
    assert frame(spark, [None, "{", "nope"]).select(identity.json_id(F.col("t")).alias("i")).distinct().first().i is None


def test_identity_of_columns(spark):
    row = spark.sql("SELECT map('b', map('z', 1, 'a', 2), 'a', map()) AS m, map('a', map(), 'b', map('a', 2, 'z', 1)) AS n, named_struct('x', 1, 'y', DATE'2020-01-01') AS s, named_struct('y', DATE'2020-01-01', 'x', 1) AS t, named_struct('y', '2020-01-01', 'x', 1) AS u")
    got = row.select(*(identity.value_id(F.col(c)).alias(c) for c in "mnstu")).first()
    assert got.m == got.n and got.s == got.t and len({got.m, got.s, got.u}) == 3


def test_no_python_in_walks(spark):
    df = frame(spark, ['{"a":[1]}'])
    for plan in (tree.nodes(df, "id", "t"), tree.find(df, "id", "t", "a"), df.select(identity.json_id(F.col("t")))):
        said = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in said and "Pandas" not in said and "Arrow" not in said


BROKEN = [
    ('{"a": 1', '{"a":1}'), ("{a: 1, b: [1,2,}", '{"a":1,"b":[1,2]}'), ("{'a': 'it's', \"b\": None}", '{"a":"it\'s","b":null}'), ("```json\n{\"a\": 1,}\n```", '{"a":1}'),
    ('{"a" 1 "b" 2}', '{"a":1,"b":2}'), ("[1 2 3", "[1,2,3]"), ('{"a": {"b": [1, {"c": 2}}', '{"a":{"b":[1,{"c":2}]}}'), ('say {"k": 5} more', '{"k":5}'), ('{"a":}', '{"a":null}'),
    ('{"a": 1, // c\n "b": 2 /* z */}', '{"a":1,"b":2}'), ('{"a": "say "hi" now", "c": 3}', '{"a":"say \\"hi\\" now","c":3}'), ("}{\"a\":1}", '{"a":1}'), ('{"k: 5}', '{"k":5}'),
    ('{"a": "unclosed', '{"a":"unclosed"}'), ("{“a”: 01}", '{"a":"01"}'), ('{"a": http://x.y/z, "b": 1}', '{"a":"http://x.y/z","b":1}'), ('{"a": "x\ny"}', '{"a":"x\\ny"}'), ("{[1]}", '{"":[1]}'), ("", None), (" hello ", '"hello"'),
]


def test_lenient(spark):
    texts = [a for a, _ in BROKEN] + ['{"a":  1.0}', None, "[" * 20000]
    got = [x.g for x in frame(spark, texts).orderBy("id").select(lenient.lenient(F.col("t")).alias("g")).collect()]
    assert got[: len(BROKEN)] == [b for _, b in BROKEN]
    assert got[len(BROKEN) :] == ['{"a":  1.0}', None, "[" * 20000 + "]" * 20000]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}[]:,\"'\\ \nab1.e-/#*“", max_size=40))
def test_lenient_always_writes_json(text):
    got = lenient.repaired(text)
    assert got is None or json.loads(got) is not NotImplemented


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(0, 12))
def test_lenient_keeps_proper_json_and_closes_what_is_cut(seed, cut):
    r = random.Random(seed)
    v = [rnd(r, 3)]
    assert json.loads(lenient.repaired(json.dumps(v, ensure_ascii=False))) == v
    plain = {"a": [{"b": [1, 2, {"c": [True]}]}]}
    text = json.dumps(plain)
    assert json.loads(lenient.repaired(text[: len(text) - min(cut, 6)])) == plain  # brackets only are cut


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", max_size=30), st.text(alphabet="abc ", max_size=30), st.booleans())
def test_steps_are_those_of_longest_blocks(a, b, popular):
    got = diff.steps(a, b, popular)
    assert got == [tuple(s) for s in SequenceMatcher(None, a, b, autojunk=not popular).get_opcodes()]
    assert "".join(a[i:j] for _, i, j, _, _ in got) == a and "".join(b[i:j] for _, _, _, i, j in got) == b


def test_steps_of_long_texts():
    r = random.Random(9)
    for k in range(12):
        a = "".join(r.choice("abcdefgh ij") for _ in range(600))
        b = a[: 50 * k] + "XYZ" + a[50 * k + 20 :].replace("cd", "dc")
        for popular in (True, False):
            assert diff.steps(a, b, popular) == [tuple(s) for s in SequenceMatcher(None, a, b, autojunk=not popular).get_opcodes()]
    assert diff.steps("a" * 30000, "a" * 29000 + "b") == [("equal", 0, 29000, 0, 29000), ("replace", 29000, 30000, 29000, 29001)]


def brute_longest(a, b):
    return max(((n, -i, -j) for i in range(len(a) + 1) for j in range(len(b) + 1) for n in range(min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=(0, 0, 0))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=9), st.text(alphabet="ab", max_size=9))
def test_longest_block_against_brute_force(a, b):
    i, j, n = diff.longest(a, b, frozenset())
    assert (n, -i, -j) == brute_longest(a, b)


def test_diff_columns(spark):
    rows = [("one <two>", "one <2> é"), ("", "new"), ("old", ""), (None, "x"), ("x", None), ("", ""), ("same & same", "same & same")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "id int, a string, b string").withColumn("ops", diff.opcodes(F.col("a"), F.col("b")))
    got = df.select("ops", diff.rebuilt(F.col("ops"), F.col("a"), F.col("b")).alias("r"), diff.highlighted(F.col("ops"), F.col("a"), F.col("b")).alias("h"), diff.privileged(F.col("ops"), F.col("b")).alias("p")).collect()
    assert got[3].ops is None and got[4].ops is None
    assert [tuple(g.r) for k, g in enumerate(got) if k not in (3, 4)] == [r for r in rows if None not in r]
    assert got[1].h == '<span style="background-color:#d6ffd6; color:#006600;">new</span>' and got[2].h == '<span style="background-color:#ffd6d6; color:#b20000;">old</span>' and got[2].p == ""
    assert got[6].h == "same & same" and got[6].p == "same &amp; same"
    assert got[0].p == 'one &lt;<mark class="token-privileged">2</mark>&gt;<mark class="token-privileged"> é</mark>'


def test_nesting(spark):
    texts = ["1", '"[["', "[]", '{"a":"\\"[{"}', '[[],[[]],{"b":[1]}]', "", None]
    assert [x.d for x in frame(spark, texts).orderBy("id").select(walk.nesting(F.col("t")).alias("d")).collect()] == [0, 0, 1, 1, 3, 0, None]

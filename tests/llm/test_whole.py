"""Inputs on which operators once did less than the whole job."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import license, pii, substrings, topk

from .test_operators import brute_passages, brute_repeats


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.3, 64).tolist()) for i in range(300)]
    rows += [(400 + i, rng.normal(0, s, 64).tolist()) for i, s in enumerate((4e4, 4e4, 3.7e5, 1e5, 3.3e4))]
    # Single outliers, doubles beyond a long when quantised, and one whose product with the scale is infinite.
    rows += [(500, [32_768.0] + [0.1] * 63), (600, [-32_768.0] + [0.1] * 63), (601, [0.0] * 63 + [3e5]), (700, [0.0, 2.0**60]), (701, [1.0, 0.0, 1e300]), (702, [-1.0, 0.0, 1.7e308]), (800, [float("inf")] * 64), (801, [1.0, None])]
    finite = [(i, v) for i, v in rows if all(x is not None and np.isfinite(x) for x in v)]

    def whole(v):
        return [int(np.floor(1024 * x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]

    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    # Rows 700 to 702 are beyond a long with most queries: they meet one that is 0 there.
    for numbers, queries in (([r for r in finite if r[0] < 700], [0, 100, 400, 401, 500, 600]), (finite, [1000])):
        numbers = numbers + [(1000, [0.25])]
        asked = spark.createDataFrame([(i, v) for i, v in numbers if i in queries], df.schema)
        got = [tuple(r) for r in topk.top_k(spark.createDataFrame(numbers + [(800, [float("inf")] * 64)], df.schema), asked, k=10, block=64, query_block=2).collect()]
        want = []
        for q in queries:
            v = whole(dict(numbers)[q])
            s = sorted((-sum(a * b for a, b in zip(v, whole(u))), i) for i, u in numbers if i != q)
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:10])]
        assert sorted(got) == sorted(want)


def test_topk_beyond_a_long(spark):
    big, small = [[1e15, 0.0]], [[-1e15, 0.0]]
    fine = [(i, [0.0, float(i)]) for i in range(2)]
    ask = spark.createDataFrame([(9, [1e15, 1.0])], "vec_id bigint, embedding array<double>")
    rows = spark.createDataFrame(fine + [(5, small[0])], ask.schema)
    # The row far below is outranked by the others; where it isn't, or one is far above, the job fails.
    assert [r.vec_id for r in topk.top_k(rows, ask, k=2).collect()] == [1, 0]
    with pytest.raises(Exception, match="is below a long"):
        topk.top_k(rows, ask, k=3).collect()
    with pytest.raises(Exception, match="exceeds a long"):
        topk.top_k(spark.createDataFrame([(5, big[0])], ask.schema), ask, k=2).collect()


def test_long_license_expressions():
    names = [f"Lic-{i}.0-only" for i in range(400)]
    plain, mixed = " OR ".join(names), " AND ".join(f"({a} OR {b} WITH Exc-1)" for a, b in zip(names[::2], names[1::2]))
    machine = license.automaton({})
    for text in (plain, mixed):
        assert len(text) > 5_000
        for form in (text, f"({text})"):
            got = license.scan_text(f"# SPDX-License-Identifier: {form}\nOR GPL-2.0 mit license", machine)
            assert got["labels"] == sorted(n.lower() for n in names) and got["expressions"] == [text] and got["score"] > 0
    # The id at character 400 is whole.
    assert license.scan_text("license-expression: " + "MIT OR " * 56 + "GPL-2.0-only", machine)["labels"] == ["gpl-2.0-only", "mit"]
    # Long and nested ones take linear time, and no recursion.
    n = 100_000
    chain = license.parse_expression(" AND ".join(["A"] * n))
    assert (chain.named, license.written(chain.form)) == ({"a"}, " AND ".join(["A"] * n))
    assert license.parse_expression("A AND (B OR " * n + "C" + ")" * n).named == {"a", "b", "c"}
    assert license.parse_expression("(" * n + "A" + ")" * (n - 1)) is None


@pytest.mark.parametrize(
    "text,required,kind",
    [
        ("MIT", {"mit"}, "permissive"), ("MIT OR GPL-3.0-only", set(), "permissive"), ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, "strong-copyleft"), ("(MIT OR GPL-2.0) AND LGPL-2.1", {"lgpl-2.1"}, "weak-copyleft"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only"}, "weak-copyleft"), ("LGPL-3.0 WITH e", {"lgpl-3.0"}, "permissive"), ("MIT WITH e", {"mit"}, "permissive"), ("(A OR B) AND (A OR C)", set(), "unknown"), ("A AND B OR A AND C", {"a"}, "unknown"),
        ("AGPL-3.0 OR MPL-2.0", set(), "weak-copyleft"), ("CC-BY-NC-4.0", {"cc-by-nc-4.0"}, "unknown"),
    ],
)
def test_expressions_are_evaluated(text, required, kind):
    got = license.parse_expression(text)
    assert (got.required, license.STRICTNESS[got.rank]) == (required, kind)
    scanned = license.scan_text(f"a\nspdx-license-identifier: {text}\nb", license.automaton({}))
    assert (scanned["required"], scanned["strictness"]) == (sorted(required), kind)


def test_long_candidates(spark):
    """Candidates have no largest length; a model that takes them all puts them into spans."""
    long = {"secret": ["aB3x" * n for n in (32, 33, 10_000)] + ["1" * 50_000 + "x"], "number": ["12-34 5678 90"], "long_number": ["7" * 25, "12-34 5678 " * 3 + "90", "12-34 5678 " * 1_000 + "90"]}
    rows = [(f"{kind}{i}", [kind], [t], f"see {t}, thanks") for kind, texts in long.items() for i, t in enumerate(texts)]
    # A long number that touches a card goes; the number after the card stays.
    rows += [("card", ["card", "number"], ["4111 1111 1111 1111", "123-45-6789"], "see 4111 1111 1111 1111 -- -- -- 123-45-6789 end")]
    # Long runs without a candidate, which a pattern must not try from every character.
    rows += [(f"none{i}", [], [], t) for i, t in enumerate(("a" * 50_000, "1" + " " * 50_000 + "x"))]
    docs = spark.createDataFrame(rows, "id string, kinds array<string>, want array<string>, text string")
    for r in pii.find_pii(docs, pii.SpanModel([], [], 0.0)).collect():
        assert ([s.kind for s in r.spans], [s.text for s in r.spans]) == (r.kinds, r.want), r.id
        assert all(r.text[s.start : s.end] == s.text for s in r.spans)


@pytest.mark.parametrize("chunk", [substrings.CHUNK, 700])
def test_substrings_of_long_texts(spark, monkeypatch, chunk):
    """Texts over a chunk, repeats across its seams, short passages of many words, classes
    beyond the size that is compared pair by pair."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(6)

    def noise(n):
        return "".join(rng.choice("abcdefghij klmnop") for _ in range(n))

    part, few = noise(900), " ".join(rng.choice("abcdefgh") for _ in range(60))
    texts = [noise(rng.randint(0, 60)) + part[rng.randint(0, 300) : rng.randint(500, 900)] + noise(rng.randint(0, 60)) for _ in range(70)]
    texts += [noise(300) + " " + few[:110] + " " + noise(200), noise(50) + " " + few.upper() + "\n" + noise(90), noise(30) + " " + few[:90] + " x", few[:80]]
    # A passage twice in one text only, between different words.
    alone = " ".join(rng.choice("stuvwxyz") + str(i % 7) for i in range(55))
    texts += [noise(80) + " " + alone + " " + noise(30) + " " + alone + " " + noise(70)]
    if chunk > 1000:
        long = noise(1 << 19)
        texts += [long + part, noise(5000) + long[-300_000:] + noise(4000), long[(1 << 18) - 500 : (1 << 18) + 700]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    short = [t for t in texts if len(t) < 3000]
    got = {r.doc_id: r for r in substrings.remove_repeats(df.where(f"doc_id < {len(short)}") if chunk < 1000 else df, length=150, k=32).collect()}
    want, shares = brute_repeats(texts, 150), brute_passages(texts, 51)
    assert len(got) == len(texts)
    for i, r in got.items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.shares_passage) == (*want[i], shares[i]), i


def test_runs_fill_all_ranges():
    """Anchors are the least of many hashes; their runs are dealt evenly all the same."""
    import pyarrow as pa

    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    found = substrings.segments_of([text.encode()], 400, 128)
    marks = [{"h": h, "lo": lo, "n": n, "off": off} for h, lo, n, off in zip(*(found[c].tolist() for c in ("h", "lo", "n", "off")))]
    batch = pa.RecordBatch.from_pylist([{"k1": 1, "k2": 2, "text": text, "marks": marks}])
    sizes = {r["r"]: len(r["lcps"]) for b in substrings.write_runs(400, 16)([batch]) for r in b.to_pylist()}
    assert len(marks) > 1000 and len(sizes) == 16 and max(sizes.values()) < 2 * len(marks) / 16


def test_classes_by_common_prefixes():
    """Large classes give the windows that comparing pair by pair gives."""
    rng = random.Random(4)
    rights = sorted("".join(rng.choice("ab") for _ in range(rng.randint(10, 40))).encode() for _ in range(60))
    lefts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode() for _ in rights]
    lcps = [0, *(substrings.common_prefix(a, b) for a, b in zip(rights, rights[1:]))]
    got = substrings.equal_windows(rights, lefts, lcps, 10)
    for x in range(60):
        want = {i for i in range(len(lefts[x]) + 1) for y in range(60) if y != x and len(lefts[y]) >= i and lefts[x][:i] == lefts[y][:i] and len(rights[x]) >= 10 - i and len(rights[y]) >= 10 - i and rights[x][: 10 - i] == rights[y][: 10 - i]}
        assert {i for a, b in got[x] for i in range(a, b + 1)} == want


def test_substrings_of_rows_that_repeat(spark, monkeypatch):
    """Thousands of rows with one text, and one id or none, are one text to look at."""
    seen = []
    whole = substrings.stored

    def spy(df):
        out = whole(df)
        if "text" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(substrings, "stored", spy)
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    other = text[300:900] + " end"
    rows = [(None, text)] * 2000 + [(5, text)] * 500 + [(6, other)] * 300 + [(7, "x" * 450), (8, text[:399])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()
    assert len(got) == len(rows) and max(seen) <= 8
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id in (None, 5, 6))
    # One letter, 450 times: its windows repeat in the text itself.
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (7, 8)} == {7: 450, 8: 0}


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1024, 1025, 40_000])
def test_running_values(spark, n):
    rng = random.Random(n)
    values = [rng.randint(-5, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,), ([],)], "v array<int>")
    rows = df.select("v", pii.running(F.col("v"), lambda a, x: a + x).alias("s"), pii.running(F.col("v"), F.greatest).alias("m")).collect()
    for r in rows:
        assert r.s == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate(r.v, max))


def test_many_spans_in_one_text(spark):
    """A text with thousands of spans takes time in proportion, and each is where it is."""
    model = pii.SpanModel([["Predict: 1.0"]], [1.0], 0.5)
    n = 20_000
    lines = [f"user{i}@mail{i % 7}.example.org, key tok{i}en/Ab{i}xyzQ9 of 10.0.{i % 256}.7" for i in range(n)]
    text = "\n".join(lines)
    began = time.perf_counter()
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), model).select("base_spans", "spans").first()
    assert time.perf_counter() - began < 60
    assert len(row.base_spans) == 2 * n and len(row.spans) == 3 * n
    assert all(text[s.start : s.end] == s.text for s in row.spans)
    assert [s.start for s in row.spans] == sorted(s.start for s in row.spans)


def test_overlaps_by_running_maxima(spark):
    rng = random.Random(3)
    kind = "struct<start:int,rank:int,end:int,kind:string,text:string,before:string,after:string>"

    def spans(k):
        return [(a, i % 3, a + rng.randint(1, 12), "k", "", "", "") for i, a in enumerate(rng.randint(0, 400) for _ in range(k))]

    for _ in range(4):
        a, b = spans(60), spans(25)
        row = spark.createDataFrame([(a, b)], f"a array<{kind}>, b array<{kind}>").select(pii.free_of(F.col("a"), F.col("b")).alias("f")).first()
        assert sorted(tuple(s) for s in row.f) == sorted(s for s in a if all(s[2] <= o[0] or o[2] <= s[0] for o in b))
        ps = [(s, float(i)) for i, s in enumerate(a)]
        groups = spark.createDataFrame([(ps,)], f"p array<struct<s:{kind},p:double>>").select(pii.clusters(F.col("p")).alias("c")).first().c
        assert sorted(tuple(x.s) for g in groups for x in g) == sorted(a)
        ends = [(min(x.s.start for x in g), max(x.s.end for x in g)) for g in groups]
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))

"""Word passages, filter audits and whitening against brute force."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from wavemill.llm import blocks, filters, whitening

from .cases import documents, empty, frame, prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_passages(rows, size):
    """(words, removed, hash) by row number; rows are (id, text)."""
    least = {}
    for d, t in rows:
        w = BLANK.findall(t or "")
        for s in range(len(w) - size + 1):
            if d is not None:
                g = tuple(w[s : s + size])
                least[g] = min(d, least.get(g, d))
    out = []
    for d, t in rows:
        w = BLANK.findall(t or "")
        gone = {s + i for s in range(len(w) - size + 1) if d is not None and least[tuple(w[s : s + size])] < d for i in range(size)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def passages():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "naïve", "A", "a"]
    shared = [prose(rng, n, words) for n in (12, 13, 14, 30, 200)]
    rows = [(d, t) for d, t, *_ in documents()]
    for i in range(200, 320):
        parts = [prose(rng, rng.randrange(0, 30), [f"u{i}_{j}" for j in range(50)]) for _ in range(3)]
        rows.append((i, f"{parts[0]} {rng.choice(shared)}\t{parts[1]}\n{rng.choice(shared)} {parts[2]}"))
    # One template in many texts, at one place; repeats inside a text; ids and texts that repeat.
    rows += [(i, f"{shared[4]} {prose(rng, 20, words)}") for i in range(400, 460)]
    rows += [(500, " ".join(["na"] * 3000)), (501, "na " * 40), (502, f"{shared[4]} {shared[4]}"), (-5, shared[3]), (250, shared[4]), (250, shared[4])]
    rows += [(None, shared[4])] * 3 + [(600, "x" * 20_000 + " " + shared[3]), (601, shared[3] + " end")]
    return rows


@pytest.mark.parametrize("held", [1 << 19, 50])
def test_passages(spark, monkeypatch, held):
    """Few entries held: tasks settle what they have again and again."""
    monkeypatch.setattr(blocks, "HELD", held)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 100_000)
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = blocks.remove_passages(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == collections.Counter(brute_passages(rows, 13))
    for r in got:
        # Spans are maximal, and what stays is what they leave.
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) and sum(s.end - s.start for s in r.spans) == r.n_removed
        if r.n_removed:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_passages_of_other_lengths(spark):
    rows = passages()[:120]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size in (3, 5):
        got = blocks.remove_passages(docs, window=size).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == collections.Counter(brute_passages(rows, size))


def test_passages_keep_other_columns(spark):
    docs = frame(spark).selectExpr("*", "1 AS n_words", "'mine' AS found", "'t' AS key", "2 AS at")
    got = blocks.remove_passages(docs)
    assert got.columns == [*docs.drop("n_words", "spans").columns, "n_words", "n_removed", "spans", "kept_sha256", "kept"]
    assert got.count() == docs.count() and {r.found for r in got.select("found").collect()} == {"mine"}
    assert blocks.remove_passages(empty(spark)).count() == 0


def test_settling_keeps_what_others_need():
    """Entries in any portions and order give the same hits."""
    rng = np.random.default_rng(4)
    n = 4000
    x = {"key": rng.integers(0, 300, n).astype(np.uint64), "text": np.sort(rng.integers(0, 60, n)).astype(np.uint64), "block": rng.random(n) < 0.1}
    want = set()
    for k in np.unique(x["key"]).tolist():
        owners = {int(t) for t in x["text"][(x["key"] == k) & x["block"]]}
        want |= {(k, int(t)) for t in x["text"][x["key"] == k] if owners - {int(t)}}
    for seed in range(3):
        cut, got, pool = np.random.default_rng(seed).permutation(40), set(), blocks.Pool(blocks.settle_blocks)
        pool.limit = 500
        for c in cut:
            own = slice(c * 100, c * 100 + 100)
            for f in pool.add({k: v[own] for k, v in x.items()}):
                got |= set(zip(f["key"].tolist(), f["text"].tolist()))
        for f in pool.settled():
            got |= set(zip(f["key"].tolist(), f["text"].tolist()))
        assert got == want


def brute_audit(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[i] == 1} for i in (0, 1))
    parts = collections.defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = BLANK.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and least[t] < d}
        parts[s or ""].append((d, {x for x in fails if fails[x]}))
    out = set()
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for _, f in docs:
                shapley.update([next((x for x in order if x in f), "-")])
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                failing = sum(x in f for _, f in docs)
                out.add((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {x} for _, f in docs), sum(d in good for d in gone), sum(d in toxic for d in gone), shapley[x]))
    return out


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(filters, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(filters, "TERMS_A_TASK", 100)
    rng = random.Random(8)
    rows = [(d, t, s) for d, t, _, s, *_ in documents()]
    rows += [(700 + i, rng.choice(["A # b", "same words " * 40, " ".join(f"k{j}" for j in range(60)), "UP " * 3 + " ".join(f"k{j}" for j in range(60)), "É | ê", None]), rng.choice(["s0", "s1", None, ""])) for i in range(60)]
    rows += [(None, "A # b", "s1")] * 3 + [(710, "A # b", "s1")] * 2 + [(-1, "same words " * 40, "s9")]
    labels = [(i, int(rng.random() < 0.5), int(rng.random() < 0.3)) for i in range(0, 760, 2)] + [(None, 1, 1), (4, 1, None), (4, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6).selectExpr("*", "'x' AS part", "0 AS mask", "1 AS n", "'y' AS shard")
    got = filters.filter_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, labels)
    assert filters.filter_audit(empty(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_matrix(spark, monkeypatch):
    """Shards in the dictionary's numbers have the documents' words."""
    monkeypatch.setattr(filters, "SHARD_ROWS", 7)
    monkeypatch.setattr(filters, "TEXT_BLOCK", 1000)
    docs = frame(spark).select("doc_id", "text")
    matrix, terms = filters.document_term_matrix(docs)
    named = {r.id: r.term for r in terms.collect()}
    assert len(named) == terms.count() == len(set(named.values()))
    got = collections.Counter()
    for r in matrix.collect():
        starts, columns, counts = filters.csr(r.asDict())
        for i, own in enumerate(r.rows):
            at = slice(starts[i], starts[i + 1])
            assert np.all(np.diff(columns[at]) > 0)
            got[own.doc_id, tuple(sorted((named[c], n) for c, n in zip(columns[at].tolist(), counts[at].tolist())))] += 1
    assert got == collections.Counter((d, tuple(sorted(collections.Counter(BLANK.findall(t or "")).items()))) for d, t, *_ in documents())
    assert [p for p in filters.pieces(b"aa bb  cc", 3)] == [b"aa ", b"bb ", b" cc"] or b"".join(filters.pieces(b"aa bb  cc", 3)) == b"aa bb  cc"


def whole(v):
    return [int(np.floor(1024 * x)) + 100_000 for x in v]


def test_whitening(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [0.5] * 3)]
    fine = [(i, whole(v)) for i, v in rows if v and len(v) == 12 and all(x is not None and np.isfinite(x) for x in v)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4).selectExpr("*", "1 AS x", "2 AS n", "'z' AS component"))
    got = got.collect()
    n, sums = len(fine), [sum(c) for c in zip(*(v for _, v in fine))]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for _, v in fine), n**3)) for j in range(12)] for i in range(12)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    white = {i: (np.array(v) - np.array(sums) / n) @ u[:, :8] / np.sqrt(e[:8]) for i, v in fine}
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in fine}
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        w = white[r.vec_id][r.component - 1]
        assert signs.setdefault(r.component, np.sign(w * r.whitened)) * w == pytest.approx(r.whitened, abs=1e-9)
        assert (r.deviation, r.deviation_exact) == (deviation[r.vec_id], deviation[r.vec_id])
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-9


def test_whitening_without_variance(spark):
    """Fewer rows than dimensions, equal rows, large numbers, and none."""
    schema = "vec_id bigint, embedding array<float>"
    got = whitening.whiten(spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(4)], schema)).collect()
    assert sum(r.whitened is not None for r in got) == 4 * 3 and {r.component for r in got} == set(range(1, 7))
    assert max(r.identity_error for r in got) < 1e-9
    same = whitening.whiten(spark.createDataFrame([(i, [0.25, -1.0]) for i in range(5)], schema)).collect()
    assert all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in same) and len(same) == 10
    rows = [(i, [float(i) * 2**45, float(-i * i)]) for i in range(5)]
    large = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    numbers = [whole(v) for _, v in rows]
    want = {i: sum((5 * x - sum(c)) ** 2 for x, c in zip(v, zip(*numbers))) for i, v in enumerate(numbers)}
    assert {(r.vec_id, int(r.deviation_exact)) for r in large} == set(want.items()) and all(r.deviation is None or r.deviation == want[r.vec_id] for r in large)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id bigint, embedding array<double>")).collect()


def test_bit_sliced_products():
    rng = np.random.default_rng(2)
    for high, n in ((5000, 1000), (2**40, 77), (1, 64), (2**62, 3)):
        x = rng.integers(0, high, (n, 5))
        x[:, 3] = 0
        assert (whitening.bit_sliced_products(x) == np.triu(x.astype(object).T @ x.astype(object))).all()

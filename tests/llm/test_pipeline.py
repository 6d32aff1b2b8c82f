"""The pipeline stage by stage against brute force, and as registered."""

import collections
import hashlib
import importlib.util
import math
import re

import pytest
from pyspark.sql import functions as F

from wavemill.llm import mixing, sharding

from .cases import documents, empty, frame
from .test_operators import WORD, lower

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


@pytest.fixture()
def bench_dir(spark, tmp_path):
    text = {d: t for d, t, *_ in documents()}
    spark.createDataFrame([(1, text[10])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages(spark, bench_dir):
    import corpus_pipeline as cp

    docs = frame(spark)
    stage = dict(cp.STAGES)
    told = stage["language_id"](spark, docs, bench_dir)
    assert told.columns == docs.columns and {(r.score, r.copies, r.spans) for r in told.collect()} == {("x", "y", "z")}
    assert told.count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in documents())
    kept = stage["near_dedup"](spark, told, bench_dir).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and not {60, 61, 72, 73, 79} & set(ids) and {1, 2, 78} <= set(ids)
    clean = stage["decontamination"](spark, told, bench_dir)
    assert {r.doc_id for r in told.collect()} - {r.doc_id for r in clean.collect()} == {10}
    mixed = stage["mixing"](spark, told, bench_dir)
    assert mixed.columns == docs.columns and mixed.count() >= told.count()
    placed = stage["sharding"](spark, told, bench_dir)
    assert placed.count() == told.count() and {"slot", "shard"} <= set(placed.columns)


def test_run_and_empty(spark, bench_dir):
    import corpus_pipeline as cp

    out = cp.run(spark, bench_dir)
    assert out.count() > 60 and 10 not in {r.doc_id for r in out.collect()}
    nothing = empty(spark)
    for _, f in cp.STAGES:
        nothing = f(spark, nothing, bench_dir)
    assert nothing.count() == 0


def brute_pipeline(rows, bench):
    """(doc_id, slot, shard) with the times each row is in the result."""
    # Language: only documents without a letter can't be told.
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # Near-duplicates, pair by pair; rows without an id stay.
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {d: d for d in sets if d is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in parent:
        for b in parent:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = [r for r in rows if r[0] is None or find(r[0]) == r[0]]
    # Benchmark windows of ten words, or of all words of a shorter item.
    windows = {tuple(w[i : i + 10]) for w in (WORD.findall(lower(t)) for t in bench) for i in range(max(1, len(w) - 9))} - {()}

    def hit(text):
        w = WORD.findall(lower(text))
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    rows = [r for r in rows if not hit(r[1])]
    # Mixing: nothing more than twice, the largest source once.
    tokens = collections.Counter()
    for _, t, _, s, *_ in rows:
        tokens[s] += len((t or "").split())
    full = {s: n for s, n in tokens.items() if n}
    spread = max(full.values()) / min(full.values())
    alpha = max(0.0, 1 - math.log(2) / math.log(spread)) if spread > 1 else 0.0
    weight = dict(zip(full, mixing.tempered(list(full.values()), alpha)))
    budget = max(n / weight[s] for s, n in full.items())

    def place(d):
        return int(hashlib.md5(f"mix0:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / (1 << 52)

    out, table, names = collections.Counter(), sharding.fill_table(sharding.shard_names(64)), sharding.shard_names(64)
    for s in tokens:
        own = [r for r in rows if r[3] == s]
        epochs = weight[s] * budget / full[s] if s in full else 1.0
        epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-9 else epochs
        rest, cut, run = (epochs - int(epochs)) * tokens[s], -1.0, 0
        for h in sorted({place(r[0]) for r in own}):
            run += sum(len((r[1] or "").split()) for r in own if place(r[0]) == h)
            if rest > 0 and run <= rest:
                cut = h
        for r in own:
            slot = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) % 65_537
            if n := int(epochs) + (place(r[0]) <= cut):
                out[r[0], r[1], slot, names[table[slot]]] += n
    return out


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [r for i, r in enumerate(documents()) if not (r[0] == 3 and i > 60)]
    bench = [rows[10][1], " ".join(rows[20][1].split()[:14]), rows[22][1].split()[0] + " zq", ""]
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((r.doc_id, r.text, r.slot, r.shard) for r in cp.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline(rows, bench) and max(got.values()) == 2


def test_columns_of_any_type(spark, bench_dir):
    """Maps and structs pass through, with names that operators use; one of repeated rows stays."""
    import corpus_pipeline as cp

    own = {"n_words": F.create_map(F.lit("a"), F.col("doc_id")), "component_id": F.struct("source"), "__n": F.lit(1), "slot": F.lit("s"), "bands": F.array(F.lit(1.5))}
    docs = frame(spark).withColumns(own)
    docs = docs.unionByName(docs.where("doc_id = 5").withColumn("n_words", F.create_map(F.lit("b"), F.lit(1).cast("bigint"))))
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, bench_dir)
        assert docs.columns[-5:] == list(own), name
    out = cp.STAGES[-1][1](spark, docs, bench_dir).collect()
    assert len({str(r.n_words) for r in out if r.doc_id == 5}) == 1 and all(r.n_words == {"a": r.doc_id} for r in out if r.doc_id != 5)

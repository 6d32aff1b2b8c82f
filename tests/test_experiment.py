import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import checks
from wavemill.operators import channels, evaluation, imbalance, model, moments, preprocess, splits, validation


def test_moments_merge(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(1000, 3, 1000)
    blocks = spark.createDataFrame([("s", 0, x[:400].tolist()), ("s", 1, x[400:].tolist())], "subject_id string, b int, samples array<double>")
    row = moments.with_deviation(moments.combine(moments.block_moments(blocks, ["subject_id", "b"]).drop("b"), ["subject_id"])).first()
    assert row.n == 1000 and abs(row["mean"] - x.mean()) < 1e-9 and abs(row.variance - x.var()) < 1e-8


def test_scalers_use_training_subjects_only(spark):
    stats = spark.createDataFrame([(s, c, 10, m, 40.0) for s, m in (("a", 0.0), ("b", 2.0), ("c", 1000.0)) for c in ("x", "y")], "subject_id string, channel_name string, n bigint, mean double, m2 double")
    roles = spark.createDataFrame([(0, "a", "train"), (0, "b", "train"), (0, "c", "test")], "fold int, subject_id string, role string")
    got = moments.fold_scalers(stats, roles, ["fold"]).collect()
    assert [r["mean"] for r in got] == [1.0, 1.0] and all(abs(r.variance - 5.0) < 1e-12 for r in got)


def windows(spark):
    rows = [(f"subject_{i:02d}", f"case_{i}", f"rec_{i}", j, int(j < 2 + i % 3)) for i in range(12) for j in range(20)]
    return spark.createDataFrame(rows, "subject_id string, case_id string, recording_id string, window_index int, binary_label int")


def test_nested_folds_have_no_leakage(spark):
    w = windows(spark)
    folds = splits.outer_folds(w, k=4)
    roles = splits.nested_roles(w, outer=4, inner=3)
    assert folds.count() == 12 and splits.role_overlaps(roles).isEmpty()
    assert validation.splits(w.join(folds, "subject_id"), roles).isEmpty()
    assert {r.outer_fold for r in folds.collect()} == {0, 1, 2, 3}


def test_weights(spark):
    w = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10 + [(None,)], "binary_label int")
    assert imbalance.class_weights(w).first().positive_weight == 9.0
    assert imbalance.class_weights(w, cap=5.0).first().positive_weight == 5.0
    assert sorted({r.weight for r in imbalance.sample_weights(w.where("binary_label IS NOT NULL")).collect()}) == [1 / 90, 1 / 10]


def test_epoch_draws_change(spark):
    w = windows(spark).withColumn("k", F.monotonically_increasing_id())
    a = {r.k for r in imbalance.epoch_negatives(w, "recording_id", "k", 1, 2.0, block=4).collect()}
    b = {r.k for r in imbalance.epoch_negatives(w, "recording_id", "k", 2, 2.0, block=4).collect()}
    positives = {r.k for r in w.where("binary_label = 1").collect()}
    assert positives <= a and positives <= b and a != b


def test_ranking_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double")
    row = evaluation.ranking_metrics(evaluation.check_scores(df)).first()
    p, q = s[y == 1], s[y == 0]
    auc = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    ap = sum((p >= t).mean() * 0 + (p == t).sum() / len(p) * (p >= t).sum() / (s >= t).sum() for t in np.unique(p))
    assert abs(row.roc_auc - auc) < 1e-12 and abs(row.average_precision - ap) < 1e-12
    one = evaluation.ranking_metrics(df.where("label = 1")).first()
    assert one.roc_auc is None


def test_scores_outside_the_range_fail(spark):
    with pytest.raises(Exception, match="outside"):
        evaluation.check_scores(spark.createDataFrame([(1, 1.5)], "label int, score double")).collect()


def test_channel_rules(spark):
    rows = spark.createDataFrame([("r1", 0, "T8-P8-0"), ("r1", 1, "EEG fp1 - f7"), ("r2", 0, "T8-P8-0")], "recording_id string, channel_index int, original_name string")
    rules = spark.createDataFrame([(1, "T8-P8-0", "T8-P8", "validated", "r1"), (2, "FP1-F7", "X", "unverified", None)], "rule_order int, normalized_name string, canonical_name string, validation_status string, recording_id string")
    got = {(r.recording_id, r.channel_index): r.canonical_name for r in channels.canonicalize(rows, rules).collect()}
    assert got == {("r1", 0): "T8-P8", ("r1", 1): "FP1-F7", ("r2", 0): "T8-P8-0"}
    assert len(channels.PRIMARY_17) == 17 and len(channels.CHANNEL_SETS["extended_18"]) == 18


def test_validated_join_fails_on_duplicates(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        checks.validated_join(left, right, ["k"]).collect()


def test_annotations(spark):
    have = spark.createDataFrame([("r", 10.0, 5.0, "seizure")], "recording_id string, onset double, duration double, description string")
    new = spark.createDataFrame([("r", 10.0000001, 5.0, "seizure"), ("r", 30.0, 5.0, "seizure"), ("r", 30.0, 5.0, "seizure")], have.schema)
    assert preprocess.append_annotations(have, new).count() == 3


def test_model_contract(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), (rng.normal(i % 2, 0.3, 3)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "window_id int, binary_label int, f array<double>")
    fitted = model.fit_windows(df, "f", iterations=5)
    scored = model.score_windows(fitted, df, "f", ["window_id"]).join(df, "window_id")
    assert scored.where("(score > 0.5) = (binary_label = 1)").count() > 55
    with pytest.raises(ValueError):
        model.fit_windows(df, "f", weight="w", sampled=True)


def test_scores_close_together(spark):
    """Scores of which 99 in 100 are in one hundredth of the range are dealt evenly, and the
    metrics are exact."""
    rng = np.random.default_rng(5)
    s = np.where(rng.random(4000) < 0.99, rng.random(4000) / 100, rng.random(4000))
    y = (rng.random(4000) < s + 0.01).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double")
    row = evaluation.ranking_metrics(df).first()
    order = np.argsort(-s)
    hits = np.cumsum(y[order])
    assert abs(row.average_precision - (hits / np.arange(1, 4001) * y[order]).sum() / y.sum()) < 1e-9
    p, q = s[y == 1], s[y == 0]
    assert abs(row.roc_auc - (p[:, None] > q).mean()) < 1e-9
    ends = df.agg(F.percentile_approx("score", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 5120).alias("c")).first().c
    assert np.bincount(np.searchsorted(ends, s), minlength=256).max() < 40


def test_draws_with_replacement(spark):
    df = spark.range(4000).withColumn("w", F.when(F.col("id") < 400, 9.0).otherwise(1.0))
    got = imbalance.resampled(df, "w", 3600, "id").collect()
    assert abs(sum(r.copies for r in got) - 3600) < 250
    assert abs(sum(r.copies for r in got if r.id < 400) - 1800) < 180 and max(r.copies for r in got) > 6


def test_rows_without_a_draw_go_first(spark):
    """The steps of a draw are taken only for rows that get one: most of a table's don't."""
    df = spark.range(3000).withColumn("w", F.when(F.col("id") == 5, 600.0).otherwise(1.0))
    got = imbalance.resampled(df, "w", 300, "id")

    def draws(i, mean):
        u, p, n = int(hashlib.md5(f"42/{i}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-mean), 0
        c = p
        while u >= c:
            n += 1
            p *= mean / n
            c += p
        return n

    want = {i: draws(i, 300 / 3599) for i in range(3000) if i != 5}
    assert {r.id: r.copies for r in got.where("id <> 5").collect()} == {i: n for i, n in want.items() if n}
    steps = next(x.lower() for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if ("Filter" in x or "Join" in x) and "aggregate(" in x)
    assert 0 <= steps.find(">= exp(-") < steps.find("aggregate(")


def test_exactly_one(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert checks.exactly_one(a, b, ["k"]).count() == 2
    for broken in (b.where("k <> 2"), b.unionByName(b.where("k = 1"))):
        with pytest.raises(Exception, match="not exactly one"):
            checks.exactly_one(a, broken, ["k"]).collect()

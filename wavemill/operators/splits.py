"""Subject mapping and patient-independent nested folds.

Only per-subject class counts decide the folds; they are a few rows a thousand subjects.
The greedy assignment runs on the driver over at most ``MAX_SUBJECTS`` of them and goes
back as a table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import default_subject

MAX_SUBJECTS = 100_000


def resolve_subjects(cases: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each case's subject: a verified mapping's, else ``subject_<case>``.  Fails where a
    case is mapped twice."""
    own = mapping.where(F.col("mapping_status") == "verified").groupBy("case_id").agg(F.count("*").alias("__n"), F.min("subject_id").alias("__s"))
    joined = cases.select("case_id").distinct().join(own, "case_id", "left")
    joined = joined.where(F.assert_true(F.coalesce("__n", F.lit(1)) == 1, F.lit("case mapped twice")).isNull())
    return joined.select("case_id", F.coalesce("__s", default_subject(F.col("case_id"))).alias("subject_id"), F.when(F.col("__s").isNull(), "default").otherwise("verified").alias("mapping_status"))


def subject_summary(windows: DataFrame, subject: str = "subject_id", case: str = "case_id", recording: str = "recording_id") -> DataFrame:
    """Cases, recordings and class counts of each subject."""
    ictal = F.col("binary_label") == 1
    out = windows.where(F.col("binary_label").isNotNull()).groupBy(subject).agg(
        F.array_join(F.array_sort(F.collect_set(case)), "|").alias("case_ids"), F.count_distinct(recording).alias("n_recordings"), F.count_distinct(F.when(ictal, F.col(recording))).alias("n_ictal_recordings"), F.count_if(~ictal).alias("n_negative"), F.count_if(ictal).alias("n_positive")
    )
    return out.withColumn("positive_fraction", F.col("n_positive") / (F.col("n_negative") + F.col("n_positive")))


def class_counts(windows: DataFrame, subject: str) -> tuple[list, np.ndarray]:
    rows = windows.where(F.col("binary_label").isNotNull() & F.col(subject).isNotNull()).groupBy(subject).agg(F.count_if(F.col("binary_label") == 0).alias("n0"), F.count_if(F.col("binary_label") == 1).alias("n1")).limit(MAX_SUBJECTS + 1).collect()
    if len(rows) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return sorted_counts(rows)


def sorted_counts(rows: Sequence[tuple]) -> tuple[list, np.ndarray]:
    """Subjects in order, and their class counts, of rows (subject, n0, n1)."""
    rows = sorted(rows, key=lambda r: r[0])
    counts = np.array([list(r[1:3]) for r in rows], dtype=float).reshape(-1, 2)
    if not len(rows) or (counts.sum(axis=0) == 0).any():
        raise ValueError("both classes are needed")
    return [r[0] for r in rows], counts


def grouped_folds(counts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Fold of each group: groups in shuffled order, the most uneven class counts first, each
    to the fold that keeps the folds' class shares closest; ties to the smaller fold."""
    if len(counts) < k:
        raise ValueError("fewer groups than folds")
    order = np.arange(len(counts))
    np.random.RandomState(seed).shuffle(order)
    order = order[np.argsort(-counts[order].std(axis=1), kind="stable")]
    total, held, folds = counts.sum(axis=0), np.zeros((k, counts.shape[1])), np.zeros(len(counts), dtype=int)
    for g in order:
        best, least, size = 0, np.inf, np.inf
        for f in range(k):
            held[f] += counts[g]
            spread, n = float(np.mean(np.std(held / total, axis=0))), held[f].sum()
            held[f] -= counts[g]
            if spread < least or (np.isclose(spread, least) and n < size):
                best, least, size = f, spread, n
        held[best] += counts[g]
        folds[g] = best
    return folds


def outer_folds(windows: DataFrame, subject: str = "subject_id", k: int = 5, seed: int = 42) -> DataFrame:
    """(subject, outer_fold)."""
    names, counts = class_counts(windows, subject)
    kind = windows.schema[subject].dataType.simpleString()
    rows = [(n, int(f)) for n, f in zip(names, grouped_folds(counts, k, seed))]
    return windows.sparkSession.createDataFrame(rows, f"{subject} {kind}, outer_fold int")


def nested_roles(windows: DataFrame, subject: str = "subject_id", outer: int = 5, inner: int = 4, seed: int = 42, inner_seed: int = 4200) -> DataFrame:
    """(outer_fold, inner_fold, subject, role) with roles train, validation and test."""
    names, counts = class_counts(windows, subject)
    return roles_of(windows.sparkSession, names, counts, f"{subject} {windows.schema[subject].dataType.simpleString()}", outer, inner, seed, inner_seed)


def roles_of(spark: SparkSession, names: list, counts: np.ndarray, subject: str, outer: int, inner: int, seed: int, inner_seed: int) -> DataFrame:
    """The roles of subjects by their class counts; ``subject`` is the column's DDL."""
    by, rows = grouped_folds(counts, outer, seed), []
    for o in range(outer):
        rest = np.flatnonzero(by != o)
        own = grouped_folds(counts[rest], inner, inner_seed + o)
        for i in range(inner):
            rows += [(o, i, names[g], "validation" if f == i else "train") for g, f in zip(rest, own)]
            rows += [(o, i, names[g], "test") for g in np.flatnonzero(by == o)]
    return spark.createDataFrame(rows, f"outer_fold int, inner_fold int, {subject}, role string")


def fold_summary(windows: DataFrame, roles: DataFrame, keys: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """Counts of all folds and roles in one plan."""
    joined = windows.join(roles, subject)
    return joined.groupBy(*keys).agg(F.count_distinct(subject).alias("n_subjects"), F.count("*").alias("n_windows"), F.count_if(F.col("binary_label") == 0).alias("n_negative"), F.count_if(F.col("binary_label") == 1).alias("n_positive"))


def select_role(windows: DataFrame, roles: DataFrame, outer: int, inner: int, role: str, subject: str = "subject_id") -> DataFrame:
    own = roles.where((F.col("outer_fold") == outer) & (F.col("inner_fold") == inner) & (F.col("role") == role)).select(subject)
    return windows.where(F.col("binary_label").isNotNull()).join(own, subject, "left_semi")


def eligibility(windows: DataFrame) -> DataFrame:
    """Which uses a window may have."""
    known = F.col("binary_label").isNotNull()
    return windows.withColumns({"train_eligible": known, "validation_eligible": known, "test_eligible": known, "clean_train_eligible": known & ((F.col("binary_label") == 1) | F.col("clean_non_ictal"))})


def role_overlaps(roles: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Subjects with more than one role in a fold: must be empty."""
    return roles.groupBy("outer_fold", "inner_fold", subject).agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")

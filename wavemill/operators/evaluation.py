"""Evaluation of scored windows: exact ranking metrics, confusion metrics, thresholds.

Rows are first aggregated per distinct score.  Cumulative counts then run within (keys);
scores are dealt to ranges of about as many distinct scores first, and each range starts from
the totals of the ranges above it, so that no single task has to order everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRID = 199


def check_scores(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``df``, failing on a score outside [0, 1] or a label that isn't 0 or 1."""
    fine = F.col(score).between(0, 1) & ~F.isnan(score) & F.col(label).isin(0, 1)
    return df.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("score outside [0, 1] or label not binary")).isNull())


def cumulative(df: DataFrame, keys: Sequence[str], label: str, score: str, ranges: int = 256, few: int = 100_000) -> DataFrame:
    """Per distinct score: its positives and negatives (p, q), the same of all higher scores
    (p_above, q_above), and the totals (p_all, q_all).  Where a key has more than ``few``
    distinct scores, these are dealt to ranges, which end at quantiles of the distinct scores
    and so hold about as many, however the scores are distributed."""
    points = df.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= few:
        # No key has more scores than rows.
        by = W.partitionBy(*keys)
        above = by.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
        sums = {f"{c}_above": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in "pq"} | {f"{c}_all": F.sum(c).over(by) for c in "pq"}
        return points.withColumns(sums).select(*keys, score, "p", "q", "p_above", "q_above", "p_all", "q_all")
    return ranged_cumulative(points, keys, score, ranges)


def ranged_cumulative(points: DataFrame, keys: Sequence[str], score: str, ranges: int) -> DataFrame:
    parts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    ends = points.groupBy(*keys).agg(F.percentile_approx(score, parts, F.lit(20 * ranges)).alias("__cuts"), F.sum("p").alias("p_all"), F.sum("q").alias("q_all"))
    joined = points.join(ends, list(keys)) if keys else points.crossJoin(F.broadcast(ends))
    joined = joined.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(score)))).drop("__cuts")
    sums = joined.groupBy(*keys, "__range").agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    above = W.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "__range", F.coalesce(F.sum("__p").over(above), F.lit(0)).alias("__pa"), F.coalesce(F.sum("__q").over(above), F.lit(0)).alias("__qa"))
    inside = W.partitionBy(*keys, "__range").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    full = joined.join(F.broadcast(sums) if not keys else sums, [*keys, "__range"])
    return full.select(
        *keys, score, "p", "q", (F.col("__pa") + F.coalesce(F.sum("p").over(inside), F.lit(0))).alias("p_above"), (F.col("__qa") + F.coalesce(F.sum("q").over(inside), F.lit(0))).alias("q_above"), "p_all", "q_all"
    )


def ranking_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Average precision (stepwise, equal scores together) and ROC AUC (ties count half);
    null where a class is missing."""
    c = cumulative(df, keys, label, score)
    seen = F.col("p_above") + F.col("p")
    step = F.col("p") / F.col("p_all") * seen / (seen + F.col("q_above") + F.col("q"))
    area = F.col("q") * (F.col("p_above") + F.col("p") / 2)
    both = (F.max("p_all") > 0) & (F.max("q_all") > 0)
    return c.groupBy(*keys).agg(
        F.max("p_all").alias("n_positive"), F.max("q_all").alias("n_negative"),
        F.when(both, F.sum(F.when(F.col("p") > 0, step).otherwise(0.0))).alias("average_precision"),
        F.when(both, F.sum(area) / (F.max("p_all") * F.max("q_all"))).alias("roc_auc"),
    )


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column | float, label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts at ``score >= threshold`` and the metrics of them."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    out = df.groupBy(*keys).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & ~true).alias("tn"), F.count_if(~hit & true).alias("fn"))
    return with_metrics(out)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Metrics of tp, fp, tn, fn.  Without a denominator, sensitivity and specificity are
    null, precision, recall, F1 and MCC 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    ratio = lambda a, b, e: F.when(b > 0, a / b).otherwise(e)
    out = counts.withColumns({
        "n": n.cast("bigint"), "prevalence": ratio(tp + fn, n, None), "sensitivity": ratio(tp, tp + fn, None), "specificity": ratio(tn, tn + fp, None), "precision": ratio(tp, tp + fp, F.lit(0.0)), "recall": ratio(tp, tp + fn, F.lit(0.0)),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, F.lit(0.0)),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn), F.lit(0.0)),
    })
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def grid_threshold(step: Column) -> Column:
    """Threshold number ``step`` (from 1) of the grid 0.01, ..., 0.99."""
    return F.lit(0.01) + (step - 1) * F.lit(0.98 / (GRID - 1))


def threshold_counts(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts at every grid threshold, from one histogram of the scores: a score
    is put in the bin of the last threshold it reaches, and the bins are summed up from the
    top.  The bin found by division is checked against the thresholds themselves."""
    guess = F.floor((F.col(score) - 0.01) / (0.98 / (GRID - 1))) + 1
    guess = F.greatest(F.lit(0), F.least(guess, F.lit(GRID))).cast("int")
    fixed = F.when((guess < GRID) & (F.col(score) >= grid_threshold(guess + 1)), guess + 1).when((guess > 0) & (F.col(score) < grid_threshold(guess)), guess - 1).otherwise(guess)
    bins = df.groupBy(*keys, fixed.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    steps = df.sparkSession.range(1, GRID + 1).select(F.col("id").cast("int").alias("step"))
    per = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("p", "q").alias("c")))).alias("__m"), F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    crossed = per.crossJoin(F.broadcast(steps)).withColumn("__c", F.col("__m")[F.col("step")])
    down = W.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tp, fp = F.sum(F.coalesce(F.col("__c.p"), F.lit(0))).over(down), F.sum(F.coalesce(F.col("__c.q"), F.lit(0))).over(down)
    out = crossed.select(*keys, "step", grid_threshold(F.col("step")).alias("threshold"), tp.alias("tp"), fp.alias("fp"), "__p", "__q")
    return out.select(*keys, "step", "threshold", "tp", "fp", (F.col("__q") - F.col("fp")).alias("tn"), (F.col("__p") - F.col("tp")).alias("fn"))


def best_threshold(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score", tie_break: str = "closest") -> DataFrame:
    """The grid threshold of highest F1; within 1e-12 the one closest to 0.5 and then lower,
    or the lowest, or the highest."""
    table = with_metrics(threshold_counts(df, keys, label, score)).select(*keys, "threshold", "f1")
    top = table.groupBy(*keys).agg(F.max("f1").alias("best_f1"))
    ties = (table.join(top, list(keys)) if keys else table.crossJoin(F.broadcast(top))).where(F.col("f1") >= F.col("best_f1") - 1e-12)
    t = F.col("threshold")
    order = {"closest": F.struct(F.round(F.abs(t - 0.5), 9), t), "lowest": F.struct(t), "highest": F.struct(-t)}[tie_break]
    return ties.groupBy(*keys).agg(F.min_by("threshold", order).alias("threshold"), F.max("best_f1").alias("f1"), F.count("*").alias("tie_count"))


def freeze_configuration(runs: DataFrame, key: str = "outer_fold", inner: int = 4) -> DataFrame:
    """Per outer fold: median best epoch (halves up, at least 1) and threshold, mean and
    sample deviation of the metrics; ``complete`` if all inner folds are there."""
    return runs.groupBy(key).agg(
        F.greatest(F.lit(1), F.floor(F.median("best_epoch") + 0.5)).cast("bigint").alias("epochs"), F.median("threshold").alias("threshold"), F.avg("average_precision").alias("mean_ap"), F.stddev_samp("average_precision").alias("std_ap"),
        F.avg("roc_auc").alias("mean_auc"), F.stddev_samp("roc_auc").alias("std_auc"), (F.count_distinct("inner_fold") == inner).alias("complete"),
    )


def stability(runs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, median, minimum and maximum of columns per fold."""
    how = {"mean": F.avg, "std": F.stddev_samp, "median": F.median, "min": F.min, "max": F.max}
    return runs.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in how.items()])


def spread_over_folds(runs: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, median and quartiles of columns across folds."""
    how = {"mean": F.avg, "std": F.stddev_samp, "median": F.median, "q25": lambda c: F.percentile(c, 0.25), "q75": lambda c: F.percentile(c, 0.75)}
    return runs.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in how.items()])


def crossfit_prevalence(df: DataFrame, fold: str = "fold", label: str = "label") -> DataFrame:
    """Each row's ``score``: the share of positives among all other folds' rows."""
    own = df.groupBy(fold).agg(F.sum(F.col(label).cast("double")).alias("__p"), F.count(label).alias("__n"))
    all_of_them = own.agg(F.sum("__p").alias("__all_p"), F.sum("__n").alias("__all_n"))
    rest = own.crossJoin(F.broadcast(all_of_them)).select(fold, ((F.col("__all_p") - F.col("__p")) / F.nullif(F.col("__all_n") - F.col("__n"), F.lit(0))).alias("score"))
    return df.drop("score").join(rest, fold)


def prevalence_baseline(development: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """The development set's share of positives as everybody's score."""
    share = development.agg(F.avg(F.col(label).cast("double")).alias("score"))
    return test.drop("score").crossJoin(F.broadcast(share))


def outer_predictions(scored: DataFrame, frozen: DataFrame, key: str = "outer_fold") -> DataFrame:
    """Predicted labels at each outer fold's frozen threshold."""
    joined = scored.join(frozen.select(key, "threshold"), key)
    return joined.withColumn("predicted_label", (F.col("score") >= F.col("threshold")).cast("int"))

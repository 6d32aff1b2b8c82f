"""Validators: the rules of a table are checked in one scan of it, and a report is the union
of the tables' violations: (rule_id, severity, key, details)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checks import Rule, Unique, inspected, report
from .imbalance import class_weights, draw_order
from .intervals import interval_coverage

FOLD = ("outer_fold", "inner_fold")


def known(condition: Column, applies: Column) -> Column:
    """``condition`` where it applies; elsewhere nothing is wrong."""
    return F.when(applies, condition).otherwise(False)


def joined(*columns: str) -> Column:
    return F.concat_ws("/", *columns)


def duplicates(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """Keys that several rows have, with their counts."""
    return inspected(df, F.lit(""), [], [Unique(rule, keys)])


def audit(files: DataFrame, channels: DataFrame) -> DataFrame:
    """File inventory against channel rows."""
    counted = files.join(channels.groupBy("relative_path").agg(F.count("*").alias("n")), "relative_path", "left")
    rules = [Rule("channel_rows", F.coalesce("n", F.lit(0)) != F.col("n_channels")), Rule("positive_rate", F.col("sampling_rate_hz") <= 0), Rule("positive_duration", F.col("duration_seconds") <= 0)]
    return inspected(counted, F.col("relative_path"), rules, [Unique("unique_path", ("relative_path",))])


def metadata(recordings: DataFrame, seizures: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Recordings and seizures: keys, paths (where there is a ``relative_path``), status,
    counts, clocks, intervals, and seizures of unknown recordings."""
    keys = ["case_id", "recording_id"]
    counted = recordings.join(seizures.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
    unique = [Unique("unique_recording", tuple(keys))] + ([Unique("unique_recording_path", ("relative_path",))] if "relative_path" in recordings.columns else [])
    own = [
        Rule("matched", F.col("status") != "matched"), Rule("seizure_count", F.coalesce("n", F.lit(0)) != F.col("n_seizures")),
        Rule("clock_duration", known(F.abs(F.col("clock_seconds") - F.col("duration_seconds")) > tolerance, F.col("clock_seconds").isNotNull()), "warning"),
    ]
    before = F.lag("offset_seconds").over(W.partitionBy(*keys).orderBy("onset_seconds", "seizure_index"))
    placed = seizures.withColumn("__before", before).join(recordings.select(*keys, F.lit(True).alias("__known")).distinct(), keys, "left")
    intervals = [
        Rule("interval", (F.col("onset_seconds") < 0) | (F.col("offset_seconds") <= F.col("onset_seconds"))), Rule("overlapping_seizures", F.coalesce(F.col("onset_seconds") < F.col("__before"), F.lit(False)), "warning"),
        Rule("seizure_recording", F.col("__known").isNull()),
    ]
    return report([inspected(counted, joined(*keys), own, unique), inspected(placed, joined(*keys), intervals, [Unique("unique_seizure", (*keys, "seizure_index"))])])


def quality(chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Chunk metrics: completeness, keys, ranges and labels."""
    parts = [c for c in chunks.columns if c.endswith("_fraction")]
    missing = recordings.select("recording_id").join(chunks.select("recording_id").distinct(), "recording_id", "left_anti")
    rules = [Rule("samples", F.col("sample_count") <= 0), *[Rule(f"range_{c}", known(~F.col(c).between(0, 1), F.col(c).isNotNull())) for c in parts]]
    key = ("recording_id", "channel_index", "chunk_index")
    return report([inspected(missing, F.col("recording_id"), [Rule("complete", F.lit(True))]), inspected(chunks, joined(*key), rules, [Unique("unique_chunk", key)])])


def harmonization(manifest: DataFrame, covered: DataFrame, minimum: float = 0.95) -> DataFrame:
    """Inclusion decisions against channel coverage."""
    complete = covered.where("complete").select("recording_id").distinct().withColumn("__complete", F.lit(True))
    rules = [Rule("included_complete", known(F.col("__complete").isNull(), F.coalesce("include", F.lit(False)))), Rule("decided", F.col("include").isNull()), Rule("reason", F.col("include") != (F.col("reason") == "included"))]
    kept = manifest.agg(F.avg(F.col("include").cast("double")).alias("kept"))
    own = inspected(manifest.join(complete, "recording_id", "left"), F.col("recording_id"), rules, [Unique("unique_recording", ("recording_id",))])
    return report([own, inspected(kept, F.lit("all"), [Rule("retention", F.col("kept") < minimum, "warning")])])


def preprocessing(manifest: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Outputs against what went in: channels, their order (where ``after_names`` and
    ``target_names`` are), rate, duration to one sample, annotations; and, with the
    ``planned`` recordings, outputs that are lost or were never planned."""
    rules = [
        Rule("channel_count", F.col("after_channels") != F.col("target_channels")), Rule("rate", F.col("after_rate") != F.col("before_rate")), Rule("duration", F.abs(F.col("after_seconds") - F.col("before_seconds")) > 1 / F.col("before_rate")),
        Rule("annotations", F.col("after_annotations") != F.col("before_annotations")), Rule("finite", ~F.col("finite")),
    ]
    if "target_names" in manifest.columns:
        rules.append(Rule("channel_order", F.col("after_names") != F.col("target_names"), details=F.array_join("after_names", ",")))
    found = [inspected(manifest, F.col("recording_id"), rules)]
    if planned is not None:
        mine, theirs = (x.select("recording_id").distinct().withColumn(n, F.lit(True)) for x, n in ((manifest, "made"), (planned, "asked")))
        found.append(inspected(theirs.join(mine, "recording_id", "full"), F.col("recording_id"), [Rule("lost_output", F.col("made").isNull()), Rule("unplanned_output", F.col("asked").isNull())]))
    return report(found)


def windows(manifest: DataFrame, recordings: DataFrame, length: int, stride: int, rate: float | None = None, summaries: DataFrame | None = None, seizures: DataFrame | None = None, loaded: DataFrame | None = None, n_samples: int | None = None) -> DataFrame:
    """Window manifest: ids, bounds, stride, labels, and the sampling rate if one is given.

    ``summaries`` (recording_id, n_windows) must agree with the windows; each of ``seizures``
    (recording_id, seizure_id, start, end) must overlap a window, and should have an ictal
    one; ``loaded`` (window_id, samples) are the signals of some windows (``load_sample``), of
    ``n_samples`` samples each (else ``length``).
    """
    bounded = manifest.join(recordings.select("recording_id", "n_times"), "recording_id", "left")
    label = F.when(F.col("label_name") == "non_ictal", F.col("binary_label") == 0).when(F.col("label_name") == "ictal", F.col("binary_label") == 1).when(F.col("label_name") == "boundary", F.col("binary_label").isNull()).otherwise(False)
    rules = [
        Rule("length", F.col("stop_sample_exclusive") - F.col("start_sample") != length), Rule("stride", F.col("start_sample") != F.col("window_index") * stride), Rule("bounds", (F.col("start_sample") < 0) | (F.col("stop_sample_exclusive") > F.col("n_times"))),
        Rule("label", ~label), Rule("label_overlap", (F.col("label_name") == "non_ictal") != (F.col("overlap") <= 0)),
    ]
    if rate is not None:
        rules.append(Rule("rate", F.col("sampling_rate_hz") != rate))
    found = [inspected(bounded, F.col("window_id"), rules, [Unique("unique_window", ("window_id",)), Unique("unique_index", ("recording_id", "window_index"))])]
    if summaries is not None:
        counted = manifest.groupBy("recording_id").agg(F.count("*").alias("n"))
        both = summaries.select("recording_id", "n_windows").join(counted, "recording_id", "full")
        found.append(inspected(both, F.col("recording_id"), [Rule("summary", F.coalesce("n", F.lit(0)) != F.col("n_windows"), details=F.coalesce("n", F.lit(0)))]))
    if seizures is not None:
        named = manifest.select("recording_id", F.col("start_sample").alias("window_start"), F.col("stop_sample_exclusive").alias("window_end"), "label_name")
        covered = interval_coverage(seizures, named, ["recording_id"], "seizure_id")
        found.append(inspected(covered, F.col("seizure_id"), [Rule("uncovered_seizure", F.col("overlapping_windows") == 0), Rule("no_ictal_window", F.col("ictal_windows") == 0, "warning")]))
    if loaded is not None:
        found.append(loads(loaded, n_samples or length))
    return report(found)


def load_sample(manifest: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """The ``n`` windows that a test load takes: the first in the order of a hash."""
    return manifest.orderBy(draw_order("window_id", seed), "window_id").limit(n)


def loads(loaded: DataFrame, length: int, key: str = "window_id") -> DataFrame:
    """Signals (key, samples) that are missing, of the wrong length, or not finite."""
    finite = F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return inspected(loaded, F.col(key), [Rule("load_length", F.size("samples") != length, details=F.size("samples")), Rule("load_finite", ~finite)])


def splits(windows_with_folds: DataFrame, roles: DataFrame, minimum_subjects: int = 3, mapping: DataFrame | None = None, pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Leakage: one outer fold a subject, case and recording; disjoint roles; every
    development subject validated once; enough subjects and both classes.

    With a ``mapping`` (case_id, subject_id), every outer and inner fold must be an exact
    partition of the subjects that have windows: its test subjects those of the outer fold,
    all others in training or validation; and the cases of each of ``pairs`` must share a
    subject (a pair that is not there in full is a warning)."""
    entities = ("subject_id", "case_id", "recording_id")
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("id")) for e in entities]))
    spread = windows_with_folds.select("outer_fold", each.alias("e")).groupBy("e").agg((F.min("outer_fold") != F.max("outer_fold")).alias("spread"))
    found = [inspected(spread, F.col("e.id"), [Rule(f"one_fold_{e}", known(F.coalesce("spread", F.lit(False)), F.col("e.entity") == e)) for e in entities])]
    twice = roles.groupBy(*FOLD, "subject_id").agg(F.count_distinct("role").alias("n"))
    found.append(inspected(twice, joined(*FOLD, "subject_id"), [Rule("disjoint_roles", F.col("n") > 1)]))
    checked = roles.where("role <> 'test'").groupBy("outer_fold", "subject_id").agg(F.count_if(F.col("role") == "validation").alias("n"))
    found.append(inspected(checked, joined("outer_fold", "subject_id"), [Rule("validated_once", F.col("n") != 1)]))
    sizes = windows_with_folds.groupBy("outer_fold").agg(F.count_distinct("subject_id").alias("n"), F.count_distinct("binary_label").alias("c"))
    found.append(inspected(sizes, F.col("outer_fold"), [Rule("enough_subjects", F.col("n") < minimum_subjects), Rule("both_classes", F.col("c") < 2)]))
    if mapping is not None:
        assigned = windows_with_folds.groupBy("subject_id").agg(F.min("outer_fold").alias("own_fold"))
        # The folds are a short list, which every subject is held against.
        folds = roles.select(*FOLD).distinct().agg(F.collect_list(F.struct(*FOLD)).alias("all"))
        asked = assigned.crossJoin(F.broadcast(folds)).select("subject_id", "own_fold", F.explode("all").alias("f")).select("subject_id", "own_fold", "f.*")
        given = roles.groupBy(*FOLD, "subject_id").agg(F.max(F.col("role") == "test").alias("test"), F.lit(True).alias("given"))
        both = asked.join(given, [*FOLD, "subject_id"], "full")
        rules = [
            Rule("test_subjects", known(F.coalesce("test", F.lit(False)) != (F.col("own_fold") == F.col("outer_fold")), F.col("own_fold").isNotNull())),
            Rule("exact_partition", F.col("own_fold").isNull() | (F.col("given").isNull() & (F.col("own_fold") != F.col("outer_fold")))),
        ]
        found.append(inspected(both, joined(*FOLD, "subject_id"), rules))
        if pairs:
            listed = F.array(*[F.struct(F.lit("+".join(p)).alias("pair"), F.lit(c).alias("case_id")) for p in pairs for c in p])
            wanted = mapping.sparkSession.range(1).select(F.explode(listed).alias("p")).select("p.*")
            met = F.broadcast(wanted).join(mapping.select("case_id", "subject_id").distinct(), "case_id", "left").groupBy("pair").agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct(F.when(F.col("subject_id").isNotNull(), F.col("case_id"))).alias("cases"))
            found.append(inspected(met, F.col("pair"), [Rule("known_pair", (F.col("cases") == 2) & (F.col("subjects") > 1)), Rule("pair_observed", F.col("cases") < 2, "warning")]))
    return report(found)


def scalers(table: DataFrame, channels: int, trained_on: DataFrame | None = None, roles: DataFrame | None = None, weights: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """Fold scalers: complete, finite and positive.

    With ``roles`` (fold keys, subject_id, role): a scaler's subjects (``trained_on``: fold
    keys, subject_id) are exactly the training subjects of its fold; and the class counts of
    ``weights`` (fold keys, n_negative, n_positive) are those of the training subjects'
    windows (``labelled``: subject_id, binary_label)."""
    counted = table.groupBy(*FOLD).agg(F.count("*").alias("n"))
    found = [
        inspected(counted, joined(*FOLD), [Rule("complete", F.col("n") != channels)]),
        inspected(table, joined(*FOLD, "channel_name"), [Rule("finite", F.isnan("mean") | F.isnan("scale")), Rule("positive", F.col("scale") <= 0)]),
    ]
    train = None if roles is None else roles.where("role = 'train'").select(*FOLD, "subject_id").distinct()
    if trained_on is not None and train is not None:
        both = trained_on.select(*FOLD, "subject_id").distinct().withColumn("used", F.lit(True)).join(train.withColumn("asked", F.lit(True)), [*FOLD, "subject_id"], "full")
        found.append(inspected(both, joined(*FOLD, "subject_id"), [Rule("scaler_leak", F.col("asked").isNull()), Rule("scaler_incomplete", F.col("used").isNull())]))
    if weights is not None and train is not None and labelled is not None:
        # Counted by subject before the folds multiply the rows.
        subjects = class_weights(labelled, ["subject_id"]).select("subject_id", "n_negative", "n_positive")
        right = train.join(subjects, "subject_id").groupBy(*FOLD).agg(F.sum("n_negative").alias("q"), F.sum("n_positive").alias("p"))
        both = weights.select(*FOLD, "n_negative", "n_positive").join(right, list(FOLD), "full")
        found.append(inspected(both, joined(*FOLD), [Rule("class_counts", (F.col("n_negative") != F.coalesce("q", F.lit(0))) | (F.col("n_positive") != F.coalesce("p", F.lit(0))))]))
    return report(found)


def baseline(predictions: DataFrame, frozen: DataFrame) -> DataFrame:
    """Predictions against the frozen configuration."""
    joined_up = predictions.join(frozen.select("outer_fold", F.col("threshold").alias("__t")), "outer_fold", "left")
    rules = [Rule("score_range", ~F.col("score").between(0, 1)), Rule("frozen_threshold", F.col("threshold") != F.col("__t")), Rule("label", (F.col("score") >= F.col("threshold")).cast("int") != F.col("predicted_label"))]
    return inspected(joined_up, F.col("window_id"), rules, [Unique("unique_prediction", ("window_id",))])


def experiment(runs: DataFrame, frozen: DataFrame, predictions: DataFrame, assigned: DataFrame, trained_on: DataFrame | None = None, checkpoints: DataFrame | None = None, inner: int = 4, metrics: Sequence[str] = (), source: str = "inner_validation") -> DataFrame:
    """A whole experiment beyond its predictions' ranges (``baseline``).

    Inner ``runs`` (fold keys, best_epoch, threshold, threshold_source, checkpoint_path and
    ``metrics``): unique, ``inner`` for each outer fold, finite, thresholds within [0, 1] and
    from the right source, checkpoints that exist (``checkpoints``: path).  ``frozen``
    (outer_fold, epochs, threshold): one row an outer fold, with the medians of its runs.
    ``predictions``' subjects are ``assigned`` (subject_id, outer_fold) to their fold, and none
    of a fold's test subjects is among the subjects ``trained_on`` (outer_fold, subject_id)."""
    rules = [
        Rule("threshold_source", F.col("threshold_source") != source), Rule("threshold_range", ~F.col("threshold").between(0, 1)),
        *[Rule(f"finite_{m}", F.col(m).isNull() | F.isnan(m) | (F.abs(m) == float("inf"))) for m in metrics],
    ]
    listed = runs
    if checkpoints is not None:
        listed = runs.join(checkpoints.select(F.col("path").alias("checkpoint_path")).distinct().withColumn("__there", F.lit(True)), "checkpoint_path", "left")
        rules.append(Rule("checkpoint", F.col("__there").isNull(), details=F.col("checkpoint_path")))
    found = [inspected(listed, joined(*FOLD), rules, [Unique("unique_run", FOLD)])]
    medians = runs.groupBy("outer_fold").agg(F.count_distinct("inner_fold").alias("n"), F.greatest(F.lit(1), F.floor(F.median("best_epoch") + 0.5)).alias("e"), F.median("threshold").alias("t"))
    both = frozen.select("outer_fold", "epochs", F.col("threshold").alias("frozen")).join(medians, "outer_fold", "full")
    told = [
        Rule("run_count", F.coalesce("n", F.lit(0)) != inner, details=F.coalesce("n", F.lit(0))), Rule("median_epoch", known(F.col("epochs") != F.col("e"), F.col("e").isNotNull())),
        Rule("median_threshold", known(F.abs(F.col("frozen") - F.col("t")) > 1e-9, F.col("t").isNotNull())),
    ]
    found.append(inspected(both, F.col("outer_fold"), told, [Unique("unique_outer_fold", ("outer_fold",))]))
    right = assigned.select("subject_id", F.col("outer_fold").alias("__fold"))
    subjects = predictions.groupBy("outer_fold", "subject_id").agg(F.count("*").alias("n")).join(right, "subject_id", "left")
    found.append(inspected(subjects, joined("outer_fold", "subject_id"), [Rule("unknown_subject", F.col("__fold").isNull(), details=F.col("n")), Rule("right_fold", known(F.col("__fold") != F.col("outer_fold"), F.col("__fold").isNotNull()), details=F.col("n"))]))
    if trained_on is not None:
        used = trained_on.select("outer_fold", "subject_id").distinct().join(right, "subject_id")
        found.append(inspected(used, joined("outer_fold", "subject_id"), [Rule("leakage", F.col("__fold") == F.col("outer_fold"))]))
    return report(found)

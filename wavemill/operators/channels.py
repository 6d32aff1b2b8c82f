"""Channel audit and harmonization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import guarded_ratio, normalize_channel_name, reasons

#: The candidate channel sets, in their target order.
PRIMARY_17 = ["FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FZ-CZ", "CZ-PZ", "FP2-F4", "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "P8-O2"]
CHANNEL_SETS = {
    "primary_17": PRIMARY_17,
    "extended_18": ["FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FZ-CZ", "CZ-PZ", "FP2-F4", "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8", "P8-O2"],
    "temporal_8": ["FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP2-F8", "F8-T8", "T8-P8", "P8-O2"],
    "parasagittal_8": ["FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4", "F4-C4", "C4-P4", "P4-O2"],
}
VALID_STATUSES = ("validated", "verified")


def channel_sets(spark: SparkSession, sets: dict[str, Sequence[str]] | None = None) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in (sets or CHANNEL_SETS).items()], "channel_set string, target array<string>")


def canonicalize(channels: DataFrame, rules: DataFrame) -> DataFrame:
    """Channels with ``canonical_name`` and ``alias_status``.  The first validated rule for
    the normalised name wins; a rule for one recording needs that recording."""
    named = channels.withColumn("normalized_name", normalize_channel_name(F.col("original_name")))
    valid = rules.where(F.col("validation_status").isin(*VALID_STATUSES)).select("rule_order", F.col("normalized_name").alias("r_name"), "canonical_name", F.col("recording_id").alias("r_recording"))
    fits = (F.col("normalized_name") == F.col("r_name")) & (F.col("r_recording").isNull() | (F.col("r_recording") == F.col("recording_id")))
    joined = named.join(valid, fits, "left")
    first = joined.groupBy("recording_id", "channel_index").agg(F.any_value("original_name").alias("original_name"), F.any_value("normalized_name").alias("normalized_name"), F.min_by("canonical_name", "rule_order").alias("alias"))
    return first.select("recording_id", "channel_index", "original_name", "normalized_name", F.coalesce("alias", "normalized_name").alias("canonical_name"), F.when(F.col("alias").isNotNull(), "applied").otherwise("none").alias("alias_status"))


def duplicate_canonicals(canonical: DataFrame) -> DataFrame:
    """Dead letters: recordings in which two channels have one canonical name."""
    return canonical.groupBy("recording_id", "canonical_name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("recording_id").alias("item"), F.lit("duplicate_channel").alias("error_type"), F.col("canonical_name").alias("error_message"))


def coverage(channels: DataFrame, sets: DataFrame, key: str, name: str) -> DataFrame:
    """Each key against each candidate set: missing and extra channels, and completeness.
    The sets are a literal table of a few rows."""
    have = channels.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("have"))
    crossed = have.crossJoin(F.broadcast(sets))
    return crossed.select(
        key, "channel_set", F.size("target").alias("n_target"), F.size(F.array_intersect("target", "have")).alias("n_present"),
        F.array_join(F.array_sort(F.array_except("target", "have")), "|").alias("missing"), F.array_join(F.array_sort(F.array_except("have", "target")), "|").alias("extra"),
        (F.size(F.array_except("target", "have")) == 0).alias("complete"),
    )


def retention(covered: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """What each set would keep: recordings, recordings with seizures, seizures, ictal time and
    hours, with fractions of the totals; its channels (``n_target``), and, where ``recordings``
    have a ``case_id``, the cases of which any recording is kept.  Recordings without metadata
    count as recordings only."""
    joined = covered.join(recordings, key, "left")
    sums = {"seizures": F.col("n_seizures"), "ictal_seconds": F.col("ictal_seconds"), "hours": F.col("duration_seconds") / 3600}
    total = [F.count("*").alias("recordings_total"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"{n}_total") for n, x in sums.items()]]
    kept = [F.count_if("complete").alias("recordings_kept"), *[F.coalesce(F.sum(F.when(F.col("complete"), x)), F.lit(0)).alias(f"{n}_kept") for n, x in sums.items()]]
    ictal = F.col("n_seizures") > 0
    total += [F.max("n_target").alias("n_target"), F.count_if(ictal).alias("seizure_recordings_total")]
    kept.append(F.count_if(ictal & F.col("complete")).alias("seizure_recordings_kept"))
    if "case_id" in recordings.columns:
        total.append(F.count_distinct("case_id").alias("cases_total"))
        kept.append(F.count_distinct(F.when(F.col("complete"), F.col("case_id"))).alias("cases_kept"))
    out = joined.groupBy("channel_set").agg(*total, *kept)
    return out.withColumns({f"{n}_fraction": guarded_ratio(F.col(f"{n}_kept"), F.col(f"{n}_total"), F.lit(0.0)) for n in ("recordings", *sums)})


def inclusion(recordings: DataFrame, covered: DataFrame, channel_set: str = "primary_17") -> DataFrame:
    """Eligibility flags, their conjunction and the reasons against."""
    one = covered.where(F.col("channel_set") == channel_set).select("recording_id", "complete")
    joined = recordings.join(one, "recording_id", "left")
    flags = joined.withColumns({
        "metadata_ok": F.coalesce(F.col("status") == "matched", F.lit(False)),
        "rate_ok": F.coalesce(F.col("sampling_rate_hz") > 0, F.lit(False)),
        "duration_ok": F.coalesce(F.col("duration_seconds") > 0, F.lit(False)),
        "channels_ok": F.coalesce(F.col("complete"), F.lit(False)),
        "manual_ok": ~F.coalesce(F.col("manual_decision").isin("confirmed_unusable_recording", "unreadable_edf", "all_target_channels_invalid"), F.lit(False)),
    })
    checks = [(f, n) for f, n in (("metadata_ok", "metadata_not_matched"), ("rate_ok", "invalid_sampling_rate"), ("duration_ok", "invalid_duration"), ("channels_ok", "missing_target_channels"), ("manual_ok", "manual_exclusion"))]
    out = flags.withColumn("reason", reasons(*[(~F.col(f), n) for f, n in checks]))
    return out.withColumn("include", F.col("reason") == "included")


def reorder(blocks: DataFrame, target: Sequence[str]) -> DataFrame:
    """Blocks of the target channels with ``target_index``; recordings that lack one go to
    the dead letters of ``missing_targets``."""
    order = blocks.sparkSession.createDataFrame(list(enumerate(target)), "target_index int, channel_name string")
    return blocks.join(F.broadcast(order), "channel_name")


def missing_targets(blocks: DataFrame, target: Sequence[str]) -> DataFrame:
    have = blocks.groupBy("recording_id").agg(F.collect_set("channel_name").alias("have"))
    gone = F.array_except(F.array(*[F.lit(t) for t in target]), F.col("have"))
    return have.where(F.size(gone) > 0).select(F.col("recording_id").alias("item"), F.lit("missing_channel").alias("error_type"), F.array_join(F.array_sort(gone), "|").alias("error_message"))


def channel_orders(signed: DataFrame) -> DataFrame:
    """Channel sets that occur in more than one order."""
    return signed.groupBy("unordered_signature").agg(F.count_distinct("ordered_signature").alias("n_orders"), F.count("*").alias("n_files")).where("n_orders > 1")


def extreme_files(channels: DataFrame, key: str) -> DataFrame:
    """Files with the fewest and with the most channels."""
    counted = channels.groupBy(key).agg(F.count("*").alias("n_channels"))
    ends = counted.agg(F.min("n_channels").alias("__lo"), F.max("n_channels").alias("__hi"))
    both = counted.crossJoin(F.broadcast(ends)).where("n_channels = __lo OR n_channels = __hi")
    return both.select(key, "n_channels", F.when(F.col("n_channels") == F.col("__lo"), "fewest").otherwise("most").alias("extreme"))


def missing_patterns(covered: DataFrame) -> DataFrame:
    """How often each pattern of missing channels occurs, by channel set."""
    return covered.where("NOT complete").groupBy("channel_set", "missing").agg(F.count("*").alias("n_files"))


def duplicate_comparison(samples: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Two channels' samples side by side: identical, close, correlation, differences."""
    x, y = F.col(a), F.col(b)
    same = F.bool_and(x == y)
    return samples.groupBy(*keys).agg(
        same.alias("identical"), F.bool_and(F.abs(x - y) <= 1e-12 + 1e-7 * F.abs(y)).alias("all_close"),
        F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).alias("pearson"), F.max(F.abs(x - y)).alias("max_abs_difference"), F.sqrt(F.avg((x - y) * (x - y))).alias("rms_difference"),
    )


def ranked_presence(channels: DataFrame, key: str, name: str, minimum: float) -> DataFrame:
    """Channels in at least the given share of files, most frequent first."""
    files = channels.agg(F.count_distinct(key).alias("__files"))
    counted = channels.groupBy(name).agg(F.count_distinct(key).alias("n_files"))
    part = counted.crossJoin(F.broadcast(files)).withColumn("fraction", F.col("n_files") / F.col("__files")).drop("__files")
    return part.where(F.col("fraction") >= minimum).orderBy(F.desc("n_files"), name)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")

"""Registered queries of validators, sources, preprocessing and the smaller operators, each
with its DuckDB SQL.  Imported for its registrations."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import checks
from ..functions import scalars as sc
from ..operators import channels as ch
from ..operators import evaluation as ev
from ..operators import imbalance as im
from ..operators import intervals as ivl
from ..operators import moments as mo
from ..operators import preprocess as pp
from ..operators import quality as qc
from ..operators import relational as rel
from ..operators import splits as sp
from ..operators import training as tr
from ..operators import validation as val
from ..scratch import scratch_dir
from ..sources import block_table as bt
from ..sources import edf
from ..sources.tables import load, split_failures
from . import surrogates as su
from .queries import DRAW, EVENTS, FLAG_SQL, LABELS, MERGED, ORACLES, ROWS, RUNS, SCORES, flag_rows, inner_runs, query, rounded, signal_blocks, subject_windows


def bad(rule: str, severity: str, key: str, condition: str, source: str, details: str = "''") -> str:
    """SQL of one rule: rows whose outcome is bad, or unknown."""
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, CAST({key} AS VARCHAR) AS key, CAST({details} AS VARCHAR) AS details FROM {source} WHERE NOT coalesce(NOT ({condition}), FALSE)"


def twice(rule: str, source: str, *keys: str) -> str:
    """SQL of the rule that keys are unique."""
    joined = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"SELECT '{rule}' AS rule_id, 'error' AS severity, {joined} AS key, CAST(count(*) AS VARCHAR) AS details FROM {source} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


def union(*rules: str) -> str:
    return " UNION ALL ".join(rules)


# Validators, on data with violations.


AUDIT = """f AS (SELECT CAST(o_custkey AS VARCHAR) AS relative_path, CAST(o_orderkey % 7 AS INTEGER) AS n_channels, o_totalprice - 50000 AS sampling_rate_hz, o_orderkey % 11 AS duration_seconds FROM orders),
c AS (SELECT CAST(l_orderkey % 1000 AS VARCHAR) AS relative_path FROM lineitem), j AS (SELECT f.*, n FROM f LEFT JOIN (SELECT relative_path, count(*) AS n FROM c GROUP BY 1) USING (relative_path))"""


@query(f"WITH {AUDIT} " + union(twice("unique_path", "f", "relative_path"), bad("channel_rows", "error", "relative_path", "coalesce(n, 0) <> n_channels", "j"), bad("positive_rate", "error", "relative_path", "sampling_rate_hz <= 0", "f"), bad("positive_duration", "error", "relative_path", "duration_seconds <= 0", "f")))
def val_audit(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    files = o.select(F.col("o_custkey").cast("string").alias("relative_path"), (F.col("o_orderkey") % 7).cast("int").alias("n_channels"), (F.col("o_totalprice") - 50_000).alias("sampling_rate_hz"), (F.col("o_orderkey") % 11).alias("duration_seconds"))
    return val.audit(files, load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).cast("string").alias("relative_path")))


META = f"""{EVENTS}, r AS (SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(day % 20 AS VARCHAR) AS recording_id, CASE WHEN user_id % 10 = 3 THEN 'left_only' ELSE 'matched' END AS status, count(*) % 4 AS n_seizures, CASE WHEN user_id % 7 > 0 THEN 86400 + user_id % 5 END AS clock_seconds, 86400 AS duration_seconds FROM e GROUP BY user_id, day),
z AS (SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(day % 20 AS VARCHAR) AS recording_id, row_number() OVER (PARTITION BY user_id, day ORDER BY s, event_id) AS seizure_index, CAST(floor(s / 1000000) AS BIGINT) - 600 AS onset_seconds, CAST(floor(t / 1000000) AS BIGINT) - 4000 AS offset_seconds FROM iv),
j AS (SELECT r.*, n FROM r LEFT JOIN (SELECT case_id, recording_id, count(*) AS n FROM z GROUP BY ALL) USING (case_id, recording_id)),
p AS (SELECT *, lag(offset_seconds) OVER (PARTITION BY case_id, recording_id ORDER BY onset_seconds, seizure_index, offset_seconds) AS before FROM z)"""
RECORDING = "case_id || '/' || recording_id"


@query(f"WITH {META} " + union(
    twice("unique_recording", "r", "case_id", "recording_id"), bad("matched", "error", RECORDING, "status <> 'matched'", "r"), bad("seizure_count", "error", RECORDING, "coalesce(n, 0) <> n_seizures", "j"),
    bad("clock_duration", "warning", RECORDING, "abs(clock_seconds - duration_seconds) > 2", "(SELECT * FROM r WHERE clock_seconds IS NOT NULL)"), bad("interval", "error", RECORDING, "onset_seconds < 0 OR offset_seconds <= onset_seconds", "z"),
    twice("unique_seizure", "z", "case_id", "recording_id", "seizure_index"), bad("overlapping_seizures", "warning", RECORDING, "TRUE", "(SELECT * FROM p WHERE onset_seconds < before)"),
))
def val_metadata(spark, sf_dir):
    e = su.events(spark, sf_dir)
    case, recording = F.col("user_id").cast("string").alias("case_id"), (F.col("day") % 20).cast("string").alias("recording_id")
    counted = e.groupBy("user_id", "day").agg((F.count("*") % 4).alias("n_seizures"))
    clock = F.when(F.col("user_id") % 7 > 0, 86_400 + F.col("user_id") % 5)
    recordings = counted.select(case, recording, F.when(F.col("user_id") % 10 == 3, "left_only").otherwise("matched").alias("status"), "n_seizures", clock.alias("clock_seconds"), F.lit(86_400).alias("duration_seconds"))
    number = F.row_number().over(W.partitionBy("user_id", "day").orderBy("start", "event_id"))
    z = su.error_intervals(spark, sf_dir).withColumn("seizure_index", number)
    seizures = z.select(case, recording, "seizure_index", (F.floor(F.col("start") / 1_000_000) - 600).alias("onset_seconds"), (F.floor(F.col("end") / 1_000_000) - 4000).alias("offset_seconds"))
    return val.metadata(recordings, seizures)


@query("""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS recording_id, l_suppkey % 3 AS channel_index, l_linenumber % 3 AS chunk_index, CAST(l_quantity AS INTEGER) - 2 AS sample_count, l_discount * 11 AS zero_fraction, CASE WHEN l_tax > 0.01 THEN l_tax * 15 - 0.2 END AS nan_fraction FROM lineitem WHERE l_orderkey % 5 > 0), k AS (SELECT *, recording_id || '/' || CAST(channel_index AS VARCHAR) || '/' || CAST(chunk_index AS VARCHAR) AS k FROM c) """ + union(
    bad("complete", "error", "o_orderkey", "TRUE", "(SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT recording_id FROM c))"), twice("unique_chunk", "c", "recording_id", "channel_index", "chunk_index"), bad("samples", "error", "k", "sample_count <= 0", "k"),
    bad("range_zero_fraction", "error", "k", "NOT zero_fraction BETWEEN 0 AND 1", "(SELECT * FROM k WHERE zero_fraction IS NOT NULL)"), bad("range_nan_fraction", "error", "k", "NOT nan_fraction BETWEEN 0 AND 1", "(SELECT * FROM k WHERE nan_fraction IS NOT NULL)"),
))
def val_quality(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").where("l_orderkey % 5 > 0")
    chunks = li.select(
        F.col("l_orderkey").cast("string").alias("recording_id"), (F.col("l_suppkey") % 3).alias("channel_index"), (F.col("l_linenumber") % 3).alias("chunk_index"), (F.col("l_quantity").cast("int") - 2).alias("sample_count"),
        (F.col("l_discount") * 11).alias("zero_fraction"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 15 - 0.2).alias("nan_fraction"),
    )
    return val.quality(chunks, load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("recording_id")))


MANIFEST = """m AS (SELECT CAST(o_orderkey % 9000 AS VARCHAR) AS recording_id, CASE WHEN o_orderkey % 50 > 0 THEN o_totalprice > 60000 END AS include, CASE WHEN o_totalprice > 61000 THEN 'included' ELSE 'small' END AS reason FROM orders), c AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS recording_id FROM lineitem WHERE l_quantity > 20)"""


@query(f"WITH {MANIFEST} " + union(
    twice("unique_recording", "m", "recording_id"), bad("included_complete", "error", "recording_id", "TRUE", "(SELECT * FROM m WHERE include AND recording_id NOT IN (SELECT recording_id FROM c))"), bad("decided", "error", "recording_id", "include IS NULL", "m"),
    bad("reason", "error", "recording_id", "include <> (reason = 'included')", "m"), bad("retention", "warning", "'all'", "kept < 0.95", "(SELECT avg(CAST(include AS DOUBLE)) AS kept FROM m)"),
))
def val_harmonization(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    manifest = o.select((F.col("o_orderkey") % 9000).cast("string").alias("recording_id"), F.when(F.col("o_orderkey") % 50 > 0, F.col("o_totalprice") > 60_000).alias("include"), F.when(F.col("o_totalprice") > 61_000, "included").otherwise("small").alias("reason"))
    covered = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("recording_id"), (F.col("l_quantity") > 20).alias("complete"))
    return val.harmonization(manifest, covered)


@query("WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS recording_id, l_suppkey % 17 AS a, l_partkey % 17 AS t, CASE WHEN l_quantity > 2 THEN 8.0 ELSE 16.0 END AS ar, 8.0 AS br, l_extendedprice AS bs, l_extendedprice + l_tax * 2 AS asec, l_linenumber AS ba, CASE WHEN l_discount > 0.02 THEN l_linenumber END AS aa, l_tax > 0 AS fin FROM lineitem) " + union(
    bad("channel_count", "error", "recording_id", "a <> t", "m"), bad("rate", "error", "recording_id", "ar <> br", "m"), bad("duration", "error", "recording_id", "abs(asec - bs) > 1 / br", "m"), bad("annotations", "error", "recording_id", "aa <> ba", "m"), bad("finite", "error", "recording_id", "NOT fin", "m"),
))
def val_preprocessing(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return val.preprocessing(li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("recording_id"), (F.col("l_suppkey") % 17).alias("after_channels"), (F.col("l_partkey") % 17).alias("target_channels"), F.when(F.col("l_quantity") > 2, 8.0).otherwise(16.0).alias("after_rate"), F.lit(8.0).alias("before_rate"),
        F.col("l_extendedprice").alias("before_seconds"), (F.col("l_extendedprice") + F.col("l_tax") * 2).alias("after_seconds"), F.col("l_linenumber").alias("before_annotations"), F.when(F.col("l_discount") > 0.02, F.col("l_linenumber")).alias("after_annotations"), (F.col("l_tax") > 0).alias("finite"),
    ))


WINDOWS = f"""m AS (SELECT 'w' || CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) || '_' || CAST(window_index % 9 AS VARCHAR) AS window_id, CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS recording_id, CAST(window_index AS BIGINT) AS window_index, window_start + (CASE WHEN user_id % 9 = 1 THEN 1 ELSE 0 END) AS a, window_end - (CASE WHEN user_id % 8 = 1 THEN 1 ELSE 0 END) AS b,
  label_name, CASE WHEN label_name = 'non_ictal' THEN 0 WHEN label_name = 'ictal' AND user_id % 6 > 0 THEN 1 END AS bl, CASE WHEN window_index = 4 THEN 0 ELSE overlap END AS overlap FROM lab),
j AS (SELECT m.*, n FROM m LEFT JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS recording_id, {su.DAY} - (CASE WHEN user_id % 12 = 1 THEN {su.WINDOW} ELSE 0 END) AS n FROM e WHERE user_id % 13 > 0) USING (recording_id))"""


@query(f"WITH {EVENTS}, {MERGED}, {LABELS}, {WINDOWS} " + union(
    twice("unique_window", "m", "window_id"), twice("unique_index", "m", "recording_id", "window_index"), bad("length", "error", "window_id", f"b - a <> {su.WINDOW}", "m"), bad("stride", "error", "window_id", f"a <> window_index * {su.STRIDE}", "m"), bad("bounds", "error", "window_id", "a < 0 OR b > n", "j"),
    bad("label", "error", "window_id", "NOT CASE label_name WHEN 'non_ictal' THEN bl = 0 WHEN 'ictal' THEN bl = 1 WHEN 'boundary' THEN bl IS NULL ELSE FALSE END", "m"), bad("label_overlap", "error", "window_id", "(label_name = 'non_ictal') <> (overlap <= 0)", "m"),
))
def val_windows(spark, sf_dir):
    w = su.labelled(spark, sf_dir)
    recording = F.concat_ws("_", "user_id", "day")
    manifest = w.select(
        F.concat(F.lit("w"), F.concat_ws("_", "user_id", "day", F.col("window_index") % 9)).alias("window_id"), recording.alias("recording_id"), F.col("window_index").cast("bigint").alias("window_index"), (F.col("window_start") + F.when(F.col("user_id") % 9 == 1, 1).otherwise(0)).alias("start_sample"),
        (F.col("window_end") - F.when(F.col("user_id") % 8 == 1, 1).otherwise(0)).alias("stop_sample_exclusive"), "label_name", F.when(F.col("label_name") == "non_ictal", 0).when((F.col("label_name") == "ictal") & (F.col("user_id") % 6 > 0), 1).alias("binary_label"), F.when(F.col("window_index") == 4, 0).otherwise(F.col("overlap")).alias("overlap"),
    )
    n_times = F.lit(su.DAY) - F.when(F.col("user_id") % 12 == 1, su.WINDOW).otherwise(0)
    recordings = su.recordings(spark, sf_dir).where("user_id % 13 > 0").select(recording.alias("recording_id"), n_times.alias("n_times"))
    return val.windows(manifest, recordings, su.WINDOW, su.STRIDE)


SPLITS = """w AS (SELECT user_id % 40 AS subject_id, user_id % 80 AS case_id, user_id % 80 AS recording_id, CASE WHEN user_id % 40 < 36 THEN user_id % 40 % 4 ELSE event_id % 2 + 5 END AS outer_fold, CASE WHEN user_id % 4 = 1 THEN 0 ELSE event_id % 2 END AS binary_label FROM events),
r AS (SELECT DISTINCT o.k AS outer_fold, i.k AS inner_fold, user_id % 40 AS subject_id, CASE WHEN user_id % 40 % 4 = o.k THEN 'test' WHEN user_id % 40 % 3 = i.k THEN 'validation' ELSE 'train' END AS role FROM events, range(0, 4) AS o(k), range(0, 3) AS i(k) UNION ALL SELECT DISTINCT 0, 0, user_id % 40, 'validation' FROM events WHERE user_id % 40 < 5),
s AS (SELECT outer_fold, count(DISTINCT subject_id) AS n, count(DISTINCT binary_label) AS c FROM w GROUP BY 1)"""


@query(f"WITH {SPLITS} " + union(
    *[bad(f"one_fold_{k}", "error", k, "n > 1", f"(SELECT {k}, count(DISTINCT outer_fold) AS n FROM w GROUP BY 1)") for k in ("subject_id", "case_id", "recording_id")],
    bad("disjoint_roles", "error", "k", "n > 1", "(SELECT CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) || '/' || CAST(subject_id AS VARCHAR) AS k, count(DISTINCT role) AS n FROM r GROUP BY outer_fold, inner_fold, subject_id)"),
    bad("validated_once", "error", "k", "n <> 1", "(SELECT CAST(outer_fold AS VARCHAR) || '/' || CAST(subject_id AS VARCHAR) AS k, count_if(role = 'validation') AS n FROM r WHERE role <> 'test' GROUP BY outer_fold, subject_id)"),
    bad("enough_subjects", "error", "outer_fold", "n < 5", "s"), bad("both_classes", "error", "outer_fold", "c < 2", "s"),
))
def val_splits(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    subject = F.col("user_id") % 40
    fold = F.when(subject < 36, subject % 4).otherwise(F.col("event_id") % 2 + 5)
    w = e.select(subject.alias("subject_id"), (F.col("user_id") % 80).alias("case_id"), (F.col("user_id") % 80).alias("recording_id"), fold.alias("outer_fold"), F.when(F.col("user_id") % 4 == 1, 0).otherwise(F.col("event_id") % 2).alias("binary_label"))
    subjects = e.select(subject.alias("subject_id")).distinct()
    folds = spark.range(4).select(F.col("id").alias("outer_fold")).crossJoin(spark.range(3).select(F.col("id").alias("inner_fold")))
    role = F.when(F.col("subject_id") % 4 == F.col("outer_fold"), "test").when(F.col("subject_id") % 3 == F.col("inner_fold"), "validation").otherwise("train")
    roles = subjects.crossJoin(F.broadcast(folds)).select("outer_fold", "inner_fold", "subject_id", role.alias("role"))
    extra = subjects.where("subject_id < 5").select(F.lit(0).cast("bigint").alias("outer_fold"), F.lit(0).cast("bigint").alias("inner_fold"), "subject_id", F.lit("validation").alias("role"))
    return val.splits(w, roles.unionByName(extra), 5)


@query("""WITH g AS (SELECT user_id % 5 AS outer_fold, event_id % 4 AS inner_fold, event_type AS channel_name, round(avg(value), 6) AS m, round(stddev_pop(value), 6) AS s FROM events WHERE NOT (user_id % 5 = 1 AND event_type = 'error') GROUP BY ALL),
t AS (SELECT outer_fold, inner_fold, channel_name, CASE WHEN outer_fold = 2 AND inner_fold = 1 THEN CAST('nan' AS DOUBLE) ELSE m END AS mean, CASE WHEN outer_fold = 3 THEN 0.0 ELSE s END AS scale FROM g),
k AS (SELECT *, CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) AS f, CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) || '/' || channel_name AS k FROM t) """ + union(
    bad("complete", "error", "f", "n <> 5", "(SELECT f, count(*) AS n FROM k GROUP BY 1)"), bad("finite", "error", "k", "isnan(mean) OR isnan(scale)", "k"), bad("positive", "error", "k", "scale <= 0", "k"),
))
def val_scalers(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("NOT (user_id % 5 = 1 AND event_type = 'error')")
    keys = ["outer_fold", "inner_fold", "channel_name"]
    t = e.groupBy((F.col("user_id") % 5).alias("outer_fold"), (F.col("event_id") % 4).alias("inner_fold"), F.col("event_type").alias("channel_name")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("scale"))
    t = t.select(*keys, F.when((F.col("outer_fold") == 2) & (F.col("inner_fold") == 1), float("nan")).otherwise(F.col("mean")).alias("mean"), F.when(F.col("outer_fold") == 3, 0.0).otherwise(F.col("scale")).alias("scale"))
    return val.scalers(t, 5)


@query("""WITH p AS (SELECT CAST(event_id % 9000 AS VARCHAR) AS window_id, user_id % 5 AS outer_fold, value / 450 AS score, CASE WHEN user_id % 10 = 7 THEN 0.4 ELSE (user_id % 5) / 10 END AS threshold, CASE WHEN value / 450 >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM events), j AS (SELECT p.*, CASE WHEN outer_fold < 4 THEN outer_fold / 10 END AS t FROM p) """ + union(
    twice("unique_prediction", "p", "window_id"), bad("score_range", "error", "window_id", "NOT score BETWEEN 0 AND 1", "p"), bad("frozen_threshold", "error", "window_id", "threshold <> t", "j"), bad("label", "error", "window_id", "CAST(score >= threshold AS INTEGER) <> predicted_label", "p"),
))
def val_baseline(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    fold = F.col("user_id") % 5
    p = e.select((F.col("event_id") % 9000).cast("string").alias("window_id"), fold.alias("outer_fold"), (F.col("value") / 450).alias("score"), F.when(F.col("user_id") % 10 == 7, 0.4).otherwise(fold / 10).alias("threshold"), (F.col("value") / 450 >= 0.5).cast("int").alias("predicted_label"))
    frozen = spark.range(4).select(F.col("id").alias("outer_fold"), (F.col("id") / 10).alias("threshold"))
    return val.baseline(p, frozen)


# Sources.


def edf_files(spark, sf_dir):
    """(path, content): each embedding as an EDF file of two channels at 8 Hz, written and read
    in tasks; one file in ten is broken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [edf.encode(["EEG T8-P8", "T8-P8"] if i % 3 else ["fp1 - f7", "fp1 - f7"], [x * 1000, x * -1000], 8) for i, x in zip(b["vec_id"], (np.asarray(x, np.float64) for x in b["embedding"]))]
            data = [b"broken" if i % 10 == 9 else d for i, d in zip(b["vec_id"], data)]
            yield pd.DataFrame({"path": [f"/data/chb{i % 100:02d}/chb{i % 100:02d}_{i}.edf" for i in b["vec_id"]], "content": data})

    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "path string, content binary")


PATH = "'/data/chb' || lpad(CAST(vec_id % 100 AS VARCHAR), 2, '0') || '/chb' || lpad(CAST(vec_id % 100 AS VARCHAR), 2, '0') || '_' || CAST(vec_id AS VARCHAR) || '.edf'"
STEM = "'chb' || lpad(CAST(vec_id % 100 AS VARCHAR), 2, '0') || '_' || CAST(vec_id AS VARCHAR)"


@query(f"SELECT {PATH} AS relative_path, 'chb' || lpad(CAST(vec_id % 100 AS VARCHAR), 2, '0') AS patient_id, {STEM} AS recording_id, 8.0::DOUBLE AS sampling_rate_hz, 64 AS n_times, 8.0::DOUBLE AS duration_seconds, 2 AS n_channels, CASE WHEN vec_id % 3 > 0 THEN 'T8-P8|T8-P8' ELSE 'FP1-F7-0|FP1-F7-1' END AS ordered_signature, CASE WHEN vec_id % 3 > 0 THEN 'T8-P8' ELSE 'FP1-F7-0|FP1-F7-1' END AS unordered_signature, 768 + 2 * 2 * 64 AS file_size FROM embeddings WHERE vec_id % 10 <> 9")
def src_edf_headers(spark, sf_dir):
    return edf.headers_of(edf_files(spark, sf_dir))[0].drop("sha256")


@query(f"SELECT {STEM} AS recording_id, k AS channel_index, CASE WHEN vec_id % 3 > 0 THEN CASE k WHEN 0 THEN 'EEG T8-P8' ELSE 'T8-P8' END ELSE 'fp1 - f7-' || CAST(k AS VARCHAR) END AS original_name, CASE WHEN vec_id % 3 > 0 THEN 'T8-P8' ELSE 'FP1-F7-' || CAST(k AS VARCHAR) END AS normalized_name, CASE WHEN vec_id % 3 > 0 THEN 'T8-P8' ELSE 'FP1-F7' END AS base_name FROM embeddings, range(0, 2) AS r(k) WHERE vec_id % 10 <> 9")
def src_edf_channels(spark, sf_dir):
    return edf.headers_of(edf_files(spark, sf_dir))[1].drop("relative_path")


@query(f"SELECT {PATH} AS item, 'ValueError' AS error_type FROM embeddings WHERE vec_id % 10 = 9")
def src_edf_failures(spark, sf_dir):
    return edf.signals_of(edf_files(spark, sf_dir))[1].select("item", "error_type")


@query(f"WITH {ROWS}, d AS (SELECT vec_id, i, round(x * 10000) / 10 AS v FROM x WHERE vec_id % 10 <> 9) SELECT {STEM} AS recording_id, k AS channel_index, CAST(floor(i / 24) AS BIGINT) AS block_index, 24 * CAST(floor(i / 24) AS BIGINT) AS start_sample, count(*) AS n, round(sum(CASE k WHEN 0 THEN v ELSE -v END), 2) AS total FROM d, range(0, 2) AS r(k) GROUP BY ALL")
def src_edf_signals(spark, sf_dir):
    blocks, _ = edf.signals_of(edf_files(spark, sf_dir), 3.0)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return blocks.select("recording_id", "channel_index", "block_index", "start_sample", F.size("samples").cast("bigint").alias("n"), F.round(total, 2).alias("total"))


@query("SELECT 'u' || CAST(user_id AS VARCHAR) AS item, 'odd' AS error_type, CAST(count(*) AS VARCHAR) AS error_message FROM events GROUP BY user_id HAVING count(*) % 2 = 1")
def snk_dead_letters(spark, sf_dir):
    n = F.count("*")
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg((n % 2 == 0).alias("ok"), F.lit("odd").alias("error_type"), n.cast("string").alias("error_message"))
    return split_failures(rows.withColumn("item", F.concat(F.lit("u"), "user_id")))[1]


@query("SELECT o_orderkey, o_orderpriority[1:1] AS first, CAST(o_custkey % 7 AS INTEGER) AS n FROM orders")
def jsn_round_trip(spark, sf_dir):
    """Records as JSON, and read back by a schema."""
    o = load(spark, sf_dir, "orders")
    text = F.to_json(F.struct(F.array(F.substring("o_orderpriority", 1, 1), F.lit("x")).alias("names"), (F.col("o_custkey") % 7).alias("n")))
    back = o.select("o_orderkey", F.from_json(text, "names array<string>, n int").alias("j"))
    return back.select("o_orderkey", F.col("j.names")[0].alias("first"), "j.n")


# Channels, annotations, preprocessing.


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'left_only' ELSE 'matched' END AS status, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 5 END AS rate, o_orderkey % 6 AS dur, CASE o_orderkey % 8 WHEN 1 THEN 'unreadable_edf' WHEN 2 THEN 'fine' END AS decision FROM orders),
c AS (SELECT l_orderkey, bool_or(l_quantity > 45) AS complete FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, coalesce(status = 'matched', FALSE) AS a, coalesce(rate > 0, FALSE) AS b, coalesce(dur > 0, FALSE) AS c, coalesce(complete, FALSE) AS d, NOT coalesce(decision IN ('confirmed_unusable_recording', 'unreadable_edf', 'all_target_channels_invalid'), FALSE) AS m FROM f LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderkey AS recording_id, a AND b AND c AND d AND m AS include, coalesce(nullif(concat_ws('|', CASE WHEN NOT a THEN 'metadata_not_matched' END, CASE WHEN NOT b THEN 'invalid_sampling_rate' END, CASE WHEN NOT c THEN 'invalid_duration' END, CASE WHEN NOT d THEN 'missing_target_channels' END, CASE WHEN NOT m THEN 'manual_exclusion' END), ''), 'included') AS reason FROM j""")
def chn_inclusion(spark, sf_dir):
    k = F.col("o_orderkey")
    files = load(spark, sf_dir, "orders").select(k.alias("recording_id"), F.when(k % 4 == 0, "left_only").otherwise("matched").alias("status"), F.when(k % 9 > 0, k % 5).alias("sampling_rate_hz"), (k % 6).alias("duration_seconds"), F.when(k % 8 == 1, "unreadable_edf").when(k % 8 == 2, "fine").alias("manual_decision"))
    covered = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("recording_id")).agg(F.bool_or(F.col("l_quantity") > 45).alias("complete")).withColumn("channel_set", F.lit("primary_17"))
    return ch.inclusion(files, covered).select("recording_id", "include", "reason")


RULES = [(1, "BRAND#11", "B-11", "validated", None), (2, "BRAND#11", "SECOND", "validated", None), (3, "BRAND#12", "B-12", "unverified", None), (4, "BRAND#13", "B-13", "verified", "7"), (5, "BRAND#14", "B-11", "verified", None)]
CANONICAL = """n AS (SELECT CAST(l_orderkey % 10 AS VARCHAR) AS g, CAST(l_orderkey AS VARCHAR) AS recording_id, l_linenumber AS channel_index, p_brand AS original_name, upper(p_brand) AS normalized_name FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT *, CASE normalized_name WHEN 'BRAND#11' THEN 'B-11' WHEN 'BRAND#14' THEN 'B-11' WHEN 'BRAND#13' THEN CASE WHEN recording_id = '7' THEN 'B-13' END END AS alias FROM n)"""


def canonical(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_order int, normalized_name string, canonical_name string, validation_status string, recording_id string")
    rows = su.channel_rows(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("recording_id"), F.col("l_linenumber").alias("channel_index"), F.col("p_brand").alias("original_name"))
    return ch.canonicalize(rows, rules)


@query(f"WITH {CANONICAL} SELECT DISTINCT recording_id, channel_index, original_name, normalized_name, coalesce(alias, normalized_name) AS canonical_name, CASE WHEN alias IS NULL THEN 'none' ELSE 'applied' END AS alias_status FROM a QUALIFY row_number() OVER (PARTITION BY recording_id, channel_index) = 1 AND count(*) OVER (PARTITION BY recording_id, channel_index) = 1")
def chn_canonicalize(spark, sf_dir):
    once = su.channel_rows(spark, sf_dir).groupBy(F.col("l_orderkey").cast("string").alias("recording_id"), F.col("l_linenumber").alias("channel_index")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return canonical(spark, sf_dir).join(once, ["recording_id", "channel_index"], "left_semi")


@query(f"WITH {CANONICAL}, o AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY recording_id, channel_index) = 1) SELECT recording_id AS item, 'duplicate_channel' AS error_type, coalesce(alias, normalized_name) AS error_message FROM o GROUP BY ALL HAVING count(*) > 1")
def chn_duplicate_canonicals(spark, sf_dir):
    return ch.duplicate_canonicals(chn_canonicalize(spark, sf_dir))


TARGET = ["Brand#12", "Brand#31", "Brand#11"]
TARGETS = "t AS (SELECT unnest(['Brand#12', 'Brand#31', 'Brand#11']) AS channel_name, unnest([0, 1, 2]) AS target_index), b AS (SELECT l_orderkey AS recording_id, p_brand AS channel_name, l_linenumber AS block_index FROM lineitem JOIN part ON p_partkey = l_partkey)"


def brand_blocks(spark, sf_dir):
    return su.channel_rows(spark, sf_dir).select(F.col("l_orderkey").alias("recording_id"), F.col("p_brand").alias("channel_name"), F.col("l_linenumber").alias("block_index"))


@query(f"WITH {TARGETS} SELECT recording_id, channel_name, block_index, target_index FROM b JOIN t USING (channel_name)")
def chn_harmonize(spark, sf_dir):
    return ch.reorder(brand_blocks(spark, sf_dir), TARGET).select("recording_id", "channel_name", "block_index", "target_index")


@query(f"WITH {TARGETS}, g AS (SELECT recording_id, t.channel_name FROM (SELECT DISTINCT recording_id FROM b), t EXCEPT SELECT recording_id, channel_name FROM b) SELECT recording_id AS item, 'missing_channel' AS error_type, string_agg(channel_name, '|' ORDER BY channel_name) AS error_message FROM g GROUP BY 1")
def chn_missing_targets(spark, sf_dir):
    return ch.missing_targets(brand_blocks(spark, sf_dir), TARGET)


@query("WITH n AS (SELECT l_orderkey, count(*) AS n_channels FROM lineitem GROUP BY 1), m AS (SELECT min(n_channels) AS lo, max(n_channels) AS hi FROM n) SELECT l_orderkey, n_channels, CASE WHEN n_channels = lo THEN 'fewest' ELSE 'most' END AS extreme FROM n, m WHERE n_channels IN (lo, hi)")
def chn_extreme_files(spark, sf_dir):
    return ch.extreme_files(load(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""WITH c AS (SELECT o_custkey AS f, o_orderpriority AS p, o_orderkey AS i FROM orders), s AS (SELECT f, string_agg(p, '|' ORDER BY i) AS o, string_agg(DISTINCT p, '|' ORDER BY p) AS u FROM c GROUP BY 1)
SELECT u AS unordered_signature, count(DISTINCT o) AS n_orders, count(*) AS n_files FROM s GROUP BY 1 HAVING count(DISTINCT o) > 1""")
def chn_orders(spark, sf_dir):
    return ch.channel_orders(rel.signatures(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey"))


@query("""WITH h AS (SELECT l_orderkey, list(DISTINCT p_brand) AS have FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), t AS (SELECT unnest(['a', 'b']) AS channel_set, unnest([['Brand#11', 'Brand#12'], ['Brand#31', 'Brand#32', 'Brand#33']]) AS target)
SELECT channel_set, array_to_string(list_sort(list_filter(target, lambda x: NOT list_contains(have, x))), '|') AS missing, count(*) AS n_files FROM h, t WHERE len(list_filter(target, lambda x: NOT list_contains(have, x))) > 0 GROUP BY ALL""")
def chn_missing_patterns(spark, sf_dir):
    sets = ch.channel_sets(spark, {"a": ["Brand#11", "Brand#12"], "b": ["Brand#31", "Brand#32", "Brand#33"]})
    return ch.missing_patterns(ch.coverage(su.channel_rows(spark, sf_dir), sets, "l_orderkey", "p_brand"))


@query(f"""WITH {ROWS}, p AS (SELECT label, x AS a, CASE WHEN label % 3 = 0 THEN x WHEN label % 3 = 1 THEN x + 1e-13 ELSE x * (1 + i % 2) END AS b FROM x)
SELECT label, bool_and(a = b) AS identical, bool_and(abs(a - b) <= 1e-12 + 1e-7 * abs(b)) AS all_close, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 8) AS pearson, round(max(abs(a - b)), 8) AS max_abs_difference, round(sqrt(avg((a - b) * (a - b))), 8) AS rms_difference FROM p GROUP BY 1""")
def sig_duplicate_channels(spark, sf_dir):
    b = F.when(F.col("label") % 3 == 0, F.col("x")).when(F.col("label") % 3 == 1, F.col("x") + 1e-13).otherwise(F.col("x") * (1 + F.col("i") % 2))
    out = ch.duplicate_comparison(su.samples(spark, sf_dir).withColumn("b", b), ["label"], "x", "b")
    return rounded(out, ["pearson", "max_abs_difference", "rms_difference"], 8)


@query(f"WITH {FLAG_SQL}, l AS (SELECT *, CASE WHEN l_quantity < 10 THEN 'ictal' WHEN l_quantity < 20 THEN 'boundary' ELSE 'non_ictal' END AS lab FROM fl) SELECT lab AS annotation_label, round(median(l_quantity), 9) AS rms_uv, round(median(sd), 9) AS std_uv, round(median(pp), 9) AS peak_to_peak_uv, round(median(ln), 9) AS line_noise_ratio FROM l GROUP BY 1")
def qc_medians_by_label(spark, sf_dir):
    names = ["rms_uv", "std_uv", "peak_to_peak_uv", "line_noise_ratio"]
    return rounded(qc.medians_by_label(flag_rows(spark, sf_dir), names), names, 9)


@query(ORACLES["qc_medians_by_label"])
def qc_medians_narrowed(spark, sf_dir):
    names = ["rms_uv", "std_uv", "peak_to_peak_uv", "line_noise_ratio"]
    return rounded(qc.medians_by_label(flag_rows(spark, sf_dir), names, few=200), names, 9)


@query(f"WITH {FLAG_SQL} SELECT recording_id, channel_name, CASE WHEN l_quantity < 10 THEN 'ictal' WHEN l_quantity < 20 THEN 'boundary' ELSE 'non_ictal' END AS annotation_label, count(*) AS n FROM fl WHERE flag_count > 0 GROUP BY ALL")
def qc_review_worklist(spark, sf_dir):
    return qc.review_worklist(qc.add_flags(flag_rows(spark, sf_dir)))


DFT = f"""{ROWS}, sg AS (SELECT vec_id, g, i - 16 * g AS j, x - avg(x) OVER (PARTITION BY vec_id, g) AS y, 0.5 - 0.5 * cos(2 * pi() * (i - 16 * g) / 32) AS w FROM x, range(0, 3) AS s(g) WHERE i >= 16 * g AND i < 16 * g + 32),
ft AS (SELECT vec_id, g, k, sum(w * y * cos(2 * pi() * k * j / 32)) AS re, sum(w * y * sin(2 * pi() * k * j / 32)) AS im, sum(w * w) AS ww FROM sg, range(0, 17) AS f(k) GROUP BY ALL),
pw AS (SELECT vec_id, k, median((re * re + im * im) / (8.0 * ww) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) / (1 + 1 / 3.0 - 1 / 2.0) AS p FROM ft GROUP BY ALL)"""


@query(f"""WITH {DFT}, b AS (SELECT vec_id, k, p, lead(p) OVER (PARTITION BY vec_id ORDER BY k) AS q, p / sum(p) OVER (PARTITION BY vec_id) AS s FROM pw WHERE k >= 2)
SELECT CAST(vec_id AS VARCHAR) AS recording_id, 0 AS chunk_index, round(sum(0.25 * (p + q) / 2), 9) AS total_power, CAST(NULL AS DOUBLE) AS line_power, CAST(NULL AS DOUBLE) AS high_frequency_power, round(-sum(s * ln(s)) / ln(15), 9) AS spectral_entropy FROM b GROUP BY vec_id""")
def qc_spectral(spark, sf_dir):
    """Of a signal at 8 Hz the bands around 60 Hz and above 40 Hz are empty."""
    out = qc.chunk_quality(signal_blocks(spark, sf_dir), "block_index")
    return rounded(out.select("recording_id", "chunk_index", "total_power", "line_power", "high_frequency_power", "spectral_entropy"), ["total_power", "spectral_entropy"], 9)


@query(f"WITH {DFT} SELECT CAST(vec_id AS VARCHAR) AS recording_id, k * 0.25 AS frequency_hz, round(10 * log10(p), 6) AS before_db, round(10 * log10(p) + 20 * log10(2), 6) AS after_db, round(20 * log10(2), 6) AS change_db FROM pw WHERE k >= 1")
def qc_spectrum_change(spark, sf_dir):
    """A signal against itself, twice as large."""
    blocks = signal_blocks(spark, sf_dir)
    louder = blocks.withColumn("samples", F.transform("samples", lambda x: x * F.lit(2.0).cast("float")))
    out = qc.spectrum_change(blocks, louder, low=0.1, high=100.0).drop("channel_index")
    return rounded(out, ["before_db", "after_db", "change_db"], 6)


TAPS = """tp AS (SELECT k, k - 82 AS m, (CASE WHEN k = 82 THEN 2 * 22.5 / 100 - 2 * 4.0 / 100 ELSE sin(pi() * 2 * 22.5 / 100 * (k - 82)) / (pi() * (k - 82)) - sin(pi() * 2 * 4.0 / 100 * (k - 82)) / (pi() * (k - 82)) END) * (0.54 - 0.46 * cos(2 * pi() * k / 164)) AS h FROM range(0, 165) AS r(k)),
sc AS (SELECT sqrt(pow(sum(h * cos(2 * pi() * 10 / 100 * m)), 2) + pow(sum(h * sin(2 * pi() * 10 / 100 * m)), 2)) AS s FROM tp)"""


@query(f"""WITH {ROWS}, {TAPS}, ex AS (SELECT vec_id, unnest(range(-82, 146)) AS a, list(x ORDER BY i) AS v FROM x GROUP BY 1),
pad AS (SELECT vec_id, a, CASE WHEN a < 0 THEN 2 * v[1] - v[1 + least(-a, 63)] WHEN a > 63 THEN 2 * v[64] - v[64 - least(a - 63, 63)] ELSE v[a + 1] END AS x FROM ex),
y AS (SELECT vec_id, a + m AS i, sum(x * h / s) AS y FROM pad, tp, sc WHERE a + m BETWEEN 0 AND 63 GROUP BY ALL)
SELECT CAST(vec_id AS VARCHAR) AS recording_id, CAST(count(*) AS INTEGER) AS n, round(max(y), 4) AS top, round(sum(y * y), 3) AS energy FROM y GROUP BY vec_id""")
def pre_bandpass(spark, sf_dir):
    """5 to 20 Hz of signals at 100 Hz: 165 taps, longer than a signal."""
    out = pp.band_pass(signal_blocks(spark, sf_dir, 100.0), 5.0, 20.0)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.select("recording_id", F.size("samples").alias("n"), F.round(F.array_max("samples").cast("double"), 4).alias("top"), F.round(energy, 3).alias("energy"))


@query(f"""WITH a AS (SELECT CAST(vec_id AS VARCHAR) AS recording_id, vec_id % 4 AS n FROM embeddings)
SELECT recording_id, 1 AS before_channels, 1.0::DOUBLE AS after_channels, 8.0::DOUBLE AS before_rate, 8.0::DOUBLE AS after_rate, 8.0::DOUBLE AS before_seconds, 8.0::DOUBLE AS after_seconds, n AS before_annotations, CASE WHEN n > 1 THEN n - 1 ELSE 0 END AS after_annotations, 1.0::DOUBLE AS finite, 1 AS target_channels FROM a WHERE CAST(recording_id AS BIGINT) % 5 > 0
UNION ALL SELECT recording_id, 1, NULL, 8.0, NULL, 8.0, NULL, n, CASE WHEN n > 1 THEN n - 1 ELSE 0 END, NULL, 1 FROM a WHERE CAST(recording_id AS BIGINT) % 5 = 0""")
def pre_rows(spark, sf_dir):
    """Recordings before and after a step that loses one in five, and an annotation."""
    blocks = signal_blocks(spark, sf_dir)
    number = F.col("recording_id").cast("bigint")
    notes = blocks.select("recording_id", F.explode(F.sequence(F.lit(0), (number % 4).cast("int"))).alias("k")).where("k > 0")
    return pp.preprocessing_rows(blocks, blocks.where(number % 5 > 0), notes, notes.where("k > 1"), 1).withColumns({c: F.col(c).cast("double") for c in ("finite", "after_channels")})


@query(f"WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS recording_id, round(s / 1000000.0, 6) AS onset, round((t - s) / 1000000.0, 6) AS duration, 'seizure' AS description FROM iv")
def pre_annotations(spark, sf_dir):
    i = su.error_intervals(spark, sf_dir)
    return rounded(pp.seizure_annotations(i.select(F.concat_ws("_", "user_id", "day").alias("recording_id"), (F.col("start") / 1_000_000).alias("onset_seconds"), (F.col("end") / 1_000_000).alias("offset_seconds"))), ["onset", "duration"])


def notes(spark, sf_dir, bound: int):
    """Annotations at whole seconds of the events below a value."""
    e = su.events(spark, sf_dir).where(F.col("value") < bound)
    return e.select(F.col("user_id").cast("string").alias("recording_id"), F.floor("value").cast("double").alias("onset"), (F.col("event_id") % 3 + 1).cast("double").alias("duration"), F.col("event_type").alias("description"))


NOTES = "n AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, floor(value) AS onset, CAST(event_id % 3 + 1 AS DOUBLE) AS duration, event_type AS description, value FROM events)"


@query(f"WITH {NOTES} SELECT recording_id, onset, duration, description FROM n WHERE value < 60 UNION ALL SELECT recording_id, onset, duration, description FROM n WHERE value < 120 AND NOT EXISTS (SELECT 1 FROM n o WHERE o.value < 60 AND o.recording_id = n.recording_id AND o.onset = n.onset AND o.duration = n.duration AND o.description = n.description)")
def pre_append(spark, sf_dir):
    return pp.append_annotations(notes(spark, sf_dir, 60), notes(spark, sf_dir, 120))


@query(f"WITH {NOTES} SELECT recording_id, onset, duration, description FROM n WHERE value < 120 AND onset + duration > CAST(recording_id AS BIGINT) % 130 + 1e-6")
def pre_uncontained(spark, sf_dir):
    recordings = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), (F.col("user_id") % 130).alias("duration_seconds")).distinct()
    return pp.uncontained_annotations(notes(spark, sf_dir, 120), recordings).select("recording_id", "onset", "duration", "description")


def short_windows(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    blocks = e.select(F.col("vec_id").cast("string").alias("recording_id"), F.lit(0).alias("channel_index"), F.lit("x").alias("channel_name"), F.posexplode(F.array(*[F.slice("embedding", 24 * i + 1, 24) for i in range(3)])).alias("block_index", "samples"))
    blocks = blocks.withColumn("block_index", F.col("block_index").cast("bigint")).withColumn("start_sample", F.col("block_index") * 24)
    windows = e.select(F.col("vec_id").cast("string").alias("recording_id"), F.explode(F.array(*[F.lit(k).cast("bigint") for k in (0, 20, 30, 48)])).alias("start_sample")).withColumn("stop_sample_exclusive", F.col("start_sample") + 16)
    return windows, blocks


@query("WITH w AS (SELECT vec_id, k AS start_sample, k + 16 AS stop_sample_exclusive FROM embeddings, (SELECT unnest([0, 20, 30, 48]) AS k)), x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(vec_id AS VARCHAR) AS recording_id, start_sample, count(*) AS n, round(sum(x * (i - start_sample + 1)), 6) AS weighted FROM w JOIN x USING (vec_id) WHERE i >= start_sample AND i < stop_sample_exclusive GROUP BY ALL")
def acc_window_samples(spark, sf_dir):
    """Windows over blocks of 24 samples, most of which touch two."""
    windows, blocks = short_windows(spark, sf_dir)
    found = pp.window_samples(windows, blocks, 24)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("recording_id", "start_sample", F.size("samples").cast("bigint").alias("n"), F.round(weighted, 6).alias("weighted"))


@query(ORACLES["acc_window_samples"])
def acc_window_table(spark, sf_dir):
    """The same windows from a table whose blocks have a halo: no samples are shuffled."""
    windows, blocks = short_windows(spark, sf_dir)
    name = f"blocks_{uuid.uuid4().hex}"
    table = bt.write_block_table(blocks, name, 15, 8, f"{scratch_dir(spark)}/{name}")
    found = bt.read_windows(windows, table, 24)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("recording_id", "start_sample", F.size("samples").cast("bigint").alias("n"), F.round(weighted, 6).alias("weighted"))


# Intervals, moments, splits.


@query(f"WITH {EVENTS}, k AS (SELECT user_id, day, {su.DAY} - user_id % 5 * {su.MINUTE} AS n FROM rec) SELECT user_id, day, r AS window_index, r * {500 * su.MINUTE} AS window_start, least((r + 1) * {500 * su.MINUTE}, n) AS window_end FROM k, range(0, 3) AS g(r)")
def ivl_statistics_blocks(spark, sf_dir):
    r = su.recordings(spark, sf_dir).withColumn("n", F.col("n") - F.col("user_id") % 5 * su.MINUTE)
    return ivl.statistics_blocks(r, "n", 500 * su.MINUTE).select("user_id", "day", F.col("window_index").cast("bigint").alias("window_index"), "window_start", "window_end")


STATUS = """CASE WHEN len IS NULL THEN 'missing_metadata' WHEN NOT coalesce(a >= 0 AND b > a AND b <= len, FALSE) THEN 'invalid_time' WHEN floor(a * 8) < 0 OR ceil(b * 8) > floor(len * 8) OR ceil(b * 8) <= floor(a * 8) THEN 'invalid_sample' ELSE 'valid' END"""


@query(f"WITH z AS (SELECT event_id, value - 20 AS a, value - 20 + user_id % 9 AS b, CASE WHEN user_id % 11 > 0 THEN 400.06 END AS len FROM events) SELECT event_id, {STATUS} AS status FROM z")
def ivl_status(spark, sf_dir):
    u = F.col("user_id")
    z = load(spark, sf_dir, "events").select("event_id", (F.col("value") - 20).alias("a"), (F.col("value") - 20 + u % 9).alias("b"), F.when(u % 11 > 0, 400.06).alias("len"))
    return z.select("event_id", ivl.interval_status(z, "a", "b", "len", F.lit(8)).alias("status"))


@query(f"WITH {ROWS}, s AS (SELECT label, i, count(x) AS n FROM x GROUP BY ALL HAVING label <> 3 OR i < 60), r AS (SELECT unnest(range(0, 12)) AS k) SELECT k AS subject_id, CAST(count(n) AS BIGINT) AS n FROM r LEFT JOIN s ON label = k WHERE k % 4 <> 0 GROUP BY 1 HAVING count(n) < 64")
def stat_missing(spark, sf_dir):
    stats = mo.row_moments(su.samples(spark, sf_dir).where("label <> 3 OR i < 60"), ["label", "i"], "x").withColumnRenamed("label", "subject_id")
    roles = spark.range(12).select(F.col("id").cast("int").alias("subject_id"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("role"))
    return mo.missing_statistics(stats, roles, 64).select("subject_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {ROWS}, m AS (SELECT label, avg(x) AS m, CASE WHEN stddev_pop(x) >= 1e-6 THEN stddev_pop(x) ELSE 1 END AS s FROM x GROUP BY 1), z AS (SELECT label, (x - m) / s AS z FROM x JOIN m USING (label)) SELECT label, count(*) AS n, abs(round(avg(z), 6)) AS mean, round(avg(z * z) - avg(z) * avg(z), 6) AS variance FROM z GROUP BY 1")
def stat_check_scaled(spark, sf_dir):
    m = mo.with_deviation(mo.row_moments(su.samples(spark, sf_dir), ["label"], "x")).withColumn("scale", F.col("std"))
    scaled = mo.apply_scaler(load(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "samples"), m, ["label"], unit=1.0)
    out = mo.check_scaled(scaled, "label")
    return out.select("label", F.col("n").cast("bigint").alias("n"), F.abs(F.round("mean", 6)).alias("mean"), F.round("variance", 6).alias("variance"))


@query("""WITH c AS (SELECT DISTINCT 'chb' || lpad(CAST(user_id % 60 AS VARCHAR), 2, '0') AS case_id FROM events) SELECT case_id, CASE WHEN CAST(case_id[4:] AS INTEGER) % 3 = 0 AND CAST(case_id[4:] AS INTEGER) % 2 = 0 THEN 'pair_' || CAST(CAST(case_id[4:] AS INTEGER) // 6 AS VARCHAR) ELSE 'subject_' || case_id END AS subject_id,
CASE WHEN CAST(case_id[4:] AS INTEGER) % 6 = 0 THEN 'verified' ELSE 'default' END AS mapping_status FROM c""")
def spl_resolve_subjects(spark, sf_dir):
    cases = load(spark, sf_dir, "events").select(F.concat(F.lit("chb"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0")).alias("case_id"))
    n = F.col("id")
    mapping = spark.range(0, 60, 3).select(F.format_string("chb%02d", n).alias("case_id"), F.concat(F.lit("pair_"), F.floor(n / 6)).alias("subject_id"), F.when(n % 2 == 0, "verified").otherwise("unverified").alias("mapping_status"))
    return sp.resolve_subjects(cases, mapping)


@query(f"WITH {EVENTS}, {MERGED}, {LABELS} SELECT user_id, day, window_index, label_name <> 'boundary' AS train_eligible, label_name <> 'boundary' AND (label_name = 'ictal' OR nearest IS NULL OR nearest >= {su.NEAR}) AS clean_train_eligible FROM lab")
def spl_eligibility(spark, sf_dir):
    return sp.eligibility(su.labelled(spark, sf_dir)).select("user_id", "day", "window_index", "train_eligible", "clean_train_eligible")


@query(f"WITH {EVENTS}, {MERGED}, {LABELS} SELECT user_id, day, window_index FROM lab WHERE label_name <> 'boundary' AND user_id % 3 = 1")
def spl_select_role(spark, sf_dir):
    u = load(spark, sf_dir, "events").select("user_id").distinct()
    roles = u.select(F.lit(0).alias("outer_fold"), F.lit(1).alias("inner_fold"), "user_id", F.when(F.col("user_id") % 3 == 1, "validation").otherwise("train").alias("role"))
    return sp.select_role(su.labelled(spark, sf_dir), roles, 0, 1, "validation", "user_id").select("user_id", "day", "window_index")


@query()
def spl_fold_counts(spark, sf_dir):
    """The outer folds' own counts."""
    w = subject_windows(spark, sf_dir)
    return sp.fold_summary(w.where("binary_label IS NOT NULL"), sp.outer_folds(w), ["outer_fold"])


@query("WITH t AS (SELECT fold, score, label, round(0.1 * fold + 0.2, 9) AS threshold FROM s) SELECT fold AS outer_fold, threshold, count(*) AS n, count_if(score >= threshold) AS n_predicted FROM t GROUP BY ALL".replace("WITH t", f"WITH {SCORES}, t"))
def eval_outer_predictions(spark, sf_dir):
    frozen = spark.range(5).select(F.col("id").alias("outer_fold"), F.round(0.1 * F.col("id") + 0.2, 9).alias("threshold"))
    out = ev.outer_predictions(su.scores(spark, sf_dir).withColumnRenamed("fold", "outer_fold"), frozen)
    return out.groupBy("outer_fold", "threshold").agg(F.count("*").alias("n"), F.sum("predicted_label").alias("n_predicted"))


def statistics_sql(column: str) -> str:
    parts = {"mean": "avg({c})", "std": "stddev_samp({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})"}
    return ", ".join(f"round({f.format(c=column)}, 9) AS {n}_{column}" for n, f in parts.items())


@query(f"WITH {RUNS} SELECT outer_fold, {statistics_sql('threshold')}, {statistics_sql('roc_auc')} FROM runs GROUP BY 1")
def eval_stability(spark, sf_dir):
    out = ev.stability(inner_runs(spark, sf_dir), "outer_fold", ["threshold", "roc_auc"])
    return rounded(out, [c for c in out.columns if c != "outer_fold"], 9)


@query(f"WITH {RUNS} SELECT inner_fold, round(avg(roc_auc), 9) AS mean_roc_auc, round(stddev_samp(roc_auc), 9) AS std_roc_auc, round(median(roc_auc), 9) AS median_roc_auc, round(quantile_cont(roc_auc, 0.25), 9) AS q25_roc_auc, round(quantile_cont(roc_auc, 0.75), 9) AS q75_roc_auc FROM runs GROUP BY 1")
def eval_fold_spread(spark, sf_dir):
    out = ev.spread_over_folds(inner_runs(spark, sf_dir), ["inner_fold"], ["roc_auc"])
    return rounded(out, [c for c in out.columns if c != "inner_fold"], 9)


@query(f"WITH {RUNS} SELECT outer_fold, round(max(CASE WHEN inner_fold = 1 THEN roc_auc END), 9) AS roc_auc_b, round(max(CASE WHEN inner_fold = 2 THEN roc_auc END), 9) AS roc_auc_c, round(max(CASE WHEN inner_fold = 1 THEN roc_auc END) - max(CASE WHEN inner_fold = 2 THEN roc_auc END), 9) AS roc_auc_difference FROM runs GROUP BY 1")
def agg_metric_difference(spark, sf_dir):
    runs = inner_runs(spark, sf_dir).withColumn("model", F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (F.col("inner_fold") + 1).cast("int")))
    return rounded(rel.metric_differences(runs, ["outer_fold"], "model", ["roc_auc"], "b", "c"), ["roc_auc_b", "roc_auc_c", "roc_auc_difference"], 9)


# Sampling.


@query("SELECT binary_label, count(*) AS n, round(sum(1 / CAST(c AS DOUBLE)), 6) AS total FROM (SELECT event_type = 'error' AS binary_label, count(*) OVER (PARTITION BY event_type = 'error') AS c FROM events) GROUP BY 1")
def imb_sample_weights(spark, sf_dir):
    e = load(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("binary_label"))
    return im.sample_weights(e).groupBy("binary_label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"))


@query("WITH b AS (SELECT *, CAST('0x' || md5('42/3/' || CAST(user_id AS VARCHAR) || '/' || CAST(CAST(floor(event_id / 64.0) AS BIGINT) AS VARCHAR))[1:8] AS BIGINT) / 4294967296.0 AS draw FROM events), t AS (SELECT count_if(event_type = 'error') AS p, count_if(event_type <> 'error') AS q FROM events) SELECT event_id FROM b, t WHERE event_type = 'error' OR draw < least(1.0, p * 2.0 / greatest(q, 1))")
def imb_epoch_negatives(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("binary_label", (F.col("event_type") == "error").cast("int"))
    return im.epoch_negatives(e, "user_id", "event_id", 3, 2.0, block=64).select("event_id")


@query(f"WITH p AS (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY {DRAW}, event_id LIMIT 30), q AS (SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY {DRAW}, event_id LIMIT 30) SELECT event_id, 1 AS binary_label FROM p UNION ALL SELECT event_id, 0 FROM q")
def imb_balanced_subset(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("binary_label"))
    return im.balanced_subset(e, "event_id", 60)


@query()
def imb_resampled(spark, sf_dir):
    """Draws with replacement, by inverse class frequency."""
    e = load(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("binary_label"))
    return im.resampled(im.sample_weights(e), "weight", 5000, "event_id").select("event_id", "binary_label", "copies")


# Projections, joins and scalars.


@query("SELECT o_orderstatus, round(count_if(o_totalprice > 100000) / count(*) * 100, 2) AS percent_large FROM orders GROUP BY 1")
def prj_percent(spark, sf_dir):
    part = F.count_if(F.col("o_totalprice") > 100_000) / F.count("*")
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(sc.percent(part).alias("percent_large"))


@query("WITH g AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, min(value) AS least, max(value) AS most FROM events WHERE event_type IN ('click', 'error') GROUP BY 1), u AS (UNPIVOT g ON n, least, most INTO NAME measure VALUE v) SELECT measure, max(CASE WHEN event_type = 'click' THEN v END) AS click, max(CASE WHEN event_type = 'error' THEN v END) AS error FROM u GROUP BY 1")
def prj_transpose(spark, sf_dir):
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return rel.transposed(g, "event_type", ["n", "least", "most"], ["click", "error"])


@query("SELECT n_nationkey AS \"key\", n_name AS \"name\" FROM nation")
def prj_rename(spark, sf_dir):
    return rel.renamed(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"n_nationkey": "key", "n_name": "name", "absent": "other"})


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def join_exactly_one(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return checks.exactly_one(checks.exactly_one(o, c, ["c_custkey"]), load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("o_orderkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 5 AND 20 AS inside, abs(l_tax - l_discount) <= 0.01 + 0.1 * abs(l_discount) AS near, least(greatest(l_quantity, 10.0), 30.0) AS clipped, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 6) AS log, 42 + 100 * (l_orderkey % 5) + l_linenumber AS seed FROM lineitem")
def mth_scalars(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").between(5, 20).alias("inside"), sc.close(F.col("l_tax"), F.col("l_discount"), 0.1, 0.01).alias("near"), sc.clip(F.col("l_quantity"), 10.0, 30.0).alias("clipped"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.round(F.ln("l_extendedprice"), 6).alias("log"),
        sc.fold_seed(F.col("l_orderkey") % 5, F.col("l_linenumber")).alias("seed"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'chb' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') WHEN doc_id % 3 = 1 THEN 'chb07' END AS case_id, CASE WHEN doc_id % 3 = 0 THEN 'file.v1' WHEN doc_id % 3 = 1 THEN 'CHB07_x' ELSE 'plain' END AS stem, CASE WHEN doc_id % 2 = 0 THEN 'chb' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') END AS valid, 'chb01__r__sz' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || CAST(doc_id AS VARCHAR) AS seizure FROM documents")
def str_paths_and_ids(spark, sf_dir):
    d = F.col("doc_id")
    two = F.lpad((d % 100).cast("string"), 2, "0")
    path = F.when(d % 3 == 0, F.concat(F.lit("/data/chb"), two, F.lit("/file.v1.edf"))).when(d % 3 == 1, F.lit("/data/other/CHB07_x.edf")).otherwise(F.lit("/data/other/plain.edf"))
    given = F.when(d % 2 == 0, F.concat(F.lit("  CHB"), two, F.lit(" "))).otherwise(F.concat(F.lit("chb"), two, F.lit("a")))
    return load(spark, sf_dir, "documents").select("doc_id", sc.case_id(path).alias("case_id"), sc.path_stem(path).alias("stem"), sc.valid_case_id(given).alias("valid"), sc.seizure_id(F.lit("chb01"), F.lit("r"), d).alias("seizure"))


@query("WITH n AS (SELECT l_orderkey, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT l_orderkey, coalesce(string_agg(CASE WHEN n > 1 THEN p_brand END, '|' ORDER BY p_brand), '') AS repeated FROM n GROUP BY 1")
def str_repeated_names(spark, sf_dir):
    return su.channel_rows(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(sc.repeated_names(F.collect_list("p_brand")), "|").alias("repeated"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents WHERE source IS NOT NULL")
def srt_contiguous(spark, sf_dir):
    """Rows of a source in order, numbered as they lie."""
    laid = rel.contiguous(load(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source"), "source", ["doc_id"])
    return laid.select("doc_id", "source", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("position"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND vec_id % 7 > 0 AS finite FROM embeddings")
def flt_finite(spark, sf_dir):
    v = F.when(F.col("vec_id") % 7 > 0, F.col("embedding")).otherwise(F.array_append("embedding", F.lit(float("nan")).cast("float")))
    return load(spark, sf_dir, "embeddings").select("vec_id", sc.all_finite(v).alias("finite"))


@query()
def mdl_epochs(spark, sf_dir):
    """Scores of a model that was trained by epochs on three of five parts and stopped by a
    fourth."""
    e = load(spark, sf_dir, "embeddings").withColumn("binary_label", (F.col("label") % 3 == 0).cast("int"))
    part = F.col("vec_id") % 5
    state = tr.train(e.where(part < 3), e.where(part == 3), "vec_id", "embedding", tr.Settings(epochs=4, steps=2, patience=2))
    return e.select("vec_id", tr.score(state.best, "embedding").alias("score"), F.lit(state.best_epoch).alias("best_epoch"))

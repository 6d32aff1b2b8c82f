"""Registered queries of the validators' further rules, on data that breaks each, with their
DuckDB SQL.  Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as val
from ..sources.tables import load
from . import surrogates as su
from .audits import bad, twice, union
from .queries import EVENTS, LABELS, MERGED, query

META = f"""{EVENTS}, r AS (SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(day AS VARCHAR) AS recording_id, user_id % 50 || '/' || CAST(day AS VARCHAR) AS relative_path FROM rec),
z AS (SELECT CAST(user_id AS VARCHAR) AS case_id, CAST(CASE WHEN event_id % 9 = 0 THEN -day ELSE day END AS VARCHAR) AS recording_id, event_id FROM iv)"""


@query(f"WITH {META} " + union(twice("unique_recording_path", "r", "relative_path"), bad("seizure_recording", "error", "case_id || '/' || recording_id", "TRUE", "(SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = z.case_id AND r.recording_id = z.recording_id))")))
def val_metadata_paths(spark, sf_dir):
    """Paths that two recordings have, and seizures of recordings that are not there."""
    case, recording = F.col("user_id").cast("string").alias("case_id"), F.col("day").cast("string").alias("recording_id")
    counted = su.recordings(spark, sf_dir).select(case, recording, F.concat_ws("/", (F.col("user_id") % 50).cast("string"), F.col("day").cast("string")).alias("relative_path"))
    day = F.when(F.col("event_id") % 9 == 0, -F.col("day")).otherwise(F.col("day")).cast("string")
    # Seizures a millisecond apart, so that nothing else is wrong.
    seizures = su.error_intervals(spark, sf_dir).select(case, day.alias("recording_id"), F.col("event_id").alias("seizure_index"), F.col("event_id").alias("onset_seconds"), (F.col("event_id") + 0.5).alias("offset_seconds"))
    known = seizures.groupBy("case_id", "recording_id").agg(F.count("*").alias("n_seizures"))
    recordings = counted.join(known, ["case_id", "recording_id"], "left").select("*", F.lit("matched").alias("status"), F.lit(None).cast("double").alias("clock_seconds"), F.lit(86_400.0).alias("duration_seconds")).fillna(0, ["n_seizures"])
    return val.metadata(recordings, seizures)


@query("""WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 3 AS k FROM lineitem), p AS (SELECT id FROM m WHERE id % 11 > 0 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 13 = 0) """ + union(
    bad("channel_order", "error", "id", "k = 0", "m", "CASE WHEN k = 0 THEN 'O2,Fz,C3' ELSE 'Fz,C3,O2' END"), bad("lost_output", "error", "id", "TRUE", "(SELECT DISTINCT id FROM p WHERE id NOT IN (SELECT id FROM m))"), bad("unplanned_output", "error", "id", "TRUE", "(SELECT DISTINCT id FROM m WHERE id NOT IN (SELECT id FROM p))"),
))
def val_preprocessing_whole(spark, sf_dir):
    """Outputs in another channel order, lost, and never planned."""
    li = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("recording_id"), (F.col("l_suppkey") % 3 == 0).alias("turned"))
    right, wrong = F.array(*map(F.lit, ("Fz", "C3", "O2"))), F.array(*map(F.lit, ("O2", "Fz", "C3")))
    same = {f"{side}_{c}": F.lit(v) for side in ("before", "after") for c, v in (("rate", 8.0), ("seconds", 10.0), ("annotations", 2))}
    manifest = li.select("recording_id", F.lit(3).alias("after_channels"), F.lit(3).alias("target_channels"), F.lit(True).alias("finite"), F.when(F.col("turned"), wrong).otherwise(right).alias("after_names"), right.alias("target_names"), *[c.alias(n) for n, c in same.items()])
    planned = li.select("recording_id").where("recording_id % 11 > 0").unionByName(load(spark, sf_dir, "orders").where("o_orderkey % 13 = 0").select((-F.col("o_orderkey")).alias("recording_id")))
    return val.preprocessing(manifest, planned)


WHOLE = f"""{EVENTS}, {MERGED}, {LABELS}, m AS (SELECT *, 'w' || CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) || '_' || CAST(window_index AS VARCHAR) AS window_id, CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS recording_id FROM lab),
sums AS (SELECT CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS recording_id, CASE WHEN user_id % 5 = 0 THEN 10 ELSE 11 END AS n_windows FROM rec WHERE user_id % 17 <> 1 UNION ALL SELECT 'ghost_' || CAST(user_id AS VARCHAR), 3 FROM rec WHERE user_id % 17 = 1 GROUP BY 1),
j AS (SELECT coalesce(s.recording_id, c.recording_id) AS recording_id, n_windows, coalesce(n, 0) AS n FROM sums s FULL JOIN (SELECT recording_id, count(*) AS n FROM m GROUP BY 1) c ON s.recording_id = c.recording_id),
z AS (SELECT user_id, day, event_id, s + (CASE WHEN event_id % 23 = 0 THEN {su.DAY} ELSE 0 END) AS s, t + (CASE WHEN event_id % 23 = 0 THEN {su.DAY} ELSE 0 END) AS t FROM iv),
cov AS (SELECT z.event_id, count(lab.window_start) AS o, count_if(label_name = 'ictal') AS i FROM z LEFT JOIN lab ON z.user_id = lab.user_id AND z.day = lab.day AND lab.window_start < z.t AND lab.window_end > z.s GROUP BY 1)"""


@query(f"WITH {WHOLE} " + union(
    bad("rate", "error", "window_id", "user_id % 11 = 1", "m"), bad("summary", "error", "recording_id", "n <> n_windows", "j", "n"), bad("uncovered_seizure", "error", "event_id", "o = 0", "cov"), bad("no_ictal_window", "warning", "event_id", "i = 0", "cov"),
    bad("load_length", "error", "vec_id", "label % 4 = 0", "embeddings", "60"), bad("load_finite", "error", "vec_id", "vec_id % 50 = 7", "embeddings"),
))
def val_windows_whole(spark, sf_dir):
    """Windows against rates, summaries, seizures and their signals."""
    recording = F.concat_ws("_", "user_id", "day")
    w = su.labelled(spark, sf_dir)
    binary = F.when(F.col("label_name") == "non_ictal", 0).when(F.col("label_name") == "ictal", 1)
    manifest = w.select(
        F.concat(F.lit("w"), F.concat_ws("_", "user_id", "day", "window_index")).alias("window_id"), recording.alias("recording_id"), "window_index", F.col("window_start").alias("start_sample"), F.col("window_end").alias("stop_sample_exclusive"), "label_name", binary.alias("binary_label"), "overlap",
        F.when(F.col("user_id") % 11 == 1, 4.0).otherwise(8.0).alias("sampling_rate_hz"),
    )
    recs = su.recordings(spark, sf_dir)
    ghosts = recs.where("user_id % 17 = 1").select(F.concat(F.lit("ghost_"), F.col("user_id")).alias("recording_id"), F.lit(3).alias("n_windows")).distinct()
    summaries = recs.where("user_id % 17 <> 1").select(recording.alias("recording_id"), F.when(F.col("user_id") % 5 == 0, 10).otherwise(11).alias("n_windows")).unionByName(ghosts)
    shift = F.when(F.col("event_id") % 23 == 0, su.DAY).otherwise(0)
    seizures = su.error_intervals(spark, sf_dir).select(recording.alias("recording_id"), F.col("event_id").alias("seizure_id"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    x = F.when(F.col("vec_id") % 50 == 7, F.transform("embedding", lambda v: v * float("nan"))).otherwise(F.col("embedding"))
    loaded = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("window_id"), F.when(F.col("label") % 4 == 0, F.slice(x, 1, 60)).otherwise(x).alias("samples"))
    return val.windows(manifest, recs.select(recording.alias("recording_id"), F.col("n").alias("n_times")), su.WINDOW, su.STRIDE, 8.0, summaries, seizures, loaded, 64)


ROLES = """w AS (SELECT user_id % 40 AS subject_id, user_id % 40 % 4 AS own FROM events GROUP BY ALL), f AS (SELECT o.k AS outer_fold, i.k AS inner_fold FROM range(0, 4) AS o(k), range(0, 3) AS i(k)),
r AS (SELECT outer_fold, inner_fold, subject_id, CASE WHEN own = outer_fold OR (subject_id = 8 AND outer_fold = 1) THEN 'test' WHEN subject_id // 4 % 3 = inner_fold THEN 'validation' ELSE 'train' END AS role FROM w, f WHERE NOT (subject_id = 7 AND outer_fold = 1 AND inner_fold = 2) UNION ALL SELECT 0, 0, 99, 'train'),
x AS (SELECT outer_fold, inner_fold, subject_id, own, role, CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) || '/' || CAST(subject_id AS VARCHAR) AS k FROM (SELECT * FROM w, f) FULL JOIN r USING (outer_fold, inner_fold, subject_id)),
c AS (SELECT DISTINCT 'c' || CAST(user_id % 40 AS VARCHAR) AS case_id, CASE WHEN user_id % 40 = 21 THEN 1 ELSE user_id % 40 END AS subject_id FROM events),
p AS (SELECT pair, count(DISTINCT subject_id) AS s, count(DISTINCT c.case_id) AS n FROM (VALUES ('c1+c21', 'c1'), ('c1+c21', 'c21'), ('c2+c22', 'c2'), ('c2+c22', 'c22'), ('c3+c99', 'c3'), ('c3+c99', 'c99')) AS v(pair, case_id) LEFT JOIN c USING (case_id) GROUP BY 1)"""


@query(f"WITH {ROLES} " + union(
    bad("validated_once", "error", "k", "n <> 1", "(SELECT CAST(outer_fold AS VARCHAR) || '/' || CAST(subject_id AS VARCHAR) AS k, count_if(role = 'validation') AS n FROM r WHERE role <> 'test' GROUP BY outer_fold, subject_id)"),
    bad("test_subjects", "error", "k", "own IS NOT NULL AND (coalesce(role, '') = 'test') <> (own = outer_fold)", "x"), bad("exact_partition", "error", "k", "own IS NULL OR (role IS NULL AND own <> outer_fold)", "x"),
    bad("known_pair", "error", "pair", "n = 2 AND s > 1", "p"), bad("pair_observed", "warning", "pair", "n < 2", "p"),
))
def val_splits_whole(spark, sf_dir):
    """Folds that are no exact partition, and cases that should share a subject."""
    subject = F.col("user_id") % 40
    e = load(spark, sf_dir, "events")
    w = e.select(subject.alias("subject_id"), F.concat(F.lit("c"), subject).alias("case_id"), subject.alias("recording_id"), (subject % 4).alias("outer_fold"), (F.col("event_id") % 2).alias("binary_label"))
    folds = F.array(*[F.struct(F.lit(o).cast("long").alias("outer_fold"), F.lit(i).cast("long").alias("inner_fold")) for o in range(4) for i in range(3)])
    each = w.select("subject_id").distinct().select("subject_id", F.explode(folds).alias("f")).select("f.*", "subject_id")
    test = (F.col("subject_id") % 4 == F.col("outer_fold")) | ((F.col("subject_id") == 8) & (F.col("outer_fold") == 1))
    role = F.when(test, "test").when(F.floor(F.col("subject_id") / 4) % 3 == F.col("inner_fold"), "validation").otherwise("train")
    roles = each.select("*", role.alias("role")).where("NOT (subject_id = 7 AND outer_fold = 1 AND inner_fold = 2)")
    extra = spark.range(1).select(F.lit(0).cast("long").alias("outer_fold"), F.lit(0).cast("long").alias("inner_fold"), F.lit(99).cast("long").alias("subject_id"), F.lit("train").alias("role"))
    mapping = w.select("case_id", F.when(F.col("subject_id") == 21, 1).otherwise(F.col("subject_id")).alias("subject_id")).distinct()
    return val.splits(w, roles.unionByName(extra), 3, mapping, [("c1", "c21"), ("c2", "c22"), ("c3", "c99")])


TRAINED = """f AS (SELECT o.k AS outer_fold, i.k AS inner_fold FROM range(0, 5) AS o(k), range(0, 4) AS i(k)), u AS (SELECT DISTINCT user_id % 40 AS subject_id FROM events),
r AS (SELECT outer_fold, inner_fold, subject_id, CASE WHEN subject_id % 5 = outer_fold THEN 'test' WHEN subject_id % 4 = inner_fold THEN 'validation' ELSE 'train' END AS role FROM u, f),
t AS (SELECT outer_fold, inner_fold, subject_id FROM r WHERE (role = 'train' AND NOT (outer_fold = 1 AND inner_fold = 1 AND subject_id % 7 = 3)) OR (role = 'test' AND outer_fold = 2 AND inner_fold = 0 AND subject_id % 10 = 2)),
k AS (SELECT *, CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) || '/' || CAST(subject_id AS VARCHAR) AS k FROM (SELECT outer_fold, inner_fold, subject_id, TRUE AS asked FROM r WHERE role = 'train') FULL JOIN (SELECT *, TRUE AS used FROM t) USING (outer_fold, inner_fold, subject_id))"""


@query(f"WITH {TRAINED} " + union(bad("scaler_leak", "error", "k", "asked IS NULL", "k"), bad("scaler_incomplete", "error", "k", "used IS NULL", "k"), bad("class_counts", "error", "CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR)", "outer_fold = 3", "f")))
def val_scalers_whole(spark, sf_dir):
    """Scalers that saw other subjects than their fold's, and class counts that are not theirs."""
    e = load(spark, sf_dir, "events").withColumn("subject_id", F.col("user_id") % 40)
    folds = F.array(*[F.struct(F.lit(o).cast("long").alias("outer_fold"), F.lit(i).cast("long").alias("inner_fold")) for o in range(5) for i in range(4)])
    each = e.select("subject_id").distinct().select("subject_id", F.explode(folds).alias("f")).select("f.*", "subject_id")
    roles = each.withColumn("role", F.when(F.col("subject_id") % 5 == F.col("outer_fold"), "test").when(F.col("subject_id") % 4 == F.col("inner_fold"), "validation").otherwise("train"))
    trained = roles.where("(role = 'train' AND NOT (outer_fold = 1 AND inner_fold = 1 AND subject_id % 7 = 3)) OR (role = 'test' AND outer_fold = 2 AND inner_fold = 0 AND subject_id % 10 = 2)").drop("role")
    labelled = e.select("subject_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 - 1).alias("binary_label"))
    counts = labelled.where("binary_label IS NOT NULL").groupBy("subject_id").agg(F.count_if(F.col("binary_label") == 0).alias("q"), F.count_if(F.col("binary_label") == 1).alias("p"))
    weights = roles.where("role = 'train'").join(counts, "subject_id").groupBy("outer_fold", "inner_fold").agg(F.sum("q").alias("n_negative"), (F.sum("p") + F.when(F.col("outer_fold") == 3, 1).otherwise(0)).alias("n_positive"))
    table = each.select("outer_fold", "inner_fold").distinct().select("*", F.lit("Fz").alias("channel_name"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    return val.scalers(table, 1, trained, roles, weights, labelled)


EXPERIMENT = """g AS (SELECT user_id % 5 AS outer_fold, CAST(floor(user_id / 5) AS BIGINT) % 4 AS inner_fold, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT outer_fold, inner_fold, n % 20 + 1 AS best_epoch, n % 100 / 80 AS threshold, CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) AS k FROM g WHERE NOT (outer_fold = 4 AND inner_fold = 3) UNION ALL SELECT outer_fold, inner_fold, n % 20 + 1, n % 100 / 80, CAST(outer_fold AS VARCHAR) || '/' || CAST(inner_fold AS VARCHAR) FROM g WHERE outer_fold = 0 AND inner_fold = 0),
m AS (SELECT outer_fold, count(DISTINCT inner_fold) AS n FROM r GROUP BY 1),
p AS (SELECT CASE WHEN user_id % 40 = 13 THEN (user_id + 1) % 5 ELSE user_id % 5 END AS outer_fold, user_id % 40 AS subject_id, count(*) AS n FROM events GROUP BY ALL), pk AS (SELECT *, CAST(outer_fold AS VARCHAR) || '/' || CAST(subject_id AS VARCHAR) AS k FROM p)"""


@query(f"WITH {EXPERIMENT} " + union(
    twice("unique_run", "r", "outer_fold", "inner_fold"), bad("threshold_source", "error", "k", "outer_fold = 1 AND inner_fold = 2", "r"), bad("threshold_range", "error", "k", "NOT threshold BETWEEN 0 AND 1", "r"), bad("finite_roc_auc", "error", "k", "outer_fold = 2 AND inner_fold = 0", "r"),
    bad("checkpoint", "error", "k", "outer_fold = 3 AND inner_fold = 1", "r", "'runs/' || k"), bad("run_count", "error", "outer_fold", "n <> 4", "m", "n"), bad("median_epoch", "error", "outer_fold", "outer_fold = 0", "m"), bad("median_threshold", "error", "outer_fold", "outer_fold = 3", "m"),
    bad("unknown_subject", "error", "k", "subject_id = 17", "pk", "n"), bad("right_fold", "error", "k", "subject_id = 13", "pk", "n"), bad("leakage", "error", "'2/12'", "TRUE", "(SELECT 1 FROM events WHERE user_id % 40 = 12 LIMIT 1)"),
))
def val_experiment(spark, sf_dir):
    """Runs, frozen configurations and predictions of a nested cross-validation."""
    e = load(spark, sf_dir, "events").withColumn("subject_id", F.col("user_id") % 40)
    g = e.groupBy((F.col("user_id") % 5).alias("outer_fold"), (F.floor(F.col("user_id") / 5) % 4).alias("inner_fold")).agg(F.count("*").alias("n"))
    path = F.concat(F.lit("runs/"), F.concat_ws("/", "outer_fold", "inner_fold"))
    odd = (F.col("outer_fold") == 1) & (F.col("inner_fold") == 2)
    named = g.select(
        "outer_fold", "inner_fold", (F.col("n") % 20 + 1).alias("best_epoch"), (F.col("n") % 100 / 80).alias("threshold"), F.when(odd, "test").otherwise("inner_validation").alias("threshold_source"), path.alias("checkpoint_path"),
        F.when((F.col("outer_fold") == 2) & (F.col("inner_fold") == 0), float("nan")).otherwise(0.5).alias("roc_auc"),
    )
    runs = named.where("NOT (outer_fold = 4 AND inner_fold = 3)").unionByName(named.where("outer_fold = 0 AND inner_fold = 0"))
    frozen = runs.groupBy("outer_fold").agg((F.greatest(F.lit(1), F.floor(F.median("best_epoch") + 0.5)) + F.when(F.col("outer_fold") == 0, 1).otherwise(0)).alias("epochs"), (F.median("threshold") + F.when(F.col("outer_fold") == 3, 0.1).otherwise(0.0)).alias("threshold"))
    predictions = e.select("subject_id", F.when(F.col("subject_id") == 13, (F.col("user_id") + 1) % 5).otherwise(F.col("user_id") % 5).alias("outer_fold"))
    subjects = e.select("subject_id").distinct()
    assigned = subjects.where("subject_id <> 17").select("subject_id", (F.col("subject_id") % 5).alias("outer_fold"))
    each = subjects.select("subject_id", F.explode(F.array(*[F.lit(o).cast("long") for o in range(5)])).alias("outer_fold"))
    trained = each.where("subject_id % 5 <> outer_fold OR (subject_id = 12 AND outer_fold = 2)")
    checkpoints = named.where("NOT (outer_fold = 3 AND inner_fold = 1)").select(F.col("checkpoint_path").alias("path"))
    return val.experiment(runs, frozen, predictions, assigned, trained, checkpoints, 4, ["roc_auc"])

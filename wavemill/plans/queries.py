"""Registered queries of the engine's own operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import channels as ch
from ..operators import evaluation as ev
from ..operators import imbalance as im
from ..operators import intervals as ivl
from ..operators import model as md
from ..operators import moments as mo
from ..operators import preprocess as pp
from ..operators import quality as qc
from ..operators import relational as rel
from ..operators import splits as sp
from ..operators import validation as val
from ..sources.summary import parse_summaries
from ..sources.tables import load
from . import surrogates as su

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Shared SQL: events by day, recordings, intervals, merged intervals, labelled windows.
EVENTS = f"""ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / {su.DAY}) AS BIGINT) AS day FROM events),
e AS (SELECT *, us - day * {su.DAY} AS tod FROM ev),
rec AS (SELECT DISTINCT user_id, day FROM e),
iv AS (SELECT user_id, day, event_id, tod AS s, least(tod + (1 + CAST(floor(value) AS BIGINT) % 120) * {su.MINUTE}, {su.DAY}) AS t FROM e WHERE event_type = 'error')"""
MERGED = """o AS (SELECT user_id, day, s, t, max(t) OVER (PARTITION BY user_id, day ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
isl AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM o),
mi AS (SELECT user_id, day, min(s) AS s, max(t) AS t FROM isl GROUP BY user_id, day, g)"""
LABELS = f"""w AS (SELECT user_id, day, k AS window_index, k * {su.STRIDE} AS window_start, k * {su.STRIDE} + {su.WINDOW} AS window_end FROM rec, range(0, {(su.DAY - su.WINDOW) // su.STRIDE + 1}) AS r(k)),
ov AS (SELECT w.user_id, w.day, w.window_index, w.window_start, w.window_end,
  CAST(coalesce(sum(CASE WHEN mi.s IS NULL THEN 0 ELSE greatest(0, least(w.window_end, mi.t) - greatest(w.window_start, mi.s)) END), 0) AS BIGINT) AS overlap,
  min(CASE WHEN mi.s IS NOT NULL THEN greatest(0, mi.s - w.window_end, w.window_start - mi.t) END) AS nearest
  FROM w LEFT JOIN mi ON w.user_id = mi.user_id AND w.day = mi.day GROUP BY ALL),
lab AS (SELECT *, CASE WHEN overlap <= 0 THEN 'non_ictal' WHEN overlap / {float(su.WINDOW)} >= {su.THRESHOLD} THEN 'ictal' ELSE 'boundary' END AS label_name FROM ov)"""
SCORES = "s AS (SELECT event_id, user_id, user_id % 5 AS fold, least(value / 500, 1.0) AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"
ROWS = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
CHANNELS = "c AS (SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)"
DRAW = "md5(concat_ws('/', '42', CAST(event_id AS VARCHAR)))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Intervals and windows.


@query(f"WITH {EVENTS}, {MERGED}, {LABELS} SELECT user_id, label_name, count(*) AS n_windows, CAST(sum(overlap) AS BIGINT) AS overlap_us, CAST(sum(nearest) AS BIGINT) AS nearest_us FROM lab GROUP BY ALL")
def win_sliding_label(spark, sf_dir):
    out = su.labelled(spark, sf_dir).groupBy("user_id", "label_name")
    return out.agg(F.count("*").alias("n_windows"), F.sum("overlap").alias("overlap_us"), F.sum("nearest").alias("nearest_us"))


@query(f"WITH {EVENTS}, {MERGED} SELECT user_id, day, s AS start, t AS \"end\" FROM mi")
def ivl_merge(spark, sf_dir):
    return ivl.merge_intervals(su.error_intervals(spark, sf_dir).select("user_id", "day", "start", "end"), ["user_id", "day"])


@query(f"WITH {EVENTS}, {MERGED}, {LABELS} SELECT user_id, day, window_index, overlap FROM ov")
def ivl_total_overlap(spark, sf_dir):
    return su.labelled(spark, sf_dir).select("user_id", "day", "window_index", "overlap")


@query(f"WITH {EVENTS}, {MERGED}, {LABELS} SELECT user_id, day, window_index, nearest FROM ov WHERE nearest IS NOT NULL")
def ivl_nearest_distance(spark, sf_dir):
    return su.labelled(spark, sf_dir).where("nearest IS NOT NULL").select("user_id", "day", "window_index", "nearest")


@query(f"""WITH {EVENTS}, ch AS (SELECT user_id, day, k AS chunk_index, k * {420 * su.MINUTE} AS a, least((k + 1) * {420 * su.MINUTE}, {su.DAY}) AS b FROM rec, range(0, 4) AS r(k)),
f AS (SELECT user_id, day, chunk_index, coalesce(max(CASE WHEN s IS NULL THEN 0 ELSE greatest(0, least(b, t) - greatest(a, s)) END / CAST(b - a AS DOUBLE)), 0) AS f FROM ch LEFT JOIN iv USING (user_id, day) WHERE b - a >= {60 * su.MINUTE} GROUP BY ALL)
SELECT user_id, day, chunk_index, round(f, 9) AS overlap_fraction, CASE WHEN f <= 0 THEN 'non_ictal' WHEN f >= 0.25 THEN 'ictal' ELSE 'boundary' END AS annotation_label FROM f""")
def ivl_chunk_annotation(spark, sf_dir):
    chunks = ivl.tumbling_chunks(su.recordings(spark, sf_dir), "n", 420 * su.MINUTE, 60 * su.MINUTE)
    out = ivl.chunk_annotation(chunks, su.error_intervals(spark, sf_dir).select("user_id", "day", "start", "end"), ["user_id", "day"], 0.25)
    return out.select("user_id", "day", F.col("window_index").cast("bigint").alias("chunk_index"), F.round("overlap_fraction", 9).alias("overlap_fraction"), "annotation_label")


@query(f"""WITH {EVENTS}, {MERGED}, {LABELS} SELECT iv.user_id, iv.day, iv.event_id, count(lab.window_start) AS overlapping_windows, count_if(label_name = 'ictal') AS ictal_windows, count_if(label_name = 'boundary') AS boundary_windows, count_if(label_name = 'ictal') > 0 AS has_ictal
FROM iv LEFT JOIN lab ON iv.user_id = lab.user_id AND iv.day = lab.day AND lab.window_start < iv.t AND lab.window_end > iv.s GROUP BY ALL""")
def win_seizure_coverage(spark, sf_dir):
    return ivl.interval_coverage(su.error_intervals(spark, sf_dir), su.labelled(spark, sf_dir), ["user_id", "day"], "event_id")


@query(f"WITH {EVENTS} SELECT iv.event_id, x.event_id AS other_id FROM iv JOIN e x ON iv.user_id = x.user_id AND iv.day = x.day AND x.tod >= iv.s AND x.tod < iv.t AND x.event_id <> iv.event_id")
def join_interval_theta(spark, sf_dir):
    i = su.error_intervals(spark, sf_dir)
    x = su.events(spark, sf_dir).select("user_id", "day", F.col("event_id").alias("other_id"), "at")
    return i.join(x, ["user_id", "day"]).where("at >= start AND at < `end` AND other_id <> event_id").select("event_id", "other_id")


@query(f"WITH {EVENTS}, p AS (SELECT *, lag(t) OVER (PARTITION BY user_id, day ORDER BY s, event_id) AS previous_end FROM iv) SELECT event_id, s AS start, previous_end FROM p WHERE s < previous_end")
def win_previous_overlap(spark, sf_dir):
    return ivl.previous_overlaps(su.error_intervals(spark, sf_dir), ["user_id", "day"], ["start", "event_id"]).select("event_id", "start", "previous_end")


@query(f"WITH {EVENTS}, {MERGED}, {LABELS} SELECT user_id, day, CAST(1 AS BOOLEAN) AS constant FROM (SELECT DISTINCT user_id, day FROM w)")
def win_constant_stride(spark, sf_dir):
    return ivl.constant_stride(su.windows(spark, sf_dir), ["user_id", "day"], "window_start", su.STRIDE)


# The same by sweeps, whatever the number of intervals.


@query(ORACLES["win_sliding_label"])
def win_swept_label(spark, sf_dir):
    out = su.labelled(spark, sf_dir, dense=0).groupBy("user_id", "label_name")
    return out.agg(F.count("*").alias("n_windows"), F.sum("overlap").alias("overlap_us"), F.sum("nearest").alias("nearest_us"))


@query(ORACLES["ivl_chunk_annotation"])
def ivl_swept_chunks(spark, sf_dir):
    chunks = ivl.tumbling_chunks(su.recordings(spark, sf_dir), "n", 420 * su.MINUTE, 60 * su.MINUTE)
    out = ivl.chunk_annotation(chunks, su.error_intervals(spark, sf_dir).select("user_id", "day", "start", "end"), ["user_id", "day"], 0.25, dense=0)
    return out.select("user_id", "day", F.col("window_index").cast("bigint").alias("chunk_index"), F.round("overlap_fraction", 9).alias("overlap_fraction"), "annotation_label")


@query(ORACLES["win_seizure_coverage"])
def win_swept_coverage(spark, sf_dir):
    return ivl.interval_coverage(su.error_intervals(spark, sf_dir), su.labelled(spark, sf_dir), ["user_id", "day"], "event_id", dense=0)


# Joins and sets.


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, n_orders, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'matched' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def join_outer_indicator(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct()
    b = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    return rel.outer_with_status(a, b, ["k"]).select("k", "n_orders", "status")


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def join_validated(spark, sf_dir):
    from ..checks import validated_join

    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    full = validated_join(validated_join(o, c, ["c_custkey"], "inner"), n, ["n_nationkey"], "inner")
    return full.select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi_fold(spark, sf_dir):
    keep = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_anti_fold(spark, sf_dir):
    used = load(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(used, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT a.l_orderkey, a.l_linenumber AS l_linenumber_a, b.l_linenumber AS l_linenumber_b, a.l_quantity AS l_quantity_a, b.l_quantity AS l_quantity_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber")
def join_self_pairs(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return rel.self_pairs(li, ["l_orderkey", "l_suppkey"], "l_linenumber", ["l_quantity"]).drop("l_suppkey")


@query("WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' AS side FROM b WHERE k NOT IN (SELECT k FROM a)")
def set_symmetric_difference(spark, sf_dir):
    a = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return rel.same_keys(a, load(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def srt_top_k(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


# Aggregations.


@query("SELECT user_id, count(*) AS n_rows, count_if(event_type = 'error') AS n_error, count_if(event_type = 'click') AS n_click, count_if(event_type = 'view') AS n_view FROM events GROUP BY 1")
def agg_conditional_counts(spark, sf_dir):
    return rel.conditional_counts(load(spark, sf_dir, "events"), ["user_id"], "event_type", ["error", "click", "view"])


@query(f"WITH {EVENTS} SELECT user_id, count(DISTINCT day) AS n_days, count(DISTINCT CASE WHEN event_type = 'error' THEN day END) AS n_error_days FROM e GROUP BY 1")
def agg_conditional_distinct(spark, sf_dir):
    day = F.when(F.col("event_type") == "error", F.col("day"))
    return su.events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("day").alias("n_days"), F.count_distinct(day).alias("n_error_days"))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM events GROUP BY 1")
def agg_collect_join(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"))


@query("SELECT user_id, CAST(coalesce(max(CASE WHEN event_type = 'click' THEN 1 END), 0) AS INTEGER) AS click, CAST(coalesce(max(CASE WHEN event_type = 'view' THEN 1 END), 0) AS INTEGER) AS view, CAST(coalesce(max(CASE WHEN event_type = 'error' THEN 1 END), 0) AS INTEGER) AS error FROM events GROUP BY 1")
def agg_presence_pivot(spark, sf_dir):
    return rel.presence_matrix(load(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "error"])


@query("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), m AS (SELECT p_size AS mode_value FROM c ORDER BY n DESC, p_size LIMIT 1) SELECT p_partkey, p_size, mode_value FROM part, m WHERE p_size <> mode_value")
def agg_mode_deviation(spark, sf_dir):
    return rel.deviations_from_mode(load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


@query(f"""WITH {CHANNELS}, s AS (SELECT l_orderkey, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS u, count(*) AS n FROM c GROUP BY 1)
SELECT u AS unordered_signature, count(*) AS n_files, min(l_orderkey) AS example, min(n) AS min_names, max(n) AS max_names FROM s GROUP BY 1""")
def agg_signatures(spark, sf_dir):
    signed = rel.signatures(su.channel_rows(spark, sf_dir), "l_orderkey", "p_brand", "l_linenumber")
    return rel.rank_signatures(signed, "l_orderkey").drop("signature_id")


@query("WITH s AS (SELECT o_orderpriority || '/' || o_orderstatus AS unordered_signature, o_orderkey FROM orders), g AS (SELECT unordered_signature, count(*) AS n_files FROM s GROUP BY 1) SELECT unordered_signature, n_files, 'SIG-' || lpad(CAST(row_number() OVER (ORDER BY n_files DESC, unordered_signature) AS VARCHAR), 3, '0') AS signature_id FROM g")
def agg_signature_ranking(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("unordered_signature"), "o_orderkey", F.lit(1).alias("n_names"))
    return rel.rank_signatures(o, "o_orderkey").select("unordered_signature", "n_files", "signature_id")


@query("WITH l AS (SELECT unnest(['click', 'view', 'error', 'absent']) AS event_type), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT l.event_type, coalesce(n, 0) AS n FROM l LEFT JOIN c USING (event_type)")
def agg_value_counts_reindexed(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in ("click", "view", "error", "absent")], "event_type string")
    return rel.counts_with_zeros(load(spark, sf_dir, "events"), "event_type", labels)


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, median(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_orderkey % 100 AS g, median(m) AS m, sum(n) AS n FROM a GROUP BY ALL)
SELECT l_returnflag, median(m) AS median_of_medians, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1""")
def agg_rollup_three_level(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    a = li.groupBy("l_orderkey", "l_returnflag").agg(F.median("l_quantity").alias("m"), F.count("*").alias("n"))
    b = a.groupBy("l_returnflag", (F.col("l_orderkey") % 100).alias("g")).agg(F.median("m").alias("m"), F.sum("n").alias("n"))
    return b.groupBy("l_returnflag").agg(F.median("m").alias("median_of_medians"), F.sum("n").alias("n"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY 1")
def agg_describe(spark, sf_dir):
    return rounded(rel.describe_by(load(spark, sf_dir, "events"), ["event_type"], "value"), ["mean", "std", "q25", "median", "q75"])


@query(ORACLES["agg_describe"])
def agg_describe_narrowed(spark, sf_dir):
    return rounded(rel.describe_by(load(spark, sf_dir, "events"), ["event_type"], "value", few=200), ["mean", "std", "q25", "median", "q75"])


@query("WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM events, m GROUP BY 1")
def agg_histogram(spark, sf_dir):
    return rel.histogram(load(spark, sf_dir, "events"), "value", 40)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def win_keep_last(spark, sf_dir):
    return rel.keep_last(load(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT user_id, event_id, event_type <> 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x, row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY event_id) AS y FROM events),
r AS (SELECT user_id, f, x - y AS g, count(*) AS n FROM a GROUP BY ALL) SELECT user_id, coalesce(max(CASE WHEN f THEN n END), 0) AS longest_run FROM r GROUP BY 1""")
def win_longest_run(spark, sf_dir):
    return rel.longest_runs(load(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") != "error")


@query("WITH n AS (SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id + 100000000, user_id, value FROM events WHERE event_id % 7 = 0) SELECT event_id, user_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM n) UNION ALL SELECT * FROM n")
def io_upsert(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "value")
    new = e.where("event_id % 3 = 0").withColumn("value", F.col("value") * 2).unionByName(e.where("event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 100_000_000))
    return rel.upsert(e, new, ["event_id"])


@query("SELECT event_id, user_id % 5 AS fold, value FROM events WHERE user_id % 5 <> 2 UNION ALL SELECT event_id, user_id % 5 AS fold, value + 1 FROM events WHERE user_id % 5 = 2 AND event_id % 2 = 0")
def io_partition_replace(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("fold"), "value")
    return rel.replace_partitions(e, e.where("fold = 2 AND event_id % 2 = 0").withColumn("value", F.col("value") + 1), "fold")


# Strings, clocks, projections.

NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim({x})), '\\s+', ' ', 'g'), ' ?- ?', '-', 'g'), '^EEG ', ''), '-(?:REF|LE)$', '')"


@query(f"SELECT p_partkey, {NORMAL.format(x="' EEG ' || p_name || ' - ' || p_brand || '-REF '")} AS normalized, regexp_replace({NORMAL.format(x="p_brand || '-' || CAST(p_size AS VARCHAR)")}, '-\\d+$', '') AS base_name FROM part")
def str_normalize_label(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    messy = F.concat(F.lit(" EEG "), "p_name", F.lit(" - "), "p_brand", F.lit("-REF "))
    return p.select("p_partkey", sc.normalize_channel_name(messy).alias("normalized"), sc.remove_duplicate_suffix(sc.normalize_channel_name(F.concat_ws("-", "p_brand", "p_size"))).alias("base_name"))


def clock_text(us, extra):
    s = F.floor(us / 1_000_000) + extra
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


@query(f"WITH {EVENTS}, c AS (SELECT event_id, CAST(floor(tod / 1000000) AS BIGINT) AS a, CAST(floor(tod / 1000000) AS BIGINT) + CAST(floor(value) AS BIGINT) * 60 - 7200 AS b0 FROM e), d AS (SELECT event_id, a, CASE WHEN b0 < 0 THEN b0 + 86400 ELSE b0 END AS b FROM c) SELECT event_id, CASE WHEN b >= a THEN b - a WHEN b < 86400 THEN b + 86400 - a END AS duration_seconds, CASE WHEN b >= a THEN FALSE WHEN b < 86400 THEN TRUE END AS crosses_midnight FROM d")
def dat_clock_duration(spark, sf_dir):
    e = su.events(spark, sf_dir)
    shift = F.floor("value").cast("bigint") * 60 - 7200
    end = F.floor(F.col("at") / 1_000_000) + shift
    shift = F.when(end < 0, shift + 86_400).otherwise(shift)
    out = e.select("event_id", sc.clock_duration(clock_text(F.col("at"), F.lit(0)), clock_text(F.col("at"), shift)).alias("d"))
    return out.select("event_id", "d.duration_seconds", "d.crosses_midnight")


@query("SELECT o_orderkey, coalesce(nullif(concat_ws('|', CASE WHEN o_orderstatus <> 'F' THEN 'not_final' END, CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low' END), ''), 'included') AS reason FROM orders")
def prj_reason_string(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", sc.reasons((F.col("o_orderstatus") != "F", "not_final"), (F.col("o_totalprice") < 50_000, "small"), (F.col("o_orderpriority").startswith("5"), "low")).alias("reason"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 256 + 0.5) AS BIGINT) AS half_up, CAST(floor(l_quantity * 256) AS BIGINT) AS onset, CAST(ceil(l_quantity * 256.5) AS BIGINT) AS \"offset\", CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half_even, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 9) END AS ratio FROM lineitem")
def mth_rounding(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", sc.round_half_up(F.col("l_extendedprice") / 256).alias("half_up"), sc.onset_sample(F.col("l_quantity"), F.lit(256)).alias("onset"), sc.offset_sample(F.col("l_quantity"), F.lit(256.5)).alias("offset"), sc.round_half_even(F.col("l_quantity") / 2).alias("half_even"), F.round(sc.guarded_ratio(F.col("l_tax"), F.col("l_discount")), 9).alias("ratio"))


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY s, event_id) AS INTEGER) AS seizure_index, CAST(floor(s / 1000000) AS DOUBLE) AS onset_seconds, CAST(floor(t / 1000000) AS DOUBLE) AS offset_seconds, day FROM iv)
SELECT 'chb' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') AS case_id, 'r' || CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS recording_id, seizure_index, onset_seconds, offset_seconds, offset_seconds - onset_seconds AS duration_seconds FROM p""")
def str_parse_blocks(spark, sf_dir):
    """Writes annotation summaries from the intervals, one a user and day, and parses them back."""
    lines = su.error_intervals(spark, sf_dir)
    number = F.row_number().over(W.partitionBy("user_id", "day").orderBy("start", "event_id"))
    seizure = F.format_string("Seizure %d Start Time: %d seconds\nSeizure %d End Time: %d seconds", "i", F.floor(F.col("start") / 1_000_000), "i", F.floor(F.col("end") / 1_000_000))
    blocks = lines.withColumn("i", number).groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", seizure.alias("t")))), lambda x: x["t"]), "\n").alias("t"), F.count("*").alias("n"))
    block = F.concat(F.lit("File Name: r"), "user_id", F.lit("_"), "day", F.lit(".edf\nFile Start Time: 00:00:00\nFile End Time: 23:59:59\nNumber of Seizures in File: "), "n", F.lit("\n"), "t")
    path = F.concat(F.lit("/data/chb"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit("/u"), "user_id", F.lit("_"), "day", F.lit("-summary.txt"))
    return parse_summaries(blocks.select(path.alias("path"), block.alias("text")))[2].select("case_id", "recording_id", "seizure_index", "onset_seconds", "offset_seconds", "duration_seconds")


# Channels.

BRANDS = ["Brand#11", "Brand#12", "Brand#13"]
SETS = {"one": BRANDS[:1], "two": BRANDS[:2], "three": BRANDS}
SETS_SQL = "t AS (SELECT unnest(['one', 'two', 'three']) AS channel_set, unnest([['Brand#11'], ['Brand#11', 'Brand#12'], ['Brand#11', 'Brand#12', 'Brand#13']]) AS target)"
COVERED = f"""{CHANNELS}, h AS (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS have FROM c GROUP BY 1), {SETS_SQL},
cov AS (SELECT l_orderkey, channel_set, CAST(len(target) AS INTEGER) AS n_target, CAST(len(list_intersect(target, have)) AS INTEGER) AS n_present, array_to_string(list_sort(list_filter(target, lambda x: NOT list_contains(have, x))), '|') AS missing, array_to_string(list_sort(list_filter(have, lambda x: NOT list_contains(target, x))), '|') AS extra, len(list_filter(target, lambda x: NOT list_contains(have, x))) = 0 AS complete FROM h, t)"""


def covered(spark, sf_dir):
    return ch.coverage(su.channel_rows(spark, sf_dir), ch.channel_sets(spark, SETS), "l_orderkey", "p_brand")


@query(f"WITH {COVERED} SELECT * FROM cov")
def chn_coverage(spark, sf_dir):
    return covered(spark, sf_dir)


@query(f"""WITH {COVERED}, m AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n_seizures, floor(o_totalprice) AS ictal_seconds, 3600.0 * (o_orderkey % 7) AS duration_seconds FROM orders),
j AS (SELECT * FROM cov LEFT JOIN m USING (l_orderkey))
SELECT channel_set, count(*) AS recordings_total, count_if(complete) AS recordings_kept, CAST(sum(n_seizures) AS BIGINT) AS seizures_total, CAST(coalesce(sum(CASE WHEN complete THEN n_seizures END), 0) AS BIGINT) AS seizures_kept, round(coalesce(sum(duration_seconds / 3600), 0), 6) AS hours_total, round(coalesce(sum(CASE WHEN complete THEN duration_seconds / 3600 END), 0), 6) AS hours_kept, round(count_if(complete) / count(*), 9) AS recordings_fraction FROM j GROUP BY 1""")
def chn_retention(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    meta = o.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("n_seizures"), F.floor("o_totalprice").alias("ictal_seconds"), (3600.0 * (F.col("o_orderkey") % 7)).alias("duration_seconds"))
    out = ch.retention(covered(spark, sf_dir), meta, "l_orderkey")
    return out.select("channel_set", "recordings_total", "recordings_kept", "seizures_total", "seizures_kept", F.round("hours_total", 6).alias("hours_total"), F.round("hours_kept", 6).alias("hours_kept"), F.round("recordings_fraction", 9).alias("recordings_fraction"))


@query(f"""WITH {COVERED}, m AS (SELECT o_orderkey AS l_orderkey, o_custkey % 40 AS case_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n_seizures, floor(o_totalprice) AS ictal_seconds FROM orders), j AS (SELECT * FROM cov LEFT JOIN m USING (l_orderkey))
SELECT channel_set, max(n_target) AS n_target, count_if(n_seizures > 0) AS seizure_recordings_total, count_if(n_seizures > 0 AND complete) AS seizure_recordings_kept, count(DISTINCT case_id) AS cases_total, count(DISTINCT CASE WHEN complete THEN case_id END) AS cases_kept,
CAST(sum(ictal_seconds) AS BIGINT) AS ictal_seconds_total, CAST(coalesce(sum(CASE WHEN complete THEN ictal_seconds END), 0) AS BIGINT) AS ictal_seconds_kept FROM j GROUP BY 1""")
def chn_retention_cases(spark, sf_dir):
    """Cases and recordings with seizures that each channel set would keep."""
    o = load(spark, sf_dir, "orders")
    meta = o.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 40).alias("case_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("n_seizures"), F.floor("o_totalprice").alias("ictal_seconds"), F.lit(60.0).alias("duration_seconds"))
    out = ch.retention(covered(spark, sf_dir), meta, "l_orderkey")
    return out.select("channel_set", "n_target", *[f"{n}_{x}" for n in ("seizure_recordings", "cases", "ictal_seconds") for x in ("total", "kept")])


@query(f"WITH {CHANNELS}, f AS (SELECT count(DISTINCT l_orderkey) AS n FROM c) SELECT p_brand, count(DISTINCT l_orderkey) AS n_files, round(count(DISTINCT l_orderkey) / max(f.n), 9) AS fraction FROM c, f GROUP BY 1 HAVING count(DISTINCT l_orderkey) / max(f.n) >= 0.1")
def chn_frequent(spark, sf_dir):
    return rounded(ch.ranked_presence(su.channel_rows(spark, sf_dir), "l_orderkey", "p_brand", 0.1), ["fraction"], 9)


# Quality.


@query(f"""WITH {ROWS} SELECT vec_id, count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, round(sqrt(avg(x * x)), 6) AS rms, round(max(x) - min(x), 6) AS peak_to_peak, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(skewness(x), 5) AS skewness, round(kurtosis(x), 5) AS kurtosis FROM x GROUP BY 1""")
def qc_amplitude_stats(spark, sf_dir):
    out = qc.amplitude_stats(su.samples(spark, sf_dir), ["vec_id"], "x").select("vec_id", "n", "mean", "median", "std", "rms", "peak_to_peak", "iqr", "skewness", "kurtosis")
    return rounded(rounded(out, ["mean", "median", "std", "rms", "peak_to_peak", "iqr"]), ["skewness", "kurtosis"], 5)


@query(f"WITH {ROWS}, m AS (SELECT vec_id, median(x) AS m FROM x GROUP BY 1) SELECT vec_id, round(median(abs(x - m)), 6) AS mad FROM x JOIN m USING (vec_id) GROUP BY 1")
def qc_median_deviation(spark, sf_dir):
    return rounded(qc.median_deviation(su.samples(spark, sf_dir), ["vec_id"], "x"), ["mad"])


@query(f"WITH {ROWS}, d AS (SELECT vec_id, abs(x - lag(x) OVER (PARTITION BY vec_id ORDER BY i)) AS d FROM x) SELECT vec_id, round(sum(d), 5) AS line_length, round(avg(d), 6) AS mean_abs_difference, round(max(d), 6) AS max_abs_difference FROM d GROUP BY 1")
def qc_line_length(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = load(spark, sf_dir, "embeddings").select("vec_id", qc.line_length(v).alias("l")).select("vec_id", "l.*")
    return rounded(rounded(out, ["line_length"], 5), ["mean_abs_difference", "max_abs_difference"])


@query(f"""WITH {ROWS}, d AS (SELECT vec_id, i, abs(x - lag(x) OVER (PARTITION BY vec_id ORDER BY i)) <= 0.05 AS f FROM x), a AS (SELECT vec_id, i, f, row_number() OVER (PARTITION BY vec_id ORDER BY i) - row_number() OVER (PARTITION BY vec_id, f ORDER BY i) AS g FROM d WHERE f IS NOT NULL),
r AS (SELECT vec_id, g, count(*) + 1 AS n FROM a WHERE f GROUP BY ALL), s AS (SELECT vec_id, max(n) AS longest, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS total FROM r GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(longest, 0) AS INTEGER) AS longest, CAST(coalesce(total, 0) AS INTEGER) AS total FROM (SELECT DISTINCT vec_id FROM x) v LEFT JOIN s USING (vec_id)""")
def qc_flatline(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", qc.flat_runs(v, 0.05, 3).alias("r")).select("vec_id", "r.*")


def flag_rows(spark, sf_dir):
    """Quality-like columns made of order lines."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("case_id"), F.col("l_orderkey").alias("recording_id"), F.col("l_linestatus").alias("channel_name"), F.col("l_linenumber").alias("channel_index"), F.when(F.col("l_quantity") < 10, "ictal").when(F.col("l_quantity") < 20, "boundary").otherwise("non_ictal").alias("annotation_label"),
        (F.col("l_tax") - 0.04).alias("nonfinite_fraction"), (F.col("l_discount") / 5).alias("flatline_sample_fraction"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") / 5).alias("zero_fraction"), (F.col("l_quantity") - 1).alias("std_uv"), F.col("l_quantity").alias("rms_uv"), F.col("l_extendedprice").alias("peak_to_peak_uv"), F.col("l_extendedprice").alias("robust_range_uv"),
        (F.col("l_discount") * 3).alias("line_noise_ratio"), (F.col("l_tax") * 7).alias("high_frequency_ratio"),
    )


FLAG_SQL = """q AS (SELECT l_returnflag AS case_id, l_orderkey AS recording_id, l_linestatus AS channel_name, l_linenumber AS channel_index, l_quantity, l_tax - 0.04 AS nf, l_discount / 5 AS ff, CASE WHEN l_tax > 0.01 THEN l_tax / 5 END AS zf, l_quantity - 1 AS sd, l_extendedprice AS pp, l_discount * 3 AS ln, l_tax * 7 AS hf FROM lineitem),
fl AS (SELECT *, CAST(coalesce(nf > 0, FALSE) AS INTEGER) + CAST(coalesce(ff >= 0.01, FALSE) AS INTEGER) + CAST(coalesce(zf >= 0.01, FALSE) AS INTEGER) + CAST(coalesce(sd <= 0.01, FALSE) AS INTEGER) + CAST(coalesce(pp >= 5000, FALSE) AS INTEGER) + CAST(coalesce(ln >= 0.25, FALSE) AS INTEGER) + CAST(coalesce(hf >= 0.5, FALSE) AS INTEGER) AS flag_count FROM q)"""


@query(f"WITH {FLAG_SQL} SELECT case_id, recording_id, channel_index, flag_count, flag_count > 0 AS needs_review FROM fl")
def qc_flags(spark, sf_dir):
    return qc.add_flags(flag_rows(spark, sf_dir)).select("case_id", "recording_id", "channel_index", "flag_count", "needs_review")


@query(f"""WITH {FLAG_SQL}, c AS (SELECT case_id, recording_id, channel_name, channel_index, count(*) AS n, count_if(flag_count > 0) AS r, median(l_quantity) AS m, max(l_quantity) AS mx FROM fl GROUP BY ALL)
SELECT case_id, recording_id, count(*) AS channel_count, count_if(r / n >= 0.1) AS reviewed_channel_count, median(m) AS median_channel_rms_uv, max(mx) AS max_channel_rms_uv, count_if(r / n >= 0.1) > 0 AS recording_needs_review FROM c GROUP BY ALL""")
def qc_roll_up(spark, sf_dir):
    out = qc.roll_up_recordings(qc.roll_up_channels(qc.add_flags(flag_rows(spark, sf_dir))))
    return out.select("case_id", "recording_id", "channel_count", "reviewed_channel_count", "median_channel_rms_uv", "max_channel_rms_uv", "recording_needs_review")


def signal_blocks(spark, sf_dir, rate: float = 8.0):
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("recording_id"), F.lit(0).alias("channel_index"), F.lit("x").alias("channel_name"), F.lit(0).cast("bigint").alias("block_index"), F.lit(0).cast("bigint").alias("start_sample"), F.lit(rate).alias("sampling_rate_hz"), F.col("embedding").alias("samples"))


# Moments.


@query(f"WITH {ROWS} SELECT label, count(x) AS n, round(avg(x), 8) AS mean, round(var_pop(x), 8) AS variance FROM x GROUP BY 1")
def stat_channel_moments(spark, sf_dir):
    parts = mo.block_moments(load(spark, sf_dir, "embeddings"), ["label", "vec_id"], "embedding")
    out = mo.with_deviation(mo.combine(parts.select("label", "n", "mean", "m2"), ["label"]))
    return rounded(out.select("label", "n", "mean", "variance"), ["mean", "variance"], 8)


@query(f"WITH {ROWS}, f AS (SELECT unnest(range(0, 4)) AS fold) SELECT fold, i AS channel, count(x) AS n, round(avg(x), 8) AS mean, round(CASE WHEN stddev_pop(x) >= 1e-6 THEN stddev_pop(x) ELSE 1 END, 8) AS scale FROM x, f WHERE label % 4 <> fold GROUP BY ALL")
def stat_fold_scalers(spark, sf_dir):
    stats = mo.row_moments(su.samples(spark, sf_dir), ["label", "i"], "x").withColumnRenamed("label", "subject_id").withColumnRenamed("i", "channel")
    folds = spark.range(4).select(F.col("id").alias("fold"))
    roles = stats.select("subject_id").distinct().crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col("subject_id") % 4 == F.col("fold"), "validation").otherwise("train"))
    return rounded(mo.fold_scalers(stats, roles, ["fold"], "channel").select("fold", "channel", "n", "mean", "scale"), ["mean", "scale"], 8)


@query(f"WITH {ROWS}, m AS (SELECT label, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1) SELECT vec_id, round(sum((x - m) / s), 5) AS total, round(max((x - m) / s), 5) AS top FROM x JOIN m USING (label) GROUP BY 1")
def arr_zscore(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "samples")
    m = mo.with_deviation(mo.row_moments(su.samples(spark, sf_dir), ["label"], "x")).withColumn("scale", F.col("std"))
    out = mo.apply_scaler(e, m, ["label"], unit=1.0)
    return out.select("vec_id", F.round(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.array_max("scaled"), 5).alias("top"))


# Imbalance and splits.


@query(f"WITH {EVENTS}, {MERGED}, {LABELS}, b AS (SELECT user_id % 5 AS fold, count_if(label_name = 'non_ictal') AS n_negative, count_if(label_name = 'ictal') AS n_positive FROM lab WHERE label_name <> 'boundary' GROUP BY 1) SELECT fold, n_negative, n_positive, round(n_negative / n_positive, 9) AS class_ratio, round(sqrt(n_negative / n_positive), 9) AS positive_weight FROM b")
def imb_class_weights(spark, sf_dir):
    w = su.labelled(spark, sf_dir).withColumn("fold", F.col("user_id") % 5)
    return rounded(im.class_weights(w, ["fold"], "sqrt"), ["class_ratio", "positive_weight"], 9)


@query(f"""WITH p AS (SELECT count(*) * 2 AS target FROM events WHERE event_type = 'error'), n AS (SELECT event_id, user_id, {DRAW} AS d FROM events WHERE event_type <> 'error'), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) <= 5 AS first FROM n),
g AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN first THEN 0 ELSE 1 END, d, event_id) AS r FROM f)
SELECT event_id, 'positive' AS strategy FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, CASE WHEN first THEN 'subject_minimum' ELSE 'global_top_up' END AS strategy FROM g, p WHERE r <= target""")
def imb_negative_sampling(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").cast("int").alias("binary_label"))
    return im.negative_sample(e, "user_id", "event_id", 2.0, 5).select("event_id", "strategy")


@query("SELECT event_id FROM (SELECT event_id, md5(concat_ws('/', '42', CAST(event_id AS VARCHAR))) AS d FROM events) ORDER BY d, event_id LIMIT 50")
def imb_hash_sample(spark, sf_dir):
    return im.hash_sample(load(spark, sf_dir, "events").select("event_id"), "event_id", 50)


def subject_windows(spark, sf_dir):
    w = su.labelled(spark, sf_dir)
    return w.select(F.concat(F.lit("subject_"), (F.col("user_id") % 25).cast("string")).alias("subject_id"), F.col("user_id").cast("string").alias("case_id"), F.concat_ws("_", "user_id", "day").alias("recording_id"), "binary_label", "window_index")


@query(f"""WITH {EVENTS}, {MERGED}, {LABELS}, x AS (SELECT 'subject_' || CAST(user_id % 25 AS VARCHAR) AS subject_id, CAST(user_id AS VARCHAR) AS c, CAST(user_id AS VARCHAR) || '_' || CAST(day AS VARCHAR) AS r, label_name = 'ictal' AS p FROM lab WHERE label_name <> 'boundary')
SELECT subject_id, string_agg(DISTINCT c, '|' ORDER BY c) AS case_ids, count(DISTINCT r) AS n_recordings, count(DISTINCT CASE WHEN p THEN r END) AS n_ictal_recordings, count_if(NOT p) AS n_negative, count_if(p) AS n_positive, round(count_if(p) / count(*), 9) AS positive_fraction FROM x GROUP BY 1""")
def spl_subject_summary(spark, sf_dir):
    return rounded(sp.subject_summary(subject_windows(spark, sf_dir)), ["positive_fraction"], 9)


@query()
def spl_outer_folds(spark, sf_dir):
    return sp.outer_folds(subject_windows(spark, sf_dir))


@query()
def spl_inner_folds(spark, sf_dir):
    w = subject_windows(spark, sf_dir)
    return sp.fold_summary(w, sp.nested_roles(w), ["outer_fold", "inner_fold", "role"])


# Evaluation.


@query(f"WITH {SCORES}, c AS (SELECT fold, count_if(score >= 0.3 AND label = 1) AS tp, count_if(score >= 0.3 AND label = 0) AS fp, count_if(score < 0.3 AND label = 0) AS tn, count_if(score < 0.3 AND label = 1) AS fn FROM s GROUP BY 1) SELECT fold, tp, fp, tn, fn, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 9) AS mcc FROM c")
def eval_confusion(spark, sf_dir):
    out = ev.confusion(su.scores(spark, sf_dir), ["fold"], 0.3).select("fold", "tp", "fp", "tn", "fn", "sensitivity", "specificity", "precision", "f1", "mcc")
    return rounded(out, ["sensitivity", "specificity", "precision", "f1", "mcc"], 9)


RANKED = "g AS (SELECT fold, score, count_if(label = 1) AS p, count_if(label = 0) AS q FROM s GROUP BY ALL), c AS (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(q) OVER (PARTITION BY fold ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY fold) AS pa, sum(q) OVER (PARTITION BY fold) AS qa FROM g)"


@query(f"WITH {SCORES}, {RANKED} SELECT fold, round(sum(p / pa * tp / (tp + fp)), 9) AS average_precision FROM c GROUP BY 1")
def eval_average_precision(spark, sf_dir):
    return rounded(ev.ranking_metrics(su.scores(spark, sf_dir), ["fold"]).select("fold", "average_precision"), ["average_precision"], 9)


@query(f"WITH {SCORES}, {RANKED} SELECT fold, round(sum(q * (tp - p + p / 2)) / (max(pa) * max(qa)), 9) AS roc_auc FROM c GROUP BY 1")
def eval_roc_auc(spark, sf_dir):
    return rounded(ev.ranking_metrics(su.scores(spark, sf_dir), ["fold"]).select("fold", "roc_auc"), ["roc_auc"], 9)


@query(f"WITH s0 AS (SELECT 1), {SCORES.replace('user_id % 5', '0')}, {RANKED} SELECT round(sum(p / pa * tp / (tp + fp)), 9) AS average_precision, round(sum(q * (tp - p + p / 2)) / (max(pa) * max(qa)), 9) AS roc_auc FROM c")
def eval_global_ranking(spark, sf_dir):
    return rounded(ev.ranking_metrics(su.scores(spark, sf_dir)).select("average_precision", "roc_auc"), ["average_precision", "roc_auc"], 9)


@query(f"WITH {SCORES.replace('user_id % 5', 'user_id')}, {RANKED} SELECT fold AS user_id, CASE WHEN max(pa) > 0 AND max(qa) > 0 THEN round(sum(p / nullif(pa, 0) * tp / (tp + fp)), 9) END AS average_precision, CASE WHEN max(pa) > 0 AND max(qa) > 0 THEN round(sum(q * (tp - p + p / 2)) / nullif(max(pa) * max(qa), 0), 9) END AS roc_auc FROM c GROUP BY 1")
def eval_per_subject(spark, sf_dir):
    """Users with one class only have nulls."""
    out = ev.ranking_metrics(su.scores(spark, sf_dir), ["user_id"])
    return rounded(out.select("user_id", "average_precision", "roc_auc"), ["average_precision", "roc_auc"], 9)


GRID_SQL = f"t AS (SELECT k AS step, 0.01::DOUBLE + (k - 1) * (0.98::DOUBLE / 198) AS threshold FROM range(1, 200) AS r(k)), m AS (SELECT fold, step, threshold, count_if(score >= threshold AND label = 1) AS tp, count_if(score >= threshold AND label = 0) AS fp, count_if(score < threshold AND label = 0) AS tn, count_if(score < threshold AND label = 1) AS fn FROM s, t GROUP BY ALL)"


@query(f"WITH {SCORES}, {GRID_SQL} SELECT fold, CAST(step AS INTEGER) AS step, tp, fp, tn, fn FROM m")
def eval_threshold_grid(spark, sf_dir):
    return ev.threshold_counts(su.scores(spark, sf_dir), ["fold"]).select("fold", "step", "tp", "fp", "tn", "fn")


@query(f"WITH {SCORES}, {GRID_SQL}, f AS (SELECT fold, threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM m), b AS (SELECT fold, max(f1) AS best FROM f GROUP BY 1), k AS (SELECT f.fold, threshold, f1, best FROM f JOIN b ON f.fold = b.fold WHERE f1 >= best - 1e-12) SELECT fold, round(arg_min(threshold, round(abs(threshold - 0.5), 9) * 10 + threshold * 1e-9), 9) AS threshold, round(max(best), 9) AS f1, count(*) AS tie_count FROM k GROUP BY 1")
def eval_best_threshold(spark, sf_dir):
    return rounded(ev.best_threshold(su.scores(spark, sf_dir), ["fold"]), ["threshold", "f1"], 9)


RUNS = "runs AS (SELECT user_id % 5 AS outer_fold, CAST(floor(user_id / 5) AS BIGINT) % 4 AS inner_fold, CAST(avg(value) AS BIGINT) % 20 + 1 AS best_epoch, avg(value) / 500 AS threshold, stddev_pop(value) / 500 AS average_precision, median(value) / 500 AS roc_auc FROM events GROUP BY ALL)"


def inner_runs(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    g = e.groupBy((F.col("user_id") % 5).alias("outer_fold"), (F.floor(F.col("user_id") / 5) % 4).alias("inner_fold"))
    return g.agg((F.round(F.avg("value"), 0).cast("bigint") % 20 + 1).alias("best_epoch"), (F.avg("value") / 500).alias("threshold"), (F.stddev_pop("value") / 500).alias("average_precision"), (F.median("value") / 500).alias("roc_auc"))


@query(f"WITH {RUNS} SELECT outer_fold, CAST(greatest(1, floor(median(best_epoch) + 0.5)) AS BIGINT) AS epochs, round(median(threshold), 9) AS threshold, round(avg(average_precision), 9) AS mean_ap, round(stddev_samp(average_precision), 9) AS std_ap, round(avg(roc_auc), 9) AS mean_auc, round(stddev_samp(roc_auc), 9) AS std_auc, count(DISTINCT inner_fold) = 4 AS complete FROM runs GROUP BY 1")
def eval_freeze_config(spark, sf_dir):
    return rounded(ev.freeze_configuration(inner_runs(spark, sf_dir)), ["threshold", "mean_ap", "std_ap", "mean_auc", "std_auc"], 9)


@query(f"WITH {SCORES}, f AS (SELECT fold, sum(label) AS p, count(*) AS n FROM s GROUP BY 1), b AS (SELECT fold, (sum(p) OVER () - p) / CAST(sum(n) OVER () - n AS DOUBLE) AS score FROM f) SELECT event_id, fold, round(b.score, 9) AS score FROM s JOIN b USING (fold)")
def eval_prevalence_baseline(spark, sf_dir):
    """Every fold scored by the prevalence in the other ones."""
    return ev.crossfit_prevalence(su.scores(spark, sf_dir).drop("score")).select("event_id", "fold", F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE h AS (SELECT user_id % 20 AS run, CAST(event_id % 40 AS INTEGER) AS epoch, avg(value) AS v FROM events GROUP BY ALL), o AS (SELECT run, epoch, v, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM h),
st AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS best, 0 AS best_epoch, 0 AS wait, 0 AS stop FROM o UNION ALL
  SELECT run, o.i, CASE WHEN stop = 0 AND (best IS NULL OR v > best + 1e-4) THEN v ELSE best END, CASE WHEN stop = 0 AND (best IS NULL OR v > best + 1e-4) THEN epoch ELSE best_epoch END,
  CASE WHEN stop > 0 THEN wait WHEN best IS NULL OR v > best + 1e-4 THEN 0 ELSE wait + 1 END, CASE WHEN stop > 0 THEN stop WHEN best IS NULL OR v > best + 1e-4 THEN 0 WHEN wait + 1 >= 8 THEN epoch ELSE 0 END FROM st JOIN o USING (run) WHERE o.i = st.i + 1)
SELECT run, arg_max(best_epoch, i) AS best_epoch, round(arg_max(best, i), 9) AS best_value, nullif(arg_max(stop, i), 0) AS stopped_at FROM st GROUP BY run""")
def eval_early_stopping(spark, sf_dir):
    h = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("run"), (F.col("event_id") % 40).cast("int").alias("epoch")).agg(F.avg("value").alias("metric"))
    return rounded(rel.early_stopping(h, ["run"], "epoch", "metric", 8, 1e-4), ["best_value"], 9)


@query()
def mdl_predict(spark, sf_dir):
    """Every row scored by the model that was fitted on the other folds."""
    e = load(spark, sf_dir, "embeddings").withColumn("binary_label", (F.col("label") == 0).cast("int"))
    own = F.col("vec_id") % 5
    parts = [md.score_windows(md.fit_windows(e.where(own != f), "embedding", iterations=10), e.where(own == f), "embedding", ["vec_id"]) for f in range(5)]
    return rel.union_all(parts)


# Validation.


@query("SELECT 'unique_line' AS rule_id, 'error' AS severity, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS details FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def val_duplicates(spark, sf_dir):
    return val.duplicates(load(spark, sf_dir, "lineitem"), "unique_line", "l_orderkey", "l_suppkey")


@query("WITH t AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) SELECT 'total' AS rule_id, 'warning' AS severity, CAST(o_orderkey AS VARCHAR) AS key, '' AS details FROM orders LEFT JOIN t ON l_orderkey = o_orderkey WHERE NOT coalesce(abs(o_totalprice - s) <= 1000, FALSE)")
def val_reconcile(spark, sf_dir):
    from ..checks import violations

    totals = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    o = load(spark, sf_dir, "orders")
    joined = o.join(totals, o.o_orderkey == totals.l_orderkey, "left")
    return violations(joined, "total", "warning", F.col("o_orderkey"), F.abs(F.col("o_totalprice") - F.col("s")) > 1000)

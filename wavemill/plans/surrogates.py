"""The engine's operators on the driver's tables.

Events stand in for annotations: a recording is a user's calendar day, an ``error`` event is
an interval, and a day is cut into sliding windows, all in integer microseconds.  Order
lines stand in for channel lists, embeddings for signals, event values for scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as ivl
from ..sources.tables import load

MINUTE = 60_000_000
DAY = 1440 * MINUTE
WINDOW, STRIDE = 240 * MINUTE, 120 * MINUTE
THRESHOLD, NEAR = 0.25, 60 * MINUTE


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their day and microsecond of the day."""
    e = load(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.withColumn("us", us).withColumn("day", F.floor(F.col("us") / DAY)).withColumn("at", F.col("us") - F.col("day") * DAY)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "day").distinct().withColumn("n", F.lit(DAY).cast("bigint"))


def error_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``error`` events as intervals of 1 to 120 minutes within their day."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    length = (1 + F.floor("value") % 120) * MINUTE
    return e.select("user_id", "day", "event_id", F.col("at").alias("start"), F.least(F.col("at") + length, F.lit(DAY)).alias("end"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivl.fixed_windows(recordings(spark, sf_dir), "n", WINDOW, STRIDE)


def labelled(spark: SparkSession, sf_dir: str, dense: int = ivl.DENSE) -> DataFrame:
    keys = ["user_id", "day"]
    found = ivl.window_overlaps(windows(spark, sf_dir), error_intervals(spark, sf_dir).select(*keys, "start", "end"), keys, dense)
    return ivl.label_windows(found, THRESHOLD, NEAR, NEAR)


def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as channel lists: the order is the file, the part's brand the name."""
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return li.select("l_orderkey", "l_partkey", "l_linenumber").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "l_linenumber", "p_brand")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as scores, in [0, 1], and ``error`` as the positive class."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", (F.col("user_id") % 5).alias("fold"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals, one row a sample."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))

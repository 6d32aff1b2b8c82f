"""A block table that is laid out for its joins.

Each block is stored with the samples that follow it, as many as a window reaches beyond its
own block, so that a window's samples are in the one block in which it starts.  The table is
bucketed and sorted by recording and block: windows come to the blocks, and the samples are
neither shuffled nor put together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("recording_id", "block_index")


def with_halo(blocks: DataFrame, halo: int) -> DataFrame:
    """``blocks`` (recording_id, channel_index, block_index, start_sample, samples, ...) with up
    to ``halo`` samples of the next block at the end of each, and ``own``, the number of a
    block's own samples.  Fails if a block that is not the last is shorter than the halo."""
    order = W.partitionBy("recording_id", "channel_index").orderBy("block_index")
    after, second = F.lead("samples").over(order), F.lead("samples", 2).over(order)
    near = blocks.withColumns({"__after": after, "__second": second})
    fine = F.col("__second").isNull() | (F.size("__after") >= halo)
    near = near.where(F.assert_true(fine, F.lit("block shorter than the halo")).isNull())
    more = F.coalesce(F.slice("__after", F.lit(1), F.lit(halo)), F.array().cast(blocks.schema["samples"].dataType))
    return near.withColumn("own", F.size("samples")).withColumn("samples", F.concat("samples", more)).drop("__after", "__second")


def write_block_table(blocks: DataFrame, name: str, halo: int, buckets: int, path: str | None = None) -> DataFrame:
    """Writes ``blocks`` as the table ``name`` (at ``path``, if one is given), bucketed and sorted
    by recording and block, and reads it back."""
    laid = with_halo(blocks, halo).repartition(buckets, *KEYS)
    writer = laid.write.bucketBy(buckets, *KEYS).sortBy(*KEYS).format("parquet").mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return blocks.sparkSession.table(name)


def read_windows(windows: DataFrame, table: DataFrame, block_samples: int) -> DataFrame:
    """``windows`` (recording_id, start_sample, stop_sample_exclusive, ...) with their samples,
    a row a channel.  Only windows are shuffled, to the buckets of the blocks they start in.
    Fails on a window that reaches beyond its recording, or further than the halo."""
    held = table.select(*KEYS, "channel_index", "channel_name", F.col("start_sample").alias("__at"), F.col("samples").alias("__samples"))
    asked = windows.withColumn("block_index", F.floor(F.col("start_sample") / block_samples).cast("bigint"))
    joined = held.join(asked, list(KEYS))
    length = (F.col("stop_sample_exclusive") - F.col("start_sample")).cast("int")
    cut = joined.withColumn("samples", F.slice("__samples", (F.col("start_sample") - F.col("__at") + 1).cast("int"), length))
    full = cut.where(F.assert_true(F.size("samples") == length, F.lit("window beyond its recording or the halo")).isNull())
    return full.select(*windows.columns, "channel_index", "channel_name", "samples")


def table_sample(spark: SparkSession, name: str, windows: DataFrame, block_samples: int, n: int = 50) -> DataFrame:
    """(window_id, samples) of the test load of ``n`` windows, for the window validator."""
    from ..operators.validation import load_sample

    return read_windows(load_sample(windows, n), spark.table(name), block_samples).select("window_id", "samples")

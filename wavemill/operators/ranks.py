"""Numbers that run over a whole table, without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import kept

#: Rows of a range.
RANGE_ROWS = 200_000


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 1, as ``name``.  Rows are dealt to
    ranges, each of which counts on from the rows of those before it.  ``order`` must tell all
    rows apart, or equal ones get their numbers in any order."""
    held = kept(df)
    parts = max(1, -(-held.count() // rows))
    ranged = kept(held.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    # One short row with the size of each range.
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct(F.col("__range").alias("r"), "n")).alias("__sizes"))
    before = F.aggregate(F.filter("__sizes", lambda s: s["r"] < F.col("__range")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    number = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.crossJoin(F.broadcast(sizes)).withColumn(name, before + number).drop("__range", "__sizes")

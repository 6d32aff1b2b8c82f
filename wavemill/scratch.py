"""Tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A folder of the application in ``spark.checkpoint.dir``, which all executors share.
    Where that is unset, a temporary folder on a local master; elsewhere ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavemill-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/wavemill-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and read back: its lineage ends there,
    so that later passes see the same rows and a lost executor costs no recomputation.  With
    ``file_rows``, files have at most as many rows, which bounds what a later task reads."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

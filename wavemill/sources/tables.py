"""Table and file IO: guarded writes, upserts, partition replacement, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import upsert


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, by an explicit schema."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_guarded(df: DataFrame, path: str, overwrite: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Fails if the output is there, unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").csv(path)


def write_upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Keyed upsert of a Parquet table: written beside it, then put in its place by two
    renames.  The old table goes last; a run that was cut short between them is mended by
    the next one."""
    at, beside, before = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at) and store.exists(before):
        store.rename(before, at)
    there = store.exists(at)
    full = upsert(spark.read.parquet(path), new, keys) if there else new
    full.write.mode("overwrite").parquet(f"{path}.new")
    store.delete(before, True)
    if there and not store.rename(at, before) or not store.rename(beside, at):
        raise OSError(f"could not put {path}.new in place")
    store.delete(before, True)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False) -> None:
    """Files in the order of the keys, and rows in order within them."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_signals(spark: SparkSession, blocks: DataFrame, path: str) -> DataFrame:
    """Writes a block table by recording; what comes back are its files' sizes and hashes."""
    blocks.repartition("recording_id").sortWithinPartitions("recording_id", "channel_index", "block_index").write.mode("errorifexists").parquet(path)
    return file_inventory(spark, path, "*.parquet")


def first_files(files: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The first ``n`` files in path order."""
    return files.orderBy(path).limit(n)


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replaces just the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of all files below ``path``, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``ok``, and the dead letters, which keep their schema when there are none."""
    return df.where("ok").drop("ok", "error_type", "error_message"), df.where("NOT ok").select("item", "error_type", "error_message")


def with_provenance(df: DataFrame, commit: str, version: str) -> DataFrame:
    """Columns that are left out of comparisons."""
    return df.withColumns({"git_commit": F.lit(commit), "engine_version": F.lit(version), "created_at": F.current_timestamp()})

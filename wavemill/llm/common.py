"""What the operators share: scratch tables, fingerprints and byte tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; a longer document is taken alone.
TEXT_BLOCK = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.  Where it is
    unset, a temporary folder on a local master; elsewhere that can't be shared: ValueError."""
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


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut
    there, and a lost executor costs no recomputation.  The folder of an application
    can be deleted once it has ended."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``stored``, with the shuffles that led to the table removed as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df)
    finally:
        conf.set(key, before)


def drop_clashes(df: DataFrame, *made: str) -> DataFrame:
    """``df`` without input columns that an operator is about to write (any case)."""
    low = {m.lower() for m in made}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def unit_hash(*cols: Column | str) -> Column:
    """A stable number in [0, 1) from the first 52 bits of an MD5, as any SQL engine gets it."""
    key = F.concat_ws(":", *[c if isinstance(c, Column) else F.col(c) for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_long(*cols: Column | str) -> Column:
    """The first 60 bits of an MD5 as a non-negative long."""
    key = F.concat_ws(":", *[c if isinstance(c, Column) else F.col(c) for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def ascii_words_table(word_digits: bool = True) -> bytes:
    """For ``bytes.translate``: A-Z lower-cased, ASCII that is neither letter nor digit
    to a blank, other bytes (all of UTF-8 beyond ASCII) as they are."""
    out = bytearray(range(256))
    for b in range(128):
        ch = chr(b)
        if ch.isalpha():
            out[b] = ord(ch.lower())
        elif not (word_digits and ch.isdigit()):
            out[b] = 0x20
    return bytes(out)


def text_lists(*columns: pa.Array, limit: int = TEXT_BLOCK, also: tuple[pa.Array, ...] = ()) -> Iterator[list[list]]:
    """The values of text columns of equal length, and of other columns beside them, as
    Python lists of about ``limit`` bytes of text at a time: a task never holds a whole
    batch as Python strings."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        last = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield [c.slice(at, last - at).to_pylist() for c in (*columns, *also)]
        at = last

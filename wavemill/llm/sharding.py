"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots, from two hashes of its name.  Shards
take turns; each claims the first slot of its permutation that is still free.  Slots end
up evenly shared, and few change hands when a shard comes or goes.  The table has a prime
number of rows, fixed by a parameter, so that it can always be broadcast: a document is
placed by one hash and one look-up, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, hash_long

#: A prime much larger than the number of shards, so that shares differ by under 1 %.
SLOTS = 65_537
MAX_SLOTS = 1_048_583


def name_hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("need distinct shard names, at least one and no more than slots")
    if slots > MAX_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime up to {MAX_SLOTS}")
    at = [name_hash(s, "offset") % slots for s in shards]
    skip = [name_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def assign_shards(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``.  Rows with one key share a shard; null keys
    are placed as the empty key; input columns of these names are replaced."""
    spark = docs.sparkSession
    kept = drop_clashes(docs, "slot", "shard")
    table = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(fill_table(shards, slots))], "slot long, shard string")
    placed = kept.withColumn("slot", hash_long(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots)
    return placed.join(F.broadcast(table), "slot").select(*kept.columns, "slot", "shard")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard, one of 64, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return assign_shards(docs, shard_names(64))

"""Resampling, notch filters and re-referencing of the block table, whatever the length of a
recording: blocks are worked on apart from each other, and only what must cross their seams
does, as a few neighbouring samples or as a filter's state.

A recursive filter's state after a block is an affine map of the state before it.  The maps of
all blocks are composed by an associative scan, in two levels: within runs of blocks, then
over the runs, so that no task walks a recording sample by sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import kernels
from ..scratch import kept

KEYS = ("recording_id", "channel_index")
#: Blocks whose maps one task composes.
RUN = 1_000


def resample(blocks: DataFrame, up: int, down: int) -> DataFrame:
    """The signals at ``up`` / ``down`` times their rate, by a polyphase low-pass (sinc under a
    Hamming window, ten periods to either side, unit gain at 0 Hz); zeros beyond the ends.

    Of n samples become ceil(n * up / down): sample m stands where m * down / up did, counted
    from the recording's start, so that the phase follows the absolute sample number and
    blocks need not begin at any multiple.  A block has the outputs that stand in it.  Fails on
    a block shorter than the filter reaches unless it is a recording's first or last one.
    """
    if up < 1 or down < 1:
        raise ValueError("up and down must be at least 1")
    taps = kernels.resample_taps(up, down)
    reach = -(-(len(taps) // 2) // up) + 1
    order = W.partitionBy(*KEYS).orderBy("block_index")
    before, after = F.lag("samples").over(order), F.lead("samples").over(order)
    near = blocks.withColumns({"__before": before, "__after": after})
    fine = F.col("__before").isNull() | F.col("__after").isNull() | (F.size("samples") >= reach)
    near = near.where(F.assert_true(fine, F.lit("block shorter than the filter reaches")).isNull())
    near = near.withColumns({"__before": F.slice("__before", F.greatest(F.lit(1), F.size("__before") - reach + 1), F.lit(reach)), "__after": F.slice("__after", F.lit(1), F.lit(reach))})
    columns = blocks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, starts = [], []
            for start, x, left, right in zip(b["start_sample"], b["samples"], b.pop("__before"), b.pop("__after")):
                left, right = (np.asarray(y if y is not None else [], np.float64) for y in (left, right))
                first, last = -(-start * up // down), -(-(start + len(x)) * up // down)
                out.append(kernels.resample_part(np.concatenate((left, np.asarray(x, np.float64), right)), start - len(left), first, last, up, down, taps).astype(np.float32))
                starts.append(first)
            b["samples"], b["start_sample"], b["sampling_rate_hz"] = out, starts, b["sampling_rate_hz"] * up / down
            yield b[columns]

    schema = blocks.withColumn("sampling_rate_hz", F.col("sampling_rate_hz").cast("double")).schema
    return near.withColumn("sampling_rate_hz", F.col("sampling_rate_hz").cast("double")).mapInPandas(run, schema)


def in_order(df: DataFrame, keys: Sequence[str], order: str, walk: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """What ``walk`` makes of the rows, which come key by key and in order within a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = walk(r for b in batches for r in b.to_pylist())
        while held := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_pylist(held, kind)

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def entry_states(maps: DataFrame, run: int = RUN) -> DataFrame:
    """(keys, seq, z): the state that each block finds, from ``maps`` (keys, seq, a, c): after a
    block the state is a z + c (a: 2 x 2 in rows); it is zero before the first one."""

    def within(rows: Iterator[dict]) -> Iterator[dict]:
        own, map_, add = None, None, None
        for r in rows:
            if (key := (*(r[k] for k in KEYS), r["run"])) != own:
                own, map_, add = key, (1.0, 0.0, 0.0, 1.0), (0.0, 0.0)
            out = {**{k: r[k] for k in (*KEYS, "run", "seq")}, "a": map_, "c": add}
            (p, q, u, v), (x, y), (e, f, g, h) = r["a"], r["c"], map_
            map_, add = (p * e + q * g, p * f + q * h, u * e + v * g, u * f + v * h), (p * add[0] + q * add[1] + x, u * add[0] + v * add[1] + y)
            yield out | {"ta": map_, "tc": add}

    def over(rows: Iterator[dict]) -> Iterator[dict]:
        own, z = None, (0.0, 0.0)
        for r in rows:
            if (key := tuple(r[k] for k in KEYS)) != own:
                own, z = key, (0.0, 0.0)
            yield {**{k: r[k] for k in (*KEYS, "run")}, "z0": z}
            (p, q, u, v), (x, y) = r["ta"], r["tc"]
            z = (p * z[0] + q * z[1] + x, u * z[0] + v * z[1] + y)

    key = ", ".join(f"{k} {maps.schema[k].dataType.simpleString()}" for k in KEYS)
    dealt = maps.withColumn("run", F.floor(F.col("seq") / run))
    parts = kept(in_order(dealt, [*KEYS, "run"], "seq", within, f"{key}, run bigint, seq bigint, a array<double>, c array<double>, ta array<double>, tc array<double>"))
    ends = parts.groupBy(*KEYS, "run").agg(F.max_by(F.struct("ta", "tc"), "seq").alias("t")).select(*KEYS, "run", "t.*")
    starts = in_order(ends, KEYS, "run", over, f"{key}, run bigint, z0 array<double>")
    row = lambda i: F.col("a")[2 * i] * F.col("z0")[0] + F.col("a")[2 * i + 1] * F.col("z0")[1] + F.col("c")[i]
    return parts.join(starts, [*KEYS, "run"]).select(*KEYS, "seq", F.array(row(0), row(1)).alias("z"))


def one_way(blocks: DataFrame, hz: float, quality: float, backward: bool, run: int) -> DataFrame:
    """``blocks`` filtered onward or backward, with their samples as doubles."""

    def alike(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows of one length and rate: where they are, and their samples in filter order."""
        for (n, rate), own in b.groupby([b["samples"].map(len), b["sampling_rate_hz"]]).indices.items():
            x = np.stack([np.asarray(b["samples"].iloc[i], np.float64) for i in own]).reshape(len(own), n)
            yield own, x[:, ::-1] if backward else x, rate

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, c = [None] * len(b), [None] * len(b)
            for own, x, rate in alike(b):
                taps = kernels.notch_taps(rate, hz, quality)
                _, z = kernels.biquad(x, *taps, np.zeros((len(own), 2)))
                power = np.linalg.matrix_power(kernels.biquad_map(*taps), x.shape[1]).ravel()
                for i, row in zip(own, z):
                    a[i], c[i] = power, row
            yield pd.DataFrame({**{k: b[k] for k in KEYS}, "seq": b["block_index"] * (-1 if backward else 1), "a": a, "c": c})

    columns = blocks.columns

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [None] * len(b)
            for own, x, rate in alike(b):
                y, _ = kernels.biquad(x, *kernels.notch_taps(rate, hz, quality), np.stack(b["__z"].iloc[own].to_list()))
                for i, row in zip(own, y[:, ::-1] if backward else y):
                    out[i] = row
            b["samples"] = out
            yield b[columns]

    key = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in KEYS)
    maps = kept(blocks.select(*KEYS, "block_index", "sampling_rate_hz", "samples").mapInPandas(summed, f"{key}, seq bigint, a array<double>, c array<double>"))
    states = entry_states(maps, run).select(*KEYS, (F.col("seq") * (-1 if backward else 1)).alias("block_index"), F.col("z").alias("__z"))
    joined = blocks.join(states, [*KEYS, "block_index"]).select(*columns, "__z")
    return joined.mapInPandas(filtered, blocks.withColumn("samples", F.col("samples").cast("array<double>")).schema)


def notch(blocks: DataFrame, hz: float, quality: float = 30.0, run: int = RUN) -> DataFrame:
    """The signals without ``hz``, by a second-order notch run onward and then backward, so
    that nothing is shifted; its state is zero at both ends of a recording and is carried
    over all seams.  ``quality`` is the frequency over the width of the notch."""
    onward = kept(one_way(blocks.withColumn("samples", F.col("samples").cast("array<double>")), hz, quality, False, run))
    both = one_way(onward, hz, quality, True, run)
    return both.withColumn("samples", F.col("samples").cast(blocks.schema["samples"].dataType)).select(*blocks.columns)


def average_reference(blocks: DataFrame) -> DataFrame:
    """Each channel less the mean of all channels of its recording, sample by sample.  A
    recording's channels have blocks alike; a sample that a channel lacks fails the job."""
    zero = F.transform(F.get(F.col("__all"), F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate("__all", zero, lambda acc, s: F.zip_with(acc, s, lambda a, x: a + x))
    sums = blocks.groupBy("recording_id", "block_index").agg(F.collect_list(F.col("samples").cast("array<double>")).alias("__all"))
    even = F.array_min(F.transform("__all", F.size)) == F.array_max(F.transform("__all", F.size))
    means = sums.where(F.assert_true(even, F.lit("channels of different lengths")).isNull()).select("recording_id", "block_index", F.transform(total, lambda x: x / F.size("__all")).alias("__mean"))
    joined = blocks.join(means, ["recording_id", "block_index"])
    less = F.zip_with("samples", "__mean", lambda x, m: x - m).cast(blocks.schema["samples"].dataType)
    return joined.withColumn("samples", less).select(*blocks.columns)

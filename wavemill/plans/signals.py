"""Registered queries of rate changes, notch filters and references, with their DuckDB SQL.
Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as rs
from .queries import ROWS, query, signal_blocks

SINGLE = "CAST(CAST(y AS FLOAT) AS DOUBLE)"


def summary(blocks, *keys):
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return blocks.select(*keys, F.size("samples").cast("bigint").alias("n"), F.round(F.array_max("samples").cast("double"), 6).alias("top"), F.round(energy, 6).alias("energy"))


@query(f"""WITH {ROWS}, k AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 3) / (pi() * k / 3) END * (0.54 + 0.46 * cos(pi() * k / 30)) AS h FROM range(-30, 31) AS r(k)), s AS (SELECT sum(h) AS s FROM k),
y AS (SELECT vec_id, m, sum(x * h * 3 / s) AS y FROM x, range(0, 96) AS r(m), k, s WHERE k = m * 2 - i * 3 GROUP BY ALL)
SELECT CAST(vec_id AS VARCHAR) AS recording_id, 150.0::DOUBLE AS rate, count(*) AS n, round(max({SINGLE}), 6) AS top, round(sum({SINGLE} * {SINGLE}), 6) AS energy FROM y GROUP BY vec_id""")
def pre_resample(spark, sf_dir):
    """Signals at three halves of their rate."""
    out = rs.resample(signal_blocks(spark, sf_dir, 100.0), 3, 2)
    return summary(out, "recording_id", F.col("sampling_rate_hz").alias("rate"))



def passed(source: str, x: str, order: str, first: int, by: int) -> str:
    """SQL of one run of the notch over (vec_id, i, x), as a recursive table."""
    y = f"g * {x} + p.z1"
    return f"""(SELECT DISTINCT vec_id, {first} AS i, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2 FROM embeddings UNION ALL
SELECT p.vec_id, p.i + {by}, {y}, g * c * {x} - g * c * ({y}) + p.z2, g * {x} - (2 * g - 1) * ({y}) FROM {order} p JOIN {source} s ON s.vec_id = p.vec_id AND s.i = p.i + {by}, q)"""


@query(f"""WITH RECURSIVE {ROWS}, q AS (SELECT 1 / (1 + tan(2 * pi() * 20 / 100 / 30 / 2)) AS g, -2 * cos(2 * pi() * 20 / 100) AS c), f AS {passed("x", "s.x", "f", -1, 1)}, b AS {passed("f", "s.y", "b", 64, -1)}
SELECT CAST(vec_id AS VARCHAR) AS recording_id, count(*) AS n, round(max({SINGLE}), 6) AS top, round(sum({SINGLE} * {SINGLE}), 6) AS energy FROM b WHERE i BETWEEN 0 AND 63 GROUP BY vec_id""")
def pre_notch(spark, sf_dir):
    """Signals at 100 Hz without 20 Hz, filtered onward and backward in blocks of 24 samples
    whose seams the filter's state crosses."""
    whole = signal_blocks(spark, sf_dir, 100.0)
    at = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("b")
    cut = whole.select("*", at).select(
        "recording_id", "channel_index", "channel_name", F.col("b").cast("bigint").alias("block_index"), (F.col("b") * 24).cast("bigint").alias("start_sample"), "sampling_rate_hz", F.slice("samples", F.col("b") * 24 + 1, F.lit(24)).alias("samples")
    )
    out = rs.notch(cut, 20.0, run=2).groupBy("recording_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "samples"))), lambda s: s["samples"])).alias("samples"))
    return summary(out, "recording_id")


@query(f"""WITH {ROWS}, two AS (SELECT vec_id, 0 AS channel_index, i, x FROM x UNION ALL SELECT vec_id, 1, 63 - i, 2 * x FROM x), m AS (SELECT vec_id, i, avg(x) AS m FROM two GROUP BY ALL), y AS (SELECT vec_id, channel_index, x - m AS y FROM two JOIN m USING (vec_id, i))
SELECT CAST(vec_id AS VARCHAR) AS recording_id, channel_index, count(*) AS n, round(max({SINGLE}), 6) AS top, round(sum({SINGLE} * {SINGLE}), 6) AS energy FROM y GROUP BY vec_id, channel_index""")
def pre_reference(spark, sf_dir):
    """Two channels, a signal and twice its reverse, less their mean."""
    one = signal_blocks(spark, sf_dir)
    two = one.withColumns({"channel_index": F.lit(1), "samples": F.transform(F.reverse("samples"), lambda x: (x * 2).cast("float"))})
    return summary(rs.average_reference(one.unionByName(two)), "recording_id", "channel_index")

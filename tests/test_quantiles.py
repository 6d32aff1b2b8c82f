"""Exact quantiles by narrowing against numpy and the built-in function."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import quantiles as qu

WANTED = {"a0": ("a", 0.0), "a25": ("a", 0.25), "a50": ("a", 0.5), "a99": ("a", 0.99), "b50": ("b", 0.5), "b1": ("b", 1.0)}


def rows(n=6000):
    rng = random.Random(5)
    out = []
    for i in range(n):
        kind = ("spread", "ties", "skewed", None)[i % 4]
        a = {"spread": rng.gauss(0, 1e3), "ties": float(rng.random() < 0.4) * (1 if rng.random() < 0.99 else rng.random()), "skewed": 10.0 ** rng.randint(-300, 300), None: -1.5}[kind]
        out.append((kind, a, None if rng.random() < 0.1 else float(rng.randint(-3, 3)), i))
    return out + [("one", 4.25, None, 1), ("none", None, None, 2)]


@pytest.mark.parametrize("few", [20, 700, 100_000])
def test_quantiles(spark, few):
    data = rows()
    df = spark.createDataFrame(data, "kind string, a double, b double, i int").repartition(5)
    got = {r.kind: r for r in qu.quantiles(df, ["kind"], WANTED, few).collect()}
    assert set(got) == {r[0] for r in data}
    for kind in got:
        for name, (c, p) in WANTED.items():
            own = [r[1 if c == "a" else 2] for r in data if r[0] == kind and r[1 if c == "a" else 2] is not None]
            assert getattr(got[kind], name) == (pytest.approx(np.quantile(own, p), rel=1e-12) if own else None), (kind, name)


def test_without_keys(spark):
    df = spark.range(10_001).select((F.col("id") * 7919 % 10_001).cast("double").alias("a"))
    assert [tuple(r) for r in qu.quantiles(df, [], {"q": ("a", 0.5), "r": ("a", 0.0001)}, 50).collect()] == [(5000.0, 1.0)]
    assert qu.quantiles(df.where("a < 0"), ["a"], {"q": ("a", 0.5)}, 50).count() == 0


def test_passes_shrink(spark):
    """What a pass leaves of a large group is a few parts of the sketch."""
    values = spark.range(200_000).select(F.struct(F.lit("x").alias("k")).alias("g"), F.sqrt("id").alias("v"))
    targets = spark.createDataFrame([(("x",), 100_000), (("x",), 7), (("x",), 199_999)], "g struct<k string>, k bigint")
    left, asked = qu.narrow(values, targets)
    assert left.groupBy("g").count().agg(F.max("count")).first()[0] < 200_000 * 7 / qu.PARTS
    found = {r.g.k: r.value for r in qu.order_statistics(left, asked).select("g", "value").collect()}
    assert found == {k: pytest.approx(k**0.5) for k in (100_000, 7, 199_999)}


@pytest.mark.parametrize("few", [20, 100_000])
def test_ranks_between_frequent_values(spark, few):
    """Two values of half the rows each, ten of a tenth, a rare one between two: no pass
    could part them while both ends of a bracket stayed in."""
    halves = spark.range(4000).select(F.struct(F.lit("x").alias("k")).alias("g"), (F.col("id") % 2).cast("double").alias("v"))
    left, _ = qu.narrow(halves, spark.createDataFrame([(("x",), 1999), (("x",), 2000)], "g struct<k string>, k bigint"))
    assert sorted((r.g.k, r.v) for r in left.collect()) == [(1999, 0.0), (2000, 1.0)]
    df = spark.range(4000).select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.cast("double").alias("a")) for n, c in (("two", F.col("id") % 2), ("ten", F.col("id") % 10), ("rare", F.when(F.col("id") == 7, 0.5).otherwise(F.col("id") % 2)))])).alias("x")).select("x.*")
    got = {r.kind: (r.q, r.r) for r in qu.quantiles(df, ["kind"], {"q": ("a", 0.5), "r": ("a", 0.1)}, few).collect()}
    assert got == {"two": (0.5, 0.0), "ten": (4.5, pytest.approx(0.9)), "rare": (0.25, 0.0)}

"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps all distinct values of a group in one task, which is right
for a channel's chunks and not for three labels over a corpus.  A large group is narrowed
instead: a sketch of bounded size gives two values with the wanted rank between them, one
pass counts exactly what is below, at and between them, and what is strictly between is
narrowed again until it is few.  A rank at one of the two values is settled by that, so that
a frequent value ends the search instead of coming back in every pass.  Each pass leaves a
hundredth of the rows or so, sums are partial before they are shuffled, and the outcome is
exact whatever the sketch says: a rank outside the pair is sought on its side of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import kept

#: Rows of a group that the built-in function gets, or that a last pass orders.
FEW = 100_000
#: Parts of a sketch, and its accuracy: a cut's rank is off by less than a part's size.
PARTS, ACCURACY = 256, 2048
#: Groups whose bounds are broadcast; with more, none is a large share of the rows.
GROUPS = 10_000


def null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def with_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    few = bounds.limit(GROUPS + 1).count() <= GROUPS
    return rows.join(F.broadcast(bounds) if few else bounds, "g")


def narrow(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step for ``rows`` (g, v) and ``targets`` (g, k: ranks from 0, in the group's rows):
    what is left of both, with (g, k) as the new g and the rank among what is left.  Of a
    target whose value is known, one row with it is left."""
    parts = F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)])
    sketch = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", parts, F.lit(ACCURACY)).alias("cuts"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.floor(F.col("k") / F.greatest(F.col("n") - 1, F.lit(1)) * PARTS).cast("int")
    near = targets.join(sketch, "g").select("g", "k", "n", "low", "high", F.when(at < 2, F.col("low")).otherwise(F.get("cuts", at - 2)).alias("a"), F.when(at > PARTS - 3, F.col("high")).otherwise(F.get("cuts", at + 3)).alias("b"))
    near = kept(near)
    counted = counts(rows, near.select("g", "a", "b").distinct())
    # Ranks that end before each piece: below a, a itself, between, b itself; beyond b is the rest.
    ends = [F.col("below"), F.col("below") + F.col("lows"), F.col("below") + F.col("lows") + F.col("between"), F.col("below") + F.col("lows") + F.col("between") + F.col("highs")]
    k, none = F.col("k"), F.lit(None).cast("double")
    pieces = [(none, F.col("a"), none, F.lit(0)), (none, none, F.col("a"), k), (F.col("a"), F.col("b"), none, ends[1]), (none, none, F.col("b"), k), (F.col("b"), none, none, ends[3])]

    def chosen(i: int) -> Column:
        out = F.when(k < ends[0], pieces[0][i])
        for end, piece in zip(ends[1:], pieces[1:]):
            out = out.when(k < end, piece[i])
        return out.otherwise(pieces[4][i])

    bounds = kept(near.join(counted, ["g", "a", "b"]).select("g", "k", chosen(0).alias("over"), chosen(1).alias("under"), chosen(2).alias("value"), chosen(3).cast("bigint").alias("below")))
    lists = bounds.where("value IS NULL").groupBy("g").agg(F.collect_list(F.struct("k", "over", "under")).alias("x"))
    inside = F.filter("x", lambda t: (t["over"].isNull() | (F.col("v") > t["over"])) & (t["under"].isNull() | (F.col("v") < t["under"])))
    left = with_bounds(rows, lists).select(F.col("g").alias("was"), "v", F.explode(inside).alias("t")).select(F.struct("was", F.col("t.k").alias("k")).alias("g"), "v")
    known = bounds.where("value IS NOT NULL").select(F.struct(F.col("g").alias("was"), "k").alias("g"), F.col("value").alias("v"))
    return kept(left.unionByName(known)), bounds.select(F.struct(F.col("g").alias("was"), "k").alias("g"), (F.col("k") - F.col("below")).alias("k"))


def counts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, a, b, below, lows, between, highs): rows of g below a, at a, between, and at b if
    that is another value."""
    lists = pairs.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("x"))
    met = with_bounds(rows, lists).select("g", "v", F.explode("x").alias("t"))
    v, a, b = F.col("v"), F.col("t.a"), F.col("t.b")
    each = {"below": v < a, "lows": v == a, "between": (v > a) & (v < b), "highs": (v > a) & (v == b)}
    return met.groupBy("g", a.alias("a"), b.alias("b")).agg(*[F.count_if(c).alias(n) for n, c in each.items()])


def order_statistics(rows: DataFrame, targets: DataFrame, few: int = FEW) -> DataFrame:
    """(g, k, value): the value of rank k, from 0, among the rows (g, v) of each g."""
    first, depth = targets, 0
    while True:
        most = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").agg(F.max("n").alias("n")).first()["n"]
        if most is None or (most <= few and depth):
            break
        rows, targets = narrow(rows, targets)
        depth += 1
    # Of groups that are one value, or few: the first value that enough rows don't exceed.
    upto = F.sum("n").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    values = rows.groupBy("g", "v").agg(F.count("*").alias("n")).withColumn("upto", upto)
    found = values.join(targets, "g").where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
    if not depth:
        return found.select("g", "k", F.col("v").alias("value"))
    inner = F.col("g")
    for _ in range(depth - 1):
        inner = inner["was"]
    return first.join(found.select(inner["was"].alias("g"), inner["k"].alias("k"), F.col("v").alias("value")), ["g", "k"])


def selected(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], few: int = FEW) -> DataFrame:
    """One row a group: keys and the ``wanted`` quantiles (name: column, share), interpolated
    between neighbours; null where a column has no values."""
    columns = sorted({c for c, _ in wanted.values()})
    held = kept(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns]))
    group = F.struct(*keys, F.col("x.c").alias("__c"))
    rows = held.select(*keys, each.alias("x")).where("x.v IS NOT NULL").select(group.alias("g"), F.col("x.v").alias("v"))
    sizes = kept(rows.groupBy("g").agg(F.count("*").alias("n")))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("c"), F.lit(float(p)).alias("p")) for name, (c, p) in wanted.items()]))
    places = sizes.select("g", "n", asked.alias("a")).where("a.c = g.__c").select("g", F.col("a.name").alias("name"), (F.col("a.p") * (F.col("n") - 1)).alias("h"))
    ranks = places.select("g", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k")).distinct()
    found = kept(order_statistics(rows, kept(ranks), few))
    both = places.join(found.select("g", F.col("k").alias("__k"), F.col("value").alias("x0")), (places["g"] == found["g"]) & (F.floor("h") == F.col("__k"))).select(places["g"], "name", "h", "x0")
    both = both.join(found.select(F.col("g").alias("__g"), F.col("k").alias("__k"), F.col("value").alias("x1")), (F.col("g") == F.col("__g")) & (F.ceil("h") == F.col("__k")))
    low, high = F.floor("h"), F.ceil("h")
    value = F.when(low == high, F.col("x0")).otherwise((high - F.col("h")) * F.col("x0") + (F.col("h") - low) * F.col("x1"))
    wide = both.select(*[F.col(f"g.{k}").alias(k) for k in keys], "name", value.alias("value")).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])
    all_keys = held.select(*keys).distinct().select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    return all_keys.join(wide, null_safe([f"__k_{k}" for k in keys], keys), "left").select(*[F.col(f"__k_{k}").alias(k) for k in keys], *wanted)


def quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], few: int = FEW) -> DataFrame:
    """One row a group with its exact quantiles, as ``percentile`` has them.  Groups with more
    than ``few`` rows are narrowed, the others left to the built-in function.  Without keys,
    all rows are one group."""
    if not keys:
        return quantiles(df.withColumn("__all", F.lit(0)), ["__all"], wanted, few).drop("__all")
    exact = [F.percentile(c, F.lit(float(p))).alias(n) for n, (c, p) in wanted.items()]
    large = kept(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > few).select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    if large.isEmpty():
        return df.groupBy(*keys).agg(*exact)
    match = null_safe(keys, [f"__k_{k}" for k in keys])
    small = df.join(large, match, "left_anti").groupBy(*keys).agg(*exact)
    return small.unionByName(selected(df.join(large, match, "left_semi"), keys, wanted, few))

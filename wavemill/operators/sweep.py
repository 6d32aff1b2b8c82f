"""Sweeps over the edges of intervals and windows, for recordings of any length.

The edges of all recordings are dealt to ranges of equal size, ordered by recording and
position, so that a long recording is many ranges and a range has many short recordings.
What a sweep carries along (sums, the last end seen, the next start) is worked out within
each range; the few totals of the ranges are carried on from one to the next.  n edges take
n log n steps, whatever overlaps whatever, and no pairs are made.

At one position, ends come first, then points that are asked about, then starts: intervals
are half-open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import kept

#: Order of the edges at one position.
END, POINT, START = 0, 1, 2
#: Edges of a range.
RANGE_ROWS = 200_000
#: Edges of a stored file: rows that compress well would else come to a task by the ten million.
FILE_ROWS = 50_000


def all_set(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def ranged(edges: DataFrame, keys: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``edges`` (keys, __pos, __kind, ...) with the number of their range, stored."""
    held = kept(edges, FILE_ROWS)
    parts = max(1, -(-held.count() // rows))
    # The last column parts what stands at one position.
    dealt = held.withColumn("__tie", F.xxhash64(*held.columns)).repartitionByRange(parts, *keys, "__pos", "__kind", "__tie")
    return kept(dealt.withColumn("__range", F.spark_partition_id()), FILE_ROWS)


def spread(edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Ranged edges dealt to as many tasks as they have ranges, and that number: a task's rows
    don't grow with the table then, as they do with a fixed number of shuffle partitions."""
    last = edges.agg(F.max("__range").alias("n")).first()["n"]
    parts = 1 + (last or 0)
    return edges.repartition(parts, "__range", *keys), parts


def carried(edges: DataFrame, keys: Sequence[str], **running: dict[str, Column]) -> DataFrame:
    """``edges`` with running values within ``keys``, by kind and name:

    ``sums`` over an edge and those before it, ``latest`` (the largest) over the same,
    ``earlier`` (the largest) over those before it only, ``following`` (the least) over it and
    those after it, ``totals`` over all.  Sums of nothing are 0, the others null."""
    sums, latest, earlier, following, totals = (running.get(k, {}) for k in ("sums", "latest", "earlier", "following", "totals"))
    largest = {**latest, **earlier}
    parts = edges.groupBy("__range", *keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in {**sums, **totals}.items()], *[F.max(c).alias(n) for n, c in largest.items()], *[F.min(c).alias(n) for n, c in following.items()]
    )
    by = W.partitionBy(*keys)
    before, after = by.orderBy("__range").rowsBetween(W.unboundedPreceding, -1), by.orderBy("__range").rowsBetween(1, W.unboundedFollowing)
    brought = parts.select(
        F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keys], F.count("*").over(by).alias("__spans"), *[F.sum(n).over(before).alias(f"__b_{n}") for n in sums], *[F.max(n).over(before).alias(f"__b_{n}") for n in largest],
        *[F.min(n).over(after).alias(f"__b_{n}") for n in following], *[F.sum(n).over(by).alias(f"__b_{n}") for n in totals],
    ).where("__spans > 1").drop("__spans")
    match = F.col("__range") == F.col("__r")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # Only a range's first and last keys go on in other ranges: two rows a range at most.
    joined = edges.join(F.broadcast(brought), match, "left").drop("__r", *[f"__k_{k}" for k in keys])
    order = ["__pos", "__kind", "__tie"]
    whole = W.partitionBy("__range", *keys)
    onward, backward = (whole.orderBy(*o) for o in (order, [F.desc(c) for c in order]))
    upto, below = onward.rowsBetween(W.unboundedPreceding, 0), onward.rowsBetween(W.unboundedPreceding, -1)
    made = {n: F.coalesce(F.col(f"__b_{n}"), F.lit(0)) + F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
    made |= {n: F.greatest(F.col(f"__b_{n}"), F.max(c).over(upto)) for n, c in latest.items()}
    made |= {n: F.greatest(F.col(f"__b_{n}"), F.max(c).over(below)) for n, c in earlier.items()}
    # Backwards in the reversed order: a frame that grows is cheaper than one that shrinks.
    made |= {n: F.least(F.col(f"__b_{n}"), F.min(c).over(backward.rowsBetween(W.unboundedPreceding, 0))) for n, c in following.items()}
    made |= {n: F.coalesce(F.col(f"__b_{n}"), F.sum(c).over(whole), F.lit(0)) for n, c in totals.items()}
    return joined.withColumns(made).drop(*[f"__b_{n}" for n in made])


def placed(df: DataFrame, keys: Sequence[str], pos: str, kind: int, **rest: Column) -> DataFrame:
    return df.select(*keys, F.col(pos).cast("long").alias("__pos"), F.lit(kind).alias("__kind"), *[c.alias(n) for n, c in rest.items()])


def points_of(asked: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Two points of each row, told apart by ``__at`` (s, e), with its number ``__id``; the
    first carries the row."""
    numbered = asked.select(*keys, start, end, F.struct(*[F.col(c) for c in asked.columns]).alias("__row"), F.monotonically_increasing_id().alias("__id"))
    both = F.array(*[F.struct(F.lit(a).alias("at"), F.col(c).cast("long").alias("pos")) for a, c in (("s", start), ("e", end))])
    return numbered.select(*keys, "__row", "__id", F.explode(both).alias("p")).select(*keys, F.col("p.pos").alias("__pos"), F.lit(POINT).alias("__kind"), "__id", F.col("p.at").alias("__at"), F.when(F.col("p.at") == "s", F.col("__row")).alias("__row"))


def together(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def put_back(points: DataFrame, parts: int, **values: Column) -> DataFrame:
    """One row for each row that was asked about, with ``values`` gathered from its points, in
    ``parts`` tasks."""
    return points.where(F.col("__kind") == POINT).repartition(parts, "__id").groupBy("__id").agg(F.any_value("__row", ignoreNulls=True).alias("__row"), *[c.alias(n) for n, c in values.items()])


def at(point: str, value: Column | str) -> Column:
    """The value at one of a row's two points."""
    return F.max(F.when(F.col("__at") == point, F.col(value) if isinstance(value, str) else value))


def swept_overlaps(windows: DataFrame, intervals: DataFrame, keys: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``windows`` with ``overlap``, ``nearest`` and ``n_intervals`` as of ``window_overlaps``.

    What is covered up to a position is a running sum: of the steps between neighbouring
    edges, those at which some interval is open.  A window's overlap is the difference of its
    two points; if it is 0, the last end before it and the first start after it are nearest.
    Intervals whose end is not beyond their start are left out."""
    fine = intervals.where(all_set(keys) & (F.col("end") > F.col("start")))
    sides = [placed(fine, keys, "start", START, __delta=F.lit(1)), placed(fine, keys, "end", END, __delta=F.lit(-1))]
    edges, parts = spread(ranged(together(points_of(windows, "window_start", "window_end", keys), *sides), keys, rows), keys)
    pos, kind, delta = F.col("__pos"), F.col("__kind"), F.coalesce("__delta", F.lit(0))
    opened = carried(edges, keys, sums={"__open": delta}, latest={"__end": F.when(kind == END, pos)}, earlier={"__from": pos}, following={"__next": F.when(kind == START, pos)})
    was_open = F.col("__open") - delta > 0
    # A start opens a merged interval unless one is open or has just ended there.
    opens = (kind == START) & ~was_open & (F.col("__end").isNull() | (F.col("__end") < pos))
    marked = opened.withColumns({"__step": F.when(was_open, pos - F.col("__from")).otherwise(0), "__new": opens.cast("int")})
    covered = carried(marked, keys, sums={"__covered": F.col("__step")}, totals={"__all": F.col("__new")})
    out = put_back(covered, parts, overlap=at("e", "__covered") - at("s", "__covered"), before=at("s", pos - F.col("__end")), after=at("e", F.col("__next") - pos), n_intervals=F.max("__all"))
    nearest = F.when(F.col("overlap") > 0, F.lit(0)).otherwise(F.least("before", "after"))
    return out.select("__row.*", "overlap", nearest.cast("long").alias("nearest"), F.col("n_intervals").cast("int").alias("n_intervals"))


def swept_coverage(intervals: DataFrame, windows: DataFrame, keys: Sequence[str], interval_id: str, rows: int = RANGE_ROWS) -> DataFrame:
    """For each interval, the windows that overlap it, by label, as of ``interval_coverage``:
    those that start before its end, less those that end by its start."""
    labels = ("ictal", "boundary")
    fine = windows.where(all_set(keys) & (F.col("window_end") > F.col("window_start")))
    sides = [placed(fine, keys, c, kind, label_name=F.col("label_name")) for c, kind in (("window_start", START), ("window_end", END))]
    edges, parts = spread(ranged(together(points_of(intervals.select(*keys, interval_id, "start", "end"), "start", "end", keys), *sides), keys, rows), keys)
    kind, named = F.col("__kind"), {"overlapping": F.lit(True), **{v: F.coalesce(F.col("label_name") == v, F.lit(False)) for v in labels}}
    counts = carried(edges, keys, sums={f"__{side}_{n}": ((kind == k) & c).cast("long") for side, k in (("started", START), ("ended", END)) for n, c in named.items()})
    out = put_back(counts, parts, **{f"{n}_windows": at("e", f"__started_{n}") - at("s", f"__ended_{n}") for n in named})
    return out.select(*[F.col(f"__row.{c}").alias(c) for c in (*keys, interval_id)], *[f"{n}_windows" for n in named]).withColumn("has_ictal", F.col("ictal_windows") > 0)


def swept_most(chunks: DataFrame, intervals: DataFrame, keys: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``chunks`` (apart from each other, within ``keys``) with ``most``: what the one interval
    that covers most of it covers.

    That is one that is open at the chunk's start and ends last, one that is open at its end
    and starts first, or the longest that starts and ends inside; the last kind is found by
    the chunk whose start was the last one before the interval's."""
    fine = intervals.where(all_set(keys) & (F.col("end") > F.col("start")))
    sides = [placed(fine, keys, c, kind, start=F.col("start"), end=F.col("end")) for c, kind in (("start", START), ("end", END))]
    points = points_of(chunks, "window_start", "window_end", keys).withColumn("__until", F.col("__row.window_end").cast("long"))
    edges, parts = spread(ranged(together(points, *sides), keys, rows), keys)
    pos, kind = F.col("__pos"), F.col("__kind")
    # Points come before starts: an interval that starts with a chunk is inside it.
    chunk = F.struct(pos.alias("pos"), F.col("__id").alias("id"), F.col("__until").alias("until"))
    found = carried(edges, keys, latest={"__end": F.when(kind == START, F.col("end")), "__chunk": F.when(F.col("__at") == "s", chunk)}, following={"__start": F.when(kind == END, F.col("start"))})
    inside = found.where((kind == START) & (F.col("end") <= F.col("__chunk.until"))).groupBy(F.col("__chunk.id").alias("__id")).agg(F.max(F.col("end") - F.col("start")).alias("__inner"))
    out = put_back(found, parts, s=at("s", "__pos"), e=at("e", "__pos"), last=at("s", "__end"), first=at("e", "__start")).join(inside, "__id", "left")
    over = F.when(F.col("last").isNotNull(), F.least("last", "e") - F.col("s"))
    under = F.when(F.col("first").isNotNull(), F.col("e") - F.greatest("first", "s"))
    most = F.greatest(F.lit(0).cast("long"), over, under, "__inner")
    return out.select("__row.*", most.alias("most"))

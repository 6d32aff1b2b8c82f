"""Embedding whitening from a bit-sliced scatter matrix.

Components become integers.  In a task, each dimension's integers, shifted to start at 0, are
cut into bit planes, and a plane's bits over all rows are packed into 64-bit words.  The
product of two dimensions summed over rows is then a sum of AND-popcounts of their planes,
each weighted by a power of two: exact, without one multiplication of components.  The
products are summed over tasks and centred as integers; floating point begins with the
eigenvectors of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, stored

#: Components are floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components kept by default.
KEPT = 8
#: Rows whose bits are packed at once.
ROWS = 1 << 15
#: A component whose variance is less than this share of the largest has none.
NO_VARIANCE = 1e-12
LONG = (1 << 63) - 1


def whole_numbers(vector: Column) -> Column:
    """The integers of a vector; null if it is null, empty, or holds a null or non-finite entry.
    A component that is beyond a long so scaled fails the job."""
    c = F.transform(vector, lambda x: x.cast("double"))
    fine = (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def scaled(x: Column) -> Column:
        y = F.floor(x * SCALE) + OFFSET
        return F.when(F.abs(x) < float(1 << 52), y).otherwise(F.raise_error(F.lit("a component is beyond a long once it is scaled")).cast("long"))

    return F.when(fine, F.transform(F.when(fine, c), scaled))


def matrix_of(lists: pa.Array) -> np.ndarray:
    """The rows of an array of lists of one length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def bit_planes(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The non-zero planes of a row of numbers of 0 or more: (weight's exponent, packed words)."""
    out = []
    for b in range(int(x.max()).bit_length() if len(x) else 0):
        bits = np.packbits((x >> b) & 1 == 1, bitorder="little")
        words = np.zeros(-(-len(bits) // 8) * 8, dtype=np.uint8)
        words[: len(bits)] = bits
        out.append((b, words.view(np.uint64)))
    return out


def bit_sliced_products(x: np.ndarray) -> np.ndarray:
    """Sum over rows of x[:, i] * x[:, j] for i <= j, of numbers of 0 or more, as Python integers.

    The planes of all dimensions lie in one array, so that one AND and popcount meets a plane
    with all planes of the dimensions from its own on."""
    dims = x.shape[1]
    planes = [(d, b, w) for d in range(dims) for b, w in bit_planes(x[:, d])]
    out = np.zeros((dims, dims), dtype=object)
    if not planes:
        return out
    dim, weight = np.array([p[0] for p in planes]), np.array([p[1] for p in planes])
    words = np.stack([p[2] for p in planes])
    first = np.searchsorted(dim, np.arange(dims))
    wide = int(weight.max()) * 2 + int(len(x)).bit_length() + 1 >= 63
    for i, d in enumerate(dim.tolist()):
        at = int(first[d])
        ones = np.bitwise_count(words[at:] & words[i]).sum(axis=1, dtype=np.int64)
        part = np.zeros(dims, dtype=object if wide else np.int64)
        np.add.at(part, dim[at:], ones.astype(object) * [1 << int(w) for w in weight[at:]] if wide else ones << weight[at:])
        out[d] += part.astype(object) * (1 << int(weight[i]))
    return out


def scatter(x: DataFrame, low: list[int]) -> DataFrame:
    """(i, j, total) for i <= j: the exact sums of (x_i - low_i) * (x_j - low_j) over all rows
    of ``x``, as decimals."""
    shift = np.array(low, dtype=np.int64)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, rows = np.zeros((len(shift), len(shift)), dtype=object), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(matrix_of(batch.column(0)) - shift)
                rows += batch.num_rows
            if rows >= ROWS:
                total += bit_sliced_products(np.concatenate(held))
                held, rows = [], 0
        if held:
            total += bit_sliced_products(np.concatenate(held))
        i, j = np.triu_indices(len(shift))
        if any(total[i, j]):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([Decimal(v) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "total"])

    return x.select("x").mapInArrow(tasks, "i long, j long, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))


class Whitening:
    """What is fitted: rows n, sums S, unit eigenvectors (rows, by falling eigenvalue), their
    eigenvalues and the trace, in double precision."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.vectors, self.values, self.trace = n, sums, vectors, values, trace


def fit_whitening(x: DataFrame, kept: int = KEPT) -> Whitening:
    """Fit on a table with integer vectors ``x`` of one length.  The driver holds the sums
    and products of dimensions, never rows."""
    stats = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("low"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not stats:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, low, sums, dims = stats[0]["n"], [r["low"] for r in stats], [int(r["s"]) for r in stats], len(stats)
    shifted = [s - n * m for s, m in zip(sums, low)]
    cov = np.zeros((dims, dims))
    for r in scatter(x, low).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = float(Fraction(n * int(r["total"]) - shifted[r["i"]] * shifted[r["j"]], n * n))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:kept]
    return Whitening(n, sums, vectors.T[order], values[order], float(np.trace(cov)))


def apply_whitening(rows: DataFrame, fit: Whitening) -> DataFrame:
    """``rows`` with ``deviation`` (decimal: the sum over dimensions of (n*x - S)^2) and
    ``white`` (their whitened components, null where a component has no variance)."""
    n, sums = fit.n, np.array(fit.sums, dtype=object)
    scale = np.array([1 / np.sqrt(v) if v > NO_VARIANCE * max(fit.values) else np.nan for v in fit.values])
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["deviation decimal(38,0)", "white array<double>"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"))
            most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(s)) for s in sums)
            # In longs where all of them fit, else in Python's integers.
            small = most < 2**62 and most * most * x.shape[1] < LONG
            centred = x * np.int64(n) - sums.astype(np.int64) if small else x.astype(object) * n - sums
            deviation = (centred * centred).sum(axis=1)
            white = (centred.astype(np.float64) / n) @ fit.vectors.T * scale
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), pa.array(white.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([Decimal(int(d)) for d in deviation], pa.decimal128(38, 0)), lists], [*names, "deviation", "white"])

    return rows.mapInArrow(apply, schema)


def identity_error(white: DataFrame, size: int) -> Column | float:
    """The largest absolute entry of the covariance of ``white`` (arrays) minus the identity,
    over the components that have variance; 0 if there are none."""
    means = white.select(*[F.avg(F.get("white", F.lit(i))).alias(f"m{i}") for i in range(size)]).first()
    held = [i for i in range(size) if means[i] is not None]
    centred = {i: F.get("white", F.lit(i)) - F.lit(means[i]) for i in held}
    pairs = [(i, j) for i in held for j in held if i <= j]
    if not pairs:
        return 0.0
    found = white.select(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", kept: int = KEPT) -> DataFrame:
    """One row for each vector and each of its first ``kept`` components: key, component (from
    1), n, deviation (null if beyond a long; ``deviation_exact`` has it whole), whitened,
    explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries take no part, nor do
    those of another length than most have (of lengths as frequent, the longer one).  Rows
    that repeat and rows without a key count each.  Components of the fit without variance
    are null in ``whitened`` and not in the identity.  A component of 2^52 or more in size,
    and sums beyond 38 digits, fail the job.  No vectors, no rows.
    """
    kept_key = drop_clashes(vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")), "x")
    rows = kept_key.select("__key", whole_numbers(F.col("__vector")).alias("x")).where("x IS NOT NULL")
    rows = stored(rows.withColumn("dims", F.size("x")))
    most = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    rows = rows.where(F.col("dims") == (most["dims"] if most else 0)).select("__key", "x")
    fit = fit_whitening(rows, kept)
    size = len(fit.values)
    if not size:
        return rows.where("false").selectExpr(f"__key AS `{key}`", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("deviation_exact", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    white = stored(apply_whitening(rows, fit).drop("x"))
    error = identity_error(white, size)
    share = F.array(*[F.lit(float(v / fit.trace) if fit.trace else 0.0) for v in fit.values])
    out = white.select("__key", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(
        F.col("__key").alias(key), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), F.when(F.col("deviation") <= LONG, F.col("deviation")).cast("long").alias("deviation"), "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers.  The index holds, for blocks of rows, one bitmap a row
and bit: the word of bit b has the b-th bits of the row's components.  The inner product
of two vectors is then a sum over pairs of bits of the population count of the AND of two
words.  A query adds the attribute slices from the most significant one downward; after
each slice, what the lower ones can still add is bounded, and rows whose upper bound is
below the k-th lower bound are dropped.  The few rows at the boundary are resolved on the
integers themselves.

The index is built once: rows and queries are packed into blocks of bounded size, with their
slices, and stored.  Blocks of rows are dealt to groups, and the blocks of queries, which are
few, are copied to each group, so that an equi-join on the group's number brings every block
of queries to every block of rows once.  A task carries each query's k best scores from block
to block as the bound to beat, and only what beats it goes on to the final ranking.

Vectors with a component too large for the index have blocks of their own.  Their scores are
bounded by floating point and its rounding error, and what is left is resolved on Python's
integers, which have no largest value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Quantised components of the index are below this: products over 8192 dimensions fit a long.
LIMIT = 1 << 25
PACKED = "n long, dims int, wide boolean, bits int, ids binary, numbers binary, slices binary"
#: Blocks of rows in a group, and bytes of query blocks up to which they are broadcast.
GROUP_BLOCKS, BROADCAST_BYTES = 64, 64 << 20
LONG = 1 << 63


def usable(vector: str) -> Column:
    """No null, and no component that is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def order_of(vector: str, scale: int) -> Column:
    """What orders vectors as their quantised forms; beyond 2**53, doubles are whole numbers."""

    def part(x: Column) -> Column:
        y = x * scale
        return F.struct(F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y).alias("y"), F.when(F.abs(y) == float("inf"), x).alias("x"))

    return F.transform(vector, part)


def pack(block: int, scale: int):
    """Rows (id, v) into blocks of up to ``block`` rows; shorter vectors are filled with zeros.
    Numbers are quantised and sliced, but in blocks of ``wide`` rows, which hold the vectors
    themselves."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                v = part["v"]
                sizes = np.diff(v.offsets.to_numpy())
                dims = int(sizes.max(initial=1)) or 1
                x = np.zeros((part.num_rows, dims))
                x[np.arange(dims) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
                ids = part["id"].to_numpy(zero_copy_only=False).astype(np.int64)
                with np.errstate(over="ignore"):
                    large = (np.abs(x * scale) >= LIMIT).any(axis=1)
                for wide in (False, True):
                    if (own := large == wide).any():
                        numbers = x[own] if wide else np.floor(x[own] * scale).astype(np.int32)
                        bits = 0 if wide else width(numbers)
                        sliced = b"" if wide else slices(numbers, bits).tobytes()
                        columns = {"n": pa.array([int(own.sum())], pa.int64()), "dims": pa.array([dims], pa.int32()), "wide": pa.array([wide]), "bits": pa.array([bits], pa.int32())}
                        yield pa.RecordBatch.from_pydict(columns | {c: pa.array([v], pa.binary()) for c, v in (("ids", ids[own].tobytes()), ("numbers", numbers.tobytes()), ("slices", sliced))})

    return packed


def unpack(numbers: bytes, wide: bool, n: int, own: int, dims: int) -> np.ndarray:
    """A block's numbers, filled from its ``own`` to ``dims`` dimensions."""
    out = np.zeros((n, dims), dtype=np.float64 if wide else np.int32)
    out[:, :own] = np.frombuffer(numbers, dtype=out.dtype).reshape(n, -1)
    return out


def floats(numbers: np.ndarray, scale: int) -> np.ndarray:
    """The quantised numbers as floats; infinite where a product with ``scale`` is."""
    with np.errstate(over="ignore"):
        return np.floor(numbers * scale) if numbers.dtype == np.float64 else numbers.astype(np.float64)


def whole(numbers: np.ndarray, scale: int) -> list[int]:
    """The quantised numbers of one vector."""
    if numbers.dtype != np.float64:
        return numbers.tolist()
    return [int(y) if np.isfinite(y) else int(x) * scale for x, y in zip(numbers.tolist(), floats(numbers, scale).tolist())]


def slices(numbers: np.ndarray, bits: int) -> np.ndarray:
    """(bit, row, word): the two's-complement bits of the components, packed over dimensions."""
    rows, dims = numbers.shape
    words = -(-dims // 64)
    out = np.zeros((bits, rows, words * 8), dtype=np.uint8)
    for b in range(bits):
        out[b, :, : -(-dims // 8)] = np.packbits(((numbers >> b) & 1).astype(np.uint8), axis=1)
    return out.view(np.uint64)


def width(numbers: np.ndarray) -> int:
    """Bits that two's complement needs for all the numbers."""
    return max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)) - 1, 1).bit_length() + 1


def best_rows(index: np.ndarray, query_bits: np.ndarray, query: np.ndarray, allowed: np.ndarray, k: int, known: int | None) -> np.ndarray:
    """Rows that may be among the k best: attribute slices from the top, with bounds.  Rows
    below ``known``, the k-th best score of earlier blocks, are not among them."""
    bits, rows, _ = index.shape
    negative, positive = int(query[query < 0].sum()), int(query[query > 0].sum())
    alive = np.flatnonzero(allowed)
    score = np.zeros(len(alive), dtype=np.int64)
    signs = [-(1 << c) if c == len(query_bits) - 1 else 1 << c for c in range(len(query_bits))]
    for b in range(bits - 1, -1, -1):
        if len(alive) <= 4 * k and (known is None or not len(alive)):
            break
        own = index[b] if len(alive) == rows else index[b, alive]
        part = np.zeros(len(alive), dtype=np.int64)
        for sign, q in zip(signs, query_bits):
            part += sign * np.bitwise_count(own & q).sum(axis=1, dtype=np.int64)
        score += (-(1 << b) if b == bits - 1 else 1 << b) * part
        rest = (1 << b) - 1
        low = score + rest * negative
        bound = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else None
        if known is not None:
            bound = known if bound is None else max(bound, known)
        stay = score + rest * positive >= bound if bound is not None else np.ones(len(alive), dtype=bool)
        if not stay.all():
            alive, score = alive[stay], score[stay]
    return alive


def best_wide(rows: np.ndarray, query: np.ndarray, ids: np.ndarray, own: int, k: int, scale: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows, of any magnitude."""
    alive = np.flatnonzero(ids != own)
    if len(alive) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            v, q = floats(rows[alive], scale), floats(query, scale)
            # Far above the rounding error of a sum of products, in whatever order.
            score, slack = v @ q, (np.abs(v) @ np.abs(q)) * ((len(q) + 8) * 2.0**-51)
            low, high = score - slack, score + slack
        if np.isfinite(low).all() and np.isfinite(high).all():
            alive = alive[high >= np.partition(low, len(low) - k)[len(low) - k]]
    q = whole(query, scale)
    exact = [(sum(a * b for a, b in zip(whole(rows[i], scale), q)), int(ids[i])) for i in alive]
    return sorted(exact, key=lambda x: (-x[0], x[1]))[:k]


def as_long(score: int, query_id: int, vec_id: int) -> int | None:
    """A score above a long is among the k best of all rows, or k larger ones are; one below
    may yet be outranked, and is null till then."""
    if score >= LONG:
        raise OverflowError(f"the score of query {query_id} and row {vec_id}, {score}, exceeds a long")
    return score if score >= -LONG else None


def search(k: int, scale: int):
    """For blocks of rows and of queries side by side: (query_id, vec_id, score), the rows of
    the block that may be among the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The k best scores so far of the queries of a block, by the block's ids.
        carried: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, own = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["q_ids"], dtype=np.int64)
                dims = max(r["dims"], r["q_dims"])
                rows = unpack(r["numbers"], r["wide"], len(ids), r["dims"], dims)
                queries = unpack(r["q_numbers"], r["q_wide"], len(own), r["q_dims"], dims)
                if r["wide"] or r["q_wide"]:
                    best = [(int(o), i, as_long(s, int(o), i)) for q, o in zip(queries, own) for s, i in best_wide(rows, q, ids, o, k, scale)]
                    yield pa.RecordBatch.from_arrays([pa.array([b[c] for b in best], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])
                    continue
                index, asked = (words(r[f"{p}slices"], r[f"{p}bits"], n, dims) for p, n in (("", len(ids)), ("q_", len(own))))
                seen = carried.setdefault(r["q_ids"], np.full((len(own), k), -LONG, dtype=np.int64))
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for j, q in enumerate(queries):
                    known = int(seen[j, 0]) if seen[j, 0] > -LONG else None
                    left = best_rows(index, asked[:, j], q, ids != own[j], k, known)
                    exact = rows[left].astype(np.int64) @ q.astype(np.int64)
                    top = np.lexsort((ids[left], -exact))[:k]
                    top = top[exact[top] >= seen[j, 0]]
                    seen[j] = np.sort(np.concatenate((seen[j], exact[top])))[-k:]
                    found.append((np.full(len(top), own[j]), ids[left][top], exact[top]))
                columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def words(sliced: bytes, bits: int, n: int, dims: int) -> np.ndarray:
    """Stored slices, filled up to the words of ``dims`` dimensions."""
    own = np.frombuffer(sliced, dtype=np.uint64).reshape(bits, n, -1)
    wanted = -(-dims // 64)
    return own if own.shape[2] == wanted else np.concatenate((own, np.zeros((bits, n, wanted - own.shape[2]), np.uint64)), axis=2)


def top_k(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, block: int = 8192, query_block: int = 1024, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows of highest integer inner
    product of the vectors ``floor(scale * x)``, ties to the smaller key, without the
    query's own key.

    Vectors that are null or hold a null or non-finite component and rows with a null key
    take no part.  Vectors of different length are compared over the shorter one's length.
    A key repeated among queries asks once, with its smallest vector; repeated rows are
    ranked each.  No usable row, no result.  Fails if a score of the result exceeds a long.
    """

    def vectors(df: DataFrame) -> DataFrame:
        return df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    asked = vectors(queries).groupBy("id").agg(F.min_by("v", order_of("v", scale)).alias("v"))
    left = stored(vectors(rows).mapInArrow(pack(block, scale), PACKED))
    right = stored(asked.mapInArrow(pack(query_block, scale), PACKED))
    groups = max(1, -(-left.count() // group_blocks))
    size = F.sum(F.octet_length("ids") + F.octet_length("numbers") + F.octet_length("slices"))
    sent = groups * (right.agg(size.alias("n")).first()["n"] or 0)
    copied = right.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), *[F.col(c).alias(f"q_{c}") for c in right.columns])
    dealt = left.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    paired = dealt.join(copied.hint("broadcast" if sent <= BROADCAST_BYTES else "merge"), "g").drop("g")
    near = paired.mapInArrow(search(k, scale), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = near.withColumn("rank", rank).where(F.col("rank") <= k)
    beyond = F.raise_error(F.concat(F.lit("the score of query "), F.col("query_id").cast("string"), F.lit(" and row "), F.col("vec_id").cast("string"), F.lit(" is below a long")))
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("score").isNotNull(), F.col("score")).otherwise(beyond.cast("long")).alias("score"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of every query, over all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS score
    FROM q a JOIN q b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

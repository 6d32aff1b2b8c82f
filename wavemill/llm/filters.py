"""Filter interaction audit on a sparse document-term matrix.

The documents become a matrix of word counts in compressed sparse rows.  A task turns some
megabytes of text into one shard with a dictionary of its own; the shards' dictionaries,
not their words, meet in a global dictionary, and the shards are recoded to its numbers.
Row sums are the documents' words, non-zero counts their distinct words: filters A and B.

With the other filters' outcomes, each document is a mask of five bits.  What every order
of the filters keeps, removes and loses follows from the counts of the 32 masks of a part,
so that documents are counted once, under partial aggregation, for all 120 orders.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count, permutations
from math import factorial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TEXT_BLOCK, text_lists, written

#: The filters' letters; filter i fails a document by bit i of its mask.
LETTERS = "ABCDE"
#: Fewest words, least percentage of distinct words, most percentage of
#: capitals, and the symbols that no document may hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text and number of rows that fill a shard; a longer text is a shard alone.
SHARD_BYTES, SHARD_ROWS = 8 << 20, 10_000
#: Terms of shards that one task numbers.
TERMS_A_TASK = 400_000

SHARD = "shard long, n_terms int, terms array<string>, rows array<struct<{row}>>, starts binary, columns binary, counts binary, narrow string"


def pieces(data: bytes, size: int = TEXT_BLOCK) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes that end at a blank."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in BLANKS:
            end += 1
        yield data[at:end]
        at = end


def narrowest(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


class ShardBuilder:
    """Rows of word counts, with the words numbered as they come."""

    def __init__(self, number: int, more: dict[str, Callable[[str, bytes], object]]):
        self.number, self.more, self.rows, self.size = number, more, [], 0
        self.vocab: dict[bytes, int] = defaultdict(count().__next__)
        self.columns, self.counts, self.lengths = [], [], []

    def add(self, text: str | None, row: dict) -> None:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words: Counter[bytes] = Counter()
        for p in pieces(data):
            words.update(p.split())
        n = len(words)
        self.columns.append(np.fromiter(map(self.vocab.__getitem__, words), dtype=np.uint32, count=n))
        self.counts.append(np.fromiter(words.values(), dtype=np.uint32, count=n))
        self.lengths.append(n)
        self.rows.append(row | {name: of(text, data) for name, of in self.more.items()})
        self.size += len(data)

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.rows) >= SHARD_ROWS

    def record(self) -> dict:
        starts = np.concatenate(([0], np.cumsum(self.lengths))).astype(np.int64)
        columns, counts = narrowest(np.concatenate(self.columns)), narrowest(np.concatenate(self.counts))
        terms = [w.decode("utf-8", "surrogatepass") for w in self.vocab]
        return {"shard": self.number, "n_terms": len(terms), "terms": terms, "rows": self.rows, "starts": starts.tobytes(), "columns": columns.tobytes(), "counts": counts.tobytes(), "narrow": f"{columns.dtype.str} {counts.dtype.str}"}


#: A further column of a document: its SQL type, its Arrow type, and how it follows from the text and
#: its bytes.
Derived = tuple[str, pa.DataType, Callable[[str, bytes], object]]


def local_shards(docs: DataFrame, text: str, more: dict[str, Derived]) -> DataFrame:
    """``docs`` as shards of the matrix, with the words numbered in each by itself; ``rows``
    has the other columns and ``more``."""
    others = [c for c in docs.columns if c != text]
    fields = [f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.select(*others).schema.fields]
    schema = SHARD.format(row=",".join(fields + [f"`{n}`:{sql}" for n, (sql, _, _) in more.items()]))
    kinds, derive = [pa.field(n, kind) for n, (_, kind, _) in more.items()], {n: of for n, (_, _, of) in more.items()}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # A task's shards have numbers of their own; the table that is written from here keeps them.
        first, built, shard, names = TaskContext.get().partitionId() << 32, 0, None, None
        for batch in batches:
            rest = batch.select(others)
            row = pa.struct([*rest.schema, *kinds])
            names = pa.schema([("shard", pa.int64()), ("n_terms", pa.int32()), ("terms", pa.list_(pa.string())), ("rows", pa.list_(row)), *[(c, pa.binary()) for c in ("starts", "columns", "counts")], ("narrow", pa.string())])
            for texts, rows in text_lists(batch.column(text), also=(rest.to_struct_array(),)):
                for t, r in zip(texts, rows):
                    shard = shard or ShardBuilder(first + built, derive)
                    shard.add(t, r)
                    if shard.full():
                        yield pa.RecordBatch.from_pylist([shard.record()], names)
                        built, shard = built + 1, None
        if shard:
            yield pa.RecordBatch.from_pylist([shard.record()], names)

    return docs.mapInArrow(build, schema)


def dealt_terms(shards: DataFrame, parts: int) -> DataFrame:
    """(part, shard, pos, terms): every shard's terms, with their places in it, by the part of
    the dictionary that they belong to; a row has all of a shard that are for one part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, own in zip(batch.column("shard").to_pylist(), batch.column("terms")):
                terms = own.values
                if not len(terms):
                    continue
                part = np.fromiter((crc32(t) % parts for t in terms.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(terms))
                order = np.argsort(part, kind="stable")
                numbers, first = np.unique(part[order], return_index=True)
                edges = np.append(first, len(order))
                pos = [order[a:b].astype(np.uint32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
                lists = pa.ListArray.from_arrays(edges.astype(np.int32), terms.take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([shard] * len(numbers), pa.int64()), pa.array(pos, pa.binary()), lists], ["part", "shard", "pos", "terms"])

    return shards.select("shard", "terms").mapInArrow(deal, "part long, shard long, pos binary, terms array<string>")


def numbered(dealt: DataFrame, parts: int, schema: str, tell: Callable[[list[tuple], pa.Array, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What ``tell`` says of each part: its rows, its distinct terms, their ids, and the term of
    each place.  A part's ids follow the order of its terms, however they come, and have its
    number in them, so that no task sees the whole dictionary."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for part, shard, pos, terms in zip(batch.column("part").to_pylist(), batch.column("shard").to_pylist(), batch.column("pos"), batch.column("terms")):
                held[part].append((shard, pos.as_py(), terms.values))
        for part, rows in held.items():
            coded = pa.chunked_array([t for _, _, t in rows]).combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            rank = np.empty(len(coded.dictionary), dtype=np.int64)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
            yield tell(rows, coded.dictionary, rank * parts + part, coded.indices.to_numpy())

    return dealt.repartition(parts, "part").mapInArrow(number, schema)


def tell_places(rows: list[tuple], _, ids: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
    edges = np.concatenate(([0], np.cumsum([len(t) for _, _, t in rows])))
    coded = [ids[terms[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in rows], pa.int64()), pa.array([p for _, p, _ in rows], pa.binary()), pa.array(coded, pa.binary())], ["shard", "pos", "ids"])


def tell_terms(_, dictionary: pa.Array, ids: np.ndarray, __) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([dictionary, pa.array(ids)], ["term", "id"])


def csr(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, columns and counts of a shard."""
    kinds = r["narrow"].split()
    return np.frombuffer(r["starts"], np.int64), np.frombuffer(r["columns"], kinds[0]), np.frombuffer(r["counts"], kinds[1])


def document_term_matrix(docs: DataFrame, text: str = "text", more: dict[str, Derived] | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrix of word counts of ``docs`` and its dictionary (term, id): ids are different and
    from 0 on, though not without gaps.

    A word is a maximal run of characters other than ASCII blanks, case and all; null is an
    empty text, whose row is empty.  Each row of the matrix is a shard: ``rows`` (the other
    columns of its documents, and ``more``), ``starts`` (where each document begins in the
    next two, and their length at last), ``columns`` (ids, rising in each document) and
    ``counts``, as arrays of numbers in binary form whose types ``narrow`` tells (``starts``
    are longs).
    """
    shards = written(local_shards(docs, text, more or {}))
    parts = max(1, -(-(shards.agg(F.sum("n_terms").cast("long").alias("n")).first()["n"] or 0) // TERMS_A_TASK))
    dealt = dealt_terms(shards, parts)
    ids = written(numbered(dealt, parts, "shard long, pos binary, ids binary", tell_places))
    left = shards.drop("terms", "n_terms")
    names = left.columns
    schema = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in names)

    def recode(shard: pa.Table, ids: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return shard
        r = {c: shard.column(c)[0].as_py() for c in ("starts", "columns", "counts", "narrow")}
        starts, columns, counts = csr(r)
        pos = np.frombuffer(b"".join(ids.column("pos").to_pylist()), np.uint32)
        own = np.zeros(len(pos), dtype=np.int64)
        own[pos] = np.frombuffer(b"".join(ids.column("ids").to_pylist()), np.int64)
        new = own[columns]
        order = np.lexsort((new, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
        made = {"columns": pa.array([new[order].tobytes()], pa.binary()), "counts": pa.array([counts[order].tobytes()], pa.binary()), "narrow": pa.array([f"{new.dtype.str} {counts.dtype.str}"])}
        return pa.table({c: made.get(c, shard.column(c)) for c in names})

    return left.groupBy("shard").cogroup(ids.groupBy("shard")).applyInArrow(recode, schema), numbered(dealt, parts, "term string, id long", tell_terms)


def row_totals(matrix: DataFrame) -> DataFrame:
    """The columns of each document of the matrix, ``n_words`` (its row's sum) and
    ``n_distinct`` (its row's non-zero entries)."""
    fields = matrix.schema["rows"].dataType.elementType.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long", "n_distinct long"])
    names = [*(f.name for f in fields), "n_words", "n_distinct"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("starts", "columns", "counts", "narrow")}
                starts, _, counts = csr(r)
                sums = np.diff(np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[starts])
                rows = batch.column("rows")[i].values
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(sums), pa.array(np.diff(starts))], names)

    return matrix.select("rows", "starts", "columns", "counts", "narrow").mapInArrow(total, schema)


def too_many_capitals(text: str, data: bytes) -> bool:
    """Whether too many of the code points are A to Z."""
    return 100 * (len(data) - len(data.translate(None, CAPITALS))) > MAX_CAPITALS * len(text)


def has_symbol(text: str, data: bytes) -> bool:
    return len(data.translate(None, SYMBOLS)) < len(data)


def document_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, part, mask of A to D, sha, good, toxic) of every document.  A document is good
    or toxic if any row of ``labels`` with its key says so; one with a null key is neither."""
    own = docs.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.col(text).alias("__t"))
    more = {"c": ("boolean", pa.bool_(), too_many_capitals), "d": ("boolean", pa.bool_(), has_symbol), "sha": ("binary", pa.binary(), lambda text, data: hashlib.sha256(data).digest())}
    totals = row_totals(document_term_matrix(own, "__t", more)[0])
    fails = (F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"), F.col("c"), F.col("d"))
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails[1:], 1)), fails[0].cast("int"))
    masked = written(totals.select("k", "part", "sha", mask.alias("mask")))
    said = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without a key would meet in one task of the join.
    none = masked.where("k IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    joined = masked.where("k IS NOT NULL").join(said, "k", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return joined.select(*none.columns).unionByName(none)


def mask_counts(masks: DataFrame) -> DataFrame:
    """(part, mask of A to E, n, good, toxic) with n > 0.

    E fails what has the text of a row with a smaller key.  Copies are counted by key, then
    by part, before the least key of their text is looked for: no group of copies is ever
    in one task.  A row with a null key passes E, and fails none."""
    kind = ["sha", "part", "good", "toxic", "mask"]
    rows = masks.groupBy(*kind, "k").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("k").isNotNull(), F.struct("k", "n")))
    parts = rows.groupBy(*kind).agg(F.sum("n").alias("n"), least.alias("first"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    passing = F.col("unnamed") + F.when(F.col("first.k") == F.min("first.k").over(W.partitionBy("sha")), F.col("first.n")).otherwise(0)
    split = parts.withColumn("passing", passing)
    e = 1 << LETTERS.index("E")
    told = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(told).alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def audit_orders(counts: DataFrame) -> DataFrame:
    """What each order of the filters does at each step, by part, from ``mask_counts``."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bits = f"transform(split(filter_order, ''), x -> shiftleft(1, ascii(x) - {ord(LETTERS[0])}))"
    known = steps.withColumns({"bit": F.expr(f"{bits}[step - 1]"), "prior": F.expr(f"aggregate(slice({bits}, 1, step - 1), 0, (a, x) -> a + x)")})

    def total(where: str, value: str = "n") -> str:
        return f"aggregate(filter(cells, c -> {where}), 0L, (a, c) -> a + c.{value})"

    removed = "c.mask & bit <> 0 AND c.mask & prior = 0"
    sums = {
        "kept": total("c.mask & (bit | prior) = 0"),
        "removed": total(removed),
        "redundant": total("c.mask & bit <> 0 AND c.mask & prior <> 0"),
        "unique_fails": total("c.mask = bit"),
        "good_lost": total(removed, "good"),
        "toxic_lost": total(removed, "toxic"),
        # Of the orders, each filter that a document fails comes first of these in an equal share.
        "shapley": f"aggregate(filter(cells, c -> c.mask & bit <> 0), 0L, (a, c) -> a + c.n * ({factorial(len(LETTERS))} div bit_count(c.mask)))",
    }
    return known.select("part", "filter_order", "step", *[F.expr(e).alias(c) for c, e in sums.items()])


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: documents kept, removed,
    redundant, failing this filter only, good and toxic ones lost, and the filter's removals
    summed over all orders (``shapley``).

    A null text is empty, a null source the part ''.  Repeated rows count each.  Of copies,
    those with the smallest key pass E; a null key passes it and is no smaller than any.
    No documents, no rows.  Columns beside key, text and source have no part in it.
    """
    return audit_orders(mask_counts(document_masks(docs, labels, key, text, source)))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters on every document, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS INT)
        + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask
), letter AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS bit,
        CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INT) AS prior
    FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
)
SELECT part, filter_order, step,
    CAST(coalesce(sum(n) FILTER (mask & (bit | prior) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM cells, steps GROUP BY part, filter_order, step
"""

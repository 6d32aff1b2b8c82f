"""Exact removal of repeated word passages by fixed-block anchors.

A window of ``WINDOW`` words always holds a whole block of ``BLOCK`` = (WINDOW + 1) / 2 words,
if a text is cut into blocks without gaps.  So the reference is an index of non-overlapping
blocks, a seventh of the words, and every rolling stretch of ``BLOCK`` words of every text
probes it.  Where the blocks begin is drawn for each text, so that a passage that many texts
have at one place is not missed by the blocks of all of them.

1. Blocks and probes meet by hash.  A probe hits if another text has it as a block; a block
   is a probe of its own text as well.
2. A hit is extended to left and right: the windows around it are compared by 128 bits of
   their words, and go if a text with a smaller id has them.  Windows of neighbouring hits
   chain into maximal repeats.

In both steps a task settles what its own texts decide and hands on one entry a key and side,
packed by the hundred; so does each receiving task while entries come in.  A passage that a
third of all texts have thus never meets in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, text_lists, written
from .dedup import _BASE, _BLANK, _BYTE, _INVERSE, constants, mix, powers

WINDOW = 13
#: Entries that a task holds before it settles them, and bytes of text a receiving task.
HELD, BUCKET_BYTES = 1 << 19, 4 << 20
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)
Arrays = dict[str, np.ndarray]


def word_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of the texts ``data[bounds[i]:bounds[i + 1]]`` begin and end, and the
    number of each text's first word (and of all words)."""
    letter = ~_BLANK[data]
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    stops[:-1] &= ~letter[1:]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    begins[cuts] = letter[cuts]
    cuts = bounds[1:][bounds[1:] > 0] - 1
    stops[cuts] = letter[cuts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds)


def hashed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each word."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(base, len(data)), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64), len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def rolled(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for j, by in enumerate(constants(size, salt)):
            out += words[j : j + len(out)] * by
        return mix(out)


def texts_of(batch: pa.RecordBatch, *also: str) -> Iterator[tuple]:
    """Blocks of a batch: bytes, word starts, ends and bounds of its texts, and other columns."""
    for texts, *rest in text_lists(batch.column("__text"), also=tuple(batch.column(c) for c in also)):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        yield data, *word_edges(data, bounds), *rest


def packed(x: np.ndarray, size: int) -> np.ndarray:
    """The lowest ``size`` bytes of each 64-bit number, a row each."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size]


def unpacked(data: bytes, size: int) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(own), 8), dtype=np.uint8)
    out[:, :size] = own
    return out.view(np.uint64).ravel()


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each group begins, and the group of each key."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def settle_blocks(x: Arrays) -> tuple[Arrays, Arrays]:
    """Hits among entries (key, text, whether it is a block), and the entries that must be
    kept: those that have not hit, and of each key the blocks of two different texts."""
    order = np.argsort(x["key"], kind="stable")
    key, text, block = (x[c][order] for c in ("key", "text", "block"))
    first, group = groups(key)
    low = np.minimum.reduceat(np.where(block, text, ~_U(0)), first)[group]
    high = np.maximum.reduceat(np.where(block, text, _U(0)), first)[group]
    some = np.maximum.reduceat(block, first)[group]
    hit = some & ((low != text) | (high != text))
    keep = ~hit | block & ((text == low) | (text == high))
    # A text's further stretches of the same words tell nothing new, unless one is a block.
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & (text[1:] == text[:-1]) & (block[1:] == block[:-1])
    found = order[hit & ~same]
    kept = np.sort(order[keep & ~same])
    return {c: x[c][found] for c in x}, {c: x[c][kept] for c in x}


def settle_windows(x: Arrays) -> tuple[Arrays, Arrays]:
    """Windows that a text with a smaller id has, and those of each key's smallest id."""
    order = np.argsort(x["key"], kind="stable")
    key, rest = x["key"][order], x["rest"][order]
    if np.any((key[1:] == key[:-1]) & (rest[1:] != rest[:-1])):
        order = np.lexsort((x["rest"], x["key"]))
        key, rest = x["key"][order], x["rest"][order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
    ids = x["id"][order]
    least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
    found, kept = order[ids > least], np.sort(order[ids == least])
    return {c: x[c][found] for c in x}, {c: x[c][kept] for c in x}


class Pool:
    """Entries that are settled whenever there are many."""

    def __init__(self, settle: Callable[[Arrays], tuple[Arrays, Arrays]]):
        self.settle, self.parts, self.size, self.limit = settle, [], 0, HELD

    def add(self, x: Arrays) -> Iterator[Arrays]:
        """Yields what is found once the pool is full; what is kept stays."""
        if self.put(x):
            yield from self.settled()
            self.limit = max(HELD, 2 * self.size)

    def put(self, x: Arrays) -> bool:
        """Whether the pool is full with these."""
        if len(x["key"]):
            self.parts.append(x)
            self.size += len(x["key"])
        return self.size >= self.limit

    def settled(self) -> Iterator[Arrays]:
        if self.parts:
            found, kept = self.settle({c: np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]})
            self.parts, self.size = [kept], len(kept["key"])
            if len(found["key"]):
                yield found

    def taken(self) -> Arrays | None:
        """What is kept, which the pool then holds no longer."""
        parts, self.parts, self.size = self.parts, [], 0
        return parts[0] if parts and len(parts[0]["key"]) else None


#: How entries travel: bytes of each number that a packed row holds.
SIZES = {"blocks": {"key": 6, "text": 6, "block": 1}, "windows": {"key": 8, "rest": 8, "id": 8, "text": 8, "at": 4}}


def dealt(x: Arrays, sizes: dict[str, int], buckets: int) -> pa.RecordBatch:
    """Entries as one packed row a bucket of keys; each row keeps the entries' order, in which
    the numbers of one text stand together."""
    bucket = ((x["key"] >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, edges = np.unique(bucket[order], return_index=True)
    edges = np.append(edges, len(order))
    columns = []
    for c, n in sizes.items():
        data = packed(x[c][order].astype(np.int64 if x[c].dtype != np.uint64 else np.uint64), n)
        columns.append(pa.array([data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()))
    done = pa.array([False] * len(own))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), done, *columns], ["bucket", "done", *sizes])


def told(x: Arrays, kind: str, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """What is found, packed by the bucket of its text: texts, and for blocks the low half of
    their keys, for windows where they begin."""
    order = np.argsort(x["text"], kind="stable")
    text, what = x["text"][order], x["key" if kind == "blocks" else "at"][order].astype(np.uint32)
    # Of a text's number, bits that its packed form has.
    bucket = ((text & _U(0xFFFFFF)) * _U(buckets) >> _U(24)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, edges = np.unique(bucket[order], return_index=True)
    edges = np.append(edges, len(order))
    text, what = text[order], what[order]
    return [(-1 - n, text[a:b].tobytes(), what[a:b].tobytes()) for n, a, b in zip(own.tolist(), edges[:-1], edges[1:])]


def found_rows(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["bucket", "text", "found"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text, with all that is found in it, in order."""
    texts, finds, size = [], [], 0

    def distinct() -> tuple[np.ndarray, np.ndarray]:
        text, found = np.concatenate(texts), np.concatenate(finds)
        order = np.lexsort((found, text))
        text, found = text[order], found[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
        return text[new], found[new]

    limit = HELD
    for batch in batches:
        for t, f in zip(batch.column("text"), batch.column("found")):
            texts.append(np.frombuffer(t.as_py(), np.uint64)), finds.append(np.frombuffer(f.as_py(), np.uint32))
            size += len(texts[-1])
            if size >= limit:
                text, found = distinct()
                texts, finds, size = [text], [found], len(text)
                limit = max(HELD, 2 * size)
    if not size:
        return
    text, found = distinct()
    first = np.append(groups(text)[0], len(text))
    for at in range(0, len(first) - 1, 1000):
        own = first[at : at + 1001]
        yield pa.RecordBatch.from_arrays([pa.array(text[own[:-1]].view(np.int64)), pa.array([found[a:b].tobytes() for a, b in zip(own[:-1], own[1:])], pa.binary())], ["text", "found"])


def found_in(entries: DataFrame, kind: str, settle, buckets: int) -> DataFrame:
    """(text, found), one row a text, of what packed entries and rows of finds tell."""
    sizes = SIZES[kind]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(settle)
        for batch in batches:
            done = batch.filter(batch.column("done"))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(c) for c in ("bucket", "text", "key")], ["bucket", "text", "found"])
            rows = batch.filter(pc.invert(batch.column("done")))
            for i in range(rows.num_rows):
                x = {c: unpacked(rows.column(c)[i].as_py(), n) for c, n in sizes.items()}
                if kind == "blocks":
                    # The bucket stands for the key's leading bits.
                    x["key"] |= _U(rows.column("bucket")[i].as_py() & 0xFFFF) << _U(48)
                    x["block"] = x["block"] == 1
                else:
                    x["id"] = x["id"].view(np.int64)
                for found in pool.add(x):
                    yield found_rows(told(found, kind, -(-buckets // 4)))
        for found in pool.settled():
            yield found_rows(told(found, kind, -(-buckets // 4)))

    met = entries.repartition(buckets, "bucket").mapInArrow(meet, "bucket long, text binary, found binary")
    # Finds are smaller than entries, and each task here writes a file.
    return met.repartition(-(-buckets // 4), "bucket").mapInArrow(gather, "text long, found binary")


def packed_schema(kind: str) -> str:
    return "bucket long, done boolean, " + ", ".join(f"`{c}` binary" for c in SIZES[kind])


def entries_of(docs: DataFrame, kind: str, make: Callable[[pa.RecordBatch], Iterator[Arrays]], settle, buckets: int) -> DataFrame:
    """Packed entries of what ``make`` tells of each batch, and the finds that need no more."""
    sizes = SIZES[kind]

    def done(found: Arrays) -> pa.RecordBatch:
        rows = told(found, kind, -(-buckets // 4))
        columns = {"bucket": pa.array([r[0] for r in rows], pa.int64()), "done": pa.array([True] * len(rows)), "text": pa.array([r[1] for r in rows], pa.binary()), "key": pa.array([r[2] for r in rows], pa.binary())}
        names = ["bucket", "done", *sizes]
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(rows), pa.binary()) for c in names], names)

    def handed_on(pool: Pool) -> Iterator[pa.RecordBatch]:
        for found in pool.settled():
            yield done(found)
        if (kept := pool.taken()) is not None:
            yield dealt(kept, sizes, buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(settle)
        for batch in batches:
            for x in make(batch):
                if pool.put(x):
                    yield from handed_on(pool)
        yield from handed_on(pool)

    return docs.mapInArrow(deal, packed_schema(kind))


def block_entries(window: int) -> Callable[[pa.RecordBatch], Iterator[Arrays]]:
    size = (window + 1) // 2

    def make(batch: pa.RecordBatch) -> Iterator[Arrays]:
        for data, starts, ends, at, keys in texts_of(batch, "__row"):
            texts, n = np.array(keys, dtype=np.int64).view(np.uint64), np.diff(at)
            keyed = rolled(hashed_words(data, starts, ends, _BASE), size, 3)
            pos = np.arange(len(keyed))
            own = np.searchsorted(at, pos, side="right") - 1
            fine = (pos + size <= at[own + 1]) & (n[own] >= window)
            pos, own = pos[fine], own[fine]
            block = (pos - at[own]) % size == (texts[own] % _U(size)).astype(np.int64)
            yield {"key": keyed[pos], "text": texts[own] & _LOW48, "block": block}

    return make


def window_entries(window: int) -> Callable[[pa.RecordBatch], Iterator[Arrays]]:
    size = (window + 1) // 2

    def make(batch: pa.RecordBatch) -> Iterator[Arrays]:
        for data, starts, ends, at, keys, ids, hits in texts_of(batch, "__row", "__id", "found"):
            one, two = (hashed_words(data, starts, ends, base) for base in (_BASE, _INVERSE))
            low = rolled(one, size, 3).astype(np.uint32)
            chosen = []
            for i, own in enumerate(hits):
                a, b = int(at[i]), int(at[i + 1])
                places = a + np.flatnonzero(np.isin(low[a : b - size + 1], np.frombuffer(own, np.uint32)))
                near = (places[:, None] - np.arange(window - size + 1)).ravel()
                near = np.unique(near[(near >= a) & (near + window <= b)])
                chosen.append((i, near))
            pos = np.concatenate([near for _, near in chosen])
            own = np.repeat([i for i, _ in chosen], [len(near) for _, near in chosen])
            yield {
                "key": rolled(one, window, 5)[pos], "rest": rolled(two, window, 7)[pos], "id": np.array(ids, dtype=np.int64)[own],
                "text": np.array(keys, dtype=np.int64).view(np.uint64)[own], "at": (pos - at[own]).astype(np.uint64),
            }

    return make


CUT = "struct<n_words:long,n_removed:long,spans:array<struct<start:long,end:long>>,kept_sha256:string,kept:string>"


def cut_udf(window: int):
    """A text without the words of the windows that begin at the given words."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept_sha256", pa.string()), ("kept", pa.string())])

    @F.arrow_udf(CUT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = []
            for text, own in ((t, m) for x, y in text_lists(texts, also=(found,)) for t, m in zip(x, y)):
                words, spans = text.encode("utf-8", "surrogatepass").split(), []
                if own:
                    starts = np.frombuffer(own, np.uint32).astype(np.int64)
                    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > window)))
                    spans = list(zip(starts[new].tolist(), (starts[np.append(new[1:], len(starts)) - 1] + window).tolist()))
                edges = [0, *(x for s in spans for x in s), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                left = b" ".join(kept)
                rows.append({"n_words": len(words), "n_removed": len(words) - len(kept), "spans": [{"start": a, "end": b} for a, b in spans], "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left.decode("utf-8", "surrogatepass") if spans else None})
            yield pa.array(rows, kind)

    return cut


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``spans`` (word ranges removed, each as long as
    it can be), ``kept_sha256`` and ``kept`` (the words that stay, joined by blanks; null where
    nothing goes: the text stands).

    Every word goes that is in ``window`` consecutive words (odd, 3 at least) which also stand
    in a row with a smaller key.  Words are what ASCII blanks separate.  A null text has no
    words.  Rows with one key don't count for one another, and a row with a null key is
    neither smaller nor larger than any: it stays whole.  Repeated rows are judged alike.
    Keys are whole numbers.  Input columns of the result's names are replaced.
    """
    made = ("n_words", "n_removed", "spans", "kept_sha256", "kept")
    kept = drop_clashes(docs, *made)
    full = F.coalesce(F.col(text), F.lit(""))
    held = kept.withColumns({"__row": F.xxhash64(F.col(key), full), "__text": full})
    some = held.where(F.col(key).isNotNull() & (F.octet_length("__text") > 2 * window - 2)).select(F.col(key).cast("long").alias("__id"), "__row", "__text")
    n = some.agg(F.sum(F.octet_length("__text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-n // BUCKET_BYTES))
    blocks = entries_of(some.select("__row", "__text"), "blocks", block_entries(window), settle_blocks, buckets)
    hits = written(found_in(blocks, "blocks", settle_blocks, buckets))
    near = some.join(hits, F.col("__row").bitwiseAND((1 << 48) - 1) == F.col("text")).select("__id", "__row", "__text", "found")
    windows = entries_of(near, "windows", window_entries(window), settle_windows, buckets)
    gone = written(found_in(windows, "windows", settle_windows, buckets))
    # A null key's row may have the number of another one: it takes no finds.
    gone = gone.select(F.col("text").alias("__of"), F.col("found").alias("__found"))
    out = held.join(gone, (F.col("__row") == F.col("__of")) & F.col(key).isNotNull(), "left").withColumn("__cut", cut_udf(window)("__text", "__found"))
    return out.select(*kept.columns, *[F.col(f"__cut.{c}") for c in made])


def op11_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 13-word windows of documents before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")

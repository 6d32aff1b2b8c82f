"""Benchmark decontamination with suffix arrays over the training text.

Each task is a shard.  It builds a suffix array over the word positions of its documents,
leaving out suffixes whose first words start no benchmark window, and binary-searches every
benchmark window in it: an equal range gives all places of a verbatim match.  Matches on
one diagonal are chained to the longest verbatim match.  The benchmark goes to the tasks in
blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words_table, drop_clashes, stored, text_lists

WORDS = ascii_words_table()
RESULT = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,longest:long>"
RESULT_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
#: Leading words that a suffix must share with a window to enter the suffix array.
LEAD = 3


def split_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def benchmark_index(items: list[tuple[str, str]], size: int) -> dict:
    """Windows of ``size`` words (whole shorter items) as rows of word numbers, sorted,
    with the places (item class, offset) of each.  Items of equal words form a class."""
    classes: dict[tuple[bytes, ...], list[str]] = {}
    for item, text in items:
        if words := tuple(split_words(text)):
            classes.setdefault(words, []).append(item)
    vocab: dict[bytes, int] = {}
    places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for c, words in enumerate(classes):
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words]
        for o in range(max(1, len(ids) - size + 1)):
            places.setdefault(tuple(ids[o : o + size]), []).append((c, o))
    windows = list(places)
    rows = np.zeros((len(windows), size), dtype=">u4")
    for i, w in enumerate(windows):
        rows[i, : len(w)] = w
    flat = [p for w in windows for p in places[w]]
    return {
        "size": size,
        "vocab": vocab,
        "rows": rows,
        "lengths": np.array([len(w) for w in windows], dtype=np.int64),
        "classes": list(classes.values()),
        "first": np.cumsum([0, *(len(places[w]) for w in windows)]),
        "place_class": np.array([c for c, _ in flat], dtype=np.int64),
        "place_offset": np.array([o for _, o in flat], dtype=np.int64),
        "leads": np.unique(lead_keys(rows.astype(np.int64), np.array([len(w) for w in windows], dtype=np.int64), len(vocab) + 1)),
    }


def lead_keys(rows: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """One number for the first words of each window: as many as the shortest has, at most LEAD."""
    n = min(LEAD, int(lengths.min())) if len(lengths) else LEAD
    key = np.zeros(len(rows), dtype=np.int64)
    for j in range(n):
        key = key * base + rows[:, j]
    return key


def fan_out(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and members of the ranges [low, high)."""
    n = high - low
    owner = np.repeat(np.arange(len(low)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def search_shard(ids: np.ndarray, bounds: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window) of every place of every window in the shard's words."""
    none = np.zeros(0, dtype=np.int64)
    size, rows, lengths = index["size"], index["rows"], index["lengths"]
    if not len(rows) or not len(ids):
        return none, none
    shortest = int(lengths.min())
    breaks = np.unique(np.concatenate([np.flatnonzero(ids == 0), bounds[1:]]))
    pos = np.flatnonzero(ids)
    run = breaks[np.searchsorted(breaks, pos, side="right")] - pos
    pos, run = pos[run >= shortest], run[run >= shortest]
    n, base = min(LEAD, shortest), len(index["vocab"]) + 1
    key = np.zeros(len(pos), dtype=np.int64)
    for j in range(n):
        key = key * base + ids[pos + j]
    leads = index["leads"]
    hit = leads[np.minimum(np.searchsorted(leads, key), len(leads) - 1)] == key
    pos, run = pos[hit], run[hit]
    if not len(pos):
        return none, none
    suffixes = np.zeros((len(pos), size), dtype=">u4")
    for j in range(size):
        inside = run > j
        suffixes[inside, j] = ids[pos[inside] + j]
    text = np.dtype(f"S{4 * size}")
    keys = suffixes.view(text).ravel()
    order = np.argsort(keys, kind="stable")
    array = keys[order]
    low = np.searchsorted(array, np.ascontiguousarray(rows).view(text).ravel(), side="left")
    top = rows.copy()
    for i in np.flatnonzero(lengths < size):
        top[i, lengths[i] :] = 0xFFFFFFFF
    high = np.searchsorted(array, np.ascontiguousarray(top).view(text).ravel(), side="right")
    window, at = fan_out(low, high)
    return pos[order[at]], window


def find_matches(texts: list[str | None], index: dict) -> list[dict]:
    """What the result struct holds, for each text."""
    get = index["vocab"].get
    words = [split_words(t) for t in texts]
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    ids = np.fromiter((get(w, 0) for own in words for w in own), dtype=np.int64, count=int(bounds[-1]))
    pos, window = search_shard(ids, bounds, index)
    out = [{"n_words": len(w), "spans": [], "items": [], "longest": 0} for w in words]
    if not len(pos):
        return out
    lengths = index["lengths"]
    which, place = fan_out(index["first"][window], index["first"][window + 1])
    doc = np.searchsorted(bounds, pos, side="right") - 1
    full = np.stack([doc[which], index["place_class"][place], pos[which] - index["place_offset"][place], pos[which], lengths[window[which]]])
    full = full[:, np.lexsort(full[[3, 2, 1, 0]])]
    same = np.all(full[:3, 1:] == full[:3, :-1], axis=0) & (full[3, 1:] == full[3, :-1] + 1)
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    tails = np.concatenate((heads[1:], [full.shape[1]])) - 1
    longest = full[3, tails] + full[4, tails] - full[3, heads]
    for d, c, n in zip(full[0, heads].tolist(), full[1, heads].tolist(), longest.tolist()):
        out[d]["longest"] = max(out[d]["longest"], n)
        out[d]["items"].append(c)
    order = np.lexsort((pos, doc))
    for d, start, end in zip(doc[order].tolist(), (pos[order] - bounds[doc[order]]).tolist(), (pos[order] - bounds[doc[order]] + lengths[window[order]]).tolist()):
        spans = out[d]["spans"]
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], end)
        else:
            spans.append({"start": start, "end": end})
    for o in out:
        o["items"] = sorted({x for c in o["items"] for x in index["classes"][c]})
    return out


def match_column(spark: SparkSession, index: dict, text: Column | str) -> Column:
    held = spark.sparkContext.broadcast(index)

    @F.arrow_udf(RESULT)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [r for (texts,) in text_lists(batch) for r in find_matches(texts, held.value)]
            yield pa.array(rows, RESULT_TYPE)

    return match(text)


def merge_spans(spans: Column) -> Column:
    """Sorted spans without overlaps or seams."""
    joined = F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return joined


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word ranges inside benchmark windows), ``items``
    (ids, as sorted strings) and ``longest`` (words of the longest verbatim match).

    A window is ``window`` consecutive words of an item, or the whole of a shorter item.  A
    null text has no words; items with a null id or without words are skipped; repeated
    items are all listed; input columns of the result's names are replaced.  A benchmark
    of more than ``block_bytes`` is searched in blocks, one pass over the documents each.
    """
    spark = docs.sparkSession
    kept = drop_clashes(docs, "n_words", "spans", "items", "longest")
    items = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("t"))
    held = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-held // block_bytes))
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)
        index = benchmark_index([(r["id"], r["t"]) for r in own.collect()], window)
        if out is None:
            out = kept.withColumn("__m", match_column(spark, index, F.col(text)))
            continue
        both = stored(out).withColumn("__o", match_column(spark, index, F.col(text)))
        merged = F.struct(
            F.col("__m.n_words").alias("n_words"),
            merge_spans(F.concat("__m.spans", "__o.spans")).alias("spans"),
            F.array_sort(F.array_union("__m.items", "__o.items")).alias("items"),
            F.greatest("__m.longest", "__o.longest").alias("longest"),
        )
        out = both.withColumn("__m", merged).drop("__o")
    return out.select(*kept.columns, "__m.n_words", "__m.spans", "__m.items", "__m.longest")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark window, and the items these are of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


ORACLE = r"""
WITH b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0
), d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), grams AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
    SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON win.n = grams.n AND win.g = array_to_string(w[i:i + grams.n - 1], ' ')
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

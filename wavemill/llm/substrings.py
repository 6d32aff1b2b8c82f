"""Exact removal of repeated substrings by distributed suffix sorting.

A byte goes if it is covered by a ``length``-byte string that starts in another place too.
Every window of that length has an anchor, its leftmost ``k``-byte string of least hash, so
equal windows have equal anchors at equal offsets.  Runs of windows with one anchor form a
segment.  Only segments whose anchor string occurs elsewhere can hold a repeat:

1. anchors are counted, and segments with a unique anchor are dropped;
2. equal segments (by their anchor's hash and a cryptographic digest of their bytes, 64 bits
   each) are collapsed; all windows of a segment with a copy are repeats;
3. the suffixes at the anchors of the distinct segments are sorted in tasks into front-coded
   runs, dealt to ranges, and each range's runs are combined by a loser tree that carries
   the prefix lengths known so far and never compares a known prefix again;
4. the common prefixes of neighbours, with the common left contexts, tell which windows of
   an anchor's class are equal.

Anchors with more than ``MAX_CLASS`` distinct segments are not sorted in one task: their
windows are counted one by one under partial aggregation, which gives the same answer.

Beside the bytes, a text is marked if it shares a passage of over 50 words with another
one, however few bytes these have.  Passages are found alike: windows of words, anchors of
``GRAM`` words, equal segments first, single windows of what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_lists
from .dedup import _BASE, _BYTE, _INVERSE, constants, mix, powers, word_hashes

LENGTH, ANCHOR = 400, 128
#: Words of a shared passage, and of the anchors in it (a power of two).
PASSAGE, GRAM = 51, 16
#: Distinct segments of one anchor that a single task compares.
MAX_CLASS = 20_000
#: Window starts that are looked at together; positions within must fit 20 bits.
CHUNK = 1 << 19
_U = np.uint64

FOUND = "struct<s:array<struct<h:long,c:long,lo:long,n:int,off:int>>,p:array<struct<h:long,c:long>>>"
SEGMENT_TYPE = {"h": pa.int64(), "c": pa.int64(), "lo": pa.int64(), "n": pa.int32(), "off": pa.int32()}
SPANS = "array<struct<start:long,end:long>>"


def raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every ``k`` consecutive values, by doubling; ``k`` is a power of two."""
    with np.errstate(over="ignore"):
        m, by = 1, constants(32, 17)
        for step in range(k.bit_length() - 1):
            h = h[:-m] * by[step] + h[m:]
            m *= 2
        return mix(h)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    m = 1
    while 2 * m <= width:
        values = np.minimum(values[:-m], values[m:])
        m *= 2
    return np.minimum(values[: len(values) - (width - m)], values[width - m :]) if width > m else values


def find_segments(values: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Segments of the sequences ``values[bounds[i]:bounds[i + 1]]``: owner, first window
    start in ``values``, windows, anchor's distance from the first start, anchor's hash."""
    names = ("owner", "lo", "n", "off", "h")
    none = {x: np.zeros(0, np.int64) for x in names}
    if len(values) < length:
        return none
    grams = gram_hashes(values, k)
    keyed = (grams & ~_U(0xFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_min(keyed, length - k + 1) & _U(0xFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    owner = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + length <= bounds[owner + 1]
    starts, owner, anchor = starts[inside], owner[inside], anchor[inside]
    if not len(starts):
        return none
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(starts)))
    lo, own, pos = starts[at], owner[at], anchor[at]
    return {"owner": own, "lo": lo, "n": n, "off": pos - lo, "h": grams[pos].view(np.int64)}


def in_chunks(bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences in groups of about ``CHUNK`` values: (owners, starts, ends) of their parts.
    A longer one is cut into parts that overlap so that each has all its windows."""
    own, low, high, held = [], [], [], 0
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for at in range(a, max(a + 1, b - length + 1), CHUNK):
            end = min(b, at + CHUNK + length - 1)
            if end - at < length:
                continue
            if held and held + end - at > CHUNK:
                yield np.array(own), np.array(low), np.array(high)
                own, low, high, held = [], [], [], 0
            own.append(i), low.append(at), high.append(end)
            held += end - at
    if own:
        yield np.array(own), np.array(low), np.array(high)


def all_segments(values: np.ndarray, bounds: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """``find_segments`` of sequences of any size, a chunk at a time."""
    found = []
    for own, low, high in in_chunks(bounds, length):
        sizes = np.concatenate(([0], np.cumsum(high - low)))
        part = find_segments(np.concatenate([values[a:b] for a, b in zip(low, high)]), sizes, length, k)
        inner = part["owner"]
        found.append(part | {"owner": own[inner], "lo": part["lo"] - sizes[inner] + low[inner]})
    names = ("owner", "lo", "n", "off", "h")
    return {x: np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in names}


def segments_of(texts: list[bytes], length: int, k: int) -> dict[str, np.ndarray]:
    """The segments of texts, in order of their owners; ``lo`` counts from the text's start,
    and ``c`` is a digest of the bytes of all the segment's windows."""
    data = b"".join(texts)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    found = all_segments(_BYTE[np.frombuffer(data, dtype=np.uint8)], bounds, length, k)
    view = memoryview(data)
    ends = found["lo"] + found["n"] + length - 1
    digests = b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(found["lo"].tolist(), ends.tolist()))
    return found | {"lo": found["lo"] - bounds[found["owner"]], "c": np.frombuffer(digests, dtype=np.int64)}


def passages_of(texts: list[bytes], width: int, gram: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Segments of word windows, with ``c``, a hash of all their words, and the hash of the
    ``width`` words from each word on."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    words, at = word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    found = all_segments(words, at, width, gram)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * powers(_BASE, len(words)), out=total[1:])
        back = powers(_INVERSE, len(words) + 1)
        lo, end = found["lo"], found["lo"] + found["n"] + width - 1
        content = mix((total[end] - total[lo]) * back[lo] + found["n"].astype(np.uint64)).view(np.int64)
        windows = mix((total[width:] - total[: max(0, len(words) + 1 - width)]) * back[: max(0, len(words) + 1 - width)]).view(np.int64)
    return found | {"c": content}, windows


def as_lists(owner: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.ListArray:
    """One list of structs for each of ``n`` owners, from rows in their order."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def segment_udf(length: int, k: int, width: int, gram: int):
    """Byte segments and word segments of each text."""

    @F.arrow_udf(FOUND)
    def segments(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            s, p = [], []
            for (texts,) in text_lists(batch):
                own = [raw(t) for t in texts]
                found = segments_of(own, length, k)
                s.append(as_lists(found["owner"], len(own), {x: pa.array(found[x], t) for x, t in SEGMENT_TYPE.items()}))
                found, _ = passages_of(own, width, gram)
                p.append(as_lists(found["owner"], len(own), {x: pa.array(found[x], pa.int64()) for x in ("h", "c")}))
            yield pa.StructArray.from_arrays([pa.concat_arrays(s), pa.concat_arrays(p)], ["s", "p"]) if s else pa.array([], pa.struct([("s", pa.list_(pa.struct(list(SEGMENT_TYPE.items())))), ("p", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))]))

    return segments


def passage_udf(width: int, gram: int):
    """(h, c, w) of every word window of the marked word segments."""

    @F.arrow_udf("array<struct<h:long,c:long,w:long>>")
    def windows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marks in batches:
            out = []
            for x, y in text_lists(texts, also=(marks,)):
                for text, own in zip(x, y):
                    found, hashes = passages_of([raw(text)], width, gram)
                    wanted = {(m["h"], m["c"]) for m in own or []}
                    rows = {}
                    for h, c, lo, n in zip(*(found[z].tolist() for z in ("h", "c", "lo", "n"))):
                        if (h, c) in wanted:
                            rows[h, c] = [{"h": h, "c": c, "w": w} for w in set(hashes[lo : lo + n].tolist())]
                    out.append([r for own_rows in rows.values() for r in own_rows])
            yield pa.array(out, pa.list_(pa.struct([(z, pa.int64()) for z in "hcw"])))

    return windows


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    most = min(len(a), len(b))
    while at < most:
        x, y = a[at : at + 64], b[at : at + 64]
        if x == y:
            at += len(x)
            continue
        n = min(len(x), len(y))
        diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
        return at + (n - (diff.bit_length() + 7) // 8 if diff else n)
    return most


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Prefix lengths shared with the key before, and the rests, of sorted keys."""
    lcps, last = [], b""
    for x in keys:
        lcps.append(common_prefix(last, x))
        last = x
    return lcps, [x[n:] for x, n in zip(keys, lcps)]


class LoserTree:
    """Merges front-coded runs.  ``known[s]`` is the prefix that stream s's head shares with
    the last key given out: of two heads the one with more in common comes first, and only
    on a tie are bytes compared, from there on."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs, self.size = runs, 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * self.size
        self.head: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        for s, (_, rests) in enumerate(runs):
            self.head[s] = rests[0] if rests else None
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self.play(winners[2 * node], winners[2 * node + 1])
        self.best = winners[1] if self.size > 1 else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix is then the one shared with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        n = common_prefix(x, y, self.known[a])
        first = n == len(x) or (n < len(y) and x[n] < y[n])
        winner, loser = (a, b) if first else (b, a)
        self.known[loser] = n
        return winner, loser

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(run, position, key, prefix shared with the key before)."""
        while (key := self.head[self.best]) is not None:
            s = self.best
            yield s, self.at[s], key, self.known[s]
            self.at[s] += 1
            lcps, rests = self.runs[s]
            if self.at[s] < len(rests):
                n = lcps[self.at[s]]
                self.head[s], self.known[s] = key[:n] + rests[self.at[s]], n
            else:
                self.head[s] = None
            node = (s + self.size) // 2
            while node:
                s, self.losers[node] = self.play(s, self.losers[node])
                node //= 2
            self.best = s


RUN = "r long, lcps array<int>, rests array<binary>, lefts array<binary>, k1 array<long>, k2 array<long>, lo array<long>, off array<int>"
RUN_TYPE = pa.schema([("r", pa.int64()), ("lcps", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("lefts", pa.list_(pa.binary())), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64())), ("off", pa.list_(pa.int32()))])
SPAN = "k1 long, k2 long, start long, end long"


def write_runs(length: int, ranges: int, flush_bytes: int = 8 << 20):
    """Rows (k1, k2, text, marks) into one front-coded sorted run a range and flush.  A key is
    the anchor's mixed hash, whose leading bits choose the range, and the suffix there."""

    def runs_of(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[0])
        rows: dict[int, list[tuple]] = {}
        for x in held:
            rows.setdefault((int.from_bytes(x[0][:8], "big") * ranges) >> 64, []).append(x)
        for r, own in rows.items():
            lcps, rests = front_code([x[0] for x in own])
            columns = [[r], [lcps], [rests], *([[x[j] for x in own]] for j in range(1, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN_TYPE)], schema=RUN_TYPE)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = raw(row["text"])
                # Anchors have small hashes, being the least of many: mixed again, they fill all ranges evenly.
                names = mix(np.array([m["h"] for m in row["marks"]], dtype=np.int64).view(np.uint64)).tolist()
                for m, name in zip(row["marks"], names):
                    lo, at = m["lo"], m["lo"] + m["off"]
                    suffix = data[at : lo + m["n"] - 1 + length]
                    left = data[lo:at][::-1]
                    held.append((name.to_bytes(8, "big") + suffix, left, row["k1"], row["k2"], lo, m["off"]))
                    size += len(suffix) + len(left)
                if size > flush_bytes:
                    yield from runs_of(held)
                    held, size = [], 0
        yield from runs_of(held)

    return write


def equal_windows(suffixes: list[bytes], lefts: list[bytes], lcps: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each member of an anchor's class, the ranges [i, j] of distances between window
    start and anchor at which another member has the same window.  ``lcps[x]`` is what
    suffix x shares with suffix x - 1."""
    g = len(suffixes)
    out: list[list[tuple[int, int]]] = [[] for _ in range(g)]
    if g <= 24:
        for x in range(g):
            right = length
            for y in range(x + 1, g):
                right = min(right, lcps[y])
                if right + len(lefts[x]) < length:
                    break
                if right + len(lefts[y]) < length:
                    continue
                left = common_prefix(lefts[x], lefts[y])
                if left >= length - right:
                    out[x].append((length - right, left))
                    out[y].append((length - right, left))
        return out
    # Larger classes: what shares the bytes up to a distance is a range of the sorted suffixes,
    # and of the sorted left contexts; two members of both ranges have the same window.
    left_size, right_size = np.array([len(x) for x in lefts]), np.array([len(x) for x in suffixes])
    order = sorted(range(g), key=lefts.__getitem__)
    rank = np.empty(g, dtype=np.int64)
    rank[order] = np.arange(g)
    left_lcps = np.array([0, *(common_prefix(lefts[x], lefts[y]) for x, y in zip(order, order[1:]))])
    right_lcps = np.array([0, *lcps[1:]])
    most = int(left_size.max())
    repeat = np.zeros((g, most + 1), dtype=bool)
    for i in range(most + 1):
        fit = np.flatnonzero((left_size >= i) & (right_size >= length - i))
        if len(fit) > 1:
            right, left = np.cumsum(right_lcps < length - i), np.cumsum(left_lcps < i)
            both = right[fit] * (g + 1) + left[rank[fit]]
            _, kind, often = np.unique(both, return_inverse=True, return_counts=True)
            repeat[fit, i] = often[kind] > 1
    for x in np.flatnonzero(repeat.any(axis=1)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], repeat[x].astype(np.int8), [0]))))
        out[x] = [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
    return out


def merge_runs(length: int, k: int):
    """The runs of one range: merge them, and give out the repeated spans of each class."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        spans: list[tuple[int, int, int, int]] = []
        members: list[tuple[dict, int]] = []
        suffixes: list[bytes] = []
        lcps: list[int] = []

        def close() -> None:
            if len(members) > 1:
                for (row, at), found in zip(members, equal_windows(suffixes, [r["lefts"][a] for r, a in members], lcps, length)):
                    anchor = row["lo"][at] + row["off"][at]
                    spans.extend((row["k1"][at], row["k2"][at], anchor - j, anchor - i + length) for i, j in found)

        for s, at, key, known in LoserTree([(r["lcps"], r["rests"]) for r in rows]):
            if known < 8 + k:
                close()
                members, suffixes, lcps = [], [], []
            members.append((rows[s], at))
            suffixes.append(key[8:])
            lcps.append(known - 8)
        close()
        return pa.table([pa.array([x[j] for x in spans], pa.int64()) for j in range(4)], names=["k1", "k2", "start", "end"])

    return merge


def window_udf(length: int):
    """(a, b, start) of every window of the marked segments: two hashes and where it starts."""

    @F.arrow_udf("array<struct<a:long,b:long,start:long>>")
    def windows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for texts, marks in batches:
                out = []
                for text, own in ((t, m) for x, y in text_lists(texts, also=(marks,)) for t, m in zip(x, y)):
                    data, rows = np.frombuffer(raw(text), dtype=np.uint8), []
                    for m in own:
                        part = data[m["lo"] : m["lo"] + m["n"] - 1 + length]
                        starts, hashes = np.arange(m["n"]), []
                        for base in (_BASE, _INVERSE):
                            total = np.zeros(len(part) + 1, dtype=np.uint64)
                            np.cumsum(_BYTE[part] * powers(base, len(part)), out=total[1:])
                            hashes.append(mix((total[starts + length] - total[starts]) * powers(pow(base, -1, 1 << 64), m["n"])).view(np.int64))
                        rows += [{"a": a, "b": b, "start": m["lo"] + s} for s, (a, b) in enumerate(zip(*(h.tolist() for h in hashes)))]
                    out.append(rows)
                yield pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64())])))

    return windows


def cut_udf():
    """What is left of a text without the spans, and the spans merged."""

    @F.arrow_udf("struct<n_removed:long,spans:array<struct<start:long,end:long>>,kept_sha256:string,kept:binary>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            rows = []
            for text, own in ((t, m) for x, y in text_lists(texts, also=(spans,)) for t, m in zip(x, y)):
                data, runs = raw(text), []
                for start, end in sorted((s["start"], s["end"]) for s in own or []):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                edges = [0, *(x for r in runs for x in r), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append({"n_removed": len(data) - len(left), "spans": [{"start": a, "end": b} for a, b in runs], "kept_sha256": hashlib.sha256(left).hexdigest(), "kept": left})
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.array(rows, pa.struct([("n_removed", pa.int64()), ("spans", span), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return cut


def content_keys(sha: Column) -> list[Column]:
    """Two numbers of 60 bits each, from the SHA-256 of a text; copies share them."""
    return [F.conv(F.substring(sha, at, 15), 16, 10).cast("long").alias(name) for name, at in (("k1", 1), ("k2", 16))]


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR, max_class: int = MAX_CLASS, range_bytes: int = 12 << 20, passage: int = PASSAGE, gram: int = GRAM
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, spans, kept_sha256, kept, shares_passage) of every row.

    Texts are their UTF-8 bytes, null as empty.  A text shorter than ``length`` loses
    nothing.  Copies of a longer text lose all their bytes, repeated rows and rows with one
    key or a null key included: each row is a text of its own.  ``kept`` is null where
    nothing was removed (the text itself stands).  ``shares_passage`` says that another row
    has ``passage`` consecutive words of the text (blank-separated, A-Z lower-cased), whether
    or not these make ``length`` bytes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("__id"), full.alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).select("*", *content_keys(F.col("sha")))
    found = base.select("__id", "sha", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), segment_udf(length, k, passage, gram)("text").alias("u"))
    found = stored(found.select("__id", "sha", "k1", "k2", "n_bytes", "u.*"))
    # Stored: an aggregation under a join would keep a frequent anchor's rows in one task.
    repeated = stored(found.select(F.explode("s.h").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    # Stored before it is aggregated: a frequent anchor's rows are then split among tasks.
    shared = stored(found.select("k1", "k2", F.explode("s").alias("s")).select("k1", "k2", "s.*").join(repeated, "h", "left_semi"))
    kind = ["h", "c", "n", "off"]
    segments = stored(shared.groupBy(*kind, "k1", "k2", "lo").agg(F.count("*").alias("copies")))
    same = stored(segments.groupBy(*kind).agg(F.sum("copies").alias("all"), F.min(F.struct("k1", "k2", "lo")).alias("first")))
    classes = stored(same.groupBy("h").agg(F.count("*").alias("distinct")).where(F.col("distinct") > 1))
    # Sorted: one segment of each kind, where the anchor has several kinds.
    chosen = same.join(classes, "h").select("first.*", "h", "n", "off", (F.col("distinct") > max_class).alias("wide"))
    twice = segments.join(same.where("all > 1").select(*kind), kind, "left_semi")
    marks = chosen.select("k1", "k2", F.struct("h", "lo", "n", "off", "wide", F.lit(False).alias("whole")).alias("m"))
    marks = marks.unionByName(twice.select("k1", "k2", F.struct("h", "lo", "n", "off", F.lit(False).alias("wide"), F.lit(True).alias("whole")).alias("m")))
    marks = marks.groupBy("k1", "k2").agg(F.collect_list("m").alias("marks"))
    spoken, sure, unsure = word_segments(found)
    looked = unsure.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c")).alias("words"))
    counts = found.where(F.col("n_bytes") >= length).groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    worded = found.where(F.size("p") > 0).groupBy("k1", "k2").agg((F.count("*") > 1).alias("spoken_twice"))
    # A text's row is that of its smallest id; where several rows have it, they are one again below.
    ids = found.groupBy("k1", "k2", "__id").agg(F.count("*").alias("n"))
    least = ids.groupBy("k1", "k2").agg(F.min(F.struct(F.col("__id").isNull().alias("unnamed"), "__id", "n")).alias("r"))
    reps = least.select("k1", "k2", "r.__id", (F.col("r.n") > 1).alias("again"))
    info = stored(marks.join(looked, ["k1", "k2"], "full").join(counts, ["k1", "k2"], "left").join(reps, ["k1", "k2"]))
    # A text is needed if it stands for a kind of segments, or loses something of its own.
    wanted = F.col("words").isNotNull() | F.exists("marks", lambda m: ~m["whole"]) | (F.col("copies") == 1)
    leads = info.where(wanted).select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("__id").alias("rep"), "again", "marks", "words", (F.col("copies") == 1).alias("alone"))
    # The id is one of the keys, so that the copies of a text don't meet in one task.
    own = (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")) & F.col("__id").eqNullSafe(F.col("rep"))
    met = base.select("__id", "k1", "k2", "text").join(leads, own).drop("__id", "rep", "l1", "l2")
    # Rows that repeat with one id, or without one, come one by one: most go before they are shuffled.
    single = met.where("again").dropDuplicates(["k1", "k2"])
    held = stored(met.where("NOT again").unionByName(single).drop("again"))
    kinds = held.where("marks IS NOT NULL").select("k1", "k2", "text", F.filter("marks", lambda m: ~m["whole"]).alias("marks")).where(F.size("marks") > 0)
    narrow = kinds.withColumn("marks", F.filter("marks", lambda m: ~m["wide"])).where(F.size("marks") > 0)
    n = narrow.agg(F.sum(F.size("marks")).alias("n")).first()["n"] or 0
    ranges = max(parts, -(-n * (length + 200) // range_bytes))
    # Stored: dealing the runs evenly looks at their ranges first.
    runs = stored(narrow.mapInArrow(write_runs(length, ranges), RUN)).repartitionByRange(ranges, "r")
    spans = runs.groupBy("r").applyInArrow(merge_runs(length, k), SPAN)
    wide = kinds.withColumn("marks", F.filter("marks", lambda m: m["wide"])).where(F.size("marks") > 0)
    single = wide.select("k1", "k2", F.explode(window_udf(length)("text", "marks")).alias("w")).select("k1", "k2", "w.*")
    often = single.groupBy("a", "b").agg(F.count("*").alias("m")).where("m > 1").select("a", "b")
    spans = spans.unionByName(single.join(often, ["a", "b"], "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("end")))
    grouped = stored(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    none = F.array().cast(SPANS)
    whole = F.transform(F.filter("marks", lambda m: m["whole"]), lambda m: F.struct(m["lo"].alias("start"), (m["lo"] + m["n"] - 1 + length).alias("end")))
    cut = held.where("alone AND marks IS NOT NULL").join(grouped, ["k1", "k2"], "left")
    done = cut.select("k1", "k2", cut_udf()(F.col("text"), F.concat(whole, F.coalesce("spans", none))).alias("r"))
    sharing = sharing_texts(spoken, sure, held, passage, gram)
    # One row a text; whatever nothing was found about has none.
    told = done.join(counts.where("copies > 1"), ["k1", "k2"], "full").join(sharing, ["k1", "k2"], "full").join(worded.where("spoken_twice"), ["k1", "k2"], "full")
    out = found.select("__id", "sha", "k1", "k2", "n_bytes").join(told, ["k1", "k2"], "left")
    gone, some = F.col("copies").isNotNull(), F.col("r.n_removed") > 0
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    removed = F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("r.n_removed", F.lit(0))).cast("long")
    spans = F.when(gone, all_of_it).otherwise(F.coalesce("r.spans", none))
    left = F.when(gone, F.sha2(F.lit(b""), 256)).when(some, F.col("r.kept_sha256")).otherwise(F.col("sha"))
    shares = F.coalesce("shares", "spoken_twice", F.lit(False))
    return out.select(F.col("__id").alias(key), "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), spans.alias("spans"), left.alias("kept_sha256"), F.when(gone, F.lit(b"")).when(some, F.col("r.kept")).alias("kept"), shares.alias("shares_passage"))


def word_segments(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The word segments (k1, k2, h, c) whose anchor has several texts or forms; those (h, c)
    of them that several texts have; and, one text each, the forms of anchors of which some
    form is in one text only, which has no other segment in common with a text."""
    all_of_them = found.select("k1", "k2", F.explode("p").alias("p")).select("k1", "k2", "p.*")
    text, form = F.struct("k1", "k2"), F.col("c")
    often = all_of_them.groupBy("h").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("h")
    spoken = stored(all_of_them.join(stored(often), "h", "left_semi"))
    alike = stored(spoken.groupBy("h", form).agg(F.min(text).alias("x"), F.max(text).alias("y")))
    sure = alike.where("x <> y").select("h", "c")
    known = spoken.join(sure, ["h", "c"], "left_semi").select("k1", "k2").distinct()
    lonely = alike.where("x = y").select("h", "x.*").join(known, ["k1", "k2"], "left_anti").select("h").distinct()
    return spoken, sure, alike.join(lonely, "h", "left_semi").select("x.*", "h", "c")


def sharing_texts(spoken: DataFrame, sure: DataFrame, held: DataFrame, passage: int, gram: int) -> DataFrame:
    """(k1, k2, shares) of the texts that have a passage of another text."""
    heard = stored(held.where("words IS NOT NULL").select("k1", "k2", F.explode(passage_udf(passage, gram)("text", "words")).alias("w")).select("k1", "k2", "w.*"))
    # A form in several texts stands here for the one that it was taken from: that one is sure anyway.
    text = F.struct("k1", "k2")
    often = heard.groupBy("w").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("w")
    met = heard.join(often, "w", "left_semi").select("h", "c")
    # Stored: a join whose one side is an aggregate could not split a frequent passage's rows.
    return spoken.join(stored(met.unionByName(sure).distinct()), ["h", "c"], "left_semi").select("k1", "k2").distinct().withColumn("shares", F.lit(True))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur twice, and
    whether it shares a passage of over 50 words, in whatever bytes, with another one."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")

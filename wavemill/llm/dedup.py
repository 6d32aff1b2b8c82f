"""Near-duplicate groups from banded MinHash with Odd-sketch verification.

Every document's word shingles are hashed.  Independent MinHash samples form bands, which
bring candidates together.  A one-permutation MinHash (the smallest hash of each of 2048
bins) is folded into an Odd sketch, the parity bitmap of its samples: the population count
of two sketches' XOR tells how many samples differ, and so estimates high similarities
precisely (for small sets it nearly counts the symmetric difference).  Candidates whose
sketches are further apart than a similar pair's could be, at five standard deviations,
go; what is left is confirmed on the full shingle sets, computed again from the text.

Groups stay linear: documents with one and the same shingle set are one node; each band
bucket first links its members to its smallest node (a star, not all pairs), and one star
link a node, the closest by sketch, is confirmed.  Only nodes that are then still in
different components are compared within buckets, by size and sketch and in bounded
blocks, so that the pairs which come out are close to the threshold or above.  A bucket's
largest component is compared with the others alone, not with itself, and buckets with
many other nodes are divided by set size, so that pairs which can't be similar by their
sizes never meet.  Neither changes which pairs come out, however large a bucket is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_lists

#: 24 bands of 3 samples: a pair at similarity 0.75 shares no band with probability
#: (1 - 0.75 ** 3) ** 24 = 2e-6, one at 0.85 with 4e-10.
BANDS, ROWS = 24, 3
#: Bins of the one-permutation MinHash, and bits of the Odd sketch.
SKETCH_BITS = 2048
SEED = 0x9E3779B97F4A7C15
_U = np.uint64

SIGNATURE = "struct<n_shingles:long,set_a:long,set_b:long,sketch:array<long>,bands:array<long>>"


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(SEED) + _U(salt)) | _U(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(SEED))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the documents ``data[bounds[i]:bounds[i + 1]]``, and
    where each document's words begin.  Words never reach across documents."""
    with np.errstate(over="ignore"):
        low = _LOWER[data]
        letter = np.zeros(len(data) + 1, dtype=bool)
        letter[:-1] = ~_BLANK[low]
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        opened = bounds[:-1][letter[bounds[:-1]]]
        first[opened] = True
        starts = np.flatnonzero(first)
        last = np.zeros(len(data) + 1, dtype=bool)
        last[1:] = letter[:-1] & ~letter[1:]
        inner = bounds[1:-1]
        inner = inner[inner > 0]
        last[inner[letter[inner - 1]]] = True
        if len(data) and letter[len(data) - 1]:
            last[len(data)] = True
        ends = np.flatnonzero(last)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * powers(_BASE, len(data)), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.  A text of fewer words than
    ``width``, but not none, has its whole word sequence as the one shingle."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    bounds = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in raw], out=bounds[1:])
    words, at = word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    by = constants(width, 7)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            rolled += words[j : j + n] * by[j]
        rolled = mix(rolled)
        out = []
        for i in range(len(raw)):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                own = np.sort(rolled[a : b - width + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                out.append(mix(np.array([np.sum(words[a:b] * by[: b - a]) + _U(int(b - a))], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def odd_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """The Odd sketch of each sorted set, as 64-bit words.  A bin is a hash's leading bits,
    so the first hash of each bin is that bin's MinHash sample."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = owner * bits + (flat >> _U(64 - bits.bit_length() + 1)).astype(np.int64)
    lead = np.ones(len(flat), dtype=bool)
    lead[1:] = slot[1:] != slot[:-1]
    with np.errstate(over="ignore"):
        place = (mix(flat[lead] * _U(SEED)) % _U(bits)).astype(np.int64)
    odd = np.bincount(owner[lead] * bits + place, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.uint64)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (two a set) and band keys of non-empty shingle sets."""
    k = bands * rows
    flat = np.concatenate(sets)
    at = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    with np.errstate(over="ignore"):
        by, salt = constants(k, 11), constants(k, 13)
        prints = np.stack([np.add.reduceat(mix(flat ^ salt[0]), at), np.add.reduceat(mix(flat * by[0] + salt[1]), at)], axis=1)
        samples = np.empty((len(sets), k), dtype=np.uint64)
        buffer = np.empty_like(flat)
        for j in range(k):
            np.bitwise_xor(flat, salt[j], out=buffer)
            np.multiply(buffer, by[j], out=buffer)
            samples[:, j] = np.minimum.reduceat(buffer, at)
        grouped = samples.reshape(len(sets), bands, rows)
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(SEED), (len(sets), bands)).copy()
        for j in range(rows):
            keys = mix(keys ^ grouped[:, :, j])
    return prints, keys


def signature_udf(width: int, bands: int, rows: int, bits: int):
    @F.arrow_udf(SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, a, b, sketches, keys = [], [], [], [], []
            for (texts,) in text_lists(batch):
                sets = shingle_sets(texts, width)
                full = [s for s in sets if len(s)]
                if full:
                    prints, band, sketch = (x.view(np.int64) for x in (*signatures(full, bands, rows), odd_sketches(full, bits)))
                own = iter(range(len(full)))
                for s in sets:
                    counts.append(len(s))
                    m = next(own) if len(s) else None
                    a.append(None if m is None else int(prints[m, 0]))
                    b.append(None if m is None else int(prints[m, 1]))
                    sketches.append(None if m is None else sketch[m])
                    keys.append(None if m is None else band[m])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["n_shingles", "set_a", "set_b", "sketch", "bands"])

    return sign


def similar_udf(width: int, numerator: int, denominator: int):
    """Whether denominator * |A and B| >= numerator * |A or B| for two texts' shingle sets."""

    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out: list[bool] = []
            for x, y in text_lists(left, right):
                sets = shingle_sets(x + y, width)
                for s, t in zip(sets[: len(x)], sets[len(x) :]):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    out.append(denominator * both >= numerator * (len(s) + len(t) - both))
            yield pa.array(out, pa.bool_())

    return similar


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable.
    Alternates large-star and small-star; both keep components and flatten them in
    about log(n) rounds, each of which is stored in the shared folder."""
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        both = links.union(links.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = stored(small)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full shingle sets."""
    left = texts.select(F.col("__id").alias("a"), F.col("__text").alias("x"))
    right = texts.select(F.col("__id").alias("b"), F.col("__text").alias("y"))
    full = pairs.join(left, "a").join(right, "b")
    return full.where(similar_udf(width, numerator, denominator)("x", "y")).select("a", "b").distinct()


def sketches_fit(left: str, right: str, percent: int, bits: int) -> Column:
    """Whether the XOR of two Odd sketches has no more ones than a pair at the threshold
    may have, at five standard deviations.  Of N filled bins of the union a share 1 - J
    differs; each toggles one bit, or two where both sets fill the bin."""
    j = percent / 100
    x, y = F.col(f"{left}.n").cast("double"), F.col(f"{right}.n").cast("double")
    union = (x + y) / (1 + j)
    filled = bits * (1 - F.exp(-union / bits))
    twice = 2 - F.exp(-F.greatest(x, y) / bits)
    toggles = filled * (1 - j) * twice
    expected = bits / 2 * (1 - F.exp(-2 * toggles / bits))
    variance = twice * twice * filled * (j * (1 - j)) * F.greatest(F.lit(0.1), 1 - filled / union) + toggles / 16
    return xor_bits(left, right, bits) <= expected + 5 * F.sqrt(variance) + 2


def most_xor(x: np.ndarray, y: np.ndarray, percent: int, bits: int) -> np.ndarray:
    """The bound of ``sketches_fit`` for arrays of set sizes."""
    j = percent / 100
    union = (x + y) / (1 + j)
    filled = bits * (1 - np.exp(-union / bits))
    twice = 2 - np.exp(-np.maximum(x, y) / bits)
    toggles = filled * (1 - j) * twice
    variance = twice * twice * filled * (j * (1 - j)) * np.maximum(0.1, 1 - filled / union) + toggles / 16
    return bits / 2 * (1 - np.exp(-2 * toggles / bits)) + 5 * np.sqrt(variance) + 2


def block_pairs(percent: int, bits: int):
    """For one pair of a large bucket's blocks: the candidates (a, b) between them that no
    earlier band has in one bucket."""

    def compare(table: pa.Table) -> pa.Table:
        rep, group, n, own, p, q = (table[c].to_numpy() for c in ("rep", "group", "n", "own", "p", "q"))
        sketch = np.frombuffer(table["sketch"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.uint64).reshape(len(rep), -1)
        earlier = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)[:, : table["j"][0].as_py()]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        found = []
        for i in left:
            other = right[(group[right] != group[i]) & (n[right] * 100 >= n[i] * percent) & (n[i] * 100 >= n[right] * percent)]
            ones = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1)
            hit = other[ones <= most_xor(n[other].astype(float), float(n[i]), percent, bits)]
            hit = hit[~(earlier[hit] == earlier[i]).any(axis=1)]
            found.append(np.stack([np.minimum(rep[hit], rep[i]), np.maximum(rep[hit], rep[i])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return compare


def candidates(rest: DataFrame, percent: int, bits: int, small: int = 64, block: int = 1024, most: int = 16_384) -> DataFrame:
    """Candidate pairs (a, b) between the components of each bucket.  Buckets up to
    ``small`` rows are joined with themselves.  In larger ones the nodes outside the largest
    component are dealt into blocks of about ``block`` rows, and so are those of it; each
    block of the first meets all blocks, in a task's arrays.  A bucket with more than
    ``most`` nodes outside its largest component is first divided by size classes, in which
    all pairs meet whose sizes fit: the pairs are the same for every ``small``, ``block`` and
    ``most``."""
    low = rest.where(F.col("size") <= small)
    apart = (F.col("m.group") < F.col("o.group")) & sizes_fit("m", "o", percent) & sketches_fit("m", "o", percent, bits)
    few = low.alias("m").join(low.alias("o"), (F.col("m.band") == F.col("o.band")) & apart).select(F.least("m.rep", "o.rep").alias("a"), F.greatest("m.rep", "o.rep").alias("b"))
    large = with_largest(rest.where(F.col("size") > small).withColumn("part", F.lit(0)), ["band", "part"])
    wide = large.where(F.col("others") > most).drop("part", "size", "others", "largest").withColumn("part", F.explode(size_parts("n", percent)))
    again = with_largest(wide, ["band", "part"]).where("others > 0")
    dealt = large.where(F.col("others") <= most).unionByName(again)
    # The blocks of the other nodes come first; those of the largest component follow.
    first = F.ceil(F.col("others") / block).cast("int")
    blocks = first + F.ceil((F.col("size") - F.col("others")) / block).cast("int")
    inner = F.col("group") == F.col("largest")
    place = F.xxhash64("rep")
    own = F.when(inner, F.col("first") + F.pmod(place, F.col("blocks") - F.col("first"))).otherwise(F.pmod(place, F.greatest("first", F.lit(1)))).cast("int")
    dealt = dealt.withColumn("first", first).withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("first")).otherwise(F.col("blocks")) - 1))).withColumn("p", F.least("own", "k")).withColumn("q", F.greatest("own", "k"))
    many = dealt.select("band", "part", "j", "p", "q", "own", "rep", "group", "n", "sketch", "bands").groupBy("band", "part", "p", "q").applyInArrow(block_pairs(percent, bits), "a long, b long")
    return few.unionByName(many).distinct()


def size_parts(n: str, percent: int) -> Column:
    """The parts of a bucket that a set of size ``n`` is in: its size class, and the next one,
    which holds the neighbouring classes' pairs.  Sizes that fit are at most one class apart;
    classes are a little wider than the threshold asks, whatever the logarithm is off by."""
    if percent >= 100:
        return F.array(F.col(n).cast("int"))
    own = F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-6))).cast("int")
    return F.array(own, own + 1)


def with_largest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the size of their bucket, its largest component, and how many rows are
    outside it."""
    groups = rows.groupBy(*keys, "group").agg(F.count("*").alias("n"))
    top = groups.groupBy(*keys).agg(F.sum("n").alias("size"), F.max_by("group", F.struct("n", "group")).alias("largest"), F.max("n").alias("top"))
    return rows.drop("size").join(top.select(*keys, "size", "largest", (F.col("size") - F.col("top")).alias("others")), keys)


def xor_bits(left: str, right: str, bits: int) -> Column:
    ones = [F.bit_count(F.col(f"{left}.sketch")[i].bitwiseXOR(F.col(f"{right}.sketch")[i])) for i in range(bits // 64)]
    return sum(ones[1:], ones[0])


def sizes_fit(left: str, right: str, percent: int) -> Column:
    """Similar sets can't differ more in size than the threshold allows."""
    x, y = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (x * 100 >= y * percent) & (y * 100 >= x * percent)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Rows whose shingle sets have ``100 * |A and B| >= percent * |A or B|`` are linked;
    ``component_id`` is the smallest key reachable and ``kept`` says that it is the row's
    own.  A null or blank text has no shingle and links with nothing.  Rows with a null
    key are kept, link with nothing and have a null component.  Rows that share a key
    are one document: they share the component, and are all kept or all dropped.
    """
    base = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    signed = stored(base.select("__id", signature_udf(width, bands, rows, SKETCH_BITS)("__text").alias("s")).select("__id", "s.*"))
    own = signed.where(F.col("__id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(own.groupBy("set_a", "set_b").agg(F.min("__id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")))
    nodes = classes.select("rep", "n", "sketch")
    buckets = classes.select("rep", F.posexplode("bands").alias("j", "band"))
    leads = buckets.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1").select("band", "lead")
    shared = stored(buckets.join(leads, "band"))
    stars = shared.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    sized = stars.join(nodes.alias("p"), F.col("a") == F.col("p.rep")).join(nodes.alias("q"), F.col("b") == F.col("q.rep"))
    near = sized.where(sizes_fit("p", "q", percent) & sketches_fit("p", "q", percent, SKETCH_BITS)).select("a", "b", xor_bits("p", "q", SKETCH_BITS).alias("d"))
    first = stored(near.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b"))
    texts = base.where(F.col("__id").isNotNull())
    links = stored(confirmed(first, texts, width, percent, 100))
    found = connected(links)
    # Stored before it is aggregated: a frequent band's rows are then split among tasks.
    grouped = stored(shared.join(found, F.col("rep") == F.col("node"), "left").select("band", "j", "rep", F.coalesce("component", "rep").alias("group")))
    mixed = grouped.groupBy("band").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.count("*").alias("size")).where("x < y").select("band", "size")
    rest = stored(grouped.join(mixed, "band").join(classes.select("rep", "n", "sketch", "bands"), "rep"))
    cross = candidates(rest, percent, SKETCH_BITS).join(first, ["a", "b"], "left_anti")
    more = confirmed(stored(cross), texts, width, percent, 100)
    all_links = links.unionByName(more).unionByName(_same_key(own, classes))
    found = connected(all_links)
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("__id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("component_id", "__id"))
    return out.select(F.col("__id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))


def _same_key(own: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a key."""
    held = own.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).select("__id", "rep")
    many = held.groupBy("__id").agg(F.min("rep").alias("a"), F.max("rep").alias("y")).where("a < y").select("__id", "a")
    return held.join(many, "__id").where("rep > a").select("a", F.col("rep").alias("b"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five words, similarity 0.75."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w
), u AS (
    SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))
), e AS (
    SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), r AS (
    SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x
), c AS (
    SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id
"""

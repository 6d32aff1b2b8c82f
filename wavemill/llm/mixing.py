"""Temperature mixing of sources.

Source weights are token shares raised to an exponent and normalised.  The exponent is
bisected to reach a target entropy, or the flattest mix within a limit on how often the
smallest source is repeated.  Weights are realised as budgeted block permutations: each
source's documents are permuted by a keyed hash and cut into blocks of equal hash ranges;
every full epoch takes all blocks, and the last, partial epoch takes blocks in order until
its token budget is met, the block at the boundary document by document.

Documents are never shuffled.  Up to ``max_sources`` sources, their totals are held by the
driver and the weights are broadcast; beyond, the exponent is found by aggregates over the
totals, and the planner chooses how weights are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_clashes, stored, unit_hash


def entropy(weights: list[float]) -> float:
    """Shannon entropy in nats."""
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[float], exponent: float) -> list[float]:
    """Normalised ``tokens ** exponent``; sources without tokens weigh nothing."""
    top = max(tokens, default=0)
    raw = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    total = sum(raw)
    return [r / total if total else 0.0 for r in raw]


def bisect_exponent(tokens: list[float], target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent in [0, 1] that meets the target entropy, raised as far as the limit on
    repeats asks for; without a target, the smallest exponent within that limit."""
    full = [t for t in tokens if t > 0]
    if not full:
        return 1.0

    def lowest(fits) -> float:
        if fits(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high

    # Entropy falls and repeats fall as the exponent grows.
    spread = max(full) / min(full)
    by_limit = lowest(lambda a: spread ** (1 - a) <= max_repeats) if max_repeats else 0.0
    by_entropy = lowest(lambda a: entropy(tempered(full, a)) <= target_entropy) if target_entropy is not None else 0.0
    return max(by_limit, by_entropy)


def bisect_by_aggregates(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, steps: int = 16) -> float:
    """``bisect_exponent`` of the column ``t``: each job looks at ``steps`` exponents at once."""
    full = totals.where("t > 0")
    top, least = full.agg(F.max("t"), F.min("t")).first()
    if top is None:
        return 1.0
    by_limit = bisect_exponent([top, least], None, max_repeats) if max_repeats else 0.0
    if target_entropy is None:
        return by_limit
    share = F.col("t") / F.lit(top)

    def entropies(exponents: list[float]) -> list[float]:
        raw = [F.pow(share, F.lit(a)) for a in exponents]
        sums = full.agg(*[x for r in raw for x in (F.sum(r), F.sum(r * F.log(r)))]).first()
        return [math.log(z) - s / z for z, s in zip(sums[::2], sums[1::2])]

    low, high = 0.0, 1.0
    if entropies([0.0])[0] <= target_entropy:
        return by_limit
    while high - low > 2.0**-52:
        inner = [low + (high - low) * (i + 1) / (steps + 1) for i in range(steps)]
        fits = [x <= target_entropy for x in entropies(inner)]
        first = fits.index(True) if True in fits else steps
        edges = (inner[first - 1] if first else low), (inner[first] if first < steps else high)
        if edges == (low, high):
            break
        low, high = edges
    return max(by_limit, high)


def word_count(text: Column) -> Column:
    """Blank-separated words; none in a null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """Null sources form a source of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def plan_mix(narrow: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_tokens: float | None, n_blocks: int, max_sources: int) -> tuple[DataFrame, bool]:
    """(s, weight, full, cut) of each source: full epochs, and the hash up to which documents
    are in the partial epoch (below 0: none); and whether there are few sources.
    ``narrow`` has the source ``s``, the place ``h`` and the tokens ``n`` of each document."""
    blocks = stored(narrow.groupBy("s", F.floor(F.col("h") * n_blocks).cast("int").alias("b")).agg(F.sum("n").alias("n")))
    totals = stored(blocks.groupBy("s").agg(F.sum("n").cast("double").alias("t")))
    held = [r["t"] for r in totals.limit(max_sources + 1).collect()]
    few = len(held) <= max_sources
    exponent = bisect_exponent(held, target_entropy, max_repeats) if few else bisect_by_aggregates(totals, target_entropy, max_repeats)
    top = totals.agg(F.max("t").alias("t")).first()["t"] or 0.0
    raw = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(top or 1.0), F.lit(exponent))).otherwise(0.0)
    sum_raw = totals.agg(F.sum(raw).alias("z")).first()["z"] or 0.0
    weight = raw / F.lit(sum_raw or 1.0)
    # Without a budget, the most plentiful source is seen just once.
    budget = budget_tokens if budget_tokens is not None else top * sum_raw
    epochs = F.when(F.col("t") > 0, F.col("weight") * F.lit(float(budget)) / F.col("t")).otherwise(1.0)
    epochs = F.least(epochs, F.lit(float(max_repeats))) if max_repeats and budget_tokens is not None else epochs
    plan = totals.withColumn("weight", weight).withColumn("e", epochs).withColumn("e", F.when(F.abs(F.col("e") - F.round("e")) < 1e-9, F.round("e")).otherwise(F.col("e")))
    plan = stored(plan.withColumn("full", F.floor("e").cast("long")).withColumn("rest", (F.col("e") - F.col("full")) * F.col("t")))
    asked = plan.where("rest > 0").select("s", "rest")
    run = F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = blocks.withColumn("upto", run).join(asked, "s").where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
    edge = stored(edge.groupBy("s").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "rest"), "b").alias("e")).select("s", "e.*"))
    inside = narrow.withColumn("b", F.floor(F.col("h") * n_blocks).cast("int")).join(F.broadcast(edge) if few else edge, ["s", "b"])
    ties = inside.groupBy("s", "h").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = F.sum("n").over(W.partitionBy("s").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = ties.withColumn("upto", F.col("before") + run).where(F.col("upto") <= F.col("rest")).groupBy("s").agg(F.max("h").alias("last"))
    # All blocks before the boundary block, and its documents that still fit; hashes have 52 bits.
    cut = F.when(F.col("rest") <= 0, -1.0).when(F.col("b").isNull(), 1.0).otherwise(F.coalesce("last", F.col("b") / n_blocks - 2.0**-53))
    return stored(plan.join(edge.select("s", "b"), "s", "left").join(last, "s", "left").select("s", "weight", "full", cut.alias("cut"))), few


def order_hash(key: str, seed: int) -> Column:
    return unit_hash(F.lit(f"mix{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_tokens: float | None = None,
    n_blocks: int = 4096,
    seed: int = 0,
    max_sources: int = 20_000,
    tokens: str | None = None,
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``weight`` (of its source), ``block`` (in its source's
    permutation) and ``copies`` (times the document is seen).

    A null source is a source of its own; a null or blank text has no tokens and takes part
    in whole epochs; rows with one key share a place in the permutation, so repeated rows
    are taken together.  Without ``budget_tokens`` the budget is the one at which the most
    plentiful source is seen once, so nothing is dropped.  ``max_sources`` bounds what is
    broadcast and held by the driver; there may be more.  ``tokens`` names a column with
    counts made before; null counts as 0.
    """
    kept = drop_clashes(docs, *({"n_tokens", "weight", "block", "copies"} - {tokens}))
    n_tokens = F.coalesce(F.col(tokens), F.lit(0)).cast("long") if tokens else word_count(F.col(text))
    narrow = stored(kept.select(source_key(source).alias("s"), order_hash(key, seed).alias("h"), n_tokens.alias("n")))
    plan, few = plan_mix(narrow, target_entropy, max_repeats, budget_tokens, n_blocks, max_sources)
    table = plan.select(F.col("s").alias("__s"), F.col("weight").alias("__weight"), F.col("full").alias("__full"), F.col("cut").alias("__cut"))
    hashed = kept.withColumn("__s", source_key(source)).withColumn("__h", order_hash(key, seed))
    joined = hashed.join(F.broadcast(table) if few else table, "__s", "left")
    copies = F.coalesce(F.col("__full") + F.when(F.col("__h") <= F.col("__cut"), 1).otherwise(0), F.lit(1)).cast("long")
    return joined.select(*[F.col(c) for c in kept.columns if c != tokens], n_tokens.alias("n_tokens"), F.col("__weight").alias("weight"), F.floor(F.col("__h") * n_blocks).cast("long").alias("block"), copies.alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every document as many times as ``copies`` says."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy", "copies", "n_tokens", "weight", "block")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is seen in the flattest mix that repeats no source more than
    twice and cuts none.  Words are counted once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")))
    return mix_sources(counted, tokens="n").select("doc_id", "source", "n_tokens", "weight", "block", "copies")

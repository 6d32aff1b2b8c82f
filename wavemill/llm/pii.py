"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans (mail addresses, IP addresses, payment cards, phone numbers) come from patterns
with checks.  Further generators propose spans with high recall, overlapping ones too: long
tokens of mixed characters, groups of digits, spelt-out mail addresses.  Boosted trees score
them by format and neighbourhood; a threshold for each kind, calibrated on held-out
candidates of that kind that touch no base span, selects.

No labels are needed: a candidate's training label comes from what its features don't see,
the checks of overlapping base spans and the cue words before it.  The trees are fitted by
MLlib on a bounded sample and compiled to SQL expressions, so that scoring is part of the
scan: no shuffle, no explode, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, stored, unit_hash

MAIL = "[A-Za-z0-9._%+-]"
#: The base kinds, in their order, and their patterns.  They match what the
#: plain patterns match: a run that failed from its first character isn't tried from its
#: later ones, and possessive quantifiers stand where nothing could be given back.
BASE = {
    "email": rf"(?:\G|(?<!{MAIL})){MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, of any length.  A long number is proposed beside the
#: numbers in it, as these can be apart from a base span that it touches.
MORE = {
    "handle": rf"(?<!{MAIL}){MAIL}++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+(?![A-Za-z0-9+/_-])",
    "number": r"(?<![A-Za-z0-9.+])[0-9][0-9()\x20.-]{7,22}[0-9](?![A-Za-z0-9])",
    "long_number": r"(?<![A-Za-z0-9.+])[0-9][0-9()\x20.-]{23,}[0-9](?![A-Za-z0-9])",
}
RANKS = {k: i for i, k in enumerate([*BASE, *MORE])}
#: Words that announce a secret or a personal number right before it.
CUES = r"(?i)(?:token|password|passwd|secret|api[_-]?key|access[_-]?key|ssn|iban|account|phone|tel|card)[\"']?\s*[=:]?\s*[\"']?$"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string,before:string,after:string>>"
#: Numbers of an array that are summed up in one go.
BLOCK = 32
FEATURES = ("length", "digits", "letters", "uppers", "separators", "distinct", "changes", "quoted", "spaced")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn check."""
    digits = F.regexp_replace(text, "[^0-9]", "")

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(span: Column) -> Column:
    """The check of a base kind."""
    text, kind = span["text"], span["kind"]
    bare = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    part = F.forall(bare, lambda p: (F.length(p) <= 3) & (F.concat(F.lit("0"), F.substring(p, 1, 3)).cast("int") <= 255))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return F.when(kind == "ip", part).when(kind == "card", luhn(text)).when(kind == "phone", digits.between(9, 15)).otherwise(True)


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a column of spans for each kind.  The gaps between a pattern's matches
    have the same lengths as the text between the spans, so that running sums of both are
    the positions."""
    digit = F.col(text).rlike("[0-9]")
    may = {"email": F.contains(F.col(text), F.lit("@")), "handle": F.col(text).rlike(r"[\[(]at[\])]"), "phone": F.contains(F.col(text), F.lit("+")), "ip": digit, "card": digit, "secret": digit, "number": digit, "long_number": digit}
    patterns = {**BASE, **MORE}
    none = F.array().cast("array<string>")
    cut = docs.withColumns({f"__m_{k}": F.when(may[k], F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()} | {f"__g_{k}": F.when(may[k], F.split(F.col(text), p, -1)).otherwise(none) for k, p in patterns.items()})

    def placed(kind: str) -> Column:
        matches, gaps = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")
        steps = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

        def spans(ends: Column) -> Column:
            return F.transform(
                matches,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"), F.lit(RANKS[kind]).alias("rank"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), m.alias("text"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(4)).alias("after")
                ),
            )

        return F.when((F.size(matches) > 0) & (F.size(gaps) > 0), let(running(steps, lambda a, x: a + x), spans)).otherwise(F.array()).cast(SPAN)

    placed_all = cut.withColumns({f"__s_{k}": placed(k) for k in patterns})
    return placed_all.drop(*[f"__{x}_{k}" for x in "mg" for k in patterns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], depth: int = 3) -> Column:
    """Running sums, maxima and the like of an array of whole numbers.  An array that grows
    by one is copied each time, so that it is done in short blocks, whose last values are
    then carried on alike."""

    def plain(block: Column) -> Column:
        return F.aggregate(block, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(combine(F.get(acc, F.size(acc) - 1), x), x))))

    def joined_up(blocks: Column) -> Column:
        upto = running(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)), combine, depth - 1)
        before = F.concat(F.array(F.lit(None).cast("int")), F.slice(upto, F.lit(1), F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, o: F.when(o.isNull(), b).otherwise(F.transform(b, lambda x: combine(o, x)))))

    def blockwise(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: plain(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(v) <= BLOCK, plain(v)).otherwise(let(cut, joined_up))

    return let(values, blockwise if depth else plain)


def apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def free_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others.  All stand in one order: the others by their
    starts, a span by its end, before what starts there.  A span is hit if the furthest end so
    far is beyond its start."""
    point = "struct<at:int,other:boolean,far:int,span:struct<start:int,rank:int,end:int,kind:string,text:string,before:string,after:string>>"
    asked = F.transform(spans, lambda c: F.struct(c["end"].alias("at"), F.lit(False).alias("other"), F.lit(0).alias("far"), c.alias("span")).cast(point))
    met = F.transform(others, lambda b: F.struct(b["start"].alias("at"), F.lit(True).alias("other"), b["end"].alias("far"), F.lit(None).alias("span")).cast(point))

    def tell(points: Column) -> Column:
        far = running(F.transform(points, lambda p: p["far"]), F.greatest)
        marked = F.zip_with(points, far, lambda p, f: F.struct(p["span"].alias("span"), (p["other"] | (f > p["span"]["start"])).alias("gone")))
        return F.transform(F.filter(marked, lambda m: ~m["gone"]), lambda m: m["span"])

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(asked, met)), tell))


def clusters(spans: Column) -> Column:
    """Spans (with their fields in ``s``) in groups, by start, so that those of different groups
    are apart."""

    def cut(ordered: Column) -> Column:
        far = running(F.transform(ordered, lambda c: c["s"]["end"]), F.greatest)

        def parts(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.coalesce(F.get(ends, i - 1) <= F.get(ordered, i)["s"]["start"], F.lit(True)))
            return let(first, lambda at: F.transform(at, lambda a, i: F.slice(ordered, a + 1, F.coalesce(F.get(at, i + 1), F.size(ordered)) - a)))

        return let(far, parts)

    return F.when(F.size(spans) == 0, F.array()).otherwise(let(F.array_sort(spans), cut))


def features(span: Column) -> list[Column]:
    """Format and neighbourhood of a candidate, in the order of FEATURES."""
    text = span["text"]

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{pattern}]", ""))

    changes = F.size(F.split(text, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))
    distinct = F.size(F.array_distinct(F.split(text, "")))
    quoted = span["before"].rlike(r"[\"'=:]$").cast("int")
    spaced = (span["before"].rlike(r"(?:^|\s)$") & (F.coalesce(span["after"], F.lit("")).rlike(r"^(?:$|[\s.,;!?])"))).cast("int")
    return [x.cast("double") for x in (F.length(text), count("0-9"), count("A-Za-z"), count("A-Z"), count(r"\x20().-"), distinct, changes, quoted, spaced)]


def tree_column(lines: list[str], value) -> Column:
    """One regression tree, from the lines of its printed form, as nested CASEs."""

    def read(i: int) -> tuple[Column, int]:
        line = lines[i].strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1])), i + 1
        f, bound = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        yes, i = read(i + 1)
        no, i = read(i + 1)  # past the Else line
        return F.when(value(int(f)) <= float(bound), yes).otherwise(no), i

    return read(0)[0]


class SpanModel:
    """Boosted trees as printed by MLlib, their weights, and the calibrated threshold of each
    kind of candidate (or one for all)."""

    def __init__(self, trees: list[list[str]], weights: list[float], threshold: dict[str, float] | float):
        self.trees, self.weights = trees, weights
        self.thresholds = threshold if isinstance(threshold, dict) else dict.fromkeys(MORE, threshold)

    def threshold(self, kind: Column) -> Column:
        """What a candidate's score must reach; over 1 where nothing may be selected."""
        chain = F.lit(2.0)
        for k, t in self.thresholds.items():
            chain = F.when(kind == k, F.lit(t)).otherwise(chain)
        return chain

    def score(self, values: Column) -> Column:
        """The probability that a candidate with this feature array is personal data."""
        if not self.trees:
            return F.lit(0.0)
        parts = [F.lit(w) * tree_column(t, lambda f: F.get(values, F.lit(f))) for t, w in zip(self.trees, self.weights)]
        return 1 / (1 + F.exp(-2 * sum(parts[1:], parts[0])))


def fit_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 20_000, sample_spans: int = 6_000, rounds: int = 8, depth: int = 3, precision: float = 0.95) -> SpanModel:
    """Fit on the candidates of about ``sample_docs`` documents, by hash of their keys, and
    ``sample_spans`` of these at most.  Two thirds train; on the rest, each kind gets the
    smallest threshold at which its candidates apart from base spans have at least
    ``precision``.  A kind without such a threshold is not selected, and with one class only,
    none is."""
    spark = docs.sparkSession
    total = docs.count()
    near = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).where(unit_hash(F.lit("pii"), F.col(key).cast("string")) < sample_docs / max(1, total))
    marked = with_spans(near.select(F.col(key).alias("__id"), F.col(text).alias("__t")), "__t")
    base = F.filter(F.concat(*[F.col(f"__s_{k}") for k in BASE]), passes)
    marked = marked.select("__id", base.alias("base"), F.concat(*[F.col(f"__s_{k}") for k in MORE]).alias("more"))
    free = marked.where(F.size("more") > 0).withColumn("free", free_of(F.col("more"), F.col("base")))
    alone = F.transform("free", lambda c: F.struct(c.alias("c"), F.lit(False).alias("touches")))
    hurt = F.transform(F.array_except("more", "free"), lambda c: F.struct(c.alias("c"), F.lit(True).alias("touches")))
    rows = free.select("__id", F.explode(F.concat(alone, hurt)).alias("x")).select("__id", "x.c", "x.touches")
    touches = F.col("touches")
    hit = touches | F.col("c.before").rlike(CUES) | (F.col("c.kind") == "handle")
    rows = rows.select(hit.cast("double").alias("label"), F.col("c.kind").alias("kind"), touches.alias("touches"), F.array(*features(F.col("c"))).alias("v"), unit_hash(F.col("__id").cast("string"), F.col("c.start").cast("string")).alias("u"))
    rows = stored(rows.orderBy("u", "v", "kind").limit(sample_spans).coalesce(1))
    kinds = [r["label"] for r in rows.where("u < 2/3.0").select("label").distinct().collect()]
    if len(kinds) < 2:
        return SpanModel([], [], 2.0)
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=32, seed=7, featuresCol="x").fit(rows.where("u < 2/3.0").select("label", array_to_vector("v").alias("x")))
    trees = [t.toDebugString.splitlines()[1:] for t in fitted.trees]
    model = SpanModel(trees, list(fitted.treeWeights), 2.0)
    held = rows.where("u >= 2/3.0 AND NOT touches").select("label", "kind", model.score(F.col("v")).alias("p")).collect()
    return SpanModel(trees, model.weights, {k: calibrate([(r["p"], r["label"]) for r in held if r["kind"] == k], precision) for k in MORE})


def calibrate(held: list[tuple[float, float]], precision: float) -> float:
    """The smallest score, 0.5 at least, from which on the labels have the precision; equal
    scores stand or fall together; 2 if there is none."""
    right, threshold = 0.0, 2.0
    ordered = sorted(held, key=lambda r: -r[0])
    for n, (p, label) in enumerate(ordered, 1):
        right += label
        if (n == len(ordered) or ordered[n][0] < p) and right / n >= precision and p >= 0.5:
            threshold = p
    return threshold


def find_pii(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, rank, end, kind, text,
    before, after), in code points, sorted by start and kind.  ``spans`` has the base spans
    and the selected candidates that touch none of them; of overlapping candidates the one
    with the highest score stays (ties: the first), but a selected long number takes the place
    of the numbers in it, unless it touches a secret or handle that stays.  A null text has no
    spans."""
    kept = drop_clashes(docs, "base_spans", "spans")
    marked = with_spans(kept.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text")
    base = marked.withColumn("base_spans", F.array_sort(F.filter(F.concat(*[F.col(f"__s_{k}") for k in BASE]), passes)))
    base = base.withColumn("__more", free_of(F.concat(*[F.col(f"__s_{k}") for k in MORE]), F.col("base_spans")))
    more = F.col("__more")
    valued = base.withColumn("__c", F.transform(more, lambda c: F.struct(c.alias("s"), F.array(*features(c)).alias("v"))))
    scored = valued.withColumn("__p", F.filter(F.transform("__c", lambda c: F.struct(c["s"].alias("s"), model.score(c["v"]).alias("p"))), lambda c: c["p"] >= model.threshold(c["s"]["kind"])))

    def beats(o: Column, c: Column) -> Column:
        return (o["p"] > c["p"]) | ((o["p"] == c["p"]) & ((o["s"]["start"] < c["s"]["start"]) | ((o["s"]["start"] == c["s"]["start"]) & (o["s"]["rank"] < c["s"]["rank"]))))

    def kind(c: Column) -> Column:
        return c["s"]["kind"]

    short = scored.withColumn("__long", F.filter("__p", lambda c: kind(c) == "long_number")).withColumn("__p", F.filter("__p", lambda c: kind(c) != "long_number"))
    best = F.flatten(F.transform(clusters(F.col("__p")), lambda own: F.when(F.size(own) == 1, own).otherwise(F.filter(own, lambda c: F.forall(own, lambda o: apart(o["s"], c["s"]) | ~beats(o, c))))))
    chosen = short.withColumn("__p", F.transform(best, lambda c: c["s"])).withColumn("__long", F.transform("__long", lambda c: c["s"]))
    chosen = chosen.withColumn("__long", free_of(F.col("__long"), F.filter("__p", lambda o: o["kind"] != "number")))
    left = free_of(F.col("__p"), F.col("__long"))
    return chosen.withColumn("spans", F.array_sort(F.concat("base_spans", left, "__long"))).select(*kept.columns, "base_spans", "spans")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, *kinds: str) -> Column:
    """How many spans are of these kinds."""
    return F.size(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("long")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, those that the method adds, and counts
    of both (``n_found`` of all)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit_spans(docs))
    more = [counted("spans", "handle").alias("n_handle"), counted("spans", "secret").alias("n_secret"), counted("spans", "number", "long_number").alias("n_number"), F.size("spans").cast("long").alias("n_found")]
    return found.select("doc_id", *[counted("base_spans", k).alias(f"n_{k}") for k in BASE], F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more)

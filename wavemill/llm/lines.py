"""Line dedup by a log-template tree.

A line's tokens are masked where they hold digits or an @, and the line goes down a tree of
fixed depth: token count first, then the leading tokens.  In the leaf, each position is
generalised by support: a token that enough documents have at that position of the leaf is
constant, any other becomes a wildcard.  Lines of one generalised form share a template,
and templates that recur across documents are dropped, unless they are mostly wildcards.

Support makes the templates independent of the order in which lines come, so the tree is a
few aggregations, each with partial sums before its shuffle.  Only leaves with enough
documents go on, and there only distinct lines are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, stored

#: Documents that a token, a leaf or a template needs to count as recurring.
MIN_DOCS = 5
#: Leading tokens on a line's path, and the share of constant tokens that a template needs.
DEPTH, MIN_CONSTANT = 3, 0.5
WILD = "<*>"
VARIABLE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*"


def masked_lines(text: Column) -> Column:
    """A text's lines, in order, with wildcards for tokens that hold a digit or @ and one
    blank between tokens.  Each step is a pass of its own over the array, so that what a
    line needs is worked out once; most lines need neither replacement."""
    for c in "\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(" "))
    single = F.transform(F.split(text, "\n"), lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    return F.transform(single, lambda x: F.trim(F.when(x.rlike("[0-9@]"), F.regexp_replace(x, VARIABLE, WILD)).otherwise(x)))


def two_hashes(x: Column) -> Column:
    """A 128-bit key."""
    return F.struct(F.xxhash64(F.lit("a"), x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"))


def recurring_lines(docs: DataFrame, key: str, text: str, min_docs: int, depth: int, min_constant: float) -> DataFrame:
    """(t, m): the masked lines of each text, by its hash, whose template recurs.  Whether a
    line goes doesn't depend on its document, so that texts of one hash can share a list."""
    lines = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.explode(masked_lines(F.col(text))).alias("s")).where("s <> ''")
    # The path is cut from the line's start; only its count looks at all of it.
    path = F.xxhash64(F.length("s") - F.length(F.replace("s", F.lit(" "))), F.substring_index("s", " ", depth))
    placed = lines.select("d", "t", two_hashes(F.col("s")).alias("m"), path.alias("leaf"), "s")
    held = stored(placed.select("leaf", "m", "d", "t").distinct())
    leaves = stored(held.select("leaf", "d").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"))
    counts = held.join(leaves, "leaf", "left_semi").select("leaf", "m", "d").distinct().groupBy("leaf", "m").agg(F.count("*").alias("docs"))
    texts = placed.join(leaves, "leaf", "left_semi").groupBy("leaf", "m").agg(F.any_value("s").alias("s"))
    forms = stored(counts.join(texts, ["leaf", "m"]))
    # A line that recurs as it stands has support for all its tokens.
    plain = forms.where(F.col("docs") >= min_docs).select("m", F.col("m").alias("template"), constant_share(F.split("s", " ")).alias("share"))
    words = forms.select("leaf", "m", "docs", F.posexplode(F.split("s", " ")).alias("p", "t"))
    support = words.groupBy("leaf", "p", "t").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "p", "t", F.lit(True).alias("constant"))
    rare = words.where(F.col("docs") < min_docs).join(support, ["leaf", "p", "t"], "left")
    general = rare.groupBy("leaf", "m").agg(F.array_sort(F.collect_list(F.struct("p", F.when(F.col("constant"), F.col("t")).otherwise(WILD).alias("t")))).alias("ts"))
    general = general.select("m", F.transform("ts", lambda x: x["t"]).alias("ts"), "leaf")
    general = general.select("m", two_hashes(F.concat_ws(" ", F.col("leaf").cast("string"), F.array_join("ts", " "))).alias("template"), constant_share(F.col("ts")).alias("share"))
    named = stored(plain.unionByName(general).where(F.col("share") >= min_constant))
    known = held.select("d", "t", "m").join(named.select("m", "template"), "m")
    often = known.select("template", "d").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    return known.join(often, "template", "left_semi").select("t", "m")


def constant_share(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != WILD)) / F.size(tokens)


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, depth: int = DEPTH, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines end at a line feed; blank lines are never dropped.  A null text has no lines and
    a null kept text; an empty one has one line.  Rows that share a key, null keys too, are
    one document when documents are counted; each row is cut.  Columns of the result's
    names are replaced.
    """
    kept = drop_clashes(docs, "n_lines", "n_dropped", "kept_text")
    gone = recurring_lines(kept, key, text, min_docs, depth, min_constant).groupBy(F.col("t").alias("__t")).agg(F.collect_set("m").alias("__gone"))
    # Stored: the rows of a frequent text can then be split among tasks.
    joined = kept.join(stored(gone), F.xxhash64(text) == F.col("__t"), "left").drop("__t")
    lines = F.split(F.col(text), "\n")
    keyed = F.arrays_zip(lines.alias("x"), F.transform(masked_lines(F.col(text)), two_hashes).alias("k"))
    left = F.transform(F.filter(keyed, lambda s: ~F.array_contains(F.col("__gone"), s["k"])), lambda s: s["x"])
    cut = joined.withColumn("__left", F.when(F.col("__gone").isNotNull(), left).otherwise(lines))
    n_lines, n_left = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("__left"), F.lit(0))
    n_lines, n_left = F.when(F.col(text).isNull(), 0).otherwise(n_lines), F.when(F.col(text).isNull(), 0).otherwise(n_left)
    return cut.select(*kept.columns, n_lines.cast("long").alias("n_lines"), (n_lines - n_left).cast("long").alias("n_dropped"), F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join("__left", "\n")).alias("kept_text"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its recurring lines."""
    cut = drop_recurring_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
    SELECT doc_id, generate_subscripts(a, 1) AS p, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), m AS (
    SELECT doc_id, p, line, array_to_string(list_transform(string_split(trim(regexp_replace(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' {2,}', ' ', 'g'), ' '), ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9@]') THEN '<*>' ELSE t END), ' ') AS s FROM l
), f AS (
    SELECT s, count(DISTINCT doc_id) AS docs, string_split(s, ' ') AS ts, CAST(len(string_split(s, ' ')) AS VARCHAR) || '|' || array_to_string(string_split(s, ' ')[1:3], ' ') AS leaf FROM m WHERE s <> '' GROUP BY s
), lv AS (
    SELECT leaf, count(DISTINCT doc_id) AS n FROM m JOIN f ON m.s = f.s GROUP BY leaf
), w AS (
    SELECT f.leaf, s, docs, generate_subscripts(ts, 1) AS q, unnest(ts) AS t FROM f JOIN lv ON f.leaf = lv.leaf WHERE n >= 5
), sup AS (
    SELECT leaf, q, t FROM w GROUP BY leaf, q, t HAVING sum(docs) >= 5
), ge AS (
    SELECT w.leaf, w.s, any_value(w.docs) AS docs, list(CASE WHEN sup.t IS NOT NULL THEN w.t ELSE '<*>' END ORDER BY w.q) AS gs
    FROM w LEFT JOIN sup ON w.leaf = sup.leaf AND w.q = sup.q AND w.t = sup.t GROUP BY w.leaf, w.s
), te AS (
    SELECT s, CASE WHEN docs >= 5 THEN s ELSE leaf || '#' || array_to_string(gs, ' ') END AS template FROM ge WHERE len(list_filter(gs, lambda x: x <> '<*>')) / len(gs) >= 0.5
), ok AS (
    SELECT template FROM te JOIN m ON te.s = m.s GROUP BY template HAVING count(DISTINCT doc_id) >= 5
), gone AS (
    SELECT DISTINCT s FROM te JOIN ok ON te.template = ok.template
), k AS (
    SELECT doc_id, count(*) AS n_lines, count(gone.s) AS n_dropped, string_agg(line, chr(10) ORDER BY p) FILTER (gone.s IS NULL) AS kept FROM m LEFT JOIN gone ON m.s = gone.s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

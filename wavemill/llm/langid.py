"""Language identification by cross-parsing entropy.

One suffix automaton per language is built over labelled text.  A document is parsed
greedily against each automaton: a phrase is the longest match that starts where the
last one ended.  Few phrases mean that the language's text predicts the document well,
so the language with the fewest phrases, normalised by the log-length of its text
(Ziv-Merhav cross-entropy), wins.

Model size is bounded by parameters and does not grow with the corpus; the automata are
flattened to one transition table, and tasks parse hundreds of whole texts in step, the
longest ones to their end one by one.  Beyond ``LANGS_PER_MODEL`` languages there are several
models, one pass over the texts each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_clashes, text_lists, unit_hash

#: Symbols 0 and 1: any run of non-letters, and letters that the training text lacks.
GAP, UNKNOWN = 0, 1
#: Symbols in all; if the training text has more letters, rarer ones are spelt in three of DIGITS
#: symbols, which number all letters there are.
SYMBOLS, DIGITS, SPELT = 252, 64, 255
#: Languages of one model: some 40 MB of table each at the default size of training texts.
LANGS_PER_MODEL = 16
#: Texts parsed side by side; fewer are parsed one by one.
TOGETHER = 24
RESULT = "struct<lang:string,first:double,second:double,size:long>"


@dataclass(frozen=True)
class LanguageModel:
    """Languages, code point to symbol (or to the number that is spelt), and the flattened
    automata: ``table[s + c]`` is twice the next state's row offset, plus one where a phrase
    begins."""

    langs: list[str]
    symbols: np.ndarray
    numbers: np.ndarray
    first_digit: int
    table: np.ndarray
    roots: np.ndarray
    log_sizes: np.ndarray
    width: int


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def to_symbols(points: np.ndarray, symbols: np.ndarray, numbers: np.ndarray, first_digit: int) -> np.ndarray:
    """Symbols with runs of gaps collapsed to one, and rare letters spelt out."""
    points = np.minimum(points, 0x10FFFF)
    s = symbols[points]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    s, points = s[keep], points[keep]
    rare = s == SPELT
    if not rare.any():
        return s
    sizes = np.where(rare, 3, 1)
    out = np.repeat(s, sizes)
    at = (np.cumsum(sizes) - sizes)[rare]
    number = numbers[points[rare]]
    for j in range(3):
        out[at + j] = first_digit + number // DIGITS ** (2 - j) % DIGITS
    return out


def train(samples: dict[str, str], max_symbols: int = SYMBOLS) -> LanguageModel:
    """Build the model from one training text per language.  All its letters, in lower case,
    have symbols of their own, or beyond ``max_symbols`` spellings in three; letters that it
    lacks count as unknown."""
    langs = sorted(samples)
    letters = Counter(c for t in samples.values() for c in t.lower() if c.isalpha())
    ranked = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
    frequent = ranked if len(ranked) <= max_symbols - 2 else ranked[: max_symbols - 2 - DIGITS]
    spelt = len(frequent) < len(ranked)
    code = {c: i + 2 for i, c in enumerate(frequent)} | {c: SPELT for c in ranked[len(frequent) :]}
    symbols, numbers = np.zeros(0x110000, dtype=np.uint8), np.zeros(0x110000 if spelt else 1, dtype=np.int32)
    number: dict[str, int] = {}
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = c.lower()[:1]
            symbols[cp] = code.get(low, UNKNOWN)
            if spelt:
                numbers[cp] = number.setdefault(low, len(number))
    first_digit = len(frequent) + 2
    width, rows, roots, sizes = first_digit + DIGITS * spelt, [], [], []
    offset = 0
    for lang in langs:
        text = to_symbols(code_points(samples[lang]), symbols, numbers, first_digit)
        states = suffix_automaton(text)
        root_next = states[0]
        base = np.full(width, 2 * offset + 1, dtype=np.int64)
        for c, t in root_next.items():
            base[c] = 2 * (offset + t * width) + 1
        table = np.tile(base, (len(states), 1))
        for s, out in enumerate(states):
            # Any step from the root starts a phrase; other states' own steps go on with one.
            if out and s:
                table[s, list(out)] = [2 * (offset + t * width) for t in out.values()]
        rows.append(table.ravel())
        roots.append(offset)
        sizes.append(math.log2(max(2, len(text))))
        offset += table.size
    table = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return LanguageModel(langs, symbols, numbers, first_digit, table.astype(np.int32) if offset < 1 << 30 else table, np.array(roots, np.int64), np.array(sizes), width)


def train_all(samples: dict[str, str], per_model: int = LANGS_PER_MODEL) -> list[LanguageModel]:
    """Models of up to ``per_model`` languages each, in the order of their names; one at least."""
    names = sorted(samples)
    return [train({n: samples[n] for n in names[i : i + per_model]}) for i in range(0, max(1, len(names)), per_model)]


def count_phrases(docs: list[np.ndarray], model: LanguageModel) -> np.ndarray:
    """Phrases of each document against each language.  Documents are parsed whole, side by
    side as long as there are enough of them, and then one by one."""
    n, k = len(docs), len(model.langs)
    out = np.zeros((n, k), dtype=np.int64)
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    starts = (np.cumsum(sizes) - sizes)[order]
    flat = np.concatenate(docs).astype(np.int32) if docs else np.zeros(0, np.int32)
    # Steps up to which at least TOGETHER documents are parsed side by side.
    steps = int(ordered[TOGETHER - 1]) if n >= TOGETHER else 0
    active = np.searchsorted(-ordered, -np.arange(steps), side="left")
    # All languages step together: their automata are in one table.
    state = np.tile(model.roots.astype(model.table.dtype), (n, 1))
    count = np.zeros((n, k), dtype=np.int64)
    for t, m in enumerate(active.tolist()):
        step = model.table[state[:m] + flat[starts[:m] + t, None]]
        count[:m] += step & 1
        state[:m] = step >> 1
    cells, symbols = memoryview(model.table), memoryview(flat)
    for lane in range(int(np.searchsorted(-ordered, -steps, side="left"))):
        rest = symbols[int(starts[lane]) + steps : int(starts[lane] + ordered[lane])].tolist()
        for lang in range(k):
            s, found = int(state[lane, lang]), 0
            for c in rest:
                x = cells[s + c]
                found += x & 1
                s = x >> 1
            count[lane, lang] += found
    out[order] = count
    return out


def predict(texts: list[str | None], model: LanguageModel) -> tuple[list, list, list, list]:
    """Language (null without a letter or a language), its bits, the runner-up's bits (null
    without one), and symbols of each text."""
    docs = [to_symbols(code_points(t), model.symbols, model.numbers, model.first_digit) if t else np.zeros(0, np.uint8) for t in texts]
    lettered = [bool((d != GAP).any()) for d in docs]
    bits = count_phrases(docs, model) * model.log_sizes if model.langs else np.zeros((len(docs), 0))
    langs, firsts, seconds, sizes = [], [], [], []
    for d, has, b in zip(docs, lettered, bits):
        best = int(np.argmin(b)) if has and len(b) else None
        langs.append(None if best is None else model.langs[best])
        firsts.append(None if best is None else float(b[best]))
        seconds.append(None if best is None or len(b) < 2 else float(np.delete(b, best).min()))
        sizes.append(len(d))
    return langs, firsts, seconds, sizes


def training_sample(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 48, chars_per_lang: int = 40_000, max_langs: int = 1_000
) -> dict[str, str]:
    """Up to ``docs_per_lang`` documents and ``chars_per_lang`` characters of each
    language, the documents with the smallest hashes of their key.  Each gives an equal
    share of the characters; what short ones leave is filled up from the others, in order.
    Counting the rows of each language first lets the scan keep only the few rows below a
    hash bound.  Raises ValueError beyond ``max_langs`` languages, the bound of what the
    driver holds."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return {}
    bounds = F.map_from_entries(F.array(*[F.struct(F.lit(name).alias("l"), F.lit(4.0 * docs_per_lang / n).alias("b")) for name, n in sorted(counts.items())]))
    near = rows.withColumn("__h", unit_hash(F.col(key).cast("string"))).where(F.col("__h") < F.element_at(bounds, F.col(lang)))
    picked = near.select(F.col(lang).alias("l"), F.substring(F.col(text), 1, chars_per_lang).alias("t"), F.col("__h").alias("h"))
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["l"], r["h"], r["t"])):
        own = samples.setdefault(r["l"], [])
        if len(own) < docs_per_lang and r["t"] not in own:
            own.append(r["t"])
    return {lang: "\n".join(shares(own, chars_per_lang)) for lang, own in samples.items()}


def shares(texts: list[str], chars: int) -> list[str]:
    """The texts cut so that they have ``chars`` characters in all: an equal share each, and
    then more of the first ones that are longer."""
    sizes = [min(len(t), chars // len(texts)) for t in texts]
    left = chars - sum(sizes)
    for i, t in enumerate(texts):
        more = min(left, len(t) - sizes[i])
        sizes[i] += more
        left -= more
    return [t[:n] for t, n in zip(texts, sizes)]


def language_column(spark: SparkSession, model: LanguageModel, text: Column | str) -> Column:
    """A struct column (lang, first, second, size) for a text column."""
    held = spark.sparkContext.broadcast(vars(model))  # plain arrays: workers need no class of ours to read them

    @F.arrow_udf(RESULT)
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = LanguageModel(**held.value)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for (texts,) in text_lists(batch, limit=4 << 20):
                for column, part in zip(out, predict(texts, own)):
                    column += part
            types = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["lang", "first", "second", "size"])

    return identify(text)


def better(a: Column, b: Column) -> Column:
    """Of two results, the one with fewer bits, with the fewest of the others' as the second."""
    later = a["first"].isNull() | (b["first"] < a["first"])
    return F.struct(
        F.when(later, b["lang"]).otherwise(a["lang"]).alias("lang"), F.least(a["first"], b["first"]).alias("first"), F.least(F.greatest(a["first"], b["first"]), a["second"], b["second"]).alias("second"),
        F.when(later, b["size"]).otherwise(a["size"]).alias("size"),
    )


def identify_languages(docs: DataFrame, models: list[LanguageModel], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits`` (bits a symbol under the
    winner's text).  A null text, or one without a letter, is ``und`` with score 0.
    ``score`` is one less the winner's share of the runner-up's bits.  Ties go to the
    language first by name; input columns of these names are replaced; every row is
    kept, repeated ones too.  Each model is one more pass over the texts in a task."""
    kept = drop_clashes(docs, "lang_pred", "score", "bits")
    found = kept
    for i, model in enumerate(models):
        found = found.withColumn(f"__l{i}", language_column(docs.sparkSession, model, F.col(text)))
    best = F.col("__l0")
    for i in range(1, len(models)):
        found = found.withColumn(f"__b{i}", better(best, F.col(f"__l{i}")))
        best = F.col(f"__b{i}")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - best["first"] / F.coalesce(best["second"], 2 * best["first"])))
    return found.select(*kept.columns, F.coalesce(best["lang"], F.lit("und")).alias("lang_pred"), F.when(best["lang"].isNull(), 0.0).otherwise(score).alias("score"), (best["first"] / best["size"]).alias("bits"))


def learned(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: crc32 of the id as text, mod 4, isn't 2."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train_all(training_sample(learned(docs)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify_languages(docs.select("doc_id", "text"), models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

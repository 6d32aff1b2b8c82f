"""License scans: identifier tags and notice phrases.

One Aho-Corasick automaton finds licence phrases in a document's normalised words and the
tags that announce an SPDX expression in its raw text.  A shunting-yard parser (WITH binds
tightest, then AND, then OR) evaluates expressions: AND asks for both sides, OR lets the
reader choose, WITH relaxes a licence.  What comes out are the licences named, those that
every choice asks for, and the strictness of the mildest choice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words_table, drop_clashes, text_lists

#: The base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Further notice phrases and the labels that the method adds.
MORE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2",
    "general public license version 3": "gpl-3",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu gpl": "gpl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "python software foundation license": "psf",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by 2 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "permissive-notice",
    "redistribution and use in source and binary forms": "redistribution-notice",
    "the software is provided as is": "warranty-notice",
    "distributed in the hope that it will be useful but without any warranty": "warranty-notice",
    "permission to use copy modify and or distribute this software": "permissive-notice",
    "free software you can redistribute it and or modify it": "gpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Kinds of licences, the mildest first; what isn't known counts as strictest.
STRICTNESS = ("permissive", "weak-copyleft", "strong-copyleft", "network-copyleft", "unknown")
#: How the ids of licence families begin, and their kind; the first that fits counts.
FAMILIES = {
    "mit": "permissive", "apache": "permissive", "bsd": "permissive", "isc": "permissive", "0bsd": "permissive", "bsl-1.0": "permissive", "zlib": "permissive", "unlicense": "permissive",
    "cc0": "permissive", "cc-by-sa": "strong-copyleft", "cc-by-nc": "unknown", "cc-by-nd": "unknown", "cc-by": "permissive", "python": "permissive", "psf": "permissive", "postgresql": "permissive",
    "lgpl": "weak-copyleft", "mpl": "weak-copyleft", "epl": "weak-copyleft", "cddl": "weak-copyleft", "eupl": "strong-copyleft", "gpl": "strong-copyleft", "agpl": "network-copyleft", "sspl": "network-copyleft",
}
#: Tags before an SPDX expression, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
TOKEN = re.compile(r"[ \t]*+([()]|[A-Za-z0-9.+-]++)")
RANK = {"OR": 1, "AND": 2, "WITH": 3}
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = ascii_words_table()
RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,expressions:array<string>,required:array<string>,strictness:string,score:double>"
RESULT_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("expressions", pa.list_(pa.string())), ("required", pa.list_(pa.string())), ("strictness", pa.string()), ("score", pa.float64())]
)


@dataclass
class Value:
    """What (part of) an expression evaluates to: the licences it names (lower case), those
    that every choice asks for, the rank of the mildest choice in ``STRICTNESS``, and its
    written form as nested lists."""

    named: set[str]
    required: set[str]
    rank: int
    form: str | tuple


def strictness(licence: str) -> int:
    """The rank of a licence id in ``STRICTNESS``."""
    low = licence.lower()
    return next((STRICTNESS.index(kind) for start, kind in FAMILIES.items() if low.startswith(start)), STRICTNESS.index("unknown"))


def combine(left: Value, op: str, right: Value) -> Value:
    """One operator applied.  The larger set takes in the smaller one, so that long chains
    stay linear; operands are not used again."""
    form = (left.form, op, right.form)
    if op == "WITH":
        # An exception qualifies its licence and is no licence of its own.
        rank = left.rank - 1 if STRICTNESS[left.rank] in ("weak-copyleft", "strong-copyleft", "network-copyleft") else left.rank
        return Value(left.named, left.required, rank, form)
    few, many = sorted((left.named, right.named), key=len)
    many |= few
    less, more = sorted((left.required, right.required), key=len)
    if op == "AND":
        more |= less
        return Value(many, more, max(left.rank, right.rank), form)
    less &= more
    return Value(many, less, min(left.rank, right.rank), form)


def written(form: str | tuple) -> str:
    """The normalised text of a form, with the brackets that it needs."""
    out, todo = [], [(form, 0)]
    while todo:
        part, rank = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            left, op, right = part
            inner = [(right, RANK[op]), (f" {op} ", 0), (left, RANK[op])]
            todo += [(")", 0), *inner, ("(", 0)] if RANK[op] < rank else inner
    return "".join(out)


def parse_expression(text: str, at: int = 0) -> Value | None:
    """The value of the longest part of ``text`` from ``at`` on that is a licence expression
    on one line; None if there is none.  Text is read up to the first token that can't go on
    with it, so the time is linear in what is read.  Operators are upper case (or all lower
    case), as the specification has them."""
    tokens, depth, good, operand = [], 0, 0, True
    while m := TOKEN.match(text, at):
        t, at = m.group(1), m.end()
        name = t.upper() if t in (t.upper(), t.lower()) and t.upper() in RANK else None
        if operand and t == "(":
            depth += 1
        elif not operand and t == ")" and depth:
            depth -= 1
        elif operand and name is None and t not in "()":
            operand = False
        elif not operand and name:
            operand = True
        else:
            break
        tokens.append(name or t)
        if not operand and not depth:
            good = len(tokens)
    if not good:
        return None
    out: list[Value] = []
    ops: list[str] = []

    def reduce() -> None:
        right, left = out.pop(), out.pop()
        out.append(combine(left, ops.pop(), right))

    for t in tokens[:good]:
        if t == "(":
            ops.append(t)
        elif t == ")":
            while ops[-1] != "(":
                reduce()
            ops.pop()
        elif t in RANK:
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[t]:
                reduce()
            ops.append(t)
        else:
            out.append(Value({t.lower()}, {t.lower()}, strictness(t), t))
    while ops:
        reduce()
    return out[0]


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p, label in phrases.items():
        found.add_word(f" {p} ", ("phrase", p, label))
    for t in TAGS:
        found.add_word(t, ("tag", t, ""))
    found.make_automaton()
    return found


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> dict:
    """What the result struct holds."""
    words = text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "expressions": [], "required": [], "strictness": None, "score": 0.0}
    if not words:
        return out
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, labels, required, ranks, longest, counted, at = set(), set(), set(), [], {}, 0, 0
    for end, (_, phrase, label) in machine.iter(joined):
        start = end - len(phrase) - 1
        if phrase not in BASE_PHRASES:
            # Of phrases that begin together, the longest says what the notice is.
            longest[start] = max(longest.get(start, (0, "")), (len(phrase), label))
        else:
            # The words before a match are counted from the last match on.
            labels.add(label)
            counted += joined.count(" ", at, start)
            at = start
            out["n_base"] += 1
            out["first_word"] = counted if out["first_word"] is None else min(out["first_word"], counted)
            out["last_word"] = counted if out["last_word"] is None else max(out["last_word"], counted)
            base.add(label)
    if "license-" in (low := text.translate(LOWER)):
        for end, (kind, *_) in machine.iter(low):
            if kind == "tag" and (got := parse_expression(text, end + 1)):
                labels |= got.named
                required |= got.required
                ranks.append(got.rank)
                out["expressions"].append(written(got.form))
    labels |= {label for _, label in longest.values()} - {""}
    evidence = len(labels) + 2 * len(out["expressions"])
    # All expressions of a text hold side by side.
    strict = STRICTNESS[max(ranks)] if ranks else None
    return out | {"base_labels": sorted(base), "labels": sorted(labels), "required": sorted(required), "strictness": strict, "score": 1.0 - 0.5**evidence if evidence else 0.0}


def license_column(text: Column | str, phrases: dict[str, str] | None = None) -> Column:
    known = {**BASE_PHRASES, **MORE_PHRASES, **(phrases or {})}

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(known)
        for batch in batches:
            yield pa.array([scan_text(t, machine) for (texts,) in text_lists(batch) for t in texts], RESULT_TYPE)

    return scan(text)


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with word and phrase counts, labels (distinct, sorted), normalised SPDX
    expressions, the licences that every choice asks for (``required``), the kind of the
    mildest choice (``strictness``, null without an expression) and a score that grows with
    the evidence.  Null and empty texts have no words and no labels; every row is kept;
    input columns of the result's names are replaced."""
    names = [f.name for f in RESULT_TYPE]
    kept = drop_clashes(docs, *names)
    return kept.withColumn("__l", license_column(F.col(text), phrases)).select(*kept.columns, *[f"__l.{n}" for n in names])


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and expressions of every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("required", ",").alias("required"), "strictness")

"""Small documents with the awkward cases: null and empty texts, null keys, repeated rows,
copies, near copies, very long texts, other scripts, clashing extra columns."""

from __future__ import annotations

import random

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, copies string, spans string"


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    en = [a + b for a in ("th", "re", "on", "st", "wh") for b in ("e", "ing", "at", "er", "ion", "ly")]
    fr = [a + b for a in ("qu", "éa", "ou", "le", "ch") for b in ("eux", "elle", "ê", "ai", "ment", "oi")]
    out: list[list] = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        out.append([i, prose(rng, rng.randint(30, 200), en if lang == "en" else fr) + ".", lang, f"s{i % 4}"])
    base = out[1][1].split()
    for i in range(60, 72):
        own = list(base)
        for _ in range(i - 59):
            own[rng.randrange(len(own))] = rng.choice(en)
        out.append([i, " ".join(own), "en", "s0"])
    out += [[72, out[2][1], "en", "s1"], [73, out[2][1].upper(), "en", None], [74, None, "en", "s1"], [75, "", "en", "s1"], [76, " \n\t ", None, "s2"], [77, "12 34 +++ !!!", "fr", "s2"], [78, "one two", "en", "s3"], [79, "One  TWO", "en", "s3"]]
    out += [[80, prose(rng, 30_000, en), "en", "s0"], [81, "x" * 50_000, "en", "s0"], [82, "ab" * 700, "en", "s0"], [3, out[3][1], "en", "s3"], [None, out[4][1], "en", "s0"], [None, None, None, None]]
    passage = prose(rng, 120, en)
    out += [[90 + i, prose(rng, 40, en) + "\n" + passage + "\n" + prose(rng, 40, fr), "en", "s0"] for i in range(8)]
    out += [[100 + i, f"Request {rng.randrange(10**6)} served from cache node{i}\n" + prose(rng, 20, en) + f"\nuser u{i}@mail.example.com wrote ok", "en", "s1"] for i in range(9)]
    return [(d, t, lang, s, len(t or ""), "x", "y", "z") for d, t, lang, s in out]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

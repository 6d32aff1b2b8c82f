"""Each operator against a brute-force version on awkward documents."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import decontam, dedup, langid, license, lines, mixing, pii, sharding, substrings, topk

from .cases import LOW, documents, empty, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate(LOW)


def test_neardup(spark):
    rows = documents()
    got = [tuple(r) for r in dedup.near_duplicates(frame(spark)).collect()]
    sets = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(d for d in sets if d is not None)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for d, n, c, kept in got:
        if d is not None:
            assert (n, c, kept) == (len(sets[d]), find(d), find(d) == d)
        else:
            assert c is None and kept
    assert dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [16_384, 4])
def test_large_family_in_blocks(spark, monkeypatch, most):
    """A bucket beyond the size that is joined natively gives the same pairs, and so does one
    that is banded again."""
    rng, words = random.Random(1), [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = dedup.shingle_sets(texts, 5)
    parent = list(range(120))
    for a in range(120):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)

    def find(x):
        return x if parent[x] == x else find(parent[x])

    whole = dedup.candidates
    monkeypatch.setattr(dedup, "candidates", lambda rest, percent, bits: whole(rest, percent, bits, small=8, block=16, most=most))
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(120)}


@pytest.mark.parametrize("switches", [{"small": 10_000}, {"small": 8, "block": 16}, {"small": 8, "block": 16, "most": 50}, {"small": 0, "block": 7, "most": 0}])
def test_candidates_do_not_depend_on_a_bucket_size(spark, switches):
    """Pairs that fit by size and sketch come out however many others are in their bucket,
    also those that share that one band only."""
    rng = random.Random(5)
    near, rows = [rng.getrandbits(63) for _ in range(32)], []
    for i in range(300):
        n = rng.choice((3, 4, 75, 99, 100, 101, 133, 134, 400, 1000))
        sketch = [w ^ (1 << rng.randrange(60)) if rng.random() < 0.3 else w for w in near]
        rows.append((7, 0, i, i if rng.random() < 0.6 else 1000, n, sketch, [7] + [i * 100 + j for j in range(1, 24)], 300))
    rest = spark.createDataFrame(rows, "band bigint, j int, rep bigint, group bigint, n bigint, sketch array<bigint>, bands array<bigint>, size bigint")

    def fits(x, y):
        ones = sum((a ^ b).bit_count() for a, b in zip(x[5], y[5]))
        return x[3] != y[3] and x[4] * 100 >= y[4] * 75 and y[4] * 100 >= x[4] * 75 and ones <= dedup.most_xor(np.float64(x[4]), np.float64(y[4]), 75, 2048)

    want = {(x[2], y[2]) for i, x in enumerate(rows) for y in rows[i + 1 :] if fits(x, y)}
    assert len(want) > 500
    assert {tuple(r) for r in dedup.candidates(rest, 75, 2048, **switches).collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in dedup.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in range(101, 160)} == {100}


def test_langid(spark):
    docs = frame(spark)
    samples = langid.training_sample(langid.learned(docs))
    model = langid.train_all(samples)
    got = [r for r in langid.identify_languages(docs, model).collect()]
    assert len(got) == len(documents())
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (74, 75, 76, 77))
    assert sum(by[i].lang_pred == ("en" if i % 3 else "fr") for i in range(60)) >= 58
    assert all(0 <= r.score <= 1 for r in got)
    apart = langid.identify_languages(docs, langid.train_all(samples, per_model=1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, apart))
    nothing = langid.train_all({})
    assert {r.lang_pred for r in langid.identify_languages(docs, nothing).collect()} == {"und"}
    assert langid.identify_languages(empty(spark), model).count() == 0


def test_phrases_by_hand():
    model = langid.train({"a": "abcabcabd", "b": "xyz"})

    def phrases(text, source):
        n, i = 0, 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in source and text[i:j] in source:
                j += 1
            n, i = n + 1, j
        return n

    texts = ["abcabd", "dcba", "abxyzabc", "zzz", "", "abc" * 900, "xyz" * 2_000 + "a"]
    for docs in ([t] for t in texts), (texts * 9,):
        for own in docs:
            got = langid.count_phrases([langid.to_symbols(langid.code_points(t), model.symbols, model.numbers, model.first_digit) for t in own], model)
            assert got.tolist() == [[phrases(t, "abcabcabd"), phrases(t, "xyz")] for t in own]


def test_thousands_of_letters():
    """Letters beyond the symbols are spelt, and stay apart."""
    first, second = "".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0x5200, 0x5600)))
    model = langid.train({"a": first * 2, "b": second * 2, "c": "plain latin text"})
    assert model.width <= 252 and langid.predict([first[500:800], second[100:300], "latin", first[:9] + second[:2]], model)[0] == ["a", "b", "c", "a"]


def test_ties_of_languages():
    model = langid.train({"b": "same text", "a": "same text"})
    assert langid.predict(["same"], model)[:3] == (["a"], [math.log2(9)], [math.log2(9)])


def test_shares():
    assert langid.shares(["a" * 100, "b" * 3, "c" * 100], 30) == ["a" * 17, "b" * 3, "c" * 10]
    assert langid.shares(["ab", "c"], 30) == ["ab", "c"]


def test_sharding(spark):
    names = sharding.shard_names(7)
    table = sharding.fill_table(names, 1009)
    size = collections.Counter(table)
    assert max(size.values()) - min(size.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.3 * 1009
    got = sharding.assign_shards(frame(spark), names, slots=1009).collect()
    assert len(got) == len(documents())
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_lines(spark):
    rows = documents()
    got = {(r.doc_id, r.text): r for r in lines.drop_recurring_lines(frame(spark)).collect()}
    served = got[100, next(t for d, t, *_ in rows if d == 100)]
    assert served.n_lines == 3 and served.n_dropped == 2 and "served" not in served.kept_text
    passage = got[90, next(t for d, t, *_ in rows if d == 90)]
    assert passage.n_dropped == 1 and len(passage.kept_text.split("\n")) == 2
    assert got[74, None].n_lines == 0 and got[74, None].kept_text is None and got[75, ""].kept_text == ""
    assert lines.drop_recurring_lines(empty(spark)).count() == 0


def test_lines_of_rows_without_a_key(spark):
    """All rows without a key are one document when documents are counted, as are rows that
    share one; each of them is cut."""
    line = "served from cache node{} in ms"
    rows = [(None, f"{line.format(i)}\nonly {'abcdefghij'[i % 10]} text") for i in range(40)] + [(7, line.format(77))] * 3
    few = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.n_dropped for r in lines.drop_recurring_lines(few).collect()} == {0}
    more = few.unionByName(spark.createDataFrame([(i, line.format(i)) for i in range(3)], few.schema))
    assert {r.n_dropped for r in lines.drop_recurring_lines(more).collect()} == {1}


def test_templates_generalise_words(spark):
    """A field of words becomes a wildcard where each value is rare."""
    rows = [(i, f"the service restarted by {name} after a failure\nown text {name} {i}") for i, name in enumerate("anna ben carl dora emil fred gina".split())]
    got = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.n_dropped == 1 for r in got)


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = b"\x01" * length
        kept = bytes(x for x, m in zip(b, mask) if not m)
        out.append((len(b), sum(mask), len(re.findall(b"\x01+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    own = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in words]
    count = collections.Counter(p for o in own for p in o)
    return [any(count[p] > 1 for p in o) for o in own]


@pytest.mark.parametrize("max_class", [20_000, 3])
def test_substrings(spark, max_class):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh é") for _ in range(300))
    texts = [t for _, t, *_ in documents() if len(t or "") < 5000]
    texts += [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))) + part[rng.randint(0, 60) : rng.randint(150, 300)] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80)))) for _ in range(60)]
    texts += ["ab" * 200, "ab" * 120, "a" * 130, "a" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = substrings.remove_repeats(df, length=100, k=32, max_class=max_class).collect()
    want, shares = brute_repeats(texts, 100), brute_passages(texts, 51)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], texts[r.doc_id][:80]
        assert r.shares_passage == shares[r.doc_id], texts[r.doc_id][:80]
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    got = list(substrings.LoserTree([substrings.front_code(r) for r in runs]))
    keys = sorted(k for r in runs for k in r)
    assert [k for _, _, k, _ in got] == keys
    assert all(runs[s][i] == k for s, i, k, _ in got)
    assert [n for *_, n in got] == [0, *(substrings.common_prefix(a, b) for a, b in zip(keys, keys[1:]))]


def brute_pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


PII = [
    None, "", "a@b.c@d.e_f@g.h a@b", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.255 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-1 12  4111111111111111", "+1 (266) 555-7057+44 20 7946 0958..", "\U0001f600 x@y.zz \U0001f6001.1.1.1",
    "5" * 30_000, "a.b" * 20_000, "1 " * 20_000, "a@" * 5000, "x@y.z_k@w.v@q.r", "token = \"a1b2c3d4e5f60718293a4b5c6d7e8f90\" and version 2.0",
]


def test_pii(spark):
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(PII)], "doc_id bigint, text string, spans string")
    plain = pii.find_pii(df, pii.SpanModel([], [], 2.0)).select("doc_id", pii.joined("base_spans").alias("b"), pii.joined("spans").alias("s")).collect()
    for r in plain:
        assert r.b == r.s == ",".join(brute_pii(PII[r.doc_id]))
    rng = random.Random(4)
    rows = [(i, f"so token = \"{rng.getrandbits(160):040x}\" it is" if i % 2 else f"see chapter{rng.randrange(10)}a-of-the-long-manual now", None) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    model = pii.fit_spans(many)
    got = pii.find_pii(many, model).select("doc_id", F.size("spans").alias("n")).collect()
    assert all(r.n == r.doc_id % 2 for r in got)
    assert pii.fit_spans(df.where("doc_id < 2")).trees == []
    # Bare numbers that look like cards but fail the check have no cue: the trees can't tell them from cards, and none is taken.
    numbers = [(1000 + i, f"see {4111111111111111 if i % 2 else 4111111111111112 + 10 * i} there", None) for i in range(300)]
    both = many.unionByName(spark.createDataFrame(numbers, df.schema))
    got = pii.find_pii(both, pii.fit_spans(both)).select("doc_id", pii.counted("spans", "secret").alias("s"), pii.counted("spans", "number").alias("n"), pii.counted("base_spans", "card").alias("c")).collect()
    luhn = {i for i, t, _ in numbers if brute_pii(t)}
    assert all((r.s, r.n, r.c) == (int(r.doc_id < 1000 and r.doc_id % 2), 0, int(r.doc_id in luhn)) for r in got)
    assert pii.find_pii(df.limit(0), model).count() == 0


def test_thresholds():
    assert pii.calibrate([(0.9, 1.0), (0.8, 1.0), (0.8, 0.0), (0.7, 1.0)], 0.7) == 0.7
    assert pii.calibrate([(0.9, 1.0), (0.8, 1.0), (0.8, 0.0)], 0.9) == 0.9
    assert pii.calibrate([(0.9, 0.0), (0.4, 1.0)], 0.5) == pii.calibrate([], 0.5) == 2.0


@pytest.mark.parametrize("block_bytes", [32 << 20, 600])
def test_decontam(spark, block_bytes):
    rng = random.Random(9)
    rows = documents()
    text = {d: t for d, t, *_ in rows}
    bench = [(i, " ".join(text[i].split()[5 : 5 + rng.randint(3, 40)])) for i in range(20)]
    bench += [(30, "one two"), (31, bench[0][1]), (32, None), (33, ""), (None, "x y"), (34, "never seen words at all in any of the documents here really")]
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontam.find_contamination(frame(spark), items, block_bytes=block_bytes).collect()
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = WORD.findall(lower(t))
        if w and i is not None:
            for o in range(max(1, len(w) - 9)):
                windows[tuple(w[o : o + 10])].add(str(i))
    for r in got:
        w, hit, found = WORD.findall(lower(r.text)), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        assert r.n_words == len(w) and sum(s.end - s.start for s in r.spans) == len(hit) and r["items"] == sorted(found)
    none = decontam.find_contamination(frame(spark), items.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.spans for r in none)


def test_mixing(spark):
    docs = frame(spark)
    got = mixing.mix_sources(docs, max_repeats=1.5, n_blocks=8).collect()
    assert len(got) == len(documents())
    tokens, seen = collections.Counter(), collections.Counter()
    for r in got:
        assert r.n_tokens == len((r.text or "").split())
        tokens[r.source] += r.n_tokens
        seen[r.source] += r.n_tokens * r.copies
    full = {s: n for s, n in tokens.items() if n}
    alpha = mixing.bisect_exponent(list(full.values()), None, 1.5)
    weight = dict(zip(full, mixing.tempered(list(full.values()), alpha)))
    budget = max(n / weight[s] for s, n in full.items())
    longest = max(r.n_tokens for r in got if r.source != "s0")
    for s in full:
        assert weight[s] * budget - longest <= seen[s] <= weight[s] * budget + 1e-6
    assert all(r.copies >= 1 for r in got)
    small = mixing.mix_sources(docs, max_repeats=None, target_entropy=0.5, budget_tokens=2000.0, n_blocks=8).collect()
    assert sum(r.n_tokens * r.copies for r in small) <= 2000
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.repeated(mixing.mix_sources(docs, n_blocks=8)).count() == sum(r.copies for r in mixing.mix_sources(docs, n_blocks=8).collect())


def test_more_sources_than_are_held(spark):
    """Aggregates over the sources give the plan that the driver's list gives, ties of places too."""
    docs = frame(spark)
    for how in ({"max_repeats": 1.5}, {"max_repeats": None, "target_entropy": 1.2, "budget_tokens": 9000.0}, {"max_repeats": None, "target_entropy": 5.0}):
        few, many = (sorted((str(r.doc_id), r.text or "", r.copies, r.block, round(r.weight, 9)) for r in mixing.mix_sources(docs, n_blocks=8, max_sources=n, **how).collect()) for n in (20_000, 1))
        assert few == many
    assert mixing.mix_sources(empty(spark), max_sources=0).count() == 0
    counted = docs.withColumn("n", mixing.word_count(F.col("text")))
    assert sorted(r.copies for r in mixing.mix_sources(counted, tokens="n").collect()) == sorted(r.copies for r in mixing.mix_sources(docs).collect())


def test_exponent():
    tokens = [1000.0, 100.0, 10.0]
    a = mixing.bisect_exponent(tokens, 0.9, None)
    assert abs(mixing.entropy(mixing.tempered(tokens, a)) - 0.9) < 1e-6
    b = mixing.bisect_exponent(tokens, None, 4.0)
    assert abs(100.0 ** (1 - b) - 4.0) < 1e-6
    assert mixing.bisect_exponent([], 1.0, 2.0) == 1.0


def test_licenses(spark):
    texts = [None, "", "MIT License", "the Apache  License, Version 2.0 and mit-license", "GNU Lesser General Public License general public license", "# SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)\nmore text", "SPDX-License-Identifier:", "mit license mit license", "x" * 40_000 + " mit license", "été mit licenseé"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, labels string")
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r.doc_id: r for r in license.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        hits = [(p, label) for p in range(len(w)) for k, label in phrases.items() if tuple(w[p : p + len(k)]) == k]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r.base_labels == sorted({h[1] for h in hits}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[5].labels == ["apache-2.0", "gpl-2.0-only", "mit"] and got[5].expressions == ["MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0"]
    assert "lgpl" in got[4].labels
    notices = {"Licensed under CC BY-NC 4.0.": ["cc-by-nc"], "Creative Commons Attribution ShareAlike": ["cc-by-sa"], "creative commons attribution": ["cc-by"], "Apache License, Version 2.0": ["apache", "apache-2.0"]}
    assert all(license.scan_text(t, license.automaton({**license.BASE_PHRASES, **license.MORE_PHRASES}))["labels"] == want for t, want in notices.items())


@pytest.mark.parametrize("text,want", [("MIT", "MIT"), ("A AND B OR C", "A AND B OR C"), ("(A OR B) AND C", "(A OR B) AND C"), ("A OR B words follow", "A OR B"), ("A AND", "A"), ("(A", None), ("", None), ("OR A", None), ("((A))", "A")])
def test_expressions(text, want):
    got = license.parse_expression(text)
    assert (got and license.written(got.form)) == want


def test_topk(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.3, 70).astype(np.float32).tolist()) for i in range(350)]
    rows += [(400, None), (500, [float("nan")] * 70), (600, [1.0, None] * 35), (700, [float("inf")] * 70), (800, [40_000.0] * 70), (900, []), (901, [0.5, -0.5]), (1000, rows[3][1]), (1001, rows[3][1]), (5, rows[5][1]), (None, rows[6][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=10, block=64, query_block=2).collect()]
    fine = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in fine if i % 100 == 0}.items():
        s = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in fine if i != q)
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:10])]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0


CLASHES = {
    "language": (lambda spark, df: langid.identify_languages(df, langid.train_all({"en": "the text", "fr": "le texte"})), ["lang_pred", "score", "bits"]),
    "sharding": (lambda spark, df: sharding.assign_shards(df, ["a", "b"], slots=101), ["slot", "shard"]),
    "lines": (lambda spark, df: lines.drop_recurring_lines(df), ["n_lines", "n_dropped", "kept_text"]),
    "pii": (lambda spark, df: pii.find_pii(df, pii.SpanModel([], [], 2.0)), ["base_spans", "spans"]),
    "decontam": (lambda spark, df: decontam.find_contamination(df, spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")), ["n_words", "spans", "items", "longest"]),
    "mixing": (lambda spark, df: mixing.mix_sources(df), ["n_tokens", "weight", "block", "copies"]),
    "licenses": (lambda spark, df: license.scan_licenses(df), [f.name for f in license.RESULT_TYPE]),
}


@pytest.mark.parametrize("name", sorted(CLASHES))
def test_clashing_names(spark, name):
    """Columns of a result's names, in any case, give way; all others stay, of any type."""
    run, names = CLASHES[name]
    plain = spark.createDataFrame([(i, f"one two three four {i}\nsame line here\nx", "en", "s") for i in range(7)] + [(7, None, None, None)], "doc_id bigint, text string, lang string, source string")
    extra = plain.withColumns({n.upper() if i % 2 else n: F.lit(f"own {n}") for i, n in enumerate(names)}).withColumns({"d": F.lit(1), "m": F.create_map(F.lit("k"), F.lit(2)), "h": F.array(F.lit(1))})
    want = sorted(map(str, run(spark, plain).collect()))
    got = run(spark, extra)
    assert got.columns == [*plain.columns, "d", "m", "h", *names]
    assert sorted(map(str, got.drop("d", "m", "h").collect())) == want


def test_rows_only_clash(spark):
    """Operators with results of their own don't mind what other columns are called."""
    df = frame(spark).where("doc_id < 40")
    extra = df.withColumns({c: F.lit("own") for c in ("__id", "k1", "k2", "set_a", "bands", "sha", "n_bytes", "kept", "component_id", "v", "id")})
    for run in (dedup.near_duplicates, substrings.remove_repeats):
        assert sorted(map(str, run(df).collect())) == sorted(map(str, run(extra).collect()))


def test_ties_of_spans(spark):
    """Of overlapping candidates with one score the first stays, the generator's order next."""
    rows = [(1, "a 123-45-67890123 b"), (2, "x ab12cd34ef56gh78 y"), (3, "same ab12cd34ef56gh78 and ab12cd34ef56gh78")]
    got = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows * 2, "doc_id bigint, text string"), pii.SpanModel([], [], 0.0)).collect()}
    assert got == {1: [("secret", 2)] if got[1][0][0] == "secret" else [("number", 2)], 2: [("secret", 2)], 3: [("secret", 5), ("secret", 26)]}


def test_ties_of_places(spark):
    """Documents with one key have one place in the mix, and are taken together."""
    rows = [(i % 5, f"w{i} " * 10, None, "a") for i in range(40)] + [(100, "w " * 4000, None, "b")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), max_repeats=1.5, n_blocks=4).collect()
    copies = collections.defaultdict(set)
    for r in got:
        copies[r.doc_id].add(r.copies)
    assert all(len(c) == 1 for c in copies.values()) and {c for s in copies.values() for c in s} == {1, 2}


def test_long_inputs(spark):
    """A text of megabytes with its licence at the end; vectors of thousands of components."""
    long = "été word " * 300_000 + "MIT License\nSPDX-License-Identifier: ISC"
    r = license.scan_licenses(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first()
    assert (r.n_words, r.first_word, r.n_base) == (600_006, 600_000, 1) and {"mit", "isc"} <= set(r.labels)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (40, 3000))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = topk.top_k(rows, rows.where("vec_id = 0"), k=5, block=16).orderBy("rank").collect()
    whole = np.floor(x * 1024).astype(np.int64)
    order = sorted(range(1, 40), key=lambda i: (-int(whole[i] @ whole[0]), i))[:5]
    assert [r.vec_id for r in got] == order and got[0].score == int(whole[order[0]] @ whole[0])


def test_nothing_is_machine_local(monkeypatch):
    """Off a local master, a scratch folder has to be named."""
    from wavemill.llm import common

    class Context:
        master = "spark://cluster:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"conf": type("C", (), {"get": lambda self, k, d: None})(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.scratch_dir(session)

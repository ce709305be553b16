"""Source divergence and collocations against plain code and against their SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from tracelane.llm import collocations as own_collocations
from tracelane.llm import source_divergence as own_divergence
from tracelane.llm.collocations import collocations, spark_hash
from tracelane.llm.queries import ORACLE_SQL, QUERIES
from tracelane.llm.source_divergence import source_divergence, term_text


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_collocations"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert_same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_divergence(rows, least, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    docs = Counter((lang, t) for lang, _, ts in terms for t in set(ts))
    kept = {}
    for (lang, t), n in docs.items():
        if n >= least:
            kept.setdefault(lang, set()).add(t)
    counts = {}
    for lang, source, ts in terms:
        for key in ((lang, source), (lang,)):
            counts.setdefault(key, Counter()).update(t for t in ts if t in kept.get(lang, ()))

    def share(key):
        own, words = counts[key], kept.get(key[0], ())
        return {t: 1 + 10**9 * (own[t] + 5) // (own.total() + 5 * len(words)) for t in words}

    out = []
    for lang, source in sorted(k for k in counts if len(k) == 2):
        p, q = share((lang, source)), share((lang,))
        others = [(sum(abs(p[t] - o[t]) for t in p), x[1]) for x in counts if len(x) == 2 and x[0] == lang and x[1] != source for o in [share(x)]]
        more = [(p[t] - q[t], t) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", others, None), ("term", more, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def made_rows(seed, n, words=60):
    draw = random.Random(seed)
    vocabulary = [f"{draw.choice(['é', 'Z', 'the', 'Ab', 'ça', 'ß'])}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    out = []
    for _ in range(n):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "hot", "hot", None])
        own = vocabulary[: words // 2] if source == "hot" else vocabulary
        out.append((lang, source, draw.choice([None, "", "  "]) if draw.random() < 0.05 else draw.choice([" ", ", ", "-", "_5.", "\n"]).join(draw.choices(own, k=draw.randint(1, 30)))))
    return out


def divergence(spark, rows, least, top, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, p long").repartition(parts)
    out = source_divergence(df, least, top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def test_divergence_equals_plain_code(spark):
    rows = made_rows(1, 300)
    assert divergence(spark, rows, 20, 7) == plain_divergence(rows, 20, 7)
    assert divergence(spark, rows, 5, 50, 1) == plain_divergence(rows, 5, 50)


@pytest.mark.parametrize("passes", [25, 90])
def test_divergence_in_several_passes_with_early_flushes(spark, monkeypatch, passes):
    monkeypatch.setattr(own_divergence, "PASS_TERMS", passes)
    monkeypatch.setattr(own_divergence, "HELD", 10)
    rows = made_rows(2, 200)
    assert divergence(spark, rows, 10, 9) == plain_divergence(rows, 10, 9)


def test_divergence_of_odd_tables(spark):
    long = "very" * 300_000
    for rows in ([], [(None, None, None)], [("en", "a", "x"), ("en", "b", None)], [("en", "a", f"{long} x {long}")] * 3 + [("en", "b", "X x-x_x")], [("en", "a", "same words")] * 40 + [("en", "b", "same words")] * 40):
        assert divergence(spark, rows, 2, 5) == plain_divergence(rows, 2, 5)


def test_terms_follow_their_pattern():
    text = "Ab1cd É_é @Z[z{ \x7f x y 日本 a"
    assert [x.decode() for x in term_text(text).split()] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_collocations(rows, least, top, absorb=100):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(a, longer.get(p[i:j], 0))
        rated = []
        for p, a in found.items():
            if 100 * longer.get(p, 0) >= absorb * a:
                continue
            score, cut = min((1000 * a * total[lang] // (own[p[:i]] * own[p[i:]]), i) for i in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rated)[:top])]
    return sorted(out)


def mined(spark, rows, least, top, parts=3, absorb=100):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "lang string, text string, w1 long, phrase string").repartition(parts)
    out = collocations(df, least, top, absorb)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def phrase_rows(seed, n):
    draw = random.Random(seed)
    fixed = ["New york city hall", "in the end of the day", "la la la la la la", "é à ü"]
    out = []
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice("abcdefgh") for _ in range(draw.randint(0, 25))]
        out.append((draw.choice(["en", "fr", None]), draw.choice([" ", "\t", "  "]).join(x + draw.choice(["", "", "", ".", ", ", "\n", "!"]) for x in parts) or None))
    return out


@pytest.mark.parametrize(("seed", "least", "parts"), [(1, 8, 1), (2, 20, 5)])
def test_collocations_equal_plain_code(spark, seed, least, parts):
    rows = phrase_rows(seed, 250)
    assert mined(spark, rows, least, 40, parts) == plain_collocations(rows, least, 40)
    assert mined(spark, rows, least, 3, parts, 90) == plain_collocations(rows, least, 3, 90)


def test_prefixes_in_several_cuts_give_the_same_phrases(spark, monkeypatch):
    """Few windows a task and a row, small buffers, and words beyond the list."""
    monkeypatch.setattr(own_collocations, "TASK_WINDOWS", 5)
    monkeypatch.setattr(own_collocations, "ROW_WINDOWS", 3)
    monkeypatch.setattr(own_collocations, "BUFFER", 50)
    monkeypatch.setattr(own_collocations, "MOST_WORDS", 3)
    rows = phrase_rows(3, 120)
    assert mined(spark, rows, 6, 50) == plain_collocations(rows, 6, 50)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(own_collocations, "FILTER_BITS", 8)
    rows = phrase_rows(4, 100)
    assert mined(spark, rows, 5, 50) == plain_collocations(rows, 5, 50)


def test_collocations_of_odd_tables(spark):
    for rows in ([], [(None, None)], [("en", "one")], [("en", "a b " * 30_000)], [("en", "x y. x y")] * 60, [("und", "p q"), (None, "p q")] * 5):
        assert mined(spark, rows, 4, 10) == plain_collocations(rows, 4, 10)


def test_hash_of_pairs_is_that_of_spark(spark):
    draw = np.random.default_rng(1)
    a, b = (draw.integers(-(2**63), 2**63 - 1, 50) for _ in range(2))
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a long, b long")
    assert [r.h for r in df.select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()] == spark_hash(a, b).tolist()

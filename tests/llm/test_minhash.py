"""Near-duplicates by MinHash against all pairs."""

import random
import re

import numpy as np
import pytest

from tracelane.llm import minhash_dedup
from tracelane.llm.common import NULL_ID
from tracelane.llm.minhash_dedup import BINS, keep_one, near_duplicates, one_permutation, shingle_sets


def plain_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 2]) for i in range(len(found) - 1)} if len(found) > 1 else {tuple(found)} - {()}


def brute(rows):
    """(doc, n, component, kept) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    ids = [NULL_ID if i is None else i for i, _ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(ids[i], least.get(root(i), NULL_ID))
    return sorted((ids[i], len(sets[i]), least[root(i)], ids[i] == least[root(i)]) for i in range(len(rows)))


def collected(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_copies(seed, bases, copies, length, edits):
    draw, rows = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randint(3, length))]
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.randint(0, max(1, int(edits * len(own))))):
                own[draw.randrange(len(own))] = f"x{draw.randrange(50)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("bases", "copies", "length", "edits"), [(40, 6, 60, 0.1), (3, 60, 120, 0.12), (60, 4, 8, 0.2)])
def test_groups_equal_all_pairs(spark, bases, copies, length, edits):
    rows = near_copies(bases, bases, copies, length, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(near_duplicates(df)) == brute(rows)


def test_chain_in_one_bucket_is_followed_by_blocks(spark, monkeypatch):
    """Members that link with each other but not with their center, in blocks of three."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 3)
    monkeypatch.setattr(minhash_dedup, "BLOCK_PAIRS", 9)
    rows = near_copies(7, 2, 90, 80, 0.25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize(("sets", "pairs"), [(512, 1 << 18), (4, 12), (1, 1)])
def test_apart_finds_every_link_without_stars(spark, monkeypatch, sets, pairs):
    """In one task and in many. One bucket of all sets and no link yet: block pairs alone must give the groups, but for the center."""
    from pyspark.sql import functions as F

    from tracelane.llm.components import reach

    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", sets)
    monkeypatch.setattr(minhash_dedup, "BLOCK_PAIRS", pairs)
    rows = near_copies(11, 6, 8, 50, 0.12)
    dedup = minhash_dedup.MinHashDedup(spark.createDataFrame([*rows, (-1, "alone here")], "doc_id long, text string"), "doc_id", "text", 80)
    center = dedup.sets.where("doc = -1").first().set
    met = dedup.sets.select(F.lit(1).cast("long").alias("bucket"), "set", F.lit(center).alias("center"), F.lit(len(rows)).cast("long").alias("c"))
    none = spark.createDataFrame([], "set long, label long")
    links = dedup.scratch.save(dedup.apart(met, none), "test")
    labels = {r.set: r.label for r in reach(links, dedup.scratch, "test").collect()}
    docs = {r.set: r.doc for r in dedup.sets.collect()}
    got, want = {}, {}
    for s, d in docs.items():
        got.setdefault(labels.get(s, s), set()).add(d)
    sets = {d: None for d in docs.values()}
    for doc, _, component, _ in brute([*rows, (-1, "alone here")]):
        if doc in sets:
            want.setdefault(component, set()).add(doc)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_few_words_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  Two"), (8, "two one"), (None, "one two"), (None, "other words"), (9, "é É"), (9, "é É"), (9, "quite other"), (10, "a " * 50_000), (11, "A a")]
    for n in (1, 3, 15):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert collected(near_duplicates(df)) == brute(rows)
    for one in ([(1, "a b")], [(1, "a")], [(1, None)], []):
        assert collected(near_duplicates(spark.createDataFrame(one, "doc_id long, text string"))) == brute(one)


def test_large_groups_of_copies_and_wide_rows(spark):
    rows = [(i, "the same text in every row of this group " + ("" if i % 3 else "indeed")) for i in range(3000)]
    df = spark.createDataFrame([(*r, r[0], "x") for r in rows], "doc_id long, text string, n_shingles long, center string").repartition(7)
    out = near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.component_id for r in out.collect()} == {0}
    assert [tuple(r) for r in keep_one(df).collect()] == [(0, rows[0][1], 0, "x")]


def test_shuffled_fetch_equals_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "MOST_CARRIERS", 0)
    rows = near_copies(5, 12, 5, 40, 0.1)
    assert collected(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_densified_bins_agree_as_often_as_sets_do():
    """Few shingles fill few of the bins; the rest must still agree at the rate of the similarity."""
    draw = np.random.default_rng(3)
    for n, shared in ((5, 4), (40, 32), (2000, 1600)):
        rates = []
        for _ in range(40):
            both = draw.integers(0, 2**63, n + n - shared, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            a, b = np.unique(both[:n]), np.unique(np.concatenate([both[: shared], both[n:]]))
            rates.append((one_permutation(a) == one_permutation(b)).mean())
        want = shared / (2 * n - shared)
        assert abs(np.mean(rates) - want) < 0.06, (n, np.mean(rates), want)
    assert len(one_permutation(np.array([5], np.uint64))) == BINS


def test_sizes_equal_plain_sets():
    texts = ["a b a b c", "", "x", "A b", "é è é è", "a\x0bb\x0cc"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert [len(x) for x in shingle_sets(data, offsets)] == [len(plain_set(t)) for t in texts]


def test_sizes_travel_with_the_buckets(spark, monkeypatch):
    """No join fetches the sizes of a bucket's pairs: its rows would grow with the buckets that a group shares."""
    plans, save = {}, minhash_dedup.Scratch.save

    def seen(self, df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return save(self, df, label)

    monkeypatch.setattr(minhash_dedup.Scratch, "save", seen)
    rows = near_copies(4, 3, 20, 40, 0.1)
    assert collected(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert "Join" not in plans["edges"]

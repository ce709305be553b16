"""The text operators against brute force, on small texts that hold the awkward cases."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from tracelane.llm import byte_bpe, decontaminate, flac, jaccard_join, language_id, line_dedup, media, ordinal_quality, queries, suffix_dedup, suffix_tree_lm, token_counts

SCHEMA = "doc_id long, text string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    data = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return WORD.findall(data)


def awkward(seed=1, n=60):
    """Copies, near copies, shared passages, nulls, empty and blank texts, one long text, ties."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, out = text(60), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or i < 6:
            out.append(text(rnd.randint(5, 120)))
        elif kind == 1:
            out.append(rnd.choice([t for t in out if t]))
        elif kind == 2:
            w = rnd.choice([t for t in out if t]).split(" ")
            w[rnd.randrange(len(w))] = "New"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(text(20) + "\n" + passage + "\n" + text(20))
        elif kind == 4:
            out.append(rnd.choice([None, "", "  \n\t ", "one two", "One  two", "a", "ababababab" * 40]))
        else:
            out.append("Common line of this corpus\n" + text(10) + "\n  common LINE of this corpus \nshort")
    out.append(text(6000))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clash(spark, rows):
    """With extra columns named as the operators name theirs."""
    extra = {c: F.lit(7) for c in ("doc", "salt", "set", "n", "a", "b", "kept", "n_bytes", "media", "token_ids", "score", "lang_pred", "label", "line", "part", "n_lines", "__doc", "__salt", "__drops", "__starts", "__fields", "__hit", "__gone", "__new", "MIXTURE", "Payload", "KEPT_text")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1: encoding ----------------------------------------------------------------------------------------------


def test_encoding_is_that_of_the_ranks(tiktoken_encoding):
    codec = byte_bpe.codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    rnd = random.Random(2)
    texts = ["", "a b  c\n\n d", "it's 10,000 ½ naïve 漢字 🙂🙂  x   y　z a\x1cb \x85c", "<|endoftext|>", " " * 50 + "x", "aaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts += ["".join(rnd.choice(rnd.choice(["ab ", "a  b\n\t'sé", "01239 .,", "漢字かな 🙂 ", "etnhao "])) for _ in range(200)) for _ in range(300)]
    texts += ["".join(map(chr, range(a, min(a + 500, 0xD800)))) for a in range(0, 0xD800, 500)]
    for text, got in zip(texts, codec.encode(texts), strict=True):
        want = tiktoken_encoding.encode_ordinary(text)
        assert got.tolist() == want, repr(text[:80])
        assert codec.decode(got) == text.encode()


def test_encoding_columns(spark, rows, tiktoken_encoding):
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(clash(spark, rows), offsets=True), as_text=True)
    for r in coded.collect():
        assert list(r.token_ids) == tiktoken_encoding.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == r.decoded_text == (r.text or "")
        assert len(r.token_starts) == len(r.token_ids) and r.salt == 7
    for r in byte_bpe.round_trip(clash(spark, rows)).collect():
        assert list(r.token_ids) == tiktoken_encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    cut = spark.createDataFrame([([*tiktoken_encoding.encode_ordinary("🙂")][:-1],), (None,)], "token_ids array<int>")
    assert byte_bpe.decode_documents(cut, as_text=True).collect()[0].decoded_text.endswith("�")
    assert byte_bpe.encode_documents(empty(spark)).count() == 0


# ---- 2: Jaccard join ------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets, parent, shared, where = {}, {}, collections.Counter(), collections.defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i
        for s in sets[i]:
            where[s].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for own in where.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                shared[b, a] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()}


def test_groups(spark, rows):
    assert groups(clash(spark, rows)) == brute_groups(rows)


def test_groups_of_large_regions(spark, monkeypatch):
    """A chain of near copies, each linked to its neighbours only, in regions larger than the bound; and copies by the dozen."""
    monkeypatch.setattr(jaccard_join, "LEADERS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(104)]
    chain = []
    for i in range(40):
        base = base.copy()
        base[rnd.randrange(len(base))] = f"x{i}"
        chain.append(" ".join(base))
    body = " ".join(f"p{i}" for i in range(200))
    far = [body + " " + " ".join(f"q{i}_{k}" for k in range(30 + 5 * (i % 7))) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(chain + far + chain[:10] + ["one two"] * 9 + ["One TWO"])]
    rnd.shuffle(rows)
    assert groups(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute_groups(rows)


def test_groups_of_odd_tables(spark):
    assert groups(empty(spark)) == {}
    got = jaccard_join.jaccard_groups(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, None), (4, "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 0, 3), (3, 2, 3), (4, 0, 4), (2**63 - 1, 2, 3)]
    kept = jaccard_join.keep_one(spark.createDataFrame([(5, "a b c d e f"), (3, "A b c d e f"), (7, None)], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7]


# ---- 3: language ----------------------------------------------------------------------------------------------


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_mixture_and_odd_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learn(docs)
    text = {r.lang: r.text for r in docs.where("length(text) > 1500").dropDuplicates(["lang"]).collect()}
    mixed = text["en"][:1200] + "\n" + text["de"][:400]
    rows = [(0, mixed), (1, None), (2, ""), (3, "123 456"), (4, text["fr"])]
    out = {r.doc_id: r for r in language_id.identify(clash(spark, rows), model).collect()}
    assert out[0].lang_pred == "en" and set(out[0].mixture) == {"en", "de"} and 0.6 < out[0].score < 0.9
    assert [out[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "fr"] and out[1].score == 0 and out[4].salt == 7
    untaught = language_id.learn(docs.where("false"))
    assert language_id.identify(spark.createDataFrame(rows, SCHEMA), untaught).where("lang_pred <> 'und'").count() == 0
    assert language_id.accept(language_id.identify(spark.createDataFrame(rows, SCHEMA), model)).count() == 2


# ---- 4: media -------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=900), min_size=1, max_size=4), st.sampled_from([1, 3, 256]))
def test_flac_round_trip(bodies, coarse):
    payloads = [(bytes(c // coarse * coarse for c in b) + b" " * (-len(b) % 192)) for b in bodies]
    for (samples, offsets), p in zip(flac.decode(flac.encode(payloads)), payloads, strict=True):
        assert (samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == p and offsets.tolist() == list(range(0, len(p), 192))


def test_flac_finds_damage():
    stream = bytearray(flac.encode([bytes(range(192)) * 3])[0])
    stream[-20] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(stream)])
    with pytest.raises(flac.FlacError):
        flac.decode([b"RIFF" + bytes(50)])


def test_flac_uses_predictors_and_is_smaller_on_smooth_signals():
    t = np.arange(192 * 40)
    payload = (128 + 100 * np.sin(t / 15)).astype(np.uint8).tobytes()
    assert len(flac.encode([payload])[0]) < 0.6 * len(payload)


def test_media(spark, rows):
    read = media.read_media(media.store_media(clash(spark, rows)))
    for r in read.collect():
        body = (r.text or "").encode()
        payload = body + b" " * (-len(body) % 192 or (0 if body else 192))
        assert bytes(r.payload) == payload and (r.n_bytes, r.payload_bytes, r.n_blocks, r.salt) == (len(body), len(payload), len(payload) // 192, 7)
    stored = media.store_media(spark.createDataFrame(rows[:3], SCHEMA))
    block = media.pcm_blocks(stored, seek=(200, 201)).collect()
    assert {(r.block, r.sample_offset, r.n_samples) for r in block} == {(1, 192, 192)}
    assert (np.frombuffer(block[0].pcm, np.uint8) ^ 0x80).tobytes() == rows[block[0].doc_id][1].encode().ljust(384)[192:384]
    assert media.read_media(media.store_media(empty(spark))).count() == 0


# ---- 5: suffix tree -------------------------------------------------------------------------------------------


def test_scores(spark, rows):
    docs = clash(spark, rows)
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs, docs.where(language_id.fold("doc_id", 5) != 1)).collect()}
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), None])
    total = sum(counts.values())
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in counts for w in tokens), total)
        assert got[i].base_score == pytest.approx(base, abs=1e-6)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_rare_words_are_joined(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {r.doc_id: r.base_score for r in suffix_tree_lm.score(docs, docs).collect()}
    monkeypatch.setattr(suffix_tree_lm, "TOP_WORDS", 20)
    some = {r.doc_id: r.base_score for r in suffix_tree_lm.score(docs, docs).collect()}
    assert some == pytest.approx(whole, abs=1e-6)


def test_runs_are_counted_over_the_whole_corpus(spark, rows):
    thin = spark.createDataFrame([(i, f"u{i} alpha beta v{i}") for i in range(16)], SCHEMA).repartition(16, "doc_id")
    one = suffix_tree_lm.score(spark.createDataFrame([(1, "alpha beta")], SCHEMA), thin).first()
    assert one.score > one.base_score + 0.5
    docs = spark.createDataFrame(rows, SCHEMA)
    whole, split = ({r.doc_id: r.score for r in suffix_tree_lm.score(docs, docs.repartition(n)).collect()} for n in (1, 30))
    assert split == pytest.approx(whole, abs=1e-6)


def test_next_token_distribution_sums_to_one(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    counted = suffix_tree_lm.count_tokens(docs)
    tree, total, distinct = suffix_tree_lm.learn(counted, docs)
    for first in tree.words[:20]:
        token = np.stack([np.full(len(tree.words), first), tree.words], axis=1).ravel()
        logp, known = tree.log10(token, np.tile([0, 1], len(tree.words)))
        rest = 0.5 / (total + 0.5 * (distinct + 1))  # the root's share of unseen tokens
        assert known.all() and 10 ** logp[1::2].sum() <= 1 + 1e-6 and (10 ** logp[1::2]).sum() == pytest.approx(1, abs=rest + 1e-6)
    assert suffix_tree_lm.score(empty(spark), docs).count() == 0
    assert suffix_tree_lm.score(docs, empty(spark)).first().train_tokens == 0


def plain_scores(rows, depth=3, least=4):
    """The same model by counting all runs in dictionaries."""
    texts = [[*words(t), None] for _, t in rows]
    n = collections.Counter(tuple(t[i - k : i]) for t in texts for k in range(1, depth + 2) for i in range(k, len(t) + 1))
    total, distinct = sum(map(len, texts)), sum(len(r) == 1 for r in n)
    root = lambda w: (n[(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
    followers = collections.defaultdict(list)
    for r in n:
        if len(r) > 1 and n[r] >= least:
            followers[r[:-1]].append(r[-1])

    @functools.cache
    def weight(context):
        theirs = [p(context[1:], w) for w in followers[context]]
        share = [n[(*context, w)] / n[context] for w in followers[context]]
        far, rest = sum(a * np.log(a / b) for a, b in zip(share, theirs)), 1 - sum(share)
        far += rest * np.log(max(rest, 1e-12) / max(1 - sum(theirs), 1e-12)) if rest > 1e-9 else 0
        return 1 + n[context] - sum(n[(*context, w)] for w in followers[context]) if far >= 0.05 else None

    @functools.cache
    def p(context, w):
        if not context:
            return root(w)
        if not followers.get(context) or weight(context) is None:
            return p(context[1:], w)
        own = n[(*context, w)] if w in followers[context] else 0
        return (own + weight(context) * p(context[1:], w)) / (n[context] + 1)

    return {i: sum(np.log10(p(tuple(t[max(0, j - depth) : j]), t[j])) for j in range(len(t))) for (i, _), t in zip(rows, texts)}


@pytest.mark.parametrize(("top_words", "top_runs", "bits"), [(1 << 20, 1 << 21, 27), (20, 1 << 21, 27), (20, 10, 8), (1 << 20, 0, 12)])
def test_no_run_is_lost_to_what_is_broadcast(spark, monkeypatch, top_words, top_runs, bits):
    """Rare words and runs are joined, and a run counts wherever it is found to occur often enough, in a corpus of any size."""
    rows = [(i, f"rare{i // 4} word{i // 4} of group {i % 3} and a common line of many words number {i // 4}") for i in range(200)]
    for name, value in (("TOP_WORDS", top_words), ("TOP_RUNS", top_runs), ("FILTER_LOG2", bits)):
        monkeypatch.setattr(suffix_tree_lm, name, value)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(docs, docs.repartition(7)).collect()}
    assert got == pytest.approx(plain_scores(rows), abs=1e-6)


def test_places_that_are_joined_travel_packed(spark, rows, monkeypatch):
    """No row for each place: the plan neither explodes keys nor joins them one by one."""
    monkeypatch.setattr(suffix_tree_lm, "TOP_WORDS", 20)
    monkeypatch.setattr(suffix_tree_lm, "TOP_RUNS", 0)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = suffix_tree_lm.score(docs, docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert {r.doc_id: r.score for r in got.collect()} == pytest.approx(plain_scores(rows), abs=1e-5)


def test_word_hashes_take_all_bytes():
    size = [1, 7, 8, 9, 16, 17, 63, 64, 65, 66, 200]
    one = [bytes(range(1, n + 1)) for n in size]
    two = [w[:-1] + b"\xff" for w in one] + [w[:-1] + b"\0" for w in one] + [w + b"\0" for w in one]
    last = np.cumsum([len(w) for w in one + two])
    starts = np.concatenate([[0], last[:-1]])
    data = np.frombuffer(b"".join(one + two), np.uint8)
    got = suffix_tree_lm.word_hashes(data, starts, last)
    assert len(set(got.tolist())) == len(set(one + two))
    moved = suffix_tree_lm.word_hashes(np.concatenate([data[:3], data, data[:9]]), starts + 3, last + 3)
    assert (moved == got).all()


# ---- 6: token counts ------------------------------------------------------------------------------------------


def test_token_counts(spark, rows, tiktoken_encoding):
    lengths = [len(tiktoken_encoding.encode_ordinary(t or "")) for _, t in rows]
    histogram = token_counts.length_histogram(clash(spark, rows))
    totals = token_counts.suffix_totals(histogram, block=16)
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == collections.Counter(lengths)
    for r in totals.collect():
        kept = sum(min(x, r.n_tokens) for x in lengths)
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.lost_tokens) == (sum(x >= r.n_tokens for x in lengths), sum(x for x in lengths if x >= r.n_tokens), kept, sum(lengths) - kept)
    for r in token_counts.totals_at_limits(histogram, [0, 5, 10**6]).collect():
        assert (r.tokens, r.truncated_tokens, r.docs_cut) == (sum(lengths), sum(min(x, r.context_limit) for x in lengths), sum(x > r.context_limit for x in lengths))
    assert {r.share: r.n_tokens for r in token_counts.length_quantiles(totals, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert token_counts.suffix_totals(token_counts.length_histogram(empty(spark))).count() == 0


# ---- 7: decontamination ---------------------------------------------------------------------------------------


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_edit_distances():
    rnd = random.Random(4)
    items = [bytes(rnd.choice(b"abc") for _ in range(n)) for n in (1, 63, 64, 65, 130)]
    which = np.array([i for i in range(len(items)) for _ in range(6)])
    texts = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 150))) for _ in which]
    got, _ = decontaminate.best_distances(items, which, texts)
    assert got.tolist() == [distance(items[i], t) for i, t in zip(which, texts, strict=True)]


def test_items_are_found(spark, sf):
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet' ORDER BY item_id").fetchall()
    rnd, noise = random.Random(6), " ".join(f"noise{i}" for i in range(80))
    rows = [(0, noise), (1, None), (2, ""), (3, " ")]
    for i, t in items:
        body = list(t)
        for _ in range(int(0.1 * len(t)) if i % 2 else 0):
            body[rnd.randrange(len(body))] = rnd.choice("abcdef ")
        rows.append((100 + i, f"{noise} {''.join(body).upper() if i % 4 == 0 and t.isascii() else ''.join(body)} {noise}"))
    found = {(r.doc_id, r.item_id): r.edit_distance for r in decontaminate.find_items(clash(spark, rows), spark.createDataFrame([*items, (900, None), (901, " "), (902, "")], "item_id long, text string")).collect()}
    pairs = {(100 + i, i) for i, _ in items}
    assert len(pairs & set(found)) >= 0.9 * len(pairs) and all(found[p] == 0 for p in pairs if p[1] % 2 == 0) and not {d for d, _ in found} & {0, 1, 2, 3}
    text = dict(rows)
    for d, i in sorted(found)[:12]:
        low = lambda s: decontaminate.normal(np.frombuffer(s.encode(), np.uint8)).tobytes()
        assert found[d, i] == distance(low(dict(items)[i]), low(text[d]))


def edited(rnd, body, share, kinds):
    """``body`` with that share of its bytes substituted, doubled or dropped."""
    out = list(body)
    for p in sorted(rnd.sample(range(len(out)), int(share * len(out))), reverse=True):
        kind = rnd.choice(kinds)
        if kind == "drop":
            del out[p]
        elif kind == "add":
            out.insert(p, rnd.choice(body))
        else:
            out[p] = rnd.choice([c for c in range(97, 123) if c != out[p]])
    return bytes(out)


@pytest.mark.parametrize("kinds", [("other",), ("other", "add", "drop")])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_recall_up_to_the_limit(share, kinds):
    """Against all items, each planted once: no text without blanks, no edited word and no neighbour is needed."""
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    said = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [said(rnd.randint(14, 60)) for _ in range(120)]
    index = decontaminate.ItemIndex(list(range(len(items))), items)
    texts = [(said(150) + "x").encode() + edited(rnd, t.encode(), share, kinds) + ("y" + said(150)).encode() for t in items]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = {(r, i): d for r, i, d, _ in index.matches(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 0.2)}
    hit = [i for i in range(len(items)) if (i, i) in found]
    assert len(hit) >= (1 if share == 0 else 0.9) * len(items)
    if share == 0:
        assert all(found[i, i] == 0 for i in hit)


def test_edits_in_every_other_word_and_text_without_blanks():
    plain = "the quick brown foxes never jumped across those seven sleeping watchdogs before sunrise yesterday morning"
    swapped = " ".join(w if k % 2 else "q" + w[1:] for k, w in enumerate(plain.split()))
    dense = "漢字仮名交じり文を空白なしで書いた長い項目をここに置く"
    index = decontaminate.ItemIndex([1, 2], [plain, dense])
    texts = [f"so {swapped} then".encode(), f"前置き{dense}後書き".encode(), b"nothing of this kind is in here at all"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = index.matches(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 0.2)
    assert {(r, index.ids[i]) for r, i, _, _ in got} == {(0, 1), (1, 2)}


def test_rows_of_one_identifier_are_clean_each_by_its_text(spark):
    item = "which of these four words is the right one"
    rows = spark.createDataFrame([(5, f"so {item} then"), (5, "five"), (None, item), (None, "none"), (6, None), (6, item)], SCHEMA)
    kept = decontaminate.clean(rows, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(5, "five"), (6, None), (None, "none")]


def test_no_items_or_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(spark.createDataFrame([(1, "a b")], SCHEMA), none).count() == 0
    some = spark.createDataFrame([(1, "alone"), (1, "alone")], "item_id long, text string")
    assert decontaminate.find_items(empty(spark), some).count() == 0
    rows = spark.createDataFrame([(1, "it is alone here"), (2, "no"), (None, "alone")], SCHEMA)
    assert sorted(r.doc_id for r in decontaminate.find_items(rows, some).collect()) == [1, 2**63 - 1]
    assert [r.doc_id for r in decontaminate.clean(rows, some).collect()] == [2]


# ---- 8: lines -------------------------------------------------------------------------------------------------


def brute_lines(rows, least=2):
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode() if line.isascii() else line.strip(" \t\n\x0b\x0c\r")
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(holders.get(key(x), ())) >= least and i != min(holders[key(x)]))]
        out[i] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("least", [2, 4])
def test_lines(spark, rows, least):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(clash(spark, rows), min_docs=least).collect()}
    assert got == brute_lines(rows, least)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_lines_equal_their_sql(spark, sf):
    assert_same(queries.QUERIES["op8_line_dedup"](spark, sf), connect(sf), queries.ORACLE_SQL["op8_line_dedup"])


# ---- 9: quality -----------------------------------------------------------------------------------------------


def test_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_ordinal_quality(spark, sf).join(labels, "doc_id").collect()
    toxic = [r.expected_grade for r in got if r.toxic]
    good = [r.expected_grade for r in got if r.quality and not r.toxic]
    assert np.mean(good) > np.mean(toxic) + 0.5


def test_thresholds_are_ordered_and_odd_inputs_work(spark, rows):
    rnd = np.random.default_rng(1)
    grades = rnd.integers(0, 3, 300)
    model = ordinal_quality.fit([np.array([g, 3 + int(rnd.integers(0, 3))]) for g in grades], grades)
    assert model.thresholds[0] < model.thresholds[1] and model.weights[2] > model.weights[1] > model.weights[0]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = ordinal_quality.grade(clash(spark, rows), ordinal_quality.learn(spark.createDataFrame(rows, SCHEMA), none)).collect()
    assert len(out) == len(rows) and len({round(r.expected_grade, 9) for r in out}) == 1 and out[0].salt == 7


# ---- 10: repeated byte strings --------------------------------------------------------------------------------


def brute_suffixes(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - width + 1):
            part = body[p : p + width]
            if part in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(part)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(body), sum(gone), spans, bytes(c for c, g in zip(body, gone, strict=True) if not g))
    return out


def repeated(df, width=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df, width).collect()}


@pytest.mark.parametrize("width", [100, 40])
def test_repeated_strings(spark, rows, width):
    assert repeated(clash(spark, rows).repartition(3), width) == brute_suffixes(rows, width)


def test_repeated_strings_of_few_letters(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) * rnd.randint(1, 120)) for i in range(40)]
    rows += [(100 + i, rows[i][1][:150] + rows[i + 1][1][:130] + rows[i][1][:150]) for i in range(20)]
    assert repeated(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute_suffixes(rows, 100)
    assert repeated(empty(spark)) == {}


def test_repeated_strings_of_near_equal_names(spark):
    """Different strings around one gram whose hashes agree in the upper 32 bits, or in the lower 32 and the range."""
    rnd = np.random.default_rng(11)
    grams = rnd.integers(97, 123, (20_000, 32), dtype=np.uint8)
    names = np.array([suffix_dedup.RangeHash(g).windows(32)[0] for g in grams])
    bodies, runs, windows = [], [], []
    for _ in range(12):
        some = rnd.integers(97, 123, (60_000, 100), dtype=np.uint8)
        some[:, 34:66] = grams[names.argmin()]
        hashes = suffix_dedup.RangeHash(some.ravel())
        row, _, _, name, run = suffix_dedup.sample_runs(hashes, np.arange(60_001) * 100, 100)
        own = name == names.min()
        bodies.append(some[row[own]])
        runs.append(run[own])
        windows.append(hashes.windows(100)[row[own] * 100])
    bodies, runs, windows = map(np.concatenate, (bodies, runs, windows))
    ranges = suffix_dedup.blobs.LEAST_RANGES
    for key in (runs >> np.uint64(32), (windows << np.uint64(32)) | suffix_dedup.blobs.part_of(windows, ranges).astype(np.uint64)):
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(key[order][1:] == key[order][:-1])
        assert len(at)
        rows = [(i, bodies[j].tobytes().decode()) for i, j in enumerate(order[at[0] : at[0] + 2])]
        assert repeated(spark.createDataFrame(rows, SCHEMA)) == brute_suffixes(rows, 100)


def test_repeated_strings_query_digest(spark, sf):
    got = {r.doc_id: r.kept_sha256 for r in queries.op10_suffix_dedup(spark, sf).collect()}
    want = brute_suffixes([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 100)
    assert got == {i: hashlib.sha256(w[3]).hexdigest() for i, w in want.items()}

"""Parts of the text operators against plain reimplementations: language sets, another FLAC encoder, the ordinal fit."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelane.llm import byte_bpe, decontaminate, flac, language_id, line_dedup, media, ordinal_quality, suffix_dedup, suffix_tree_lm


# ---- 3: language sets against all subsets -----------------------------------------------------------------------


def subset_likelihood(words, chosen):
    """Log likelihood of the words by plain expectation-maximisation."""
    lik = np.exp(words[:, chosen])
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(300):
        own = lik * share
        share = (own / own.sum(axis=1, keepdims=True)).mean(axis=0)
    return np.log((lik * share).sum(axis=1)).sum()


def test_language_sets_against_all_subsets():
    rnd = np.random.default_rng(3)
    names = ["aa", "bb", "cc", "dd"]
    alphabets = ["abcdefg", "efghijk", "ijklmno", "mnopqrs"]
    say = lambda k, n: " ".join("".join(rnd.choice(list(alphabets[k]), 5)) for _ in range(n))
    counts = np.zeros((1 << language_id.BUCKETS_LOG2, 4))
    for k in range(4):
        counts[:, k] = np.bincount(language_id.trigrams([say(k, 3000)])[0], minlength=len(counts))
    model = language_id.LanguageModel(names, counts)
    texts = [say(0, 40), say(0, 30) + " " + say(2, 30), say(1, 20) + " " + say(2, 25) + " " + say(3, 30), say(3, 3), " ".join(say(k, 12) for k in range(4))]
    shares, equal = language_id.infer(model, texts), 0
    for text, share in zip(texts, shares, strict=True):
        bucket, first, _ = language_id.trigrams([text])
        words = np.add.reduceat(model.logp[bucket], first, axis=0).astype(float)
        price = language_id.PENALTY * np.log(max(2, len(words)))
        worth = lambda own: subset_likelihood(words, list(own)) - price * len(own)  # noqa: B023, E731
        best = max((s for n in range(1, 5) for s in itertools.combinations(range(4), n)), key=worth)
        mine = tuple(np.flatnonzero(share))
        equal += mine == best
        assert worth(mine) >= worth(best) - price and abs(share.sum() - 1) < 1e-9
    assert equal >= 4


def test_any_number_of_languages_fits_the_model(spark):
    assert [language_id.buckets_log2(n) for n in (0, 1, 4, 512, 513, 7000)] == [16, 16, 16, 16, 15, 12]
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 30, f"l{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert len(model.languages) == 600 and len(model.logp) == 1 << 15
    got = language_id.identify(docs.where("doc_id < 40"), model).where(F.col("lang_pred") == F.col("lang")).count()
    assert got >= 38


# ---- 4: streams of another encoder ------------------------------------------------------------------------------


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, width):
        self.out += [(value >> (width - 1 - i)) & 1 for i in range(width)]
        return self

    def bytes(self):
        self.out += [0] * (-len(self.out) % 8)
        return np.packbits(np.array(self.out, np.uint8)).tobytes()


def crc(data, polynomial, width):
    value = 0
    for b in data:
        value ^= b << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ (polynomial if value >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return value


def frame(number, samples, write, depth=8):
    head = Bits().put(0xFFF8, 16).put(6, 4).put(0, 4).put(0, 4).put(1 if depth == 8 else 4, 3).put(0, 1).put(number, 8).put(len(samples) - 1, 8).bytes()
    head += bytes([crc(head, 0x07, 8)])
    body = Bits()
    write(body, samples, depth)
    whole = head + body.bytes()
    return whole + crc(whole, 0x8005, 16).to_bytes(2, "big")


def wasted(bits, samples, depth):
    """As they stand, without two low bits that are 0 in all."""
    bits.put(0, 1).put(1, 6).put(1, 1).put(1, 2)
    for s in samples:
        bits.put(int(s >> 2) & ((1 << (depth - 2)) - 1), depth - 2)


def escaped(bits, samples, depth):
    """First differences in two partitions: one as plain numbers of 9 bits, one in Rice codes."""
    bits.put(0, 1).put(9, 6).put(0, 1).put(int(samples[0]) & ((1 << depth) - 1), depth).put(0, 2).put(1, 4)
    residual = np.diff(samples)
    half = len(samples) // 2 - 1
    bits.put(15, 4).put(9, 5)
    for r in residual[:half]:
        bits.put(int(r) & 511, 9)
    bits.put(3, 4)
    for r in residual[half:]:
        u = 2 * int(r) if r >= 0 else -2 * int(r) - 1
        bits.put(1, (u >> 3) + 1).put(u & 7, 3)


def constant(bits, samples, depth):
    bits.put(0, 8).put(int(samples[0]) & ((1 << depth) - 1), depth)


def stream(frames, samples, depth):
    digest = hashlib.md5(samples.astype(np.int8 if depth == 8 else "<i2").tobytes()).digest()
    packed = (8000 << 44) | ((depth - 1) << 36) | len(samples)
    padding = b"\x01\x00\x00\x05" + bytes(5)
    return b"fLaC\x00\x00\x00\x22" + bytes([0, 16, 0, 255]) + bytes(6) + packed.to_bytes(8, "big") + digest + b"\x81" + padding[1:] + b"".join(frames)


@pytest.mark.parametrize("depth", [8, 16])
def test_streams_of_another_encoder(depth):
    rnd = np.random.default_rng(depth)
    parts = [rnd.integers(-20, 20, 64) * 4, rnd.integers(-100, 100, 96), np.full(16, -7), rnd.integers(-100, 100, 96)]
    writers = [wasted, escaped, constant, escaped]
    body = stream([frame(i, p, w, depth) for i, (p, w) in enumerate(zip(parts, writers, strict=True))], np.concatenate(parts), depth)
    ((samples, offsets),) = flac.decode([body])
    assert samples.tolist() == np.concatenate(parts).tolist() and offsets.tolist() == [0, 64, 160, 176]


def test_a_frame_inside_samples_is_none_of_the_stream():
    """Verbatim samples hold a valid frame header with the next running number."""
    trap = np.frombuffer(frame(1, np.full(16, 3), constant)[:7], np.int8).astype(np.int64)

    def verbatim(bits, samples, depth):
        bits.put(2, 8)
        for s in samples:
            bits.put(int(s) & 255, 8)

    first = np.concatenate([np.arange(20), trap, np.arange(30)])
    parts = [first, np.full(16, 5)]
    body = stream([frame(0, first, verbatim), frame(1, parts[1], constant)], np.concatenate(parts), 8)
    ((samples, offsets),) = flac.decode([body])
    assert samples.tolist() == np.concatenate(parts).tolist() and offsets.tolist() == [0, len(first)]


def test_cut_streams_and_wrong_digests_are_noticed():
    body = flac.encode([bytes(range(192)) * 3])[0]
    starts = flac.frame_starts(np.frombuffer(body, np.uint8))
    for bad in (body[: starts[2]], body[:30] + bytes([body[30] ^ 1]) + body[31:], body[:20]):
        with pytest.raises(flac.FlacError):
            flac.decode([bad])


def test_streams_of_a_batch_share_the_passes_over_checksums(monkeypatch):
    """However many streams there are; one that needs following, or is damaged, is still told apart."""
    passes, crc = [], flac._crc
    monkeypatch.setattr(flac, "_crc", lambda *a: passes.append(1) or crc(*a))
    draw = np.random.default_rng(4)
    payloads = [bytes(draw.integers(0, 256, 192 * int(n), dtype=np.uint8)) for n in draw.integers(1, 5, 60)]
    streams = flac.encode(payloads)
    passes.clear()
    found = flac.decode(streams)
    assert len(passes) < 10
    assert [media._bytes(samples) for samples, _ in found] == payloads
    trap = np.frombuffer(frame(1, np.full(16, 3), constant)[:7], np.int8).astype(np.int64)

    def verbatim(bits, samples, depth):
        bits.put(2, 8)
        for s in samples:
            bits.put(int(s) & 255, 8)

    first = np.concatenate([np.arange(20), trap, np.arange(30)])
    odd = stream([frame(0, first, verbatim), frame(1, np.full(16, 5), constant)], np.concatenate([first, np.full(16, 5)]), 8)
    for at in (0, 1, 2):
        mixed = [*streams[:at], odd, *streams[at:2]]
        want = [*payloads[:at], media._bytes(np.concatenate([first, np.full(16, 5)])), *payloads[at:2]]
        assert [media._bytes(samples) for samples, _ in flac.decode(mixed)] == want
        for bad in (streams[5][:-1], streams[5][:50] + bytes([streams[5][50] ^ 1]) + streams[5][51:], streams[5][:20], odd[:-3]):
            with pytest.raises(flac.FlacError):
                flac.decode([*streams[:at], bad, *streams[at:2]])


# ---- 9: the ordinal fit -------------------------------------------------------------------------------------------


def plain_loss(p, rows, grades):
    """Penalised negative log likelihood, text by text."""
    weights, cuts = p[:-2], [p[-2], p[-2] + np.exp(p[-1])]
    tail = lambda s, k: 1.0 if k <= 0 else 0.0 if k > 2 else 1 / (1 + np.exp(cuts[k - 1] - s))
    value = 0.0
    for own, grade in zip(rows, grades, strict=True):
        s = sum(weights[f] for f in own)
        value -= np.log(max(tail(s, grade) - tail(s, grade + 1), 1e-9))
    return (value + ordinal_quality.RIDGE * float((weights**2).sum()) / 2) / len(grades)


def test_loss_and_gradient():
    rnd = np.random.default_rng(9)
    rows = [rnd.integers(0, 6, 3) for _ in range(30)]
    grades, p = rnd.integers(0, 3, 30), rnd.normal(size=8) / 2
    row, column = np.repeat(np.arange(30), 3), np.concatenate(rows)
    value, slope = ordinal_quality.loss(p, row, column, grades, 3)
    assert abs(value - plain_loss(p, rows, grades)) < 1e-12
    step = 1e-6 * np.eye(8)
    by_hand = [(plain_loss(p + e, rows, grades) - plain_loss(p - e, rows, grades)) / 2e-6 for e in step]
    assert np.allclose(slope, by_hand, atol=1e-7)


def test_held_out_grades(spark, sf):
    """Fitted on two thirds of the rated documents, the model orders the rest."""
    larger = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    model = ordinal_quality.learn(docs, labels.where("doc_id % 3 <> 1"))
    rated = ordinal_quality.graded(labels.where("doc_id % 3 = 1"))
    got = ordinal_quality.grade(docs.join(rated, "doc_id"), model).select("grade", "expected_grade").collect()
    by = {g: [r.expected_grade for r in got if r.grade == g] for g in (0, 2)}
    right = np.mean([a < b for a in by[0] for b in by[2]])
    assert len(by[0]) >= 3 and len(by[2]) >= 10 and right > 0.7


# ---- odd rows: null and shared identifiers, equal rows, a text larger than what tasks take at a time, no rows -------


def odd_rows():
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(5000)]
    big = " ".join(rnd.choice(vocabulary) for _ in range(480_000))
    return big, [(1, "first text of one"), (1, "second text of one"), (None, "no identifier"), (None, ""), (2, None), (3, big), (4, big), (4, big)]


@pytest.fixture(scope="module")
def odd(spark):
    big, rows = odd_rows()
    assert len(big) > 2_500_000
    return big, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")


def test_odd_rows_encode(odd, tiktoken_encoding):
    big, docs, empty = odd
    want = {t: tiktoken_encoding.encode_ordinary(t or "") for t in (big, "no identifier", None)}
    for r in byte_bpe.round_trip(docs).collect():
        assert bytes(r.decoded) == (r.text or "").encode() and (r.text not in want or list(r.token_ids) == want[r.text])
    assert byte_bpe.round_trip(empty).count() == 0


def test_odd_rows_of_language_and_quality(odd, spark):
    _, docs, empty = odd
    model = language_id.learn(docs.withColumn("lang", F.lit("xx")))
    got = language_id.identify(docs, model).select("doc_id", F.length("text").alias("n"), "lang_pred").collect()
    assert len(got) == 8 and {r.lang_pred for r in got if not r.n} == {"und"} and {r.lang_pred for r in got if r.n} == {"xx"}
    assert language_id.identify(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in ordinal_quality.graded(labels).collect()] == [(1, 1)]
    fitted = ordinal_quality.learn(docs, labels)
    assert ordinal_quality.grade(docs, fitted).count() == 8 and ordinal_quality.grade(empty, fitted).count() == 0


def test_odd_rows_of_media(odd):
    _, docs, _ = odd
    for r in media.read_media(media.store_media(docs)).select("text", "payload", "n_bytes").collect():
        assert bytes(r.payload)[: r.n_bytes] == (r.text or "").encode()


def test_odd_rows_of_the_language_model(odd):
    _, docs, empty = odd
    by = {}
    for parts in (1, 7):
        rows = suffix_tree_lm.score(docs.repartition(parts), docs).collect()
        assert len(rows) == 8 and all(np.isfinite(r.score) for r in rows)
        by[parts] = sorted((r.n_tokens, round(r.score, 6), round(r.base_score, 6)) for r in rows)
        assert len({r.score for r in rows if r.n_tokens > 1000}) == 1
    assert by[1] == by[7] and suffix_tree_lm.score(empty, docs).count() == 0


def test_odd_rows_of_line_and_suffix_dedup(odd):
    big, docs, empty = odd
    lines = line_dedup.line_dedup(docs).select("doc_id", F.length("text").alias("n"), "n_dropped").collect()
    assert sorted((r.doc_id or 9, r.n, r.n_dropped) for r in lines if r.n_dropped) == [(4, 0, 1), (4, 0, 1)] and len(lines) == 8
    cut = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted((r.doc_id or 9, r.n_removed, r.n_spans) for r in cut if r.n_removed) == [(4, len(big), 1)] * 2 and len(cut) == 8
    assert line_dedup.line_dedup(empty).count() == 0 and suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("n", range(7))
def test_jaccard_of_tables_of_few_words(spark, n):
    """Parts with fewer words than a shingle, alone or at the end of a batch."""
    from tracelane.llm.jaccard_join import jaccard_groups

    rows = [(i, f"w{i}") for i in range(n)] + [(100, " ".join(f"v{i}" for i in range(n)))]
    for parts in (1, n + 1):
        out = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted([*((i, 1, i) for i in range(n)), (100, max(1, n - 4) if n else 0, 100 if n != 1 else 100)])


def test_texts_of_one_identifier_with_equal_short_hashes_stay_apart(spark):
    """Texts whose 32-bit hashes meet, under a null and under a given identifier: none loses bytes to the other's repeats."""
    from pyspark.sql import Window as W

    made = spark.range(260_000).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2((-F.col("id") - 1).cast("string"), 256), F.sha2((F.col("id") + 10**9).cast("string"), 256)).alias("t"))
    met = made.withColumn("h", F.hash("t")).withColumn("n", F.count("*").over(W.partitionBy("h"))).where("n > 1").orderBy("h", "t").limit(2).collect()
    a, b = met[0].t, met[1].t
    assert met[0].h == met[1].h and a != b
    for own in (None, 7):
        out = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, a), (own, a), (own, b)], "doc_id long, text string"))
        got = {(r.doc_id, r.text): r.n_removed for r in out.collect()}
        assert got == {(1, a): 0, (own, a): len(a), (own, b): 0}


# ---- 7: the bound on windows --------------------------------------------------------------------------------------


def test_windows_are_bounded_before_they_are_embedded():
    """No window that would be verified is lost, at any rate of edits, and most of those by chance go first."""
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [*(prose(n) for n in (1, 4, 12, 40, 40, 40)), "aaaa" * 30]
    texts = ["", "ab", prose(400)]
    for item in items:
        for edits in (0, 0.1, 0.2, 0.25):
            body = list(item)
            for _ in range(int(edits * len(item))):
                at = draw.randrange(len(body))
                body[at : at + 1] = draw.choice(["", "x", body[at] + "y"])
            texts += [prose(30) + "".join(body) + prose(30), "".join(body)]
    index = decontaminate.ItemIndex(list(range(len(items))), items)
    data = decontaminate.normal(np.frombuffer("".join(texts).encode(), np.uint8))
    offsets = np.cumsum([0, *map(len, texts)])
    found = index.windows(data, offsets)
    for most in (0.05, 0.2):
        may = index.possible(data, offsets, found, most)
        row, item, start, _ = found
        size = index.sizes[item]
        slack = (most * size).astype(np.int64)
        begin, stop = np.maximum(offsets[row], start - slack), np.minimum(offsets[row + 1], start + size + slack)
        distance, _ = decontaminate.best_distances(index.bodies, item, [data[i:j].tobytes() for i, j in zip(begin, stop, strict=True)])
        true = distance <= slack
        assert true.any() and not (true & ~may).any()
    chance = row == 2
    assert index.possible(data, offsets, found, 0.05)[chance].mean() < 0.5


def test_workers_do_not_keep_the_codec(spark):
    """A worker that has encoded a partition waits without the vocabulary; else each one of an executor would hold it."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(16)], "doc_id long, text string").repartition(8)
    coded = byte_bpe.round_trip(docs)
    assert all(bytes(r.decoded).decode() == r.text for r in coded.collect())

    @F.arrow_udf("bigint")
    def held(ids: pa.Array) -> pa.Array:
        return pa.array([byte_bpe.codec.cache_info().currsize] * len(ids))

    assert {r.n for r in docs.select(held("doc_id").alias("n")).collect()} == {0}

"""Which languages a document mixes, and in what proportions."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import arrow_udf, byte_view, chunks, map_batches, strings, with_fields

#: Hashed character trigrams per language, and the size of the model: with over 2^9 languages each has fewer buckets, so
#: that it stays within 2^MODEL_LOG2 float32 (134 MB) for any number of them.
BUCKETS_LOG2, MODEL_LOG2 = 16, 25
SMOOTHING = 0.1
#: Expectation-maximisation ends when no share moves by more than EM_STEP, after EM_ROUNDS at the latest.
EM_ROUNDS, EM_STEP = 50, 1e-3
#: Price of one more language: this times ln(words).
PENALTY = 1.5
CHUNK_BYTES = 200_000
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, first trigram of each word, row of each word).

    Text is lower-cased; what is not a letter counts as one blank, so words see their edges.
    """
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    codes = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, 0x10FFFF)]
    shown = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    before = np.where(at > 0, shown[at - 1], 0).astype(np.uint64)
    after = shown[np.minimum(at + 1, len(shown) - 1)]
    key = (before << np.uint64(42)) | (shown[at] << np.uint64(21)) | after
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (key >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return bucket, first, np.searchsorted(ends, at[first], "right")


def _groups(column: pa.Array, languages: int = 8) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of row ranges of about CHUNK_BYTES, of fewer where each has more languages to weigh.

    Only one range at a time is held as Python strings.
    """
    for start, stop in chunks(byte_view(column)[1], CHUNK_BYTES * 8 // max(8, languages)):
        yield start, strings(column[start:stop])


def buckets_log2(languages: int) -> int:
    return min(BUCKETS_LOG2, MODEL_LOG2 - max(languages - 1, 0).bit_length())


class LanguageModel:
    """Trigram log probabilities, one column per language, sorted by name."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.shift = languages, BUCKETS_LOG2 - (len(counts) - 1).bit_length()
        total = counts.sum(axis=0, keepdims=True)
        self.logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * len(counts))).astype(np.float32)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram counts of each language over all rows of ``labelled``.

    Rows whose language or text is null teach nothing. Each task adds up its own counts, so the shuffle carries one row
    per language, bucket and task; the summed table has at most 2^MODEL_LOG2 rows, whatever the number of languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    bits = buckets_log2(rows.select(lang_col).distinct().count())
    size, shift = 1 << bits, BUCKETS_LOG2 - bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for start, texts in _groups(batch.column(0)):
                bucket, first, row = trigrams(texts)
                spread = np.repeat(row, np.diff(np.append(first, len(bucket))))
                own = langs[start : start + len(texts)]
                for lang in sorted(set(own)):
                    mine = bucket[(own == lang)[spread]] >> shift
                    sums[lang] = sums.get(lang, 0) + np.bincount(mine, minlength=size)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["lang", "bucket", "n"])

    table = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (table.column(c).to_pylist() if c == "lang" else table.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    languages = sorted(set(lang))
    counts = np.zeros((size, max(1, len(languages))))
    where = {x: i for i, x in enumerate(languages)}
    counts[bucket, [where[x] for x in lang]] = n
    return LanguageModel(languages, counts)


def _mixture(words: np.ndarray, row: np.ndarray, rows: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each row by expectation-maximisation; words: log likelihood by language."""
    top = words.max(axis=1, keepdims=True)
    lik = np.exp(words - top)
    share = np.full((rows, words.shape[1]), 1 / words.shape[1])
    for _ in range(EM_ROUNDS):
        own = lik * share[row]
        own /= own.sum(axis=1, keepdims=True)
        before, share = share, np.stack([np.bincount(row, own[:, j], rows) for j in range(own.shape[1])], axis=1) / n[:, None]
        if np.abs(share - before).max(initial=0) < EM_STEP:
            break
    seen = np.log((lik * share[row]).sum(axis=1)) + top[:, 0]
    return share, np.bincount(row, seen, rows)


def infer(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Proportions [text, language]; all zero for a text without letters.

    The language set grows from the single best language by the one that adds most likelihood, the proportions of each
    larger set being fitted by expectation-maximisation over words; it is kept if that gains more than
    PENALTY * ln(words). The sum of word maxima bounds what a language can add, so candidates are fitted in the order of
    their bounds until no other can be better.
    """
    size = len(model.languages)
    out = np.zeros((len(texts), size))
    if not size:
        return out
    bucket, first, row = trigrams(texts)
    if not len(bucket):
        return out
    words = np.add.reduceat(model.logp[bucket >> model.shift], first, axis=0).astype(np.float64)
    rows = len(texts)
    n = np.bincount(row, minlength=rows)
    alone = np.stack([np.bincount(row, words[:, j], rows) for j in range(size)], axis=1)
    has = n > 0
    best = alone.argmax(axis=1)
    out[has, best[has]] = 1
    likelihood = alone[np.arange(rows), best]
    chosen = [best]
    price = PENALTY * np.log(np.maximum(n, 2))
    active = has.copy()
    for k in range(1, size):
        ids = np.flatnonzero(active)
        if not len(ids):
            break
        back = np.full(rows, -1)
        back[ids] = np.arange(len(ids))
        mine = back[row] >= 0
        w, r = words[mine], back[row[mine]]
        sets = np.stack([c[ids] for c in chosen], axis=1)
        held = np.take_along_axis(w, sets[r], axis=1).max(axis=1)
        bound = np.stack([np.bincount(r, np.maximum(held, w[:, j]), len(ids)) for j in range(size)], axis=1)
        np.put_along_axis(bound, sets, -np.inf, axis=1)
        order = np.argsort(-bound, axis=1, kind="stable")
        least = likelihood[ids] + price[ids]  # what a candidate must exceed, later the best one so far
        best, shares = np.full(len(ids), -1), np.zeros((len(ids), k + 1))
        for extra in order.T:
            own = np.flatnonzero(bound[np.arange(len(ids)), extra] > least)
            if not len(own):
                break
            place = np.full(len(ids), -1)
            place[own] = np.arange(len(own))
            keep = place[r] >= 0
            wider = np.column_stack([sets[own], extra[own]])
            share, got = _mixture(np.take_along_axis(w[keep], wider[place[r[keep]]], axis=1), place[r[keep]], len(own), n[ids[own]])
            better = got > least[own]
            won = own[better]
            best[won], least[won], shares[won] = extra[won], got[better], share[better]
        active[ids[best < 0]] = False
        grown = best >= 0
        ids, sets = ids[grown], np.column_stack([sets, best])[grown]
        if not len(ids):
            break
        likelihood[ids] = least[grown]
        out[ids] = 0
        out[ids[:, None], sets] = shares[grown]
        added = np.zeros(rows, np.int64)
        added[ids] = sets[:, -1]
        chosen.append(added)
    return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its share, 0 to 1) and ``mixture`` (language to share, the chosen set).

    Null text, empty text and text without a letter give ``und``, score 0 and an empty mixture, as does a model that
    has learned nothing. Equal shares go to the first name. Input columns of these names are replaced; other columns
    and repeated rows pass through. No shuffle; the model is a broadcast of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double,mixture:map<string,double>>")
    def predict(column: pa.Array) -> pa.Array:
        own = shared.value
        names, scores, mixtures = [], [], []
        for _, texts in _groups(column, len(own.languages)):
            for share in infer(own, texts):
                top = int(share.argmax()) if len(share) else 0
                found = len(share) > 0 and share[top] > 0
                names.append(own.languages[top] if found else UNDETERMINED)
                scores.append(min(1.0, float(share[top])) if found else 0.0)
                mixtures.append([(own.languages[j], float(share[j])) for j in np.flatnonzero(share)])
        kinds = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))]
        return pa.StructArray.from_arrays(kinds, names=["lang_pred", "score", "mixture"])

    return with_fields(docs, predict(F.col(text_col).cast("string")), ("lang_pred", "score", "mixture"))


def fold(id_col: str, folds: int):
    """crc32 of the identifier's decimal text modulo ``folds``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def accept(identified: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose language is determined and has at least ``least`` of the words.

    Texts that are null, empty or without a letter are undetermined and go; equal rows stay or go together. An empty table
    stays empty, and every column stays as it is.
    """
    return identified.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))


"""Which activities a free text is about: named in it, spelled almost so, or sharing a telling word with it."""

from __future__ import annotations

import difflib
import re
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.functions.size import MOST_ROWS
from tracelane.functions.text import activity_key

#: Words that tell no activity from another. Fixed values.
STOP_WORDS = (
    "which", "where", "cases", "orders", "order", "process", "about", "there", "their", "what",
    "does", "slow", "slower", "long", "longer", "delay", "delayed", "delays", "waiting", "how",
)
LEAST_LIKENESS, LEAST_LETTERS, MOST_CANDIDATES = 0.85, 4, 3
#: The automaton works along a key recursively; longer keys are searched for one by one.
TRIE_LENGTH = 1000
#: Distinct groups of words whose nearest label a worker remembers.
REMEMBERED = 1 << 16
#: Labels and groups of words that one task compares.
CELL_LABELS, CELL_GRAMS = 100_000, 20_000
#: Labels of up to so many words are found by a join; longer ones are searched for in blocks.
MOST_WORDS = 8
#: Common subsequences are counted in a machine word per label, of labels up to a length.
GRAM_BITS, LABEL_CELLS = 63, 128
_FOUND = "struct<how:string,activity:string,likeness:double>"


def labels(events: DataFrame) -> DataFrame:
    """``activity`` and ``key``: each distinct label by what its spellings share. Labels without a key (``_``) cannot be named."""
    keyed = events.select("activity").distinct().withColumn("key", activity_key("activity"))
    return keyed.where("key <> ''").groupBy("key").agg(F.max("activity").alias("activity"))


def folded(text: str) -> str:
    """Runs of blanks, ``_`` and ``-`` are one blank, and case is folded, as in keys of labels."""
    return re.sub(r"[\s_\-]+", " ", text).strip().casefold()


def _plain(text: str) -> str:
    """Folded, with blanks for punctuation."""
    return folded(re.sub(r"[^\w\s-]", " ", text))


def _grams(plain: str, counts: tuple[int, ...]) -> set[str]:
    """Distinct groups of so many words in a row."""
    words = plain.split()
    return {" ".join(words[i : i + n]) for n in counts for i in range(len(words) - n + 1)}


class LabelFinder:
    """One block of labels: an automaton for exact mentions, and lengths and letters for a first look at likeness."""

    def __init__(self, keys: list[str], names: list[str]):
        order = sorted(range(len(keys)), key=lambda i: (len(keys[i]), names[i]))
        self.keys, self.names = [keys[i] for i in order], [names[i] for i in order]
        self.automaton = ahocorasick.Automaton()
        self.long = [i for i, key in enumerate(self.keys) if len(key) > TRIE_LENGTH]
        for i, key in enumerate(self.keys[: len(self.keys) - len(self.long)]):
            self.automaton.add_word(f" {key} ", i)
        self.automaton.make_automaton()
        self.nearest = lru_cache(maxsize=REMEMBERED)(self._nearest)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(k) for k in self.keys], np.int64)

    @cached_property
    def letters(self) -> np.ndarray:
        return np.array([_letters(k) for k in self.keys], np.uint64)

    @cached_property
    def _signs(self) -> tuple[dict[str, int], np.ndarray]:
        """A number from 1 on for each sign, and a row of them for each label of up to LABEL_CELLS signs, filled up with 0."""
        short = self.keys[: int(np.searchsorted(self.lengths, LABEL_CELLS, "right"))]
        numbers = {c: i for i, c in enumerate(sorted(set().union(*short)), 1)}
        rows = np.zeros((len(short), int(self.lengths[len(short) - 1]) if short else 0), np.uint32)
        for i, key in enumerate(short):
            rows[i, : len(key)] = [numbers[c] for c in key]
        return numbers, rows

    def _in_common(self, gram: str, at: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of a group of words and each label ``at`` a place; likeness matches no more."""
        numbers, rows = self._signs
        masks = np.zeros(len(numbers) + 1, np.uint64)
        for i, c in enumerate(gram):
            if c in numbers:
                masks[numbers[c]] |= np.uint64(1 << i)
        left = np.full(len(at), np.uint64((1 << 64) - 1))
        for j in range(int(self.lengths[at[-1]])):
            here = left & masks[rows[at, j]]
            left = (left + here) | (left - here)
        return len(gram) - np.bitwise_count(left & np.uint64((1 << len(gram)) - 1)).astype(np.int64)

    def exact(self, text: str) -> str | None:
        """The longest label whose key stands in the text between blanks; of equal ones the first by name."""
        padded = f" {_plain(text)} "
        found = {self.names[i] for _, i in self.automaton.iter(padded)} if len(self.automaton) else set()
        found.update(self.names[i] for i in self.long if f" {self.keys[i]} " in padded)
        return min(found, key=lambda a: (-len(a), a)) if found else None

    def _nearest(self, gram: str, cutoff: float) -> tuple[float, str] | None:
        """(-likeness, label) of the label nearest to a group of words, if it is near enough.

        Likeness is 2 * matched / (both lengths). What cannot reach ``cutoff`` by lengths alone, by letters that only one
        of the two has, or by the longest common subsequence is not compared.
        """
        n = len(gram)
        low = int(np.searchsorted(self.lengths, n * cutoff / (2 - cutoff) - 1e-9))
        high = int(np.searchsorted(self.lengths, n * (2 - cutoff) / cutoff + 1e-9, "right"))
        unmatched = np.bitwise_count(self.letters[low:high] ^ np.uint64(_letters(gram)))
        best = None
        matcher = difflib.SequenceMatcher(None, gram)
        at = low + np.flatnonzero(unmatched <= (1 - cutoff) * (n + self.lengths[low:high]) + 1e-9)
        if 0 < n <= GRAM_BITS and len(at) and self.lengths[at[-1]] <= LABEL_CELLS:
            at = at[2 * self._in_common(gram, at) >= cutoff * (n + self.lengths[at]) - 1e-9]
        for i in at.tolist():
            matcher.set_seq2(self.keys[i])
            if matcher.quick_ratio() >= cutoff and (like := matcher.ratio()) >= cutoff:
                own = (-like, self.names[i])
                best = own if best is None else min(best, own)
        return best

    def like(self, text: str, cutoff: float) -> tuple[float, str] | None:
        """The label nearest to any two or three words in a row."""
        return min((x for g in _grams(folded(text), (2, 3)) if (x := self.nearest(g, cutoff))), default=None)


def _letters(text: str) -> int:
    """A bit for each distinct letter; letters that share a bit only make two texts look nearer."""
    return sum(1 << b for b in {ord(c) % 64 for c in text})


@lru_cache(maxsize=256)
def _finder(shared) -> LabelFinder:
    return LabelFinder(*shared.value)


def _blocks(known: DataFrame, most: int) -> list:
    """Broadcast blocks of at most about ``most`` labels each; one, if the labels are that few."""
    spark = known.sparkSession
    rows = known.select("key", "activity").limit(most + 1).toArrow()
    if rows.num_rows > most:
        n = -(-known.count() // (most * 3 // 4 or 1))
        tables = [known.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).select("key", "activity").toArrow() for i in range(n)]
    else:
        tables = [rows]
    return [spark.sparkContext.broadcast((t.column(0).to_pylist(), t.column(1).to_pylist())) for t in tables]


def mention(text: Column, known: DataFrame, cutoff: float = LEAST_LIKENESS, most: int = MOST_ROWS) -> Column:
    """``how`` (exact, like, or null), ``activity``, ``likeness`` of the one activity that a text mentions.

    Exact: the longest label (ties: the first by name) whose key stands in the text, punctuation aside. Only where no label
    does, the label most like any two or three words in a row is taken, if it reaches ``cutoff`` (Ratcliff-Obershelp; ties:
    the first by name). Null and empty texts mention nothing.

    The texts are not shuffled. ``known`` (of ``labels``) is broadcast in blocks of at most ``most`` labels; each block
    is a column of its own, and the best of them is taken. Likeness is looked for only where no block names the text.
    ``mentioned`` is for many labels.
    """
    blocks = _blocks(known, most)
    named = F.array_min(F.array(*[_exact(text, b) for b in blocks]))
    near = F.array_min(F.array(*[_like(F.when(named.isNull(), text), b, cutoff) for b in blocks]))
    best = F.coalesce(named, near)
    return _found(named.isNotNull(), best)


#: Compared field by field: the smallest order first, then the name.
_PLACED = "struct<order:double,activity:string>"
_PLACED_ARROW = pa.struct([("order", pa.float64()), ("activity", pa.string())])


def _found(exact: Column, best: Column) -> Column:
    how = F.when(exact, "exact").when(best.isNotNull(), "like")
    return F.struct(how.alias("how"), best["activity"].alias("activity"), F.when(exact, F.lit(1.0)).otherwise(-best["order"]).alias("likeness")).cast(_FOUND)


def _exact(text: Column, shared) -> Column:
    @F.arrow_udf(_PLACED)
    def find(texts: pa.Array) -> pa.Array:
        finder = _finder(shared)
        found = [finder.exact(value) if value else None for value in texts.to_pylist()]
        return pa.array([None if x is None else {"order": -float(len(x)), "activity": x} for x in found], _PLACED_ARROW)

    return find(text)


def _like(text: Column, shared, cutoff: float) -> Column:
    @F.arrow_udf(_PLACED)
    def find(texts: pa.Array) -> pa.Array:
        found = [_finder(shared).like(value, cutoff) if value else None for value in texts.to_pylist()]
        return pa.array([None if x is None else {"order": x[0], "activity": x[1]} for x in found], _PLACED_ARROW)

    return find(text)


def _words_in_a_row(text: Column, counts: tuple[int, ...], plain: bool) -> Column:
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else sorted(_grams(_plain(x) if plain else folded(x), counts)) for x in texts.to_pylist()], pa.list_(pa.string()))

    return cut(text)


def _named(texts: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``id``, ``best``: the longest label named in a text, of those that name one. ``texts``: id, text."""
    sized = known.withColumn("n", F.size(F.split("key", " ")))
    counts = tuple(sorted(r.n for r in sized.where(F.col("n") <= MOST_WORDS).select("n").distinct().collect()))
    placed = F.struct((-F.length("activity")).cast("double").alias("order"), F.col("activity"))
    grams = texts.select("id", F.explode(_words_in_a_row(F.col("text"), counts, True)).alias("key"))
    hits = grams.join(sized.where(F.col("n") <= MOST_WORDS).select("key", placed.alias("best")), "key").select("id", "best")
    long = sized.where(F.col("n") > MOST_WORDS).select("key", "activity")
    if not long.isEmpty():
        found = F.array_min(F.array(*[_exact(F.col("text"), b) for b in _blocks(long, most)]))
        hits = hits.unionByName(texts.select("id", found.alias("best")).where("best IS NOT NULL"))
    return hits.groupBy("id").agg(F.min("best").alias("best"))


def _nearest(grams: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """``gram``, ``best``: the label most like a group of words, of those that one is near enough to.

    Labels and groups of words are dealt into cells of bounded size, in which each is compared with each.
    """
    across, down = -(-known.count() // CELL_LABELS) or 1, -(-grams.count() // CELL_GRAMS) or 1
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = grams.select("gram", deal("gram", down).alias("row"), all_of(across).alias("column"))
    right = known.select("key", "activity", deal("key", across).alias("column"), all_of(down).alias("row"))

    def compare(texts: pa.Table, block: pa.Table) -> pa.Table:
        finder = LabelFinder(block["key"].to_pylist(), block["activity"].to_pylist())
        near = [(g, x) for g in texts["gram"].to_pylist() if (x := finder._nearest(g, cutoff))]
        return pa.table({"gram": pa.array([g for g, _ in near], pa.string()), "order": pa.array([x[0] for _, x in near], pa.float64()), "activity": pa.array([x[1] for _, x in near], pa.string())})

    cells = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(compare, "gram string, order double, activity string")
    return cells.groupBy("gram").agg(F.min(F.struct("order", "activity")).alias("best"))


def mentioned(texts: DataFrame, ids: list[str], known: DataFrame, text_col: str = "text", cutoff: float = LEAST_LIKENESS, most: int = MOST_ROWS, exact_only: bool = False) -> DataFrame:
    """``ids``, ``how``, ``activity``, ``likeness``: what ``mention`` finds, a row for each text, for any number of labels.

    Up to ``most`` labels are broadcast. Of more, those that a text names are found by joining its words in a row with the
    labels, a text that occurs often once; only groups of words of texts that name none are compared with all labels, each
    distinct one once, which stays a product of the two numbers. ``exact_only``: nothing is compared.
    """
    if known.limit(most + 1).count() <= most and not exact_only:
        return texts.select(*ids, mention(F.col(text_col), known, cutoff, most).alias("m")).select(*ids, "m.*")
    own = F.sha2(text_col, 256)
    distinct = texts.where(F.col(text_col) != "").groupBy(own.alias("id")).agg(F.first(text_col).alias("text"))
    named = _named(distinct, known, most).withColumn("exact", F.lit(True))
    if not exact_only:
        rest = distinct.join(named, "id", "left_anti").select("id", F.explode(_words_in_a_row(F.col("text"), (2, 3), False)).alias("gram"))
        near = rest.join(_nearest(rest.select("gram").distinct(), known, cutoff), "gram").groupBy("id").agg(F.min("best").alias("best"))
        named = named.unionByName(near.withColumn("exact", F.lit(False)))
    found = named.select(F.col("id").alias("__id"), F.col("exact").alias("__exact"), F.col("best").alias("__best"))
    best = _found(F.coalesce("__exact", F.lit(False)), F.col("__best"))
    return texts.withColumn("__own", own).join(found, F.col("__own") == F.col("__id"), "left").select(*ids, best.alias("__m")).select(*ids, "__m.*")


def telling_words(key: Column) -> Column:
    """Distinct words of LEAST_LETTERS letters and more that are no stop words."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(*STOP_WORDS)))


def candidates(texts: DataFrame, ids: list[str], known: DataFrame, scores: DataFrame, text_col: str = "text", limit: int = MOST_CANDIDATES) -> DataFrame:
    """``ids``, ``activity``, ``score``, ``place``: per text the activities that share a telling word with it, by bottleneck score.

    ``ids`` tell the texts apart. ``scores``: activity, score; an activity without a score counts as 0, and ties are
    ordered by name. A text that shares no word has no row.

    An inverted index of the labels' words meets the distinct words of the texts in one join, which adaptive execution
    broadcasts while the index is small and splits where a word is hot. An activity among the first ``limit`` of a text is
    among the first ``limit`` of the word that they share, so the index holds no more of a word, and a text meets no more.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[^\p{L}\p{N}_\s-]", " ")
    first = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "activity"))
    rated = scores.groupBy("activity").agg(F.max("score").alias("score"))
    index = known.select("activity", F.explode(telling_words(F.col("key"))).alias("word")).join(rated, "activity", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    index = index.groupBy("word", "activity").agg(F.max("score").alias("score")).withColumn("place", first("word")).where(F.col("place") <= limit).drop("place")
    words = texts.select(*ids, F.explode(telling_words(activity_key(plain))).alias("word"))
    shared = words.join(index, "word").groupBy(*ids, "activity").agg(F.max("score").alias("score"))
    return shared.withColumn("place", first(*ids)).where(F.col("place") <= limit)


def activities_mentioned(texts: DataFrame, ids: list[str], known: DataFrame, scores: DataFrame, text_col: str = "text", limit: int = MOST_CANDIDATES, cutoff: float = LEAST_LIKENESS) -> DataFrame:
    """``ids``, ``activity``, ``how``, ``place``: the mentioned activity of a text, else its ``candidates`` (how: ``word``)."""
    named = mentioned(texts, [*ids, text_col], known, text_col, cutoff)
    rest = candidates(named.where("activity IS NULL").select(*ids, text_col), ids, known, scores, text_col, limit)
    own = named.where("activity IS NOT NULL").select(*ids, "activity", "how", F.lit(1).alias("place"))
    return own.unionByName(rest.select(*ids, "activity", F.lit("word").alias("how"), "place"))

"""Phrases that occur more often than their parts suggest, by contiguous pattern growth over projected occurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.llm.blobs import firsts
from tracelane.llm.common import Scratch, arrow_udf, mix, trim
from tracelane.llm.words import byte_flags, slices, words

#: Words of a phrase at most.
LONGEST = 5
#: Bytes that end a piece, and those between words.
_PIECE = byte_flags(b".,;:!?\n\x0b\x0c\r")
_SPACE = _PIECE | byte_flags(b" \t")
#: Words with small numbers, the most frequent ones: 12 bytes each in a broadcast. All others are numbered by their name.
MOST_WORDS = 1 << 22
#: Bits of the filter of frequent pairs (16 MB); when many pairs share bits, more windows are kept than are needed.
FILTER_BITS = 1 << 27
SLICE_BYTES = 8_000_000
#: Windows that a task collects before it counts equal ones, and windows of one row.
BUFFER, ROW_WINDOWS = 1 << 20, 1 << 14
#: A first word with more occurrences than a task should grow is cut by its second and third word.
TASK_WINDOWS = 1 << 20
KEY = [f"w{i + 1}" for i in range(LONGEST)]
_KINDS = ", ".join(f"{c} long" for c in KEY)


def word_name(lang: bytes, word: bytes) -> int:
    """64 bits of a cryptographic hash of a language's word."""
    return int.from_bytes(blake2b(word, digest_size=8, key=blake2b(lang, digest_size=16).digest()).digest(), "little")


def spark_hash(*columns: np.ndarray) -> np.ndarray:
    """``xxhash64`` of rows of longs, as Spark's function of that name computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = h + p5 + np.uint64(8)
        h = turn(h ^ (turn(c.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def counted(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and the sums of their weights; rows whose hashes meet may stay apart, so sums are partial ones."""
    h = np.zeros(len(weights), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + c.view(np.uint64))
    order = np.argsort(h)
    columns = [c[order] for c in columns]
    at = np.flatnonzero(firsts(*columns)) if len(order) else np.zeros(0, np.int64)
    return [c[at] for c in columns], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def merged(parts: list[tuple[list[np.ndarray], np.ndarray]], most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of several ``counted`` tables of ``most`` columns."""
    return counted([np.concatenate([x[0][i] for x in parts]) for i in range(most)], np.concatenate([x[1] for x in parts]))


class Numbers:
    """Numbers of words by name: 1, 2, ... for the words of the list, then none (0), or if the list is not whole, large ones."""

    def __init__(self, listed: np.ndarray, whole: bool):
        order = np.argsort(listed)
        self.names, self.places, self.whole = listed[order], (order + 1).astype(np.int32), whole

    def of(self, names: np.ndarray) -> np.ndarray:
        rest = np.zeros(len(names), np.int64) if self.whole else (names & np.uint64((1 << 62) - 1)).astype(np.int64) | np.int64(1 << 62)
        if not len(self.names):
            return rest
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.places[at], rest)


def spoken(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each slice of a batch of (lang, text): languages, distinct (language, word) codes, their words, each word's pair, and whether the next word is in the same piece."""
    coded = batch.column(0).dictionary_encode()
    langs, lang = [x.encode() for x in coded.dictionary.to_pylist()], coded.indices.to_numpy()
    for a, _, data, offsets in slices(batch.column(1), SLICE_BYTES):
        found = words(data, offsets, _SPACE)
        pair, own = np.unique(lang[a + found.row].astype(np.int64) * max(1, len(found.unique)) + found.code, return_inverse=True)
        if not len(pair):
            continue
        piece = np.cumsum(_PIECE[data])[found.start]
        together = np.append((piece[1:] == piece[:-1]) & (found.row[1:] == found.row[:-1]), False)
        spelled = found.unique.take(pa.array(pair % len(found.unique)))
        yield langs, pair // len(found.unique), spelled, own, together


class Collocations:
    """The steps over one table; tables between them are written to the shared folder."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, least: int):
        self.least, self.scratch, self.spark = least, Scratch(docs.sparkSession, "collocations"), docs.sparkSession
        text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
        self.docs = docs.select(text(lang_col, "und").alias("lang"), text(text_col, "").alias("text"))

    def words(self) -> DataFrame:
        """(lang, word, f, name): how often each word of each language occurs."""

        def count(batches):
            for batch in batches:
                for langs, lang, spelled, own, _ in spoken(batch):
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i].decode() for i in lang]), spelled.cast(pa.large_string()).cast(pa.string()), pa.array(np.bincount(own))], ["lang", "word", "f"])
                trim()

        @arrow_udf("bigint")
        def name(lang: pa.Array, word: pa.Array) -> pa.Array:
            return pa.array(np.array([word_name(x.encode(), y.encode()) for x, y in zip(lang.to_pylist(), word.to_pylist(), strict=True)], np.uint64).view(np.int64))

        found = self.docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
        found = self.scratch.save(found, "words")
        self.totals = self.scratch.save(found.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        return self.scratch.save(found.where(F.col("f") >= self.least).withColumn("name", name("lang", "word")), "frequent")

    def _counted(self, make: Callable, most: int, rows: Callable, schema: str) -> DataFrame:
        """``rows(columns, c)`` of the distinct windows that ``make(numbers, together)`` finds; equal ones are counted in each task first."""
        shared = self.shared

        def run(batches):
            held, size = [], 0
            for batch in batches:
                for langs, lang, spelled, own, together in spoken(batch):
                    names = np.array([word_name(langs[i], w) for i, w in zip(lang.tolist(), spelled.to_pylist(), strict=True)], np.uint64)
                    columns = make(shared.value.of(names)[own], together)
                    if len(columns[0]):
                        held.append(counted(columns, np.ones(len(columns[0]), np.int64)))
                        size += len(held[-1][1])
                    if size >= BUFFER:
                        yield rows(*merged(held, most))
                        held, size = [], 0
                trim()
            if held:
                yield rows(*merged(held, most))

        return self.docs.mapInArrow(run, schema)

    def pairs(self) -> DataFrame:
        """(w1, w2, a) of the frequent pairs, counted exactly."""

        def make(number: np.ndarray, together: np.ndarray) -> list[np.ndarray]:
            at = np.flatnonzero(together[:-1] & (number[:-1] > 0) & (number[1:] > 0))
            return [number[at], number[at + 1]]

        def rows(columns: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(c)], ["w1", "w2", "c"])

        counts = self._counted(make, 2, rows, "w1 long, w2 long, c long").groupBy("w1", "w2").agg(F.sum("c").alias("a"))
        return self.scratch.save(counts.where(F.col("a") >= self.least), "pairs")

    def windows(self, pairs: DataFrame) -> DataFrame:
        """(w1, cut, windows): for each first word the places where two frequent pairs follow each other.

        A window has the second to fifth word, as far as pairs are frequent (then 0), and how often it occurs. A word with
        more than TASK_WINDOWS occurrences has several cuts, dealt by its second and third word, so all windows of three
        words are in one cut. The pairs are known by a filter of FILTER_BITS bits, whatever their number; a pair that is in it by chance only
        makes a window longer than need be.
        """
        bits = FILTER_BITS
        place = F.pmod(F.xxhash64("w1", "w2"), F.lit(bits)) + 1
        parts = pairs.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
        flags = np.zeros(bits // 8, np.uint8)
        for part, own in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist(), strict=True):
            flags[(part - 1) * 4096 : part * 4096] = np.frombuffer(own, np.uint8)[: len(flags) - (part - 1) * 4096]
        hot = pairs.groupBy("w1").agg(F.sum("a").alias("a")).where((F.col("a") > TASK_WINDOWS) & (F.col("w1") <= MOST_WORDS)).toArrow()
        cuts = np.ones(int(max([0, *hot.column(0).to_pylist()])) + 1, np.int64)
        cuts[hot.column(0).to_numpy()] = -(-hot.column(1).to_numpy() // TASK_WINDOWS)
        known = self.spark.sparkContext.broadcast((flags, cuts))

        def make(number: np.ndarray, together: np.ndarray) -> list[np.ndarray]:
            at = np.flatnonzero(together[:-1] & (number[:-1] > 0) & (number[1:] > 0))
            bit = spark_hash(number[at], number[at + 1]) % bits
            linked = np.zeros(len(number) + LONGEST, bool)
            linked[at] = known.value[0][bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            padded = np.concatenate([number, np.zeros(LONGEST, np.int64)])
            at = np.flatnonzero(linked[:-1] & linked[1:])
            columns, more = [padded[at], padded[at + 1], padded[at + 2]], np.ones(len(at), bool)
            for i in range(3, LONGEST):
                more &= linked[at + i - 1]
                columns.append(np.where(more, padded[at + i], 0))
            return columns

        def rows(columns: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
            first, cuts = columns[0], known.value[1]
            parts = np.where(first < len(cuts), cuts[np.minimum(first, len(cuts) - 1)], 1)
            cut = ((mix(columns[1].view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + columns[2].view(np.uint64)) >> np.uint64(1)) % parts.astype(np.uint64)).astype(np.int64)
            order = np.lexsort((cut, first))
            first, cut = first[order], cut[order]
            new = np.flatnonzero(firsts(first, cut))
            place = np.arange(len(first)) - np.repeat(new, np.diff(np.append(new, len(first))))
            at = np.flatnonzero(place % ROW_WINDOWS == 0)
            flat = np.stack([x[order] for x in (*columns[1:], c)], axis=1).ravel()
            ends = (np.append(at, len(first)) * LONGEST).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(first[at]), pa.array(cut[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["w1", "cut", "windows"])

        return self._counted(make, LONGEST, rows, "w1 long, cut long, windows array<long>")

    def grown(self, pairs: DataFrame) -> DataFrame:
        """(w1, ..., w5, a): frequent phrases of three words and more.

        A first word's windows, or a cut of them, meet in one task, which merges equal ones as they come and extends the
        prefix to the right, depth first, over the windows that have it, as long as they are frequent.
        """
        least, windows = self.least, self.windows(pairs)
        total = pairs.agg(F.coalesce(F.sum("a"), F.lit(0))).first()[0]
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WINDOWS))

        def grow(batches):
            held, size = [], 0
            for batch in batches:
                lists = batch.column(2)
                flat = lists.flatten().to_numpy().reshape(-1, LONGEST)
                first = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()) // LONGEST)
                held.append(([first, *(np.ascontiguousarray(flat[:, i]) for i in range(LONGEST - 1))], np.ascontiguousarray(flat[:, -1])))
                size += len(first)
                if size >= BUFFER:
                    held = [merged(held, LONGEST)]
                    size = 0
            if not held:
                return
            word, c = merged(held, LONGEST)
            order = np.lexsort(word[::-1])
            word, total = [w[order] for w in word], np.concatenate([[0], np.cumsum(c[order])])
            out = []

            def extend(prefix: tuple[int, ...], low: int, high: int) -> None:
                depth = len(prefix)
                own = word[depth][low:high]
                edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), high - low]
                for a, b in zip(edges, edges[1:], strict=False):
                    step, n = int(own[a]), int(total[low + b] - total[low + a])
                    if step and n >= least:
                        longer = (*prefix, step)
                        if depth >= 2:
                            out.append((*longer, *[0] * (LONGEST - depth - 1), n))
                        if depth + 1 < LONGEST:
                            extend(longer, low + a, low + b)

            extend((), 0, len(order))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(LONGEST + 1)], [*KEY, "a"])
            trim()

        return windows.repartition(tasks, "w1", "cut").mapInArrow(grow, f"{_KINDS}, a long")

    def phrases(self) -> tuple[DataFrame, DataFrame]:
        """(w1, ..., w5, k, a, phrase number) of all candidates, and (number, lang, word, f) of their words."""
        frequent = self.words()
        listed = frequent.orderBy(F.desc("f"), "name").select("name").limit(MOST_WORDS).toArrow().column(0).to_numpy().view(np.uint64)
        shared = self.shared = self.spark.sparkContext.broadcast(Numbers(listed, frequent.count() <= MOST_WORDS))

        @arrow_udf("bigint")
        def number(name: pa.Array) -> pa.Array:
            return pa.array(shared.value.of(name.to_numpy().view(np.uint64)))

        numbered = self.scratch.save(frequent.withColumn("number", number("name")).drop("name"), "numbered")
        pairs = self.pairs()
        longer = self.grown(pairs)
        none = [F.lit(0).cast("long").alias(c) for c in KEY[2:]]
        every = pairs.select("w1", "w2", *none, "a").unionByName(longer)
        size = sum(((F.col(c) > 0).cast("int") for c in KEY), F.lit(0))
        return self.scratch.save(every.withColumns({"k": size, "id": F.monotonically_increasing_id()}), "phrases"), numbered


def _part(first: int, last: int) -> Column:
    """The words ``first`` to ``last`` (from 0, without ``last``) as a key of their own."""
    own = [F.col(c) for c in KEY[first:last]]
    return F.struct(*[(own[i] if i < len(own) else F.lit(0).cast("long")).alias(c) for i, c in enumerate(KEY)])


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, absorb_percent: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language.

    Texts have A-Z lower-cased and are split at ``.,;:!?`` and bytes 10-13 into pieces, those at bytes 32 and 9 into words.
    Candidates are phrases of two to five words that occur ``least`` times or more within pieces, overlaps counted.
    ``score``: floor(1000 * a * n / (l * r)), a, l and r being the counts of the phrase, its left and its right part, n of
    the language's words, for the cut with the lowest score (of equal ones the leftmost). A candidate goes if a longer one
    that holds it has ``absorb_percent`` of its count. Ranked by score, count, then the phrase's bytes.

    Null texts count as empty, a null language as ``und``; rows are documents, equal ones too. Only two columns are read, so
    others cannot clash. An empty table gives an empty table.

    Plan: words, then pairs of frequent words are counted exactly; only places where two frequent pairs meet become
    windows, counted in each task and projected to their first word, a hot one in several cuts; a task per word grows its
    phrases (``Collocations.grown``). Nothing but the names of the most frequent words, a filter of fixed size and the cuts
    is broadcast; a word beyond them has a number made of its hash.
    """
    run = Collocations(docs, lang_col, text_col, least)
    phrases, numbered = run.phrases()
    zero = [F.lit(0).cast("long").alias(c) for c in KEY[1:]]
    counts = phrases.select(F.struct(*KEY).alias("part"), "a").unionByName(numbered.select(F.struct(F.col("number").alias("w1"), *zero).alias("part"), F.col("f").alias("a")))
    parts = [(k, i, j) for k in range(3, LONGEST + 1) for i in range(k) for j in range(i + 2, k + 1) if j - i < k]
    inner = phrases.where("k > 2").select("a", F.explode(F.filter(F.array(*[F.when(F.col("k") == k, _part(i, j)) for k, i, j in parts]), lambda x: x.isNotNull())).alias("part"))
    held = inner.groupBy("part").agg(F.max("a").alias("longer"))
    own = phrases.withColumn("part", F.struct(*KEY)).join(held, "part", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("a"))).drop("part", "longer")
    own = run.scratch.save(own, "kept")

    spelled = own.select("id", F.posexplode(F.filter(F.array(*KEY), lambda x: x > 0)).alias("pos", "number")).join(numbered.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("phrase"), F.min("lang").alias("lang"))
    cuts = own.select("id", "a", F.explode(F.filter(F.array(*[F.when(F.col("k") > i, F.struct(F.lit(i).alias("cut"), _part(0, i).alias("left"), F.when(F.col("k") > i, _right(i)).alias("right"))) for i in range(1, LONGEST)]), lambda x: x.isNotNull())).alias("c"))
    cuts = cuts.select("id", "a", "c.*").join(counts.select(F.col("part").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("part").alias("right"), F.col("a").alias("r")), "right")
    rated = cuts.join(spelled, "id").join(run.totals, "lang")
    rated = rated.withColumn("score", F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = rated.groupBy("id").agg(F.min_by(F.struct("lang", "phrase", "a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("b")).select("b.*")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _right(first: int) -> Column:
    """What is left of a phrase after its first words: later words are 0 where the phrase has ended."""
    return _part(first, LONGEST)

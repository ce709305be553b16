"""Language-model scores from a probabilistic suffix tree over words, beside its unigram base."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.blobs import LEAST_RANGES, firsts, pack, part_of, reduce_parts, schema, text_ranges, unpack
from tracelane.llm.common import RangeHash, Scratch, byte_view, chunks, lower_ascii, map_batches, mix, trim, word_spans

#: Longest context, in tokens.
DEPTH = 3
#: Runs that occur at least so often in the training rows are in the tree, however large the corpus is.
LEAST_COUNT = 4
#: A context is a state if its next-token distribution is at least this far (nats) from that of its suffix.
DIVERGENCE = 0.05
#: Weight of the shorter context in the smoothed distribution of a longer one, besides what its rare followers weigh.
PRIOR = 1.0
#: Words and runs whose values are broadcast, the most frequent ones. The values of all others are joined.
TOP_WORDS, TOP_RUNS = 1 << 20, 1 << 21
#: Bits of a filter of runs (8 MB), as a power of two; when many runs share bits, more places are looked up than are needed.
FILTER_LOG2 = 26
#: Bytes of text whose runs are summed at once, and that are cut into tokens or rated at once, whose arrays fit a core's cache.
CHUNK_BYTES, SLICE_BYTES = 4_000_000, 1_000_000
#: Bytes of text per hash range in which runs are counted, and such ranges to one in which places are joined; the number of ranges grows with the input.
RANGE_BYTES, JOINED_RANGES = 10_000_000, 3
#: Bytes of a word that are hashed eight at a time; a longer word is hashed by RangeHash.
SHORT_WORD = 64
END_TOKEN = np.uint64(0x8A5CD789635D2DFF)
_STEP = np.uint64(0x9FB21C651E98DF25)
_SIZE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, none of which is empty. The work is by word, not by byte, where words are short."""
    size = ends - starts
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def bytes_from(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        over = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        return (eight[at] << over) >> over

    out = mix(bytes_from(starts, size) + size.astype(np.uint64) * _SIZE)
    more = np.flatnonzero(size > 8)
    for done in range(8, SHORT_WORD, 8):
        more = more[size[more] > done]
        out[more] = mix(out[more] * _STEP + bytes_from(starts[more] + done, size[more] - done))
    more = more[size[more] > SHORT_WORD]
    if len(more):
        last = np.cumsum(size[more])
        out[more] = RangeHash(np.concatenate([data[a:b] for a, b in zip(starts[more], ends[more], strict=True)])).ranges(last - size[more], last)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row, place in the row) of all tokens: each row's lower-cased words, then END_TOKEN."""
    got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in chunks(offsets, SLICE_BYTES):
        part = lower_ascii(data[offsets[a] : offsets[b]])
        starts, ends, row = word_spans(part, offsets[a : b + 1] - offsets[a])
        sizes = np.bincount(row, minlength=b - a) + 1
        last = np.cumsum(sizes)
        out = np.full(last[-1], END_TOKEN)
        out[np.arange(len(starts)) + row] = word_hashes(part, starts, ends)
        got.append((out, np.repeat(np.arange(a, b), sizes), np.arange(len(out)) - np.repeat(last - sizes, sizes)))
    token, row, place = zip(*got, strict=True)
    return np.concatenate(token), np.concatenate(row), np.concatenate(place)


def joined(prefix: np.ndarray, suffix: np.ndarray, k: int) -> np.ndarray:
    """Hash of a run of k + 1 tokens from those of its first k and its last k."""
    return mix(prefix * _STEP + suffix + np.uint64(k))


def runs(token: np.ndarray, place: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 .. ``longest`` (hash of the k tokens that end at each place, whether there are so many)."""
    out = [(token, np.ones(len(token), bool))]
    for k in range(1, longest):
        longer = np.zeros(len(token), np.uint64)
        longer[k:] = joined(out[-1][0][k - 1 : -1], out[-1][0][k:], k)
        out.append((longer, place >= k))
    return out


class Filter:
    """Two bits per hash, by its first and its last ones, for whatever number of hashes: what is not in it did not go in."""

    def __init__(self):
        self.shift = 64 - FILTER_LOG2
        self.bits = np.zeros(1 << (FILTER_LOG2 - 6), np.int64)

    def add(self, rows: DataFrame) -> None:
        """The column ``run`` of ``rows``. The driver gets at most a row for every 64 bits."""
        slots = rows.selectExpr(f"explode(array(shiftrightunsigned(run, {self.shift}), run & {(1 << FILTER_LOG2) - 1}L)) AS slot").selectExpr("shiftright(slot, 6) AS at", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
        found = slots.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits[found.column("at").to_numpy()] |= found.column("bits").to_numpy()
        del found
        trim()

    def has(self, wanted: np.ndarray) -> np.ndarray:
        out = self._set(wanted >> np.uint64(self.shift))
        at = np.flatnonzero(out)
        out[at] = self._set(wanted[at] & np.uint64((1 << (64 - self.shift)) - 1))
        return out

    def _set(self, slot: np.ndarray) -> np.ndarray:
        return (self.bits.view(np.uint64)[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


class Keys:
    """Sorted 64-bit hashes, looked up by their first bits, whose places are noted when they are first needed."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.starts = keys, None

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted one, -1 where it is not there."""
        out = np.full(len(wanted), -1)
        if not len(self.keys):
            return out
        bits = len(self.keys).bit_length()
        if self.starts is None:
            first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            self.starts = np.append(first, len(self.keys)).astype(np.int32)
        slot = wanted >> np.uint64(64 - bits)
        at, end = self.starts[slot], self.starts[slot + np.uint64(1)]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            found = self.keys[at]
            hit = found == wanted
            out[left[hit]] = at[hit]
            at += 1
            rest = np.flatnonzero((found < wanted) & (at < end))
            left, at, end, wanted = left[rest], at[rest], end[rest], wanted[rest]
        return out


def _parts(column: pa.Array, limit: int):
    data, offsets = byte_view(column)
    for start, stop in chunks(offsets, limit):
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def count_tokens(training: DataFrame, text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """``run``, ``n``: all tokens and their counts. Summed per part first, then per hash range."""
    ranges = ranges or text_ranges(training, text_col, RANGE_BYTES)
    kinds = {"run": np.uint64, "n": np.uint32}

    def count(batch):
        for _, _, data, offsets in _parts(batch.column(0), CHUNK_BYTES):
            values, n = np.unique(tokens(data, offsets)[0], return_counts=True)
            yield pack(part_of(values, ranges), {"run": values, "n": n}, kinds)

    def total(got):
        order, at, n = _summed(got["run"], got["n"])
        return pa.table({"run": _signed(got["run"][order[at]]), "n": pa.array(n, pa.int64())})

    return reduce_parts(map_batches(training.select(F.col(text_col).cast("string")), count, schema(kinds)), total, kinds, "run long, n long")


def _summed(run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by ``run``, places in it at which another run begins, sums of ``n`` of each run)."""
    order = np.argsort(run)
    at = np.flatnonzero(firsts(run[order])) if len(run) else np.zeros(0, np.int64)
    return order, at, np.add.reduceat(n[order].astype(np.int64), at) if len(run) else np.zeros(0, np.int64)


def _grown(own: list[tuple], frequent: Filter, depth: int) -> list[np.ndarray]:
    """For k = 1 .. ``depth`` the places at which a run of k tokens ends whose parts, itself included, are all in ``frequent``."""
    places = [np.flatnonzero(frequent.has(own[0][0]))]
    for k in range(1, depth):
        at = _extended(places[-1], own[k][1])
        places.append(at[frequent.has(own[k][0][at])])
    return places


def _extended(at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` at which both parts of the next longer run are alive, and which have so many tokens."""
    follows = np.concatenate([[False], at[1:] == at[:-1] + 1]) if len(at) else np.zeros(0, bool)
    at = at[follows]
    return at[there[at]]


def count_longer(training: DataFrame, frequent: Filter, k: int, least: int, ranges: int, text_col: str = "text") -> DataFrame:
    """``run``, ``prefix``, ``suffix``, ``n``: all runs of k tokens that occur at least ``least`` times in the whole corpus.

    Such a run has only parts that do, so places with a part that is not in ``frequent`` (runs of fewer tokens) are left
    out; what the filter lets through by chance is counted like the rest. Summed per part first, then per hash range.
    """
    shared = training.sparkSession.sparkContext.broadcast(frequent)
    kinds = {"prefix": np.uint64, "suffix": np.uint64, "n": np.uint32}
    high = np.uint64(ranges.bit_length())

    def count(batch):
        for _, _, data, offsets in _parts(batch.column(0), CHUNK_BYTES):
            token, _, place = tokens(data, offsets)
            own = runs(token, place, k)
            at = _extended(_grown(own, shared.value, k - 1)[-1], own[k - 1][1])
            run = own[k - 1][0][at]
            order, first, n = _summed(run, np.ones(len(run), np.uint32))
            at, part = at[order[first]], part_of(run[order[first]], ranges)
            prefix, suffix = own[k - 2][0][at - 1], own[k - 2][0][at]
            alike = np.argsort((part.astype(np.uint64) << (np.uint64(64) - high)) | (prefix >> high))  # equal prefixes side by side take fewer bytes
            yield pack(part[alike], {"prefix": prefix[alike], "suffix": suffix[alike], "n": n[alike]}, kinds)

    def total(got):
        run = joined(got["prefix"], got["suffix"], k - 1)
        order, at, n = _summed(run, got["n"])
        enough = n >= least
        at = order[at[enough]]
        return pa.table({"run": _signed(run[at]), "prefix": _signed(got["prefix"][at]), "suffix": _signed(got["suffix"][at]), "n": pa.array(n[enough], pa.int64())})

    rows = map_batches(training.select(F.col(text_col).cast("string")), count, schema(kinds))
    return reduce_parts(rows, total, kinds, "run long, prefix long, suffix long, n long")


def grow(scratch: Scratch, counted: DataFrame, training: DataFrame, total: int, distinct: int, ranges: int, text_col: str = "text") -> tuple[DataFrame, Filter]:
    """(``run``, ``n``, ``enter``, ``leave``; a filter of all runs of the tree): what each run adds to a text's log10 probability.

    A context is a state if its next-token distribution diverges from that of the context without its first token. A
    state gives (count + weight * suffix's probability) / (total + PRIOR), where weight is PRIOR plus the count of all
    followers that are too rare for the tree, so it sums to one; any other context gives what its suffix does.

    In logarithms that is a sum over runs. Whatever follows a state, ``leave`` = log10(weight / (total + PRIOR)) is added to what its
    suffix gives; where the run of state and follower is in the tree, also ``enter``, the rest. A run may have a row for each.
    """
    frequent = Filter()
    context = counted.where(F.col("n") >= LEAST_COUNT).select("run", "n", ((F.col("n") + 0.5) / (total + 0.5 * (distinct + 1))).alias("p"))
    frequent.add(context)
    values = []
    for k in range(2, DEPTH + 2):
        level = scratch.save(count_longer(training, frequent, k, LEAST_COUNT, ranges, text_col), f"level{k}")
        frequent.add(level)
        lower = level.join(context.select(F.col("run").alias("suffix"), F.col("p").alias("theirs")), "suffix")
        followed = lower.groupBy("prefix").agg(F.sum("n").alias("listed"), F.sum("theirs").alias("theirs"), F.sum(F.col("n") * F.log(F.col("n") / F.col("theirs"))).alias("s"))
        followed = followed.join(context.select(F.col("run").alias("prefix"), F.col("n").alias("total")), "prefix")
        rest, rest_theirs = F.greatest(1 - F.col("listed") / F.col("total"), F.lit(0.0)), F.greatest(1 - F.col("theirs"), F.lit(1e-12))
        far = (F.col("s") - F.col("listed") * F.log(F.col("total").cast("double"))) / F.col("total") + F.when(rest > 0, rest * F.log(F.greatest(rest, F.lit(1e-12)) / rest_theirs)).otherwise(0.0)
        states = followed.where(far >= DIVERGENCE).select("prefix", "total", (PRIOR + F.greatest(F.col("total") - F.col("listed"), F.lit(0))).alias("weight"))
        states = scratch.save(states.withColumn("leave", F.log10(F.col("weight") / (F.col("total") + PRIOR))), f"states{k}")
        smoothed = F.coalesce((F.col("n") + F.col("weight") * F.col("theirs")) / (F.col("total") + PRIOR), "theirs")
        context = lower.join(states, "prefix", "left").select("run", "n", smoothed.alias("p"), F.coalesce(F.log10(smoothed) - F.log10("theirs") - F.col("leave"), F.lit(0.0)).alias("enter"))
        context = scratch.save(context, f"context{k}")
        scratch.drop(f"level{k}")
        values += [context.where("enter <> 0").select("run", "n", "enter", F.lit(0.0).alias("leave")), states.select(F.col("prefix").alias("run"), F.col("total").alias("n"), F.lit(0.0).alias("enter"), "leave")]
    whole = values[0]
    for other in values[1:]:
        whole = whole.unionByName(other)
    return whole, frequent


class SuffixTree:
    """What words and runs add to a text's log10 probability: the most frequent ones, and a filter of all others."""

    def __init__(self, words: np.ndarray, root: np.ndarray, enter: tuple, leave: tuple, frequent: Filter, joined: Filter | None):
        """words: sorted hashes with log10 probabilities; enter, leave: (hashes of runs, values); joined: runs that are in neither, if any."""
        self.words, self.root, self.frequent, self.joined = words, root, frequent, joined
        self.own = Keys(words)
        run = np.union1d(enter[0], leave[0])
        self.runs = Keys(run)
        self.enter, self.leave = (np.bincount(np.searchsorted(run, keys), values, len(run)) for keys, values in (enter, leave))

    def look_up(self, token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability of each token as far as it is known here, the index of its word or -1, keys whose values are to be joined, their places).

        A key that only seems to be in ``joined`` adds nothing.
        """
        at = self.own.find(token)
        out = np.where(at >= 0, self.root[np.maximum(at, 0)], 0) if len(self.root) else np.zeros(len(token))
        own = runs(token, place, DEPTH + 1)
        keys, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k, here in enumerate(_grown(own, self.frequent, DEPTH + 1)):
            run = own[k][0][here]
            found = self.runs.find(run)
            if self.joined is not None:
                rest = (found < 0) & self.joined.has(run)
                if not k:  # words that are not here are keys themselves
                    rest &= at[here] >= 0
                keys.append(run[rest])
                where.append(here[rest])
            here, found = here[found >= 0], found[found >= 0]
            out[here] += self.enter[found]
            then = np.minimum(here + 1, len(out) - 1)
            inside = place[then] > place[here]  # nothing follows the end of a row
            out[then[inside]] += self.leave[found[inside]]
        return out, at, np.concatenate(keys), np.concatenate(where)

    def log10(self, token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each token as far as it is known here, whether its word is)."""
        out, at, _, _ = self.look_up(token, place)
        return out, at >= 0


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and values of ``rows``, its two columns; the table they came in is freed."""
    table = rows.toArrow()
    hashes = table.column(0).to_numpy().view(np.uint64)
    values = table.column(1).to_numpy()
    del table
    trim()
    return hashes, values


def _classes(times: Column, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(each of ``times``, from the largest on; number of ``rows`` that occur at least so often)."""
    sizes = rows.groupBy(times.alias("n")).count().toArrow()
    held, size = sizes.column("n").to_numpy(), sizes.column("count").to_numpy()
    down = np.argsort(-held)
    return held[down], np.cumsum(size[down])


def broadcast_part(counted: DataFrame, values: DataFrame, frequent: Filter, total: int, distinct: int) -> tuple[SuffixTree, DataFrame | None, DataFrame | None]:
    """(suffix tree with about the TOP_WORDS most frequent words and at most 2 * TOP_RUNS values, counts of all other words, values of all other runs).

    Both bounds are of what is broadcast, not of the model. None: there are no others.
    """
    times = F.least("n", F.lit(1 << 16))
    top, others = counted, None
    if distinct > TOP_WORDS:
        held, upto = _classes(times, counted)
        last = int(np.argmax(upto > TOP_WORDS))
        before = int(upto[last - 1]) if last else 0
        share = (TOP_WORDS - before) / (int(upto[last]) - before)  # of the words that occur as often as the last ones, by their hashes
        chosen = (times > int(held[last])) | ((times == int(held[last])) & (F.col("run") < int((share - 0.5) * 2**64)))
        top, others = counted.where(chosen), counted.where(~chosen)
    word, n = _collected(top.select("run", "n"))
    order = np.argsort(word)
    root = np.log10(n[order] + 0.5) - math.log10(total + 0.5 * (distinct + 1)) if total else np.zeros(0)
    held, upto = _classes(times, values)
    over = held[upto > 2 * TOP_RUNS]
    rare = values.where(times <= int(over[0])) if len(over) else None
    some = values.where(times > int(over[0])) if len(over) else values
    known = None if rare is None else Filter()
    if known:
        known.add(rare)
    enter, leave = (_collected(some.where(F.col(c) != 0).select("run", c)) for c in ("enter", "leave"))
    tree = SuffixTree(word[order], root, enter, leave, frequent, known)
    del enter, leave
    trim()
    return tree, others, rare


def _size(counted: DataFrame) -> tuple[int, int]:
    """(tokens, distinct tokens)."""
    size = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    return size.n, size.v


def learn(counted: DataFrame, training: DataFrame, text_col: str = "text") -> tuple[SuffixTree, int, int]:
    """(suffix tree, training tokens, distinct tokens) from ``count_tokens``; the tree is whole for a small corpus."""
    total, distinct = _size(counted)
    ranges = text_ranges(training, text_col, RANGE_BYTES)
    values, frequent = grow(Scratch(training.sparkSession, "suffix_tree_lm"), counted, training, total, distinct, ranges, text_col)
    return broadcast_part(counted, values, frequent, total, distinct)[0], total, distinct


def join_places(rated: DataFrame, values: DataFrame, ranges: int) -> DataFrame:
    """``row`` and the sums of ``base``, ``model`` and ``known`` in ``values`` (by ``run``) over its ``keys``, hashes in binary.

    Places and values meet by hash range, sums come back by that of their row; both travel packed.
    """
    places, sums = {"run": np.uint64, "row": np.int64}, {"row": np.int64, "base": np.float64, "model": np.float64, "known": np.int64}
    names = [c for c in sums if c != "row"]

    def deal(batch):
        data, offsets = byte_view(batch.column(1))
        keys = np.frombuffer(data, np.uint64)
        yield pack(part_of(keys, ranges), {"run": keys, "row": np.repeat(batch.column(0).to_numpy(), np.diff(offsets) // 8)}, places)

    def added(row, columns):
        order, at, _ = _summed(row, np.ones(len(row), np.int8))
        return {"row": row[order[at]]} | {c: np.add.reduceat(x[order], at) if len(at) else x for c, x in columns.items()}

    def meet(left, right):
        got = unpack(left, places)
        run, own = np.unique(right.column("run").to_numpy().view(np.uint64), return_inverse=True)
        at = Keys(run).find(got["run"])
        there = at >= 0
        out = added(got["row"][there], {c: np.bincount(own, right.column(c).to_numpy(), len(run))[at[there]] for c in names})
        return pa.Table.from_batches([pack(part_of(mix(out["row"].view(np.uint64)), ranges), out, sums)])

    def total(got):
        out = added(got["row"], {c: got[c] for c in names})
        return pa.table({"row": out["row"]} | {f"more_{c}": out[c] for c in names})

    part = F.expr(f"CAST(shiftrightunsigned(shiftrightunsigned(run, 32) * {ranges}L, 32) AS INT)")
    dealt = map_batches(rated.select("row", "keys"), deal, schema(places)).groupBy("part")
    met = dealt.cogroup(values.select(part.alias("part"), "run", *names).groupBy("part")).applyInArrow(meet, schema(sums))
    return reduce_parts(met, total, sums, "row long, more_base double, more_model double, more_known long")


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its identifier, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end. The base scores each token by its count in
    ``training``; the suffix tree scores it in the state of the longest context before it, down to the base. Equal
    tokens and runs are recognised by 64-bit hashes.

    Null or empty text is the end token alone. Repeated rows are scored alike, null identifiers pass through. Without
    training rows a token costs log10(0.5 / 0.5) = 0. An empty table gives an empty table. Only the identifier and the
    scores are returned, so other columns cannot clash.

    Words and runs never meet in one place: the most frequent ones are broadcast (bounded), which leaves no hot key, and
    the values of all others, however many and rare, are joined by hash with the places that have them. A value is a
    sum's term, so a key that only seemed to be a run of the tree finds nothing and adds nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix_tree_lm")
    ranges = text_ranges(docs, text_col, RANGE_BYTES)
    counted = scratch.save(count_tokens(training, text_col, ranges), "counted")
    total, distinct = _size(counted)
    values, frequent = grow(scratch, counted, training, total, distinct, ranges, text_col)
    tree, others, rare = broadcast_part(counted, values, frequent, total, distinct)
    whole = others is None
    floor = math.log10(total + 0.5 * (distinct + 1))
    unseen = math.log10(0.5) - floor
    shared = spark.sparkContext.broadcast(tree)

    def rate(batch):
        tree = shared.value
        ids = batch.column(0)
        for start, stop, data, offsets in _parts(batch.column(1), SLICE_BYTES):
            rows = stop - start
            token, row, place = tokens(data, offsets)
            model, at, keys, where = tree.look_up(token, place)
            known = at >= 0
            base = np.full(len(token), unseen)
            base[known] = tree.root[at[known]]
            model[~known] += unseen
            if not whole:
                keys, where = np.concatenate([keys, token[~known]]), np.concatenate([where, np.flatnonzero(~known)])
            order = np.argsort(row[where], kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[where], minlength=rows))]) * 8
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(keys[order])])
            yield pa.RecordBatch.from_arrays(
                [ids[start:stop], pa.array(np.bincount(row, minlength=rows), pa.int64()), pa.array(np.bincount(row[known], minlength=rows), pa.int64()), pa.array(np.bincount(row, base, rows)), pa.array(np.bincount(row, model, rows)),
                 packed.cast(pa.binary())],
                ["id", "n_tokens", "n_known", "base", "model", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rated = map_batches(docs.select(id_col, F.col(text_col).cast("string")), rate, f"id {kind}, n_tokens long, n_known long, base double, model double, keys binary")
    rated = scratch.save(rated.withColumn("row", F.monotonically_increasing_id()), "rated")
    ratings = rated.select("id", "n_tokens", "n_known", "base", "model", "row")
    more = []
    if rare is not None:
        more.append(rare.select("run", (F.col("enter") + F.col("leave")).alias("model"), F.lit(0.0).alias("base"), F.lit(0).alias("known")))
    if others is not None:
        word = F.log10(F.col("n") + 0.5) - F.lit(floor + unseen)
        more.append(others.select("run", word.alias("model"), word.alias("base"), F.lit(1).alias("known")))
    if more:
        sums = join_places(rated, more[0].unionByName(more[1]) if more[1:] else more[0], max(LEAST_RANGES, -(-ranges // JOINED_RANGES)))
        ratings = ratings.join(sums, "row", "left")
    else:
        ratings = ratings.withColumns({f"more_{c}": F.lit(0) for c in ("base", "model", "known")})
    plus = lambda c, d: F.col(c) + F.coalesce(d, F.lit(0))
    return ratings.select(
        F.col("id").alias(id_col), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "more_base").cast("double").alias("base_score"), plus("model", "more_model").cast("double").alias("score"),
    )

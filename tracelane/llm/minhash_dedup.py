"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import Scratch, arrow_udf, fresh, id_key, map_batches, mix
from tracelane.llm.components import reach
from tracelane.llm.words import names, slices, words

WORDS = 2
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A band is ROWS bins; two sets of similarity s share one of BANDS bands with probability 1 - (1 - s ** ROWS) ** BANDS:
#: 0.99999 at 0.8, 0.22 at 0.5, 0.004 at 0.3.
ROWS, BANDS = 8, 64
BINS = ROWS * BANDS
_BIN_BITS = np.uint64(64 - BINS.bit_length() + 1)
#: Sets whose documents are broadcast (40 bytes each) to fetch their texts' shingles; more are fetched by a shuffle join.
MOST_CARRIERS = 1 << 20
#: Members of a bucket beside its largest group that one task takes, pairs that it compares, and shingles of either side.
BLOCK_SETS, BLOCK_PAIRS, BLOCK_SHINGLES = 512, 1 << 18, 1 << 20

#: For each bin the place of every bin in a random order of its own; its own place comes first.
RANK = np.random.default_rng(20240229).permuted(np.tile(np.arange(1, BINS + 1, dtype=np.int16), (BINS, 1)), axis=1)
np.fill_diagonal(RANK, 0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct names of its runs of ``size`` words; a shorter text has its whole sequence as one."""
    _, row, code, unique = words(data, offsets)
    word = names(unique)[code] if len(code) else np.zeros(0, np.uint64)
    ends = np.searchsorted(row, np.arange(len(offsets) - 1), "right")
    start = 0
    for end in ends.tolist():
        own, start = word[start:end], end
        n = len(own)
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        k = min(size, n)
        name = np.full(n - k + 1, k, np.uint64)  # a sequence of one word is not the start of a longer one
        for i in range(k):
            name = mix(name * np.uint64(0x9FB21C651E98DF25) + own[i : n - k + 1 + i])
        yield np.unique(name)


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """The least name in each of BINS ranges of names; an empty range takes that of the first full one in its own random order.

    All of one permutation of the names, so a shingle is hashed once. The random orders are fixed, so two sets fill an empty
    bin alike with the probability of their similarity (optimal densification), however few bins are full.
    """
    place = (shingles >> _BIN_BITS).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    full, least = place[first], shingles[first]
    out = np.empty(BINS, np.uint64)
    out[full] = least
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    if len(empty):
        out[empty] = least[RANK[np.ix_(empty, full)].argmin(axis=1)]
    return out


def band_names(signatures: np.ndarray) -> np.ndarray:
    """[set, band] of bucket names: the bins of each band, and which band it is."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    name = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        name = mix(name * np.uint64(0x9FB21C651E98DF25) + parts[:, :, i])
    return name


def signed(docs: DataFrame) -> DataFrame:
    """(doc, n, digest, buckets) of each row of (doc, text); no digest and no buckets without a word."""

    def sign(batch: pa.RecordBatch):
        for a, b, data, offsets in slices(batch.column(1)):
            size, digest, some, signatures = [], [], [], []
            for i, own in enumerate(shingle_sets(data, offsets)):
                size.append(len(own))
                digest.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    some.append(i)
                    signatures.append(one_permutation(own))
            counts = np.zeros(b - a, np.int32)
            counts[some] = BANDS
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = band_names(np.stack(signatures)).ravel().view(np.int64) if some else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc", "n", "digest", "buckets"])

    return map_batches(docs, sign, "doc long, n long, digest binary, buckets array<long>")


class MinHashDedup:
    """The steps over one table; tables between them are written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int):
        self.percent, self.scratch = percent, Scratch(docs.sparkSession, "minhash_dedup")
        self.docs = docs.select(id_key(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
        self.rows = self.scratch.save(signed(self.docs), "rows")
        same = self.rows.where("n > 0").groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
        #: Each distinct set once; its number is settled by the write.
        self.sets = self.scratch.save(same.withColumn("set", F.monotonically_increasing_id()), "sets")

    def met(self) -> DataFrame:
        """(bucket, set, n, center, m, c): members of buckets of two sets and more; the center is the smallest of them.

        n and m are the sizes of the set and of its center; they travel with the buckets, so no pair fetches them by a join.
        """
        entries = self.sets.select("set", "n", F.explode("buckets").alias("bucket"))
        stars = entries.groupBy("bucket").agg(F.min(F.struct("set", "n")).alias("least"), F.count("*").alias("c")).where("c > 1")
        return self.scratch.save(entries.join(stars.select("bucket", F.col("least.set").alias("center"), F.col("least.n").alias("m"), "c"), "bucket"), "met")

    def bodies(self, wanted: DataFrame, label: str) -> DataFrame:
        """(set, keys): the shingles of the wanted sets, read from the text of one document each."""
        carriers = self.scratch.save(self.sets.join(wanted, "set", "left_semi").select("doc", "set", "digest"), f"carriers{label}")
        if carriers.count() <= MOST_CARRIERS:
            carriers = F.broadcast(carriers)

        def body(batch: pa.RecordBatch):
            for a, b, data, offsets in slices(batch.column(2)):
                digests = batch.column(1).slice(a, b - a).to_pylist()
                found, keys = [], []
                for i, own in enumerate(shingle_sets(data, offsets)):
                    if len(own) and blake2b(own.tobytes(), digest_size=16).digest() == digests[i]:  # rows of one identifier may differ in text
                        found.append(a + i)
                        keys.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found, pa.int64())), pa.array(keys, pa.binary())], ["set", "keys"])

        found = map_batches(self.docs.join(carriers, "doc").select("set", "digest", "text"), body, "set long, keys binary")
        return self.scratch.save(found.dropDuplicates(["set"]), f"bodies{label}")

    def linked(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) that are linked, by their whole sets."""
        percent = self.percent
        pairs = self.scratch.save(pairs, f"pairs{label}")
        bodies = self.bodies(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), label)

        @arrow_udf("boolean")
        def near(left: pa.Array, right: pa.Array) -> pa.Array:
            return pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(left, right, strict=True)], pa.bool_())

        one = pairs.join(bodies.select(F.col("set").alias("b"), F.col("keys").alias("right")), "b")
        two = one.join(bodies.select(F.col("set").alias("a"), F.col("keys").alias("left")), "a")
        links = self.scratch.save(two.where(near("left", "right")).select("a", "b"), f"links{label}")
        self.scratch.drop(f"bodies{label}")
        return links

    def apart(self, met: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between members of one bucket that are still in different groups; neither is the bucket's center.

        Centers were compared with all members before, so buckets whose other members are one group are done, and of
        buckets of the same members one is enough. Members of a bucket's largest group are not compared with each other.
        The others meet them and each other, by whole sets, in tasks of bounded size: one if the bucket is not large, else
        one for each pair of blocks. A task returns only links that join two groups, fewer than it has members.
        """
        percent = self.percent
        large = met.where("c > 2 AND set <> center").select("bucket", "set").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
        kinds = large.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("h"))
        kinds = kinds.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("groups"), F.sum("k").alias("k"), F.sum("h").alias("h")).where("groups > 1")
        one = kinds.groupBy("k", "h").agg(F.min_by(F.struct("bucket", "main"), "bucket").alias("b")).select("b.*")
        open_ = large.join(one, "bucket").join(self.sets.select("set", "n"), "set")
        open_ = self.scratch.save(open_.select("bucket", "set", "label", "n", (F.col("label") == F.col("main")).alias("inner")), "open")
        if open_.isEmpty():
            return open_.select(F.col("set").alias("a"), F.col("set").alias("b"))
        inner, other = F.col("inner"), ~F.col("inner")
        shingles = lambda own: F.coalesce(F.ceil(F.sum(F.when(own, F.col("n"))) / BLOCK_SHINGLES), F.lit(1))
        others = F.greatest(F.lit(1), F.ceil(F.count_if(other) / BLOCK_SETS), shingles(other))
        inners = F.greatest(F.lit(1), F.ceil(F.count_if(inner) * F.least(F.count_if(other), F.lit(BLOCK_SETS)) / BLOCK_PAIRS), shingles(inner))
        sizes = open_.groupBy("bucket").agg(inners.alias("inner_blocks"), others.alias("other_blocks"))
        # Blocks of the others are 0, 1, ..., those of the largest group -1, -2, ...; a task (i, j) has i of the others and
        # j < i. Task (i, -1) also compares block i with itself.
        block = lambda c: F.pmod(F.xxhash64("set"), F.col(c))
        dealt = open_.join(sizes, "bucket").withColumn("own", F.when(F.col("inner"), -1 - block("inner_blocks")).otherwise(block("other_blocks")))
        after = F.greatest(F.col("own") + 1, F.lit(0).cast("long"))
        as_right = F.when(after < F.col("other_blocks"), F.transform(F.sequence(after, F.col("other_blocks") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
        as_left = F.transform(F.sequence(-F.col("inner_blocks"), F.col("own") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
        none = F.array().cast("array<struct<i:bigint,j:bigint>>")
        at = F.concat(F.when(F.col("inner"), none).otherwise(as_left), F.coalesce(as_right, none))
        bodies = self.bodies(open_.select("set").distinct(), "apart")
        placed = dealt.select("bucket", "set", "label", "own", F.explode(at).alias("at")).join(bodies, "set")

        def compare(table: pa.Table) -> pa.Table:
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            own, label, sets_ = (table.column(c).to_numpy() for c in ("own", "label", "set"))
            keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
            left, right = np.flatnonzero(own == i).tolist(), np.flatnonzero(own == j).tolist()
            group = {x: x for x in label.tolist()}

            def root(x: int) -> int:
                while group[x] != x:
                    x = group[x]
                return x

            out = []
            for place, x in enumerate(left):
                for y in [*right, *(left[:place] if j == -1 else ())]:
                    a, b = root(int(label[x])), root(int(label[y]))
                    if a != b and similar(keys[x], keys[y], percent):
                        group[max(a, b)] = min(a, b)
                        out.append((int(sets_[x]), int(sets_[y])))
            return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        return placed.select("bucket", "set", "label", "own", "keys", "at.i", "at.j").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")

    def groups(self) -> DataFrame:
        """(set, label) of linked sets.

        A set is first compared with the center that it shares most bands with: one pair a set, however large its group.
        Then centers and members that are still in different groups are, and last the members of a bucket that no star
        tells of. So each pair that shares a band is compared or known to be in one group.
        """
        met = self.met()
        fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent
        edges = self.scratch.save(met.where("set <> center").where(fits).groupBy("center", "set").agg(F.count("*").alias("bands")), "edges")
        pairs = edges.groupBy("set").agg(F.max_by("center", F.struct("bands", "center")).alias("center"))
        links = self.linked(pairs.select(F.col("center").alias("a"), F.col("set").alias("b")), "-best")
        labels = reach(links, self.scratch, "-best")
        label = lambda c: labels.select(F.col("set").alias(c), F.col("label").alias(f"{c}_label"))
        more = edges.join(pairs, ["center", "set"], "left_anti").join(label("set"), "set", "left").join(label("center"), "center", "left")
        more = more.where(F.coalesce("set_label", "set") != F.coalesce("center_label", "center")).select(F.col("center").alias("a"), F.col("set").alias("b"))
        links = links.unionByName(self.linked(more, "-stars"))
        labels = reach(links, self.scratch, "-stars")
        rest = self.scratch.save(self.apart(met, labels), "rest")
        return labels if rest.isEmpty() else reach(links.unionByName(rest), self.scratch, "-all")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of names are linked."""
    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    inner = int((both[1:] == both[:-1]).sum())
    return 100 * inner >= percent * (len(x) + len(y) - inner)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    A document's set has the distinct runs of two words (A-Z lower-cased, of all bytes but 32 and 9-13); one word is a
    sequence of its own. Two documents link if 100 * intersection >= percent * union, confirmed on whole sets.
    ``component_id``: the smallest identifier that links reach, its own included; ``kept``: whether that is its own.

    Null and empty texts, and those without a word, have size 0, no links, and are kept. A null identifier is the largest
    long. Rows that share an identifier are judged each by its text; of equal rows of the smallest identifier all are
    kept. Only the two columns are read, so others cannot clash. An empty table gives an empty table.

    Every pair that shares a band is compared, or is known to be in one group; a pair of similarity exactly 0.8 shares none
    with probability 8e-6. Shingles are named by 64 bits, sets by 128. Equal sets are one from the start, buckets are
    aggregated and joined by Spark (a hot bucket is summed in each task and its join can be split), and a set sends one
    pair for all its bands, so neither copies nor large groups are paired among themselves.
    """
    dedup = MinHashDedup(docs, id_col, text_col, percent)
    labels = dedup.groups()
    named = dedup.sets.select("digest", "set", F.col("doc").alias("first")).join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(least, "label").select("digest", "least")
    out = dedup.rows.select("doc", "n", "digest").join(named, "digest", "left").withColumn("least", F.coalesce("least", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), (F.col("doc") == F.col("least")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without rows whose identifier links to a smaller one. Columns pass through; see ``near_duplicates`` for odd cases."""
    own = fresh(docs.columns, "__gone")
    gone = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col(id_col).alias(own)).distinct()
    return docs.join(gone, id_key(id_col) == F.col(own), "left_anti")

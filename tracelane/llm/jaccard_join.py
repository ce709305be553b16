"""Exact Jaccard join of documents on word shingles, and the groups that its links form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.llm import blobs
from tracelane.llm.components import reach
from tracelane.llm.common import RangeHash, Scratch, arrow_udf, byte_view, chunks, fresh, id_key, lower_ascii, map_batches, mix, word_spans

WORDS = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
CHUNK_BYTES, CHUNK_ROWS_LOG2 = 1_000_000, 13
#: Bytes of text whose results are sent together.
SLICE_BYTES = 8_000_000
#: Bits of a shingle's name, under the bits of its frequency class.
NAME_BITS, CLASS_BITS = 46, 5
#: Shingles in so many documents of a slice are counted, and the MOST frequent of them are known to all tasks.
FREQUENT_HERE, MOST_FREQUENT = 2, 1 << 20
#: Regions of at most SMALL sets are joined outright; larger ones around a leader, then around LEADERS more a round.
SMALL, LEADERS = 3, 1024
#: Members of a region that are compared with its leaders at a time.
BLOCK = 4096
#: Documents whose identifiers are broadcast to fetch their sets: 2^21 * 8 bytes. More are fetched by a shuffle join.
MOST_CARRIERS = 1 << 21
#: Near sets are linked first as long as this share of the leaders finds a link.
STILL_MERGING = 0.05
#: Buckets of the histogram of a set, whose difference is a lower bound of the symmetric difference of two sets.
BUCKETS_LOG2 = 8
_NAME_MASK = np.uint64((1 << NAME_BITS) - 1)
_KEY_MASK = np.uint64((1 << (NAME_BITS + CLASS_BITS)) - 1)
_KINDS = {"a": np.int64, "b": np.int64, "n": np.int32, "h": np.uint8}
_ENTRIES = {"a": np.uint32, "b": np.int64, "n": np.int32}
_BUCKETS = 1 << BUCKETS_LOG2


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit name) of each run of WORDS lower-cased words; a shorter text has its whole sequence as one."""
    data = lower_ascii(data)
    starts, ends, row = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = RangeHash(data).ranges(starts, ends)
    name = np.zeros(len(word), np.uint64)
    step = np.uint64(0x9FB21C651E98DF25)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    left = np.cumsum(counts)[row] - np.arange(len(row))  # words from here to the end of the text
    for i in range(WORDS):
        following = np.zeros(len(word), np.uint64)
        rest = max(len(word) - i, 0)  # a part may have fewer words than a shingle
        following[:rest] = word[i:]
        name = name * step + np.where(left > i, following, 0).astype(np.uint64)
    first = left == counts[row]
    own = (left >= WORDS) | (first & (left < WORDS))
    return row[own], mix(name[own] + np.minimum(left[own], WORDS).astype(np.uint64))


class Frequent:
    """Names of frequent shingles and their frequency class, at most MOST_FREQUENT."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        order = np.argsort(names)
        self.names, self.classes = names[order], np.minimum(np.frexp(counts[order].astype(float))[1], (1 << CLASS_BITS) - 1).astype(np.uint64)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.names >> np.uint64(NAME_BITS - 22)).astype(np.int64)] = True

    def classed(self, name: np.ndarray) -> np.ndarray:
        """Sort key of names: frequent ones come last, by class."""
        key = name.copy()
        some = np.flatnonzero(self.bitmap[(name >> np.uint64(NAME_BITS - 22)).astype(np.int64)])
        if len(some) and len(self.names):
            at = np.minimum(np.searchsorted(self.names, name[some]), len(self.names) - 1)
            hit = self.names[at] == name[some]
            key[some[hit]] |= self.classes[at[hit]] << np.uint64(NAME_BITS)
        return key


def sets(data: np.ndarray, offsets: np.ndarray, frequent: Frequent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the distinct shingles of each text, in the order of keys."""
    row, name = shingles(data, offsets)
    name = name >> np.uint64(64 - NAME_BITS)
    key = name if frequent is None else frequent.classed(name)
    packed = np.sort((row.astype(np.uint64) << np.uint64(NAME_BITS + CLASS_BITS)) | key)
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    return (packed >> np.uint64(NAME_BITS + CLASS_BITS)).astype(np.int64), packed & _KEY_MASK


def _slices(column: pa.Array) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Slices of a column, each as parts (first row, end, bytes, offsets)."""
    data, offsets = byte_view(column)
    for low, high in chunks(offsets, SLICE_BYTES):
        parts = []
        for a, b in chunks(offsets[low : high + 1], CHUNK_BYTES):
            for c in range(low + a, low + b, 1 << CHUNK_ROWS_LOG2):
                d = min(low + b, c + (1 << CHUNK_ROWS_LOG2))
                parts.append((c, d, data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]))
        yield parts


def set_ids(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(identifier, size) of each row's set; equal sets have equal identifiers."""
    size = np.bincount(row, minlength=rows)
    mixed = mix(key & _NAME_MASK)
    total = np.zeros(rows, np.uint64)
    cross = np.zeros(rows, np.uint64)
    at = np.flatnonzero(blobs.firsts(row)) if len(row) else np.zeros(0, np.int64)
    if len(at):
        total[row[at]] = np.add.reduceat(mixed, at)
        cross[row[at]] = np.bitwise_xor.reduceat(mix(mixed), at)
    return (mix(total * np.uint64(3) + cross) >> np.uint64(1)).astype(np.int64), size


def histograms(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """[row, bucket] counts of each set's shingles, 255 at most."""
    bucket = (mix(key & _NAME_MASK) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    return np.minimum(np.bincount(row * _BUCKETS + bucket, minlength=rows * _BUCKETS), 255).astype(np.uint8).reshape(rows, _BUCKETS)


def frequent_shingles(texts: DataFrame, most: int = MOST_FREQUENT) -> Frequent:
    """Counts over all texts of the shingles that several documents of some batch share."""

    def count(batch: pa.RecordBatch):
        for parts in _slices(batch.column(0)):
            name = np.sort(np.concatenate([sets(data, offsets)[1] for _, _, data, offsets in parts]))
            first = np.flatnonzero(blobs.firsts(name)) if len(name) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(name)))
            some = n >= FREQUENT_HERE
            yield pa.RecordBatch.from_arrays([pa.array(name[first[some]].view(np.int64)), pa.array(n[some], pa.int64())], ["name", "n"])

    counted = map_batches(texts, count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    table = counted.orderBy(F.desc("n"), "name").limit(most).toArrow()
    return Frequent(table.column("name").to_numpy().view(np.uint64), table.column("n").to_numpy())


def _pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within each of the runs [start, start + size)."""
    left = np.repeat(start, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    more = np.repeat(start + size, size) - left - 1
    a = np.repeat(left, more)
    b = a + 1 + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    return a, b


class JaccardJoin:
    """The steps of the join over one table; tables between them are written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int):
        self.percent, self.scratch = percent, Scratch(docs.sparkSession, "jaccard_join")
        self.docs = docs.select(id_key(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
        self.ranges = blobs.text_ranges(docs, text_col)

    def regions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc, set, n), candidate pairs (a, b), and members (region, set, n) of large regions.

        A set's pivots are its rarest shingles: so many that a set which has none of them in common with it, and so
        shares only what is left, is farther away than the threshold. A set goes to the region of each of its pivots, so
        every two linked sets meet in the region of a pivot of both.
        """
        spark, ranges, percent = self.docs.sparkSession, self.ranges, self.percent
        shared = spark.sparkContext.broadcast(frequent_shingles(self.docs.select("text")))

        def cut(batch: pa.RecordBatch):
            ids = batch.column(0).to_numpy()
            seen: set[int] = set()
            for parts in _slices(batch.column(1)):
                docs, whole, entries = [], [], []
                for a, b, data, offsets in parts:
                    row, key = sets(data, offsets, shared.value)
                    own, size = set_ids(row, key, b - a)
                    docs.append(ids[a:b])
                    whole.append((own, size, histograms(row, key, b - a)))
                    new = np.zeros(b - a, bool)
                    for i in np.unique(own, return_index=True)[1].tolist():  # copies within the batch send their pivots once
                        if own[i] not in seen:
                            seen.add(own[i])
                            new[i] = True
                    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    pivots = size - -(-percent * size // 100) + 1
                    some = new[row] & (place < pivots[row])
                    entries.append((mix(key[some] & _NAME_MASK), own[row[some]], size[row[some]]))
                own, size, histogram = (np.concatenate(x) for x in zip(*whole, strict=True))
                yield blobs.pack(np.full(len(own), -1), {"a": np.concatenate(docs), "b": own, "n": size, "h": histogram}, _KINDS)
                name, own, size = (np.concatenate(x) for x in zip(*entries, strict=True))
                sent = blobs.pack(blobs.part_of(name, ranges), {"a": (name & np.uint64(0xFFFFFFFF)).astype(np.uint32), "b": own, "n": size}, _ENTRIES)
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.nulls(sent.num_rows, pa.binary())], ["part", *_KINDS])

        packed = self.scratch.save(map_batches(self.docs, cut, blobs.schema(_KINDS)), "packed")

        def rows(batch: pa.RecordBatch):
            own = blobs.unpack(pa.Table.from_batches([batch]), _KINDS)
            drawn = [x.tobytes() for x in own["h"].reshape(-1, _BUCKETS)]
            yield pa.RecordBatch.from_arrays([pa.array(own["a"]), pa.array(own["b"]), pa.array(own["n"].astype(np.int64)), pa.array(drawn, pa.binary())], ["doc", "set", "n", "histogram"])

        members = self.scratch.save(map_batches(packed.where("part = -1"), rows, "doc long, set long, n long, histogram binary"), "members")

        def meet(own: dict[str, np.ndarray]) -> pa.Table:
            """Candidate pairs of small regions; large regions: the members (b null), their number, and the leader if its size fits."""
            order = np.lexsort((own["b"], own["a"]))
            name, set_, size = own["a"][order], own["b"][order], own["n"][order].astype(np.int64)
            new = blobs.firsts(name, set_)
            name, set_, size = name[new], set_[new], size[new]
            start = np.flatnonzero(blobs.firsts(name)) if len(name) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(name)))
            small = (count > 1) & (count <= SMALL)
            a, b = _pairs_within(start[small], count[small])
            large = count > SMALL
            lead = np.repeat(start[large], count[large])
            member = lead + np.arange(len(lead)) - np.repeat(np.cumsum(count[large]) - count[large], count[large])
            fits = lambda a, b: np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent
            fit = fits(a, b)
            pair = np.unique(np.stack([set_[a[fit]], set_[b[fit]]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            n_pairs, n_members = len(pair), len(member)
            none = lambda n: pa.nulls(n, pa.int64())
            return pa.table({
                "a": pa.concat_arrays([pa.array(pair[:, 0]), pa.array(set_[member])]), "b": pa.concat_arrays([pa.array(pair[:, 1]), none(n_members)]),
                "region": pa.concat_arrays([none(n_pairs), pa.array(name[member].astype(np.int64))]), "n": pa.concat_arrays([none(n_pairs), pa.array(size[member])]),
                "leader": pa.concat_arrays([none(n_pairs), pa.array(set_[lead], mask=(member == lead) | ~fits(member, lead))]),
                "c": pa.concat_arrays([none(n_pairs), pa.array(np.repeat(count[large], count[large]))]),
            })

        met = self.scratch.save(blobs.reduce_parts(packed.where("part >= 0").drop("h"), meet, _ENTRIES, "a long, b long, region long, n long, leader long, c long"), "met")
        self.scratch.drop("packed")
        large = met.where("b IS NULL").select(F.xxhash64("region", "c").alias("region"), F.col("a").alias("set"), "n")
        # A set is first compared with two leaders, those of its largest and its smallest region; what these links do not
        # settle is compared region by region, so a group of many near copies costs two pairs a copy and not one a pivot.
        led, place = met.where("b IS NULL AND leader IS NOT NULL").groupBy(F.col("a").alias("set")), F.struct("c", "region")
        led = led.agg(F.array(F.max_by("leader", place), F.min_by("leader", place)).alias("leaders")).select("set", F.explode("leaders").alias("leader"))
        pairs = met.where("b IS NOT NULL").select("a", "b").unionByName(led.select(F.least("set", "leader").alias("a"), F.greatest("set", "leader").alias("b")))
        # Copies of one near-duplicate group meet in many regions of the same members: one of them is enough.
        same = large.groupBy("region").agg(F.count("*").alias("c"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("h"))
        one = same.groupBy("c", "h").agg(F.min("region").alias("region"))
        return members, pairs.distinct(), large.join(one.select("region"), "region", "left_semi")

    def bodies(self, members: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
        """(set, keys) of the wanted sets, from one document of each; the texts are not shuffled unless very many are wanted."""
        carriers = self.scratch.save(members.select("doc", "set").join(wanted, "set", "left_semi").groupBy("set").agg(F.min("doc").alias("doc")), f"carriers{label}")
        if carriers.count() <= MOST_CARRIERS:
            carriers = F.broadcast(carriers)

        def body(batch: pa.RecordBatch):
            wanted = batch.column(0).to_numpy()
            for parts in _slices(batch.column(1)):
                for a, b, data, offsets in parts:
                    row, key = sets(data, offsets)
                    own, size = set_ids(row, key, b - a)
                    ends = np.cumsum(size)
                    keep = np.flatnonzero(own == wanted[a:b])  # another row of the same identifier may hold another text
                    yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array([key[ends[i] - size[i] : ends[i]].tobytes() for i in keep], pa.binary())], ["set", "keys"])

        return map_batches(self.docs.join(carriers, "doc").select("set", "text"), body, "set long, keys binary").dropDuplicates(["set"])

    def plausible(self, sketch: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs whose histograms leave room for a link."""
        percent = self.percent

        @arrow_udf("boolean")
        def near(left: pa.Array, right: pa.Array, sizes: pa.Array) -> pa.Array:
            """Whether the histograms leave room for a link: the symmetric difference is at most (1 - t) / (1 + t) of both sizes."""
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, _BUCKETS).astype(np.int16) for c in (left, right))
            return pa.array(np.abs(x - y).sum(axis=1) * (100 + percent) <= sizes.to_numpy() * (100 - percent), pa.bool_())

        drawn = pairs.join(sketch.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("histogram").alias("ha")), "a").join(sketch.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("histogram").alias("hb")), "b")
        return drawn.where(near("ha", "hb", F.col("na") + F.col("nb"))).select("a", "b")

    def compared(self, known: DataFrame, leaders: DataFrame, nearest: bool) -> DataFrame:
        """Plausible pairs of leaders with members of other groups of their region; members are taken in blocks.

        A pair that meets in several regions is given by the first of them alone. ``nearest``: of each block only the member
        whose histogram is nearest to the leader's, which is enough to find most groups that belong together.
        """
        percent = self.percent

        @arrow_udf("array<struct<a:bigint,b:bigint>>")
        def near(region: pa.Array, sets: pa.Array, sizes: pa.Array, labels: pa.Array, bodies: pa.Array, regions: pa.Array, sets2: pa.Array, sizes2: pa.Array, labels2: pa.Array, bodies2: pa.Array, regions2: pa.Array) -> pa.Array:
            out = []
            for here, x, n, own, h, r, y, m, other, g, q in zip(region.to_pylist(), sets, sizes, labels, bodies, regions, sets2, sizes2, labels2, bodies2, regions2, strict=True):
                r, q = ([frozenset(z) for z in c.as_py()] for c in (r, q))
                x, n, own, y, m, other = (c.values.to_numpy() for c in (x, n, own, y, m, other))
                h, g = (np.frombuffer(b"".join(c.values.to_pylist()), np.uint8).reshape(-1, _BUCKETS).astype(np.int16) for c in (h, g))
                pairs: set[tuple[int, int]] = set()
                for i in range(len(y)):
                    some = np.flatnonzero((own != other[i]) & (np.minimum(n, m[i]) * 100 >= np.maximum(n, m[i]) * percent))
                    apart = np.abs(h[some] - g[i]).sum(axis=1) / (n[some] + m[i])
                    near_by = apart * (100 + percent) <= 100 - percent
                    some, apart, b = some[near_by], apart[near_by], int(y[i])
                    if nearest:
                        pairs.update((min(int(x[k]), b), max(int(x[k]), b)) for k in some[np.argsort(apart, kind="stable")[:1]].tolist())
                        continue
                    pairs.update((min(a, b), max(a, b)) for a, k in zip(x[some].tolist(), some.tolist(), strict=True) if min(r[k] & q[i]) == here)
                out.append([{"a": a, "b": b} for a, b in sorted(pairs)])
            return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

        columns = ("set", "n", "label", "histogram", "regions")
        lists = lambda rows, keys, mark: rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows")).select(*keys, *[F.col(f"rows.{c}").alias(f"{c}{mark}") for c in columns])
        blocks = lists(known.withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), F.ceil(F.col("c") / BLOCK))), ["region", "block"], "")
        met = blocks.join(lists(leaders, ["region"], "2"), "region")
        return met.select(F.explode(near("region", *columns, *[f"{c}2" for c in columns])).alias("p")).select("p.a", "p.b").distinct()

    def verified(self, members: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
        """(a, b) of the pairs that are linked, by their whole sets."""
        percent = self.percent
        pairs = self.scratch.save(pairs, f"pairs{label}")
        if pairs.isEmpty():
            return pairs
        bodies = self.scratch.save(self.bodies(members, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), label), f"bodies{label}")

        @arrow_udf("boolean")
        def linked(left: pa.Array, right: pa.Array) -> pa.Array:
            out = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                inner = int((both[1:] == both[:-1]).sum())
                out.append(100 * inner >= percent * (len(a) + len(b) - inner))
            return pa.array(out, pa.bool_())

        one = pairs.join(bodies.select(F.col("set").alias("b"), F.col("keys").alias("right")), "b")
        two = one.join(bodies.select(F.col("set").alias("a"), F.col("keys").alias("left")), "a")
        links = self.scratch.save(two.where(linked("left", "right")).select("a", "b"), f"links{label}")
        self.scratch.drop(f"bodies{label}")
        return links

    def labels(self, links: DataFrame, label: str) -> DataFrame:
        """(set, label) of the sets that have links: the smallest set that their links reach."""
        return reach(links, self.scratch, label)

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(doc, set, n) and (set, label).

        Sets of large regions were compared with two leaders. What ended in a region's main group needs no more; the
        others are compared with their nearest sets of other groups until no groups merge any more. Then, of the
        others up to LEADERS a round become leaders and are compared with all members of other groups, until none is
        left. So each pair of a region that its groups do not settle is compared.
        """
        members, pairs, large = self.regions()
        large = self.scratch.save(large, "large-0")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).unionByName(large.select("set")).distinct()
        sketch = self.scratch.save(members.select("set", "n", "histogram").join(wanted, "set", "left_semi").dropDuplicates(["set"]), "sketch")
        links = self.verified(members, self.plausible(sketch, pairs), "0")
        labels = self.labels(links, "0")
        turn = 0
        while not large.isEmpty():
            turn += 1
            known = large.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
            counts = known.groupBy("region", "label").agg(F.count("*").alias("c"))
            main = counts.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("kinds"), F.sum("c").alias("c")).where("kinds > 1")
            open_ = self.scratch.save(known.join(main.select("region", "main", "c"), "region"), f"open-{turn}")
            if open_.isEmpty():
                break
            regions = open_.groupBy("set").agg(F.collect_list("region").alias("regions"))
            drawn = open_.join(regions, "set").join(sketch.select("set", "histogram"), "set")
            known = self.scratch.save(drawn, f"known-{turn}")
            rest = known.where("label <> main").withColumn("place", F.row_number().over(W.partitionBy("region").orderBy("set")))
            leaders = rest.where(F.col("place") <= LEADERS)
            merging = False
            for nearest in (True, False):
                more = self.verified(members, self.compared(known, leaders, nearest), f"{turn}-{nearest}")
                n = more.count()
                if n:
                    links = links.unionByName(more)
                    labels = self.labels(links, f"{turn}-{nearest}")
                merging = nearest and n > STILL_MERGING * leaders.select("set").distinct().count()
                if merging:  # look again with the merged groups before all pairs are compared
                    break
            if merging:
                continue
            large = self.scratch.save(known.join(leaders.select("region", "set"), ["region", "set"], "left_anti").select("region", "set", "n"), f"large-{turn}")
        return members, labels


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` for each row of ``docs``.

    A document's set has the distinct runs of five words (A-Z lower-cased, of all bytes but 32 and 9-13); a shorter text's
    whole sequence is one. Two documents link if 100 * intersection >= percent * union. ``component_id``: the smallest
    identifier that links reach, its own included.

    Null and empty texts, and those without a word, have size 0 and no links. A null identifier is the largest long. Rows
    that share an identifier are judged each by its text. Only the two columns are read, so others cannot clash. An empty
    table gives an empty table. The join is exact but for hashing: shingles are names of 46 bits, sets of 63.
    """
    join = JaccardJoin(docs, id_col, text_col, percent)
    members, labels = join.groups()
    grouped = members.drop("histogram").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = grouped.where("n > 0").groupBy("label").agg(F.min("doc").alias("least"))
    out = grouped.join(least, "label", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that link, directly or through others, to one of a smaller identifier.

    Of rows that share the kept identifier all stay. Rows of different text that share an identifier, null ones too, go
    together if one of them links to a smaller identifier.
    """
    groups = jaccard_groups(docs, id_col, text_col, percent)
    own = fresh(docs.columns, "__gone")
    gone = groups.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(own)).distinct()
    return docs.join(gone, id_key(id_col) == F.col(own), "left_anti")



"""Byte strings of a fixed length that occur earlier in the corpus, removed wherever they occur again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm import blobs
from tracelane.llm.common import RangeHash, Scratch, arrow_udf, byte_view, chunks, fresh, id_key, map_batches, mix, with_fields

#: Bytes of a sampled gram. A string of ``width`` bytes has width - GRAM + 1 of them; its smallest is its sample.
GRAM = 32
CHUNK_BYTES = 2_000_000
#: Bytes of text whose repeats are settled together before anything is sent.
SLICE_BYTES = 8_000_000
#: Low bits of a sort key that hold a position within a part; parts (single huge documents) beyond it are refused.
_PLACE = np.uint64((1 << 28) - 1)
#: Symbols of a second hash of a string that is independent of the first.
_OTHER = mix(np.arange(1, 257, dtype=np.uint64))
_RUNS = {"name": np.uint32, "run": np.uint64, "doc": np.int64, "salt": np.int64, "start": np.int32, "size": np.uint8}
_WINDOWS = {"name": np.uint64, "check": np.uint32, "doc": np.int64, "salt": np.int64, "start": np.int32}
_MARKS = {"doc": np.int64, "salt": np.int64, "start": np.int32, "end": np.int32}
_SPANS = {"starts": pa.int32(), "ends": pa.int32()}
_SPAN_SCHEMA = "doc long, salt long, starts array<int>, ends array<int>"


def sample_runs(hashes: RangeHash, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, start, size, name, run): maximal runs of neighbouring strings of ``width`` bytes that share one sampled gram.

    A string's sample is the leftmost gram of the smallest hash in it, so equal strings have it at the same place: the
    property for which a difference cover is taken. ``name``: the gram's hash; ``run``: the hash of all bytes of the run.
    """
    gram = hashes.windows(GRAM)
    if len(gram) and len(gram) > int(_PLACE):
        raise ValueError("a document is longer than 2^28 bytes")
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span, step = width - GRAM + 1, 1
    while step * 2 <= span:
        key = np.minimum(key[:-step], key[step:]) if len(key) > step else key[:0]
        step *= 2
    if span > step:
        rest = span - step
        key = np.minimum(key[:-rest], key[rest:]) if len(key) > rest else key[:0]
    inside = np.zeros(len(key), bool)  # strings that begin and end in one document
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            inside[a : b - width + 1] = True
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    own = key[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (np.diff(at) > 1)))
    start = at[first]
    size = np.append(first[1:], len(at)) - first
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, size, gram[(own[first] & _PLACE).astype(np.int64)], hashes.ranges(start, start + size - 1 + width)


def merge_spans(starts: np.ndarray, ends: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not len(starts):
        return []
    edge = np.zeros(limit + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    inside = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    return list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True))


def _joined(doc: np.ndarray, salt: np.ndarray, start: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Spans of neighbouring starts."""
    order = np.lexsort((start, salt, doc))
    doc, salt, start = doc[order], salt[order], start[order]
    new = blobs.firsts(doc, salt) | (np.diff(start, prepend=-2) != 1)
    last = np.append(new[1:], True)[: len(new)]
    return {"doc": doc[new], "salt": salt[new], "start": start[new], "end": start[last] + width}


def _doc_part(doc: np.ndarray, ranges: int) -> np.ndarray:
    return blobs.part_of(mix(doc.view(np.uint64)), ranges)


def _by_part(packed: DataFrame, fn: Callable[[bool, dict[str, np.ndarray]], pa.Table], kinds: dict[str, type], ranges: int, out: str) -> DataFrame:
    """``fn`` over all numbers of each part. Parts from ``ranges`` on are by document and hold what a slice has settled."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return fn(key[0].as_py() >= ranges, blobs.unpack(table, kinds))

    return packed.groupBy("part").applyInArrow(run, out)


def salted(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells apart texts that share an identifier: 60 bits of SHA-256, or nothing where no two rows share one.

    A job counts identifiers; where all differ, the column is 0 everywhere and takes no room in what is written.
    """
    shared = docs.groupBy(id_key(id_col).alias("doc")).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if shared.isEmpty():
        return F.lit(0).cast("long")
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("long")


def repeated_spans(docs: DataFrame, width: int, id_col: str, text_col: str, salt: Column, scratch: Scratch) -> DataFrame:
    """``doc``, ``salt``, ``starts``, ``ends``: byte spans to remove. ``salt`` tells apart texts that share an identifier."""
    keyed = docs.select(id_key(id_col).alias("doc"), salt.alias("salt"), F.col(text_col).cast("binary").alias("body")).where(F.octet_length("body") >= width)
    ranges = blobs.text_ranges(docs, text_col)

    def slices(batch: pa.RecordBatch):
        """Slices of the batch, each as a list of parts."""
        ids, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = byte_view(batch.column(2))
        for low, high in chunks(offsets, SLICE_BYTES):
            inner = [(low + a, low + b) for a, b in chunks(offsets[low : high + 1], CHUNK_BYTES)]
            yield ((ids[a:b], salts[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a) for a, b in inner)

    def map_runs(batch: pa.RecordBatch):
        """Runs by range of their name; of equal runs of a slice only the first, the others are spans at once."""
        for parts in slices(batch):
            found = []
            for ids, salts, data, offsets, _ in parts:
                row, start, size, name, run = sample_runs(RangeHash(data), offsets, width)
                found.append((name, run, ids[row], salts[row], (start - offsets[row]).astype(np.int32), size.astype(np.uint8)))
            name, run, doc, salt, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((start, salt, doc, run, name))
            name, run, doc, salt, start, size = (c[order] for c in (name, run, doc, salt, start, size))
            first = blobs.firsts(name, run)
            own = {"name": (name & np.uint64(0xFFFFFFFF)).astype(np.uint32), "run": run, "doc": doc, "salt": salt, "start": start, "size": size}
            yield blobs.pack(np.where(first, blobs.part_of(name, ranges), ranges + _doc_part(doc, ranges)), own, _RUNS)

    def to_spans(own: dict[str, np.ndarray]) -> pa.Table:
        return blobs.grouped_lists([own["doc"], own["salt"]], ["doc", "salt"], {"starts": own["start"], "ends": (own["start"] + own["size"] - 1 + width).astype(np.int32)}, _SPANS)

    def sort_runs(settled: bool, own: dict[str, np.ndarray]) -> pa.Table:
        """Equal runs after the first are spans. Different runs of one name may still share strings: those are open."""
        if settled:
            closed = to_spans(own)
            return closed.append_column("open", pa.array(np.zeros(len(closed), bool)))
        order = np.lexsort((own["start"], own["salt"], own["doc"], own["run"], own["name"]))
        own = {c: v[order] for c, v in own.items()}
        first = blobs.firsts(own["name"], own["run"])
        new = blobs.firsts(own["name"])
        kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new)) if len(new) else np.zeros(0, np.int64)
        shared = kinds[np.cumsum(new) - 1] > 1 if len(new) else first
        closed = to_spans({c: v[~first] for c, v in own.items()})
        again = first & shared
        open_ = to_spans({c: v[again] for c, v in own.items()})
        return pa.concat_tables([closed.append_column("open", pa.array(np.zeros(len(closed), bool))), open_.append_column("open", pa.array(np.ones(len(open_), bool)))])

    runs = map_batches(keyed, map_runs, blobs.schema(_RUNS))
    sorted_ = scratch.save(_by_part(runs, sort_runs, _RUNS, ranges, _SPAN_SCHEMA + ", open boolean"), "sorted")
    settled = sorted_.where("NOT open").drop("open")

    open_runs = sorted_.where("open").groupBy("doc", "salt").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    again = keyed.join(open_runs, ["doc", "salt"]).select("doc", "salt", "body", "starts", "ends")

    def map_windows(batch: pa.RecordBatch):
        """Every string of the open runs by range of its hash; of equal ones of a slice only the first, the others are spans at once."""
        starts_at, from_, to = (np.asarray(batch.column(3).offsets), batch.column(3).values.to_numpy(), batch.column(4).values.to_numpy()) if len(batch) else (np.zeros(1, int), np.zeros(0, int), np.zeros(0, int))
        for parts in slices(batch):
            found = []
            for ids, salts, data, offsets, a in parts:
                n = len(offsets) - 1
                own = slice(starts_at[a], starts_at[a + n])
                row = np.repeat(np.arange(n), np.diff(starts_at[a : a + n + 1]))
                size = to[own] - from_[own] - width + 1
                begin = np.repeat(from_[own] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
                row = np.repeat(row, size)
                at = begin + offsets[row]
                check = (RangeHash(_OTHER[data]).windows(width)[at] >> np.uint64(32)).astype(np.uint32)
                found.append((RangeHash(data).windows(width)[at], check, ids[row], salts[row], begin.astype(np.int32)))
            name, check, doc, salt, start = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((start, salt, doc, check, name))
            name, check, doc, salt, start = (c[order] for c in (name, check, doc, salt, start))
            first = blobs.firsts(name, check)
            yield blobs.pack(blobs.part_of(name[first], ranges), {"name": name[first], "check": check[first], "doc": doc[first], "salt": salt[first], "start": start[first]}, _WINDOWS)
            own = _joined(doc[~first], salt[~first], start[~first], width)
            yield blobs.pack(ranges + _doc_part(own["doc"], ranges), {**own, "name": np.zeros(len(own["doc"])), "check": own["end"] - own["start"]}, _WINDOWS)

    def sort_windows(settled: bool, own: dict[str, np.ndarray]) -> pa.Table:
        """Equal strings after the first are spans; of settled spans, ``check`` is the length."""
        if settled:
            return marks({**own, "end": own["start"] + own["check"].astype(np.int32)})
        order = np.lexsort((own["start"], own["salt"], own["doc"], own["check"], own["name"]))
        later = order[~blobs.firsts(own["name"][order], own["check"][order])]
        return marks(_joined(own["doc"][later], own["salt"][later], own["start"][later], width))

    def marks(own: dict[str, np.ndarray]) -> pa.Table:
        return pa.Table.from_batches([blobs.pack(_doc_part(own["doc"], ranges), own, _MARKS)])

    def to_lists(own: dict[str, np.ndarray]) -> pa.Table:
        return blobs.grouped_lists([own["doc"], own["salt"]], ["doc", "salt"], {"starts": own["start"], "ends": own["end"]}, _SPANS)

    windows = map_batches(again, map_windows, blobs.schema(_WINDOWS))
    compared = scratch.save(_by_part(windows, sort_windows, _WINDOWS, ranges, blobs.schema(_MARKS)), "compared")
    return settled.unionByName(blobs.reduce_parts(compared, to_lists, _MARKS, _SPAN_SCHEMA))


def suffix_dedup(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (binary: the UTF-8 bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a smaller identifier, or in the same
    document further left. Strings never cross documents; all are judged on the input.

    Null text counts as empty; texts shorter than ``width`` stay whole. A null identifier is the largest. Different texts
    of one identifier are documents in the order of their hash (60 bits of SHA-256); equal rows are one document and get equal results. Input
    columns named like the new ones are replaced, others pass through. A text of more than 2^28 bytes (268 MB) is refused. An empty table gives an empty table. Strings are
    taken as equal if two independent hashes of them are, of 64 and 32 bits; runs around one gram if 64 bits are.

    Plan: sampled grams that equal strings share by construction stand for the runs of strings around them. Runs are
    named and sorted by range of the name; equal runs are settled there, and only runs that share a name but differ are
    looked at string by string, sorted and compared with their neighbours. Each slice of the input first settles what
    repeats within itself, so a passage in a third of all documents costs one record per slice.
    """
    if width < GRAM + 1 or width - GRAM + 1 > 255:
        raise ValueError(f"width must be {GRAM + 1} to {GRAM + 254}")
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    salt_of = salted(docs, id_col, text_col)
    spans = repeated_spans(docs, width, id_col, text_col, salt_of, scratch)
    per_doc = spans.groupBy("doc", "salt").agg(F.flatten(F.collect_list("starts")).alias("__starts"), F.flatten(F.collect_list("ends")).alias("__ends"))

    @arrow_udf("struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint>")
    def cut(bodies: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        kept, sizes, removed, counts = [], [], [], []
        for body, a, b in zip(bodies, starts, ends, strict=True):
            body = body.as_py() or b""
            spans = merge_spans(a.values.to_numpy(), b.values.to_numpy(), len(body)) if a.is_valid else []
            edges = [0, *(x for s in spans for x in s), len(body)]
            out = b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if spans else body
            kept.append(out)
            sizes.append(len(body))
            removed.append(len(body) - len(out))
            counts.append(len(spans))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts))], names=["kept", "n_bytes", "n_removed", "n_spans"])

    doc, salt, starts, ends = (fresh(docs.columns, c) for c in ("__doc", "__salt", "__starts", "__ends"))
    keyed = docs.withColumns({doc: id_key(id_col), salt: salt_of})
    joined = keyed.join(per_doc.toDF(doc, salt, starts, ends), [doc, salt], "left")
    out = with_fields(joined, cut(F.col(text_col).cast("binary"), F.col(starts), F.col(ends)), ("kept", "n_bytes", "n_removed", "n_spans"))
    return out.drop(doc, salt, starts, ends)

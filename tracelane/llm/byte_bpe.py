"""Byte-level byte-pair encoding and decoding over Arrow batches."""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import RangeHash, arrow_udf, byte_view, chunks, list_array, strings, trim, with_columns_last, with_fields

#: Slots for encoded units in a worker, tokens that they may hold before all are emptied, and units encoded at a time.
SLOTS_LOG2, POOL_TOKENS, UNITS = 19, 4_000_000, 5_000
#: Bytes of text that are cut into units at a time.
CHUNK_BYTES = 1_000_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next free from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteTable:
    """The bytes of every token: what decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        table = bytearray(int(self.lengths.sum()))
        for token, rank in ranks.items():
            table[self.starts[rank] : self.starts[rank] + len(token)] = token
        self.table = np.frombuffer(bytes(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens in order."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        if not total:
            return b""
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.table[np.arange(total) + shift].tobytes()


_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:!?)(\"")] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that the parts encode apart: before a lone space between two other characters, between an
    ASCII letter and punctuation but the apostrophe, and around a lone line end.

    No match of the pattern spans such a place. Next to characters of three bytes that begin like Unicode white space, and
    to the white space of two bytes, nothing is cut, which only makes units longer.
    """
    n = len(data)
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at + 1 < n)]
    before, after = data[at - 1], data[at + 1]
    two, second = data[np.maximum(at - 2, 0)], data[np.minimum(at + 2, n - 1)]
    blank = lambda x: (x == 0x85) | (x == 0xA0)
    wide = lambda x: (x >= 0xE1) & (x <= 0xE3)
    left = (before > 32) & ~((before >= 0x80) & ((two == 0xC2) & blank(before) | wide(data[np.maximum(at - 3, 0)])))
    right = (after > 32) & ~((after == 0xC2) & blank(second) | wide(after))
    cut = np.zeros(n + 1, bool)
    cut[at[left & right]] = True
    stop = np.flatnonzero(_STOPS[data[1:]]) + 1
    cut[stop[_LETTERS[data[stop - 1]]]] = True
    end = np.flatnonzero(data[1:-1] == 10) + 1 if n > 2 else stop[:0]
    end = end[_VISIBLE[data[end - 1]]]
    cut[end] = True
    cut[end[_VISIBLE[data[end + 1]]] + 1] = True
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:-1])


class Codec(ByteTable):
    """A rank file as a tokenizers-library BPE model, beside its inverse byte table.

    The rank file merges any two neighbours whose concatenation is a token, lowest rank first, so every split of a
    token into two tokens is listed as a merge, in rank order; a piece that is a token is taken whole.

    Units that were encoded are remembered by the 64-bit hash of their bytes, one per slot, so a frequent word goes to the
    library once.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        super().__init__(ranks)
        chars = byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = [(spell(t[:i]), spell(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._reset()

    def _reset(self) -> None:
        self._hash = np.zeros(1 << SLOTS_LOG2, np.uint64)
        self._start, self._size = np.zeros(1 << SLOTS_LOG2, np.int32), np.zeros(1 << SLOTS_LOG2, np.int32)
        self._pool, self._used = np.zeros(POOL_TOKENS, np.int32), 0

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in the pool of units newly encoded."""
        body = data.tobytes()
        units = [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes, ids = [], []
        for i in range(0, len(units), UNITS):
            own = [got.ids for got in self.tokenizer.encode_batch_fast(units[i : i + UNITS], add_special_tokens=False)]
            sizes += map(len, own)
            ids.append(np.fromiter(itertools.chain.from_iterable(own), np.int32))
        size, new = np.array(sizes, np.int32), np.concatenate(ids)
        if self._used + len(new) > len(self._pool):  # one text may need more than the pool has left, until it is emptied
            self._pool = np.concatenate([self._pool[: self._used], np.zeros(len(new), np.int32)])
        self._pool[self._used : self._used + len(new)] = new
        start = self._used + np.cumsum(size) - size
        self._used += len(new)
        return start.astype(np.int32), size

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers (int32) of all texts, how many each has)."""
        rows = len(offsets) - 1
        starts = unit_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        if self._used > POOL_TOKENS // 2:
            self._reset()
        ends = np.append(starts[1:], len(data))
        hashes = RangeHash(data).ranges(starts, ends) | np.uint64(1)
        slot = (hashes >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        begin, size = self._start[slot], self._size[slot]
        missed = np.flatnonzero(self._hash[slot] != hashes)
        if len(missed):
            new, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            own = missed[first]
            at, n = self._learn(data, starts[own], ends[own])
            begin[missed], size[missed] = at[back], n[back]
            self._hash[slot[own]], self._start[slot[own]], self._size[slot[own]] = new, at, n
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        ids = self._pool[np.arange(int(size.sum())) + shift]
        row = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(row, size, rows).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers (int32) of each text."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = byte_view(texts)
        parts = [self.encode_bytes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK_BYTES)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts, strict=True)))  # type: ignore[return-value]


@functools.lru_cache(maxsize=2)
def byte_table(path: str) -> ByteTable:
    """One per worker and vocabulary."""
    return ByteTable(read_ranks(path))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, pattern)


def character_starts(text: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token the index of the character that holds its first byte."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    own = lengths[codes]
    return character[np.cumsum(own) - own].astype(np.int32)


def _flat(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.array([len(x) for x in rows], np.int64)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))


def encode_column(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """Token identifiers of ``text`` as array<int>."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, sizes = codec(ranks, pattern).encode_column(texts)
        return list_array(ids, np.concatenate([[0], np.cumsum(sizes)]), pa.int32())

    return encode(text.cast("string"))


def count_column(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of ``text`` as long."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(codec(ranks, pattern).encode_column(texts)[1], pa.int64())

    return count(text.cast("string"))


def offsets_column(text: Column, ids: Column, ranks: str | None = None) -> Column:
    """For each token the index of the character that holds its first byte, as array<int>."""
    ranks = ranks or default_ranks()

    @arrow_udf("array<int>")
    def offsets(texts: pa.Array, codes: pa.Array) -> pa.Array:
        lengths = byte_table(ranks).lengths
        return _flat([character_starts(t, np.array(c or [], np.int64), lengths) if c else np.zeros(0, np.int32) for t, c in zip(strings(texts), codes.to_pylist(), strict=True)])

    return offsets(text.cast("string"), ids)


def decode_column(ids: Column, ranks: str | None = None) -> Column:
    """Bytes of the tokens ``ids``; they may begin or end inside a character."""
    ranks = ranks or default_ranks()

    @arrow_udf("binary")
    def decode(codes: pa.Array) -> pa.Array:
        own = byte_table(ranks)
        values = np.asarray(codes.flatten().fill_null(0))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(codes), 0))
        ends = np.cumsum(sizes)
        return pa.array([own.decode(values[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())

    return decode(ids)


def round_trip_column(text: Column, ranks: str | None = None, pattern: str | None = None) -> Column:
    """struct(token_ids, decoded): the identifiers of ``text`` and the bytes that they decode to, in one pass.

    The codec goes with its partition: a worker that waits for other work would keep it.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    @F.arrow_udf("struct<token_ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                own = codec(ranks, pattern)
                ids, sizes = own.encode_column(texts)
                ends = np.cumsum(sizes)
                decoded = pa.array([own.decode(ids[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())
                yield pa.StructArray.from_arrays([list_array(ids, np.concatenate([[0], ends]), pa.int32()), decoded], names=["token_ids", "decoded"])
                del own, ids, sizes, ends, decoded
                trim()
        finally:
            codec.cache_clear()
            trim()

    return both(text.cast("string"))


def decode_text_column(decoded: Column) -> Column:
    """Decoded bytes as text. A character of which only a part is there, at either end, becomes U+FFFD."""

    @arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([(x or b"").decode("utf-8", "replace") for x in values.to_pylist()], pa.string())

    return text(decoded)


def encode_documents(docs: DataFrame, text_col: str = "text", offsets: bool = False, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` array<int> and, if asked for, ``token_starts`` array<int>.

    Null text counts as empty and has no tokens. Each match of ``pattern`` is encoded apart; special tokens are
    ordinary text. All columns pass through, those named like the new ones are replaced; rows stay as they are, copies
    included. No shuffle: memory is bounded by an Arrow batch and the longest text.
    """
    new = {"token_ids": encode_column(F.col(text_col), ranks, pattern)}
    out = with_columns_last(docs, docs.columns, new)
    if offsets:
        out = with_columns_last(out, out.columns, {"token_starts": offsets_column(F.col(text_col), F.col("token_ids"), ranks)})
    return out


def decode_documents(encoded: DataFrame, ids_col: str = "token_ids", as_text: bool = False, ranks: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded`` (binary) and, if asked for, ``decoded_text``; null or no identifiers give no bytes."""
    out = with_columns_last(encoded, encoded.columns, {"decoded": decode_column(F.col(ids_col), ranks)})
    if as_text:
        out = with_columns_last(out, out.columns, {"decoded_text": decode_text_column(F.col("decoded"))})
    return out


def round_trip(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encode_documents`` and ``decode_documents`` in one pass over the texts, with the same results."""
    return with_fields(docs, round_trip_column(F.col(text_col), ranks, pattern), ("token_ids", "decoded"))


def codec_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes."""
    coded = round_trip(docs.select("doc_id", "text"))
    ids = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.octet_length("decoded").cast("long").alias("n_bytes"))

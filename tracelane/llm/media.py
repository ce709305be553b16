"""Media columns: bytes kept as FLAC streams, read back as PCM blocks that can be sought by sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm import flac
from tracelane.llm.common import arrow_udf, byte_view, chunks, map_batches, with_fields

#: Bytes of payload that are coded together.
CHUNK_BYTES = 1_500_000
MEDIA = "struct<media:binary,n_bytes:bigint,payload_bytes:bigint>"


def _parts(column: pa.Array) -> Iterator[list[bytes]]:
    data, offsets = byte_view(column)
    for a, b in chunks(offsets, CHUNK_BYTES):
        yield [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]


def encode_column(body: Column) -> Column:
    """struct(media, n_bytes, payload_bytes): ``body`` as a FLAC stream of one 8-bit channel.

    The payload is the body with blanks (byte 32) up to a positive multiple of flac.BLOCK; null counts as empty.
    """

    @arrow_udf(MEDIA)
    def encode(bodies: pa.Array) -> pa.Array:
        media, sizes, padded = [], [], []
        for part in _parts(bodies):
            payloads = [p + b" " * ((-len(p)) % flac.BLOCK or (0 if p else flac.BLOCK)) for p in part]
            media += flac.encode(payloads)
            sizes += map(len, part)
            padded += map(len, payloads)
        return pa.StructArray.from_arrays([pa.array(media, pa.binary()), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64())], names=["media", "n_bytes", "payload_bytes"])

    return encode(body.cast("binary"))


def _feature(samples: np.ndarray) -> str:
    """Mean, root mean square and sign changes of a stream's samples, as exact sums."""
    return f"sum={int(samples.sum())};energy={int((samples * samples).sum())};crossings={int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())}"


def _bytes(samples: np.ndarray) -> bytes:
    return (samples.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()


def decode_column(media: Column) -> Column:
    """struct(payload, n_blocks, feature): the bytes of a stream of 8-bit samples. Raises where a checksum is wrong."""

    @arrow_udf("struct<payload:binary,n_blocks:bigint,feature:string>")
    def decode(streams: pa.Array) -> pa.Array:
        payloads, blocks, features = [], [], []
        for part in _parts(streams):
            for samples, offsets in flac.decode(part):
                payloads.append(_bytes(samples))
                blocks.append(len(offsets))
                features.append(_feature(samples))
        return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.array(blocks, pa.int64()), pa.array(features, pa.string())], names=["payload", "n_blocks", "feature"])

    return decode(media)


def store_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``media`` (FLAC), ``n_bytes`` (of the text in UTF-8) and ``payload_bytes``.

    Null and empty text become one block of blanks. Whole texts are stored; equal texts give equal streams. Input columns of
    these names are replaced, others and repeated rows pass through; an empty table gives an empty table. No shuffle.
    """
    return with_fields(docs, encode_column(F.col(text_col).cast("string")), ("media", "n_bytes", "payload_bytes"))


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """``stored`` with ``payload`` (bytes as read back), ``n_blocks`` and ``feature``; all checksums are verified."""
    return with_fields(stored, decode_column(F.col(media_col)), ("payload", "n_blocks", "feature"))


def pcm_blocks(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media", seek: tuple[int, int] | None = None) -> DataFrame:
    """A row per block of a stream: identifier, ``block``, ``sample_offset``, ``n_samples``, ``pcm`` (signed 8-bit).

    ``seek`` = (first, end): only blocks that hold samples of that range; only their frames are decoded, found by the frame
    headers of the stream. Null media give no rows, an empty table none, repeated rows rows each; only the two columns
    are read, so others cannot clash. Raises where a checksum is wrong.
    """
    kind = stored.schema[id_col].dataType.simpleString()

    def blocks(batch: pa.RecordBatch):
        for i, stream in enumerate(batch.column(1).to_pylist()):
            data = np.frombuffer(stream, np.uint8)
            starts = flac.frame_starts(data)
            ends = np.append(starts[1:], len(data))
            sizes = flac.block_sizes(data, starts)
            offsets = np.cumsum(sizes) - sizes
            own = np.arange(len(starts)) if seek is None else np.flatnonzero((offsets < seek[1]) & (offsets + sizes > seek[0]))
            pcm = flac.decode_frames(data, starts[own], ends[own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.full(len(own), i))), pa.array(own, pa.int64()), pa.array(offsets[own], pa.int64()), pa.array(sizes[own], pa.int64()), pa.array([x.astype(np.int8).tobytes() for x in pcm], pa.binary())],
                [id_col, "block", "sample_offset", "n_samples", "pcm"],
            )

    return map_batches(stored.where(F.col(media_col).isNotNull()).select(id_col, media_col), blocks, f"`{id_col}` {kind}, block long, sample_offset long, n_samples long, pcm binary")

"""Lines that occur in several documents, dropped from all but the first."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import NULL_ID, SPACE_BYTES, Scratch, arrow_udf, fresh, id_key, map_batches, strings

_SPACE = SPACE_BYTES.decode()


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """For each line the 128-bit hash of its normalised form, None for a line too short to count."""
    keys = []
    for line in text.split("\n"):
        line = line.strip(_SPACE)
        keys.append(hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(line) >= min_chars else None)
    return keys


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines removed, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of bytes 32 and 9-13 with A-Z lower-cased. Keys of at least ``min_chars`` code
    points that ``min_docs`` or more documents hold lose their lines in all documents but the one of the smallest
    identifier. Lines that stay keep their order and spelling.

    Null or empty text is one empty line. A null identifier counts as the largest long; rows that share an identifier
    are one document, so none of them loses a line to another. All other columns pass through; input columns named
    ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty table.

    Plan: only 16-byte hashes are shuffled to find repeated lines, with partial min/max per hash, so that a line in a
    third of all documents costs one row per task; the join that finds the losers can be split by adaptive execution.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "line_dedup")
    doc, own_drops = fresh(docs.columns, "__doc"), fresh(docs.columns, "__drops")
    keyed = docs.withColumn(doc, id_key(id_col))

    def explode(batch: pa.RecordBatch):
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            own = {k for k in line_keys(text, min_chars) if k is not None}
            ids += [doc] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["line", "__doc"])

    lines = scratch.save(map_batches(keyed.select(F.col(doc).alias("__doc"), F.col(text_col).cast("string")), explode, "line binary, __doc long"), "lines")
    if min_docs == 2:  # two documents hold it if its smallest and largest identifiers differ
        repeated = lines.groupBy("line").agg(F.min("__doc").alias("keeper"), F.max("__doc").alias("other")).where("keeper < other")
    else:
        repeated = lines.distinct().groupBy("line").agg(F.min("__doc").alias("keeper"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    losers = lines.join(repeated.select("line", "keeper"), "line").where("__doc > keeper")
    drops = losers.groupBy(F.col("__doc").alias(doc)).agg(F.collect_set("line").alias(own_drops))  # at most a document's own lines

    @arrow_udf("struct<text:string,n_lines:bigint,n_dropped:bigint>")
    def rebuild(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out, before, gone = [], [], []
        for text, drop in zip(strings(texts), dropped.to_pylist(), strict=True):
            parts = text.split("\n")
            if drop:
                drop = set(drop)
                kept = [x for x, k in zip(parts, line_keys(text, min_chars), strict=True) if k is None or k not in drop]
            else:
                kept = parts
            out.append("\n".join(kept))
            before.append(len(parts))
            gone.append(len(parts) - len(kept))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], names=["text", "n_lines", "n_dropped"])

    own = fresh(docs.columns, "__new")
    joined = keyed.join(drops, doc, "left").withColumn(own, rebuild(F.col(text_col).cast("string"), F.col(own_drops)))
    old = [F.col(f"`{own}`.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*old, F.col(f"`{own}`.n_lines").alias("n_lines"), F.col(f"`{own}`.n_dropped").alias("n_dropped"))


__all__ = ["NULL_ID", "line_dedup", "line_keys"]

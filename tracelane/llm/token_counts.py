"""Exact histogram of encoded lengths, and what follows from it for any context limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.llm.byte_bpe import count_column

#: Lengths per block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", by: list[str] | None = None, length: Column | None = None) -> DataFrame:
    """``by`` columns, ``n_tokens``, ``n_docs``: how many documents have each encoded length.

    Null or empty text has length 0; null is a group of its own in ``by``. Copies count as often as they occur. An empty
    table gives an empty histogram. Counting is map-side first, so the shuffle carries one row per length and task.
    """
    by = by or []
    counted = docs.select(*by, (count_column(F.col(text_col)) if length is None else length).alias("n_tokens"))
    return counted.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_totals(histogram: DataFrame, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The histogram with, per length L, sums over all documents of at least that length and totals at limit L.

    ``docs_at_least``, ``tokens_at_least``: suffix sums. ``truncated_tokens``: what stays if each document is cut to L
    tokens. ``lost_tokens``: what is cut off. ``share_at_most``: share of documents that fit whole.

    The sums are two-level: one per block of ``block`` lengths, then within each block; the table of blocks is the
    largest length / ``block`` rows, however many documents or lengths there are.
    """
    by = by or []
    cells = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = cells.groupBy(*by, "block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    later = W.partitionBy(*by).orderBy(F.desc("block"))
    above = later.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        *by, "block",
        F.coalesce(F.sum("b_docs").over(above), zero).alias("a_docs"), F.coalesce(F.sum("b_tokens").over(above), zero).alias("a_tokens"),
        F.sum("b_docs").over(whole).alias("all_docs"), F.sum("b_tokens").over(whole).alias("all_tokens"),
    )
    within = W.partitionBy(*by, "block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    same = F.lit(True)
    for c in [*by, "block"]:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = cells.alias("c").join(blocks.alias("b"), same).select("c.*", "a_docs", "a_tokens", "all_docs", "all_tokens")
    docs, tokens = F.col("a_docs") + F.sum("n_docs").over(within), F.col("a_tokens") + F.sum("tokens").over(within)
    out = joined.select(*by, "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "all_docs", "all_tokens")
    lost = F.col("tokens_at_least") - F.col("n_tokens") * F.col("docs_at_least")
    return out.select(
        *by, "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("all_tokens") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def totals_at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit``, ``docs``, ``tokens``, ``truncated_tokens``, ``docs_cut`` for each asked limit, without sorting.

    One pass over the histogram; an empty histogram gives zeros.
    """
    n, docs = F.col("n_tokens"), F.col("n_docs")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    one = histogram.agg(
        zero(docs).alias("docs"), zero(n * docs).alias("tokens"),
        F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), zero(F.least(n, F.lit(x).cast("long")) * docs).alias("truncated_tokens"), zero(F.when(n > x, docs).otherwise(F.lit(0))).alias("docs_cut")) for x in limits]).alias("at"),
    )
    return one.select("docs", "tokens", F.explode("at").alias("at")).select("at.context_limit", "docs", "tokens", "at.truncated_tokens", "at.docs_cut")


def length_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """``share``, ``n_tokens``: the smallest length that at least that share of documents does not exceed."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return totals.select(at, "n_tokens", "share_at_most").where("share_at_most >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))

"""Graded text quality by ordinal cumulative-link regression over hashed text features."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import arrow_udf, id_key, strings, with_columns_last, with_fields

FEATURES_LOG2 = 18
#: Rated rows that the model is fitted on at most: those of the smallest hashes of their identifiers.
TRAINING_ROWS = 6000
#: A feature must occur in so many training texts to get a weight.
LEAST_TEXTS = 5
ROUNDS = 150
RIDGE = 1e-2
#: Letters; anything else that is not white space.
_PARTS = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+")
#: Grades, lowest first.
TOXIC, POOR, GOOD = 0, 1, 2


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a whole text: words, symbol runs, and how words are written.

    Deciles of the share of upper-case words and of symbol runs are features too; an empty text has only these.
    """
    import zlib

    parts = _PARTS.findall(text)
    words = symbols = upper = 0
    names = set()
    for part in parts:
        if part.isalpha():
            words += 1
            upper += len(part) > 1 and part.isupper()
            names.add("w " + part.lower())
        else:
            symbols += 1
            names.add("s " + ("0" if part.isdigit() else part[:8]))
    names.add(f"upper {10 * upper // max(1, words)}")
    names.add(f"symbols {min(10, 10 * symbols // max(1, words))}")
    return np.unique(np.fromiter((zlib.crc32(n.encode("utf-8", "surrogatepass")) >> (32 - FEATURES_LOG2) for n in names), np.int64, len(names)))


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(identifier, grade): 0 toxic, 1 poor, 2 good.

    Rows of one identifier give it their lowest grade. Rows without an identifier, or with neither ``toxic`` = 1 nor a
    ``quality``, give none; an empty table gives an empty table. Other columns are not read.
    """
    grade = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, POOR).when(F.col("quality") == 1, GOOD)
    return labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), grade.alias("grade")).where("grade IS NOT NULL").groupBy(id_col).agg(F.min("grade").alias("grade"))


class OrdinalModel:
    """P(grade >= k) = sigmoid(score - threshold[k]) with one weight per feature and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return 1 / (1 + np.exp(-(scores[:, None] - self.thresholds[None, :])))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int = 3) -> OrdinalModel:
    """Maximum penalised likelihood by Adam over all rows at once. Thresholds stay ordered: each is the one before plus an exponential."""
    size = 1 << FEATURES_LOG2
    n = len(rows)
    base = np.array([np.log(max(1, (grades < k).sum()) / max(1, (grades >= k).sum())) for k in range(1, levels)]) if n else np.zeros(levels - 1)
    first, steps = base[0], np.log(np.maximum(np.diff(base), 1e-2))
    if not n:
        return OrdinalModel(np.zeros(size), np.append(first, first + np.cumsum(np.exp(steps))))
    column, row = np.concatenate(rows), np.repeat(np.arange(n), [len(x) for x in rows])
    common = np.bincount(column, minlength=size) >= LEAST_TEXTS
    row, column = row[common[column]], column[common[column]]
    used, column = np.unique(column, return_inverse=True)
    p = np.concatenate([np.zeros(len(used)), [first], steps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, ROUNDS + 1):
        _, g = loss(p, row, column, grades, levels)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = p[: len(used)]
    return OrdinalModel(weights, np.concatenate([[p[len(used)]], np.exp(p[len(used) + 1 :])]).cumsum())


def loss(p: np.ndarray, row: np.ndarray, column: np.ndarray, grades: np.ndarray, levels: int) -> tuple[float, np.ndarray]:
    """(penalised negative log likelihood a row, its gradient). ``p``: weights, first threshold, logs of the steps to the next."""
    n, size = len(grades), len(p) - (levels - 1)
    weights, steps = p[:size], np.exp(p[size + 1 :])
    edge = np.concatenate([[-np.inf], np.concatenate([[p[size]], steps]).cumsum(), [np.inf]])
    score = np.bincount(row, weights[column], n)
    with np.errstate(over="ignore"):
        least, more = 1 / (1 + np.exp(edge[grades] - score)), 1 / (1 + np.exp(edge[grades + 1] - score))  # P(grade >= own), P(grade > own)
    own = np.maximum(least - more, 1e-9)
    down, up = least * (1 - least) / own / n, more * (1 - more) / own / n
    by_edge = (np.bincount(grades, down, levels + 1) - np.bincount(grades + 1, up, levels + 1))[1:levels]
    slope = np.bincount(column, (up - down)[row], size) + RIDGE * weights / n
    value = -np.log(own).mean() + RIDGE * (weights**2).sum() / 2 / n
    return value, np.concatenate([slope, [by_edge.sum()], [by_edge[k:].sum() * steps[k - 1] for k in range(1, levels - 1)]])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> OrdinalModel:
    """Fit on at most ``rows`` rated documents; only their feature numbers reach the driver."""
    chosen = graded(labels, id_col).orderBy(F.xxhash64(id_col), id_col).limit(rows)

    @arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in strings(texts)], pa.list_(pa.int64()))

    rated = docs.where(F.col(id_col).isNotNull()).select(id_key(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col(id_col))
    own = rated.orderBy("__doc", F.xxhash64("__text")).limit(rows).select(hashed("__text").alias("f"), "grade").toArrow()
    return fit([np.asarray(x, np.int64) for x in own.column("f").to_pylist()], np.array(own.column("grade").to_pylist(), np.int64))


def grade(docs: DataFrame, model: OrdinalModel, keep_from: int = GOOD, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to 2), ``tail_prob`` = P(grade >= keep_from) and ``keep`` = tail_prob >= least.

    Whole texts count. Null and empty text have only the base features. Input columns of these names are replaced, other
    columns and repeated rows pass through. Without rated rows every text gets the same middling grade. No shuffle; the
    model is a broadcast of 2^FEATURES_LOG2 float32.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<expected_grade:double,tail_prob:double>")
    def rate(texts: pa.Array) -> pa.Array:
        own = shared.value
        scores = np.array([own.weights[features(t)].sum() for t in strings(texts)], np.float64)
        tails = own.tails(scores)
        return pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, keep_from - 1])], names=["expected_grade", "tail_prob"])

    rated = with_fields(docs, rate(F.col(text_col).cast("string")), ("expected_grade", "tail_prob"))
    return with_columns_last(rated, rated.columns, {"keep": F.col("tail_prob") >= least})

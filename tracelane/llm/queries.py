"""One query per numbered operator, over whole tables with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm import language_id, ordinal_quality, suffix_tree_lm
from tracelane.llm.byte_bpe import codec_digests
from tracelane.llm.collocations import collocations
from tracelane.llm.common import read_table
from tracelane.llm.decontaminate import find_items
from tracelane.llm.jaccard_join import jaccard_groups
from tracelane.llm.line_dedup import line_dedup
from tracelane.llm.media import read_media, store_media
from tracelane.llm.minhash_dedup import near_duplicates
from tracelane.llm.source_divergence import source_divergence
from tracelane.llm.suffix_dedup import suffix_dedup
from tracelane.llm.token_counts import length_histogram, suffix_totals


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text; a null text is encoded as an empty one, equal rows give equal rows, an empty table none."""
    return codec_digests(read_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by five-word shingles; texts without a word link to nothing, a null identifier is the largest."""
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by a model of the rows outside the fold; ``und`` for null and letterless texts. Without a labelled row every text is ``und``."""
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(language_id.fold("doc_id", 3) != 1))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (language_id.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("mixture").cast("long").alias("n_languages"))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a FLAC stream and back; a null text is one block of blanks, equal texts give equal streams."""
    out = read_media(store_media(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "n_blocks",
    )


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities under a model of the rows outside the fold; a null text is the end token alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_tree_lm.score(docs, docs.where(language_id.fold("doc_id", 5) != 1))
    return out.withColumn("held_out", language_id.fold("doc_id", 5) == 1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each encoded length with its suffix sums; null texts have length 0, an empty table gives no row."""
    return suffix_totals(length_histogram(read_table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents; null and blank items are found nowhere, null texts hold none."""
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines dropped from all but the smallest identifier; a null text is one empty line, rows of one identifier are one document."""
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by a model of the labelled rows; null texts are graded like empty ones, labels without a document teach nothing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal_quality.learn(docs, read_table(spark, sf_dir, "labels"))
    return ordinal_quality.grade(docs, model).select("doc_id", "expected_grade", "tail_prob", "keep")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of strings that start earlier removed; a null text is empty, texts of one identifier stand in the order of their hash."""
    out = suffix_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of sources and terms that a source overuses; nulls count as empty, an empty table gives no row."""
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents; null and empty texts have no shingle and stay, an empty table gives no row."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases by score; null texts count as empty, a null language as ``und``, an empty table gives no row."""
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_flac_media": op4_flac_media,
    "op5_suffix_tree_lm": op5_suffix_tree_lm,
    "op6_token_counts": op6_token_counts,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos, len(parts) AS n FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN df USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN occ USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, df.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0)::HUGEINT + 5)) // (t.total + 5 * v.v) AS p
      FROM tot t JOIN df ON t.lang = df.lang JOIN v ON v.lang = t.lang LEFT JOIN occ o ON o.lang = t.lang AND o.source = t.source AND o.term = df.term),
q AS (SELECT df.lang, df.term, 1 + (1000000000 * (sum(p.n)::HUGEINT + 5)) // (any_value(w.total) + 5 * any_value(v.v)) AS q
      FROM df JOIN p ON p.lang = df.lang AND p.term = df.term JOIN v ON v.lang = df.lang JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) w ON w.lang = df.lang GROUP BY df.lang, df.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([ws[i : i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
inner_ AS (SELECT lang, phrase[i : j] AS phrase, max(f) AS longer FROM c, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(2, 6)) AS j) WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR longer < c.f),
cut AS (SELECT c.lang, c.phrase, c.f AS a, i, l.f AS l, r.f AS r, n.n, (1000 * c.f::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score
        FROM kept c JOIN (SELECT unnest(range(1, 5)) AS i) ON i < c.k JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[1 : i] JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[i + 1 : c.k] JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (SELECT *, array_to_string(phrase, ' ') AS text FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, text) AS rank, text AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, text) <= 2000""",
}

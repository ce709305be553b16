"""How sources of a language differ in their use of words: counts of a kept vocabulary by a word automaton, then distances and ranks."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelane.llm.common import Scratch, trim

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 30
#: Added to each count; ranks of terms that are listed; shares are told in parts of SCALE.
PRIOR, TOP_TERMS, SCALE = 5, 50, 1_000_000_000
#: Kept terms and their bytes that one automaton pass looks for; more are looked for in further passes over the texts.
PASS_TERMS, PASS_BYTES = 200_000, 8_000_000
#: Entries that a task holds before it hands them on.
HELD = 500_000
#: Longer terms are not in the automaton.
TRIE_BYTES = 200
_LONG = re.compile(rb"[^ ]{%d,}" % (TRIE_BYTES + 1))
#: Bytes to what a term is compared by: A-Z lower-cased, all other ASCII but a-z a blank. UTF-8 above 127 stays as it is.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_text(text: str | None) -> bytes:
    """The terms of a text, with blanks between them."""
    return (text or "").encode().translate(_TERM_BYTES)


class TermFinder:
    """Finds whole terms of one language in a text.

    Each term is padded with blanks on both sides, and terms that follow each other share one. The automaton works
    along a term recursively, so terms of over TRIE_BYTES bytes are looked up as wholes.
    """

    def __init__(self, terms: list[str]):
        self.terms, self.long = terms, {}
        self.automaton = ahocorasick.Automaton()
        for place, term in enumerate(terms):
            own = term.encode()
            if len(own) > TRIE_BYTES:
                self.long[own] = place
            else:
                self.automaton.add_word(f" {own.decode('latin-1')} ", place)
        self.automaton.make_automaton()

    def places(self, text: bytes) -> list[int]:
        """The place in ``terms`` of each occurrence."""
        found = [place for _, place in self.automaton.iter(f" {text.decode('latin-1')} ")] if len(self.automaton) else []
        if self.long:
            found += [self.long[x] for x in _LONG.findall(text) if x in self.long]
        return found


@lru_cache(maxsize=1)
def _finders(key: str, shared) -> dict[str, TermFinder]:
    """By language; a worker builds a pass's automata once."""
    return {lang: TermFinder(terms) for lang, terms in shared.value.items()}


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, df): in how many rows of (lang, source, text) a term occurs. Summed in each task first."""

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, Counter())
                before = len(own)
                own.update(set(term_text(text).split(b" ")))
                size += len(own) - before
                if size >= HELD:
                    yield rows(held)
                    held, size = {}, 0
            trim()
        if size:
            yield rows(held)

    def rows(held):
        entries = [(lang, term.decode(), n) for lang, own in held.items() for term, n in own.items() if term]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "term", "df"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, term string, df long").groupBy("lang", "term").agg(F.sum("df").alias("df"))


def term_counts(docs: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n) of the kept terms (lang, term): occurrences by passes of an automaton over the texts.

    A pass knows at most PASS_TERMS terms of at most PASS_BYTES bytes in all, which are broadcast. It has whole languages
    and reads their texts alone, so a text is read once; the terms of a language with more than half of that are dealt by
    hash to passes of its own.
    """
    spark = docs.sparkSession
    sizes = kept.groupBy("lang").agg((F.greatest(F.count("*") / PASS_TERMS, F.sum(F.octet_length("term") + 2) / PASS_BYTES) * 2).alias("weight"))
    before = F.sum(F.when(F.col("weight") <= 1, F.col("weight")).otherwise(0)).over(W.orderBy("lang").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumns({"bin": F.floor(F.coalesce(before, F.lit(0.0))), "parts": F.ceil("weight")})
    own = F.concat_ws("#", F.lit("own"), "lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("string"))
    dealt = kept.join(sizes, "lang").withColumn("pass", F.when(F.col("weight") > 1, own).otherwise(F.concat(F.lit("bin#"), F.col("bin").cast("string"))))
    dealt = scratch.save(dealt.select("lang", "term", "pass"), "passes")
    out = None
    for turn, (key,) in enumerate(dealt.select("pass").distinct().orderBy("pass").collect()):
        terms = dealt.where(F.col("pass") == key).groupBy("lang").agg(F.array_sort(F.collect_list("term")).alias("terms")).toArrow().to_pylist()
        shared = spark.sparkContext.broadcast({r["lang"]: r["terms"] for r in terms})
        found = docs.where(F.col("lang").isin([r["lang"] for r in terms]))
        counts = found.select("lang", "source", "text").mapInArrow(_recount(shared, f"{scratch.folder}/{turn}"), "lang string, source string, term string, n long")
        out = counts if out is None else out.unionByName(counts)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _recount(shared, key: str):
    def run(batches):
        finders = _finders(key, shared)
        held, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang in finders:
                    own = held.setdefault((lang, source), Counter())
                    before = len(own)
                    own.update(finders[lang].places(term_text(text)))
                    size += len(own) - before
                if size >= HELD:
                    yield rows(held, finders)
                    held, size = {}, 0
            trim()
        if size:
            yield rows(held, finders)

    def rows(held, finders):
        entries = [(lang, source, finders[lang].terms[place], n) for (lang, source), own in held.items() for place, n in own.items()]
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "term", "n"])

    return run


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(PRIOR)), wide(total) + F.lit(PRIOR) * wide(terms)) + 1


def _pair_sums(postings: DataFrame) -> DataFrame:
    """(lang, g, h, part): sums over each term's postings (source, p, p0) of what two sources that both have it differ
    from what each would alone; summed in each task before they are shuffled."""

    def run(batches):
        sums: dict[tuple[str, str, str], int] = {}
        for batch in batches:
            lists, coded = batch.column(1), batch.column(0).dictionary_encode()
            source, p, p0 = lists.flatten().flatten()
            sources = source.dictionary_encode()
            code, p, p0 = (c.to_numpy().astype(np.int64) for c in (sources.indices, p, p0))
            term = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            lang, n = coded.indices.to_numpy().astype(np.int64)[term], len(sources.dictionary)
            langs, named, own = coded.dictionary.to_pylist(), sources.dictionary.to_pylist(), Counter()
            for step in range(1, int(np.diff(lists.offsets.to_numpy()).max(initial=0))):  # each posting with the one so many places on
                i = np.flatnonzero(term[step:] == term[:-step])
                j = i + step
                d = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                key, at = np.unique((lang[i] * n + np.maximum(code[i], code[j])) * n + np.minimum(code[i], code[j]), return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, d)
                own.update(dict(zip(key.tolist(), total.tolist(), strict=True)))
            for k, d in own.items():
                g, h = sorted((named[k // n % n], named[k % n]))  # each pair in one order
                sums[langs[k // n // n], g, h] = sums.get((langs[k // n // n], g, h), 0) + d
            if len(sums) >= HELD:
                yield rows(sums)
                sums = {}
        if sums:
            yield rows(sums)

    def rows(sums):
        keys = [*sums]
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([*sums.values()], pa.int64())], ["lang", "g", "h", "part"])

    half = postings.mapInArrow(run, "lang string, g string, h string, part long").groupBy("lang", "g", "h").agg(F.sum("part").alias("part"))
    return half.unionByName(half.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "part"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: distances of sources and the terms a source overuses.

    Terms are runs of ASCII letters and characters above 127, A-Z lower-cased. A language keeps the V terms that occur in
    ``least_docs`` of its documents. A source of a language, and the language, give a term p = 1 + floor(10^9 * (count + 5)
    / (N + 5 * V)), N being all their counts of kept terms. Part ``pair``: every other source of the language, by the
    sum of the differences of p over all kept terms. Part ``term``: the kept terms that the source has and gives a larger p
    than its language, by that difference, down to rank ``top_terms``. Ties go to the smaller item in bytes.

    Null texts, languages and sources count as empty ones. Rows are documents, equal ones too. A source without terms has
    its pairs; a language of one source has none; without kept terms all distances are 0. Only three columns are read, so
    others cannot clash. An empty table gives an empty table.

    Plan: exact document frequencies first, then an automaton of the kept terms counts their occurrences; both passes sum
    in their tasks, so a source of a third of all rows is no hot key. Terms that a source lacks are never listed: its
    distance is that of all terms lacking, corrected by its postings, and by pairs of postings of one term.
    """
    scratch = Scratch(docs.sparkSession, "source_divergence")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    groups = scratch.save(docs.groupBy("lang", "source").agg(F.count("*").alias("docs")).drop("docs"), "groups")
    kept = scratch.save(document_frequencies(docs).where(F.col("df") >= least_docs).select("lang", "term"), "kept")
    counts = scratch.save(term_counts(docs, kept, scratch), "counts")

    zero = F.lit(0).cast("long")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    sized = scratch.save(sized.withColumn("p0", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms")))), "sized")
    posted = scratch.save(counts.join(sized, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).select("lang", "source", "term", "p", "p0"), "posted")

    whole = sized.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    expected = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    over = posted.join(expected, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # A pair (g, h): all V terms lacking in both, then each one's postings against the other's lacking share, then both.
    two = sized.select("lang", F.col("source").alias("g"), F.col("p0").alias("g0"), "terms").join(sized.select("lang", F.col("source").alias("h"), F.col("p0").alias("h0")), "lang").where("g <> h")
    alone = posted.groupBy("lang", F.col("source").alias("g"), "p").agg(F.count("*").alias("n"))
    one = two.join(alone, ["lang", "g"]).groupBy("lang", "g", "h").agg(F.sum((F.abs(F.col("p") - F.col("h0")) - F.abs(F.col("g0") - F.col("h0"))) * F.col("n")).alias("own"))
    both = _pair_sums(posted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("posts")).drop("term"))
    pairs = two.join(one, ["lang", "g", "h"], "left").join(one.select("lang", F.col("g").alias("h"), F.col("h").alias("g"), F.col("own").alias("other")), ["lang", "g", "h"], "left").join(both, ["lang", "g", "h"], "left")
    apart = F.coalesce(F.col("terms") * F.abs(F.col("g0") - F.col("h0")), zero) + F.coalesce("own", zero) + F.coalesce("other", zero) + F.coalesce("part", zero)
    pairs = pairs.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), apart.alias("value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(over).where(F.col("rank") <= top_terms)).select("lang", "source", "part", "item", "value", "rank")

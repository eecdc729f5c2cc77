"""Language identification by Bayesian fusion of evidence.

For each document four kinds of evidence multiply:

* the likelihood of its text under byte-trigram models, one for each language that
  any row is labelled with, fitted on a bounded sample of each language's rows;
* the languages its pages declare, through P(declared | language), a small
  smoothed table counted over the whole corpus;
* the suffix of its addresses (country codes speak for a language);
* the prior of its hosts, smoothed towards its domain's, its suffix's and the overall
  one, from counts over the whole corpus without the document itself.

Corpus counts are sums of posteriors, by grouped aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .shared import cut
from .urls import split_url
from .wordhash import LOWER, buffers, slices, trim

# Country-code suffixes that speak for a language.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en",
    "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "se": "sv",
}


@dataclass(frozen=True)
class LanguageParams:
    #: Labelled rows of each language that its text model is fitted on (about so many, chosen by hash; all if there are fewer).
    sample_rows: int = 1000
    #: More labels than these are not languages: an error. A model takes ``cells`` floats a language.
    most_languages: int = 1000
    cells: int = 1 << 14
    smoothing: float = 0.1
    #: Each character is in three trigrams, which are far from independent.
    temper: float = 1 / 3
    #: Counts that a declared language, a suffix or a prior is worth before any data.
    declared_weight: float = 5.0
    suffix_odds: float = 8.0
    prior_weight: float = 10.0


def _cells(column: pa.Array, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of a batch, and where each row's begin."""
    data, offsets = buffers(column)
    x = LOWER[data].astype(np.int64)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = (x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35) >> 7
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # trigrams that would reach into the next row
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(code))]] = False
    begin = np.concatenate(([0], np.cumsum(inside)))
    return (code % cells)[inside], begin[np.minimum(offsets, len(code))]


def sampled(labelled: DataFrame, p: LanguageParams) -> tuple[list[str], DataFrame]:
    """All languages that rows are labelled with, counted over all rows, and about ``sample_rows`` rows of each, the same ones each time."""
    labelled = labelled.where("lang is not null and doc_id is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    found = sorted((r["lang"], r["n"]) for r in counts.limit(p.most_languages + 1).collect())
    if len(found) > p.most_languages:
        raise ValueError(f"more than {p.most_languages} different labels in column lang")
    spark, places = labelled.sparkSession, 1 << 30
    table = spark.createDataFrame([(lang, min(places, p.sample_rows * places // n)) for lang, n in found], "_lang string, _share long")
    place = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(places))
    rows = labelled.join(F.broadcast(table), F.col("lang") == F.col("_lang")).where(place < F.col("_share"))  # a row a language
    return [lang for lang, _ in found], rows.drop("_lang", "_share")


def fit(labelled: DataFrame, p: LanguageParams) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(trigram cell | language), from (doc_id, text, lang).

    Rows without a label or a doc_id, and null or empty texts, add nothing; repeated rows count
    each; a table without labels gives no languages. What reaches the driver is a
    table of at most languages times cells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b in slices(batch.column("text")):
                found, begin = _cells(batch.column("text").slice(a, b - a), p.cells)
                for i in range(b - a):
                    own = sums.setdefault(langs[a + i], np.zeros(p.cells, np.int64))
                    own += np.bincount(found[begin[i] : begin[i + 1]], minlength=p.cells)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=["lang", "cell", "n"])

    languages, sample = sampled(labelled, p)
    sample = sample.select("lang", "text")
    counts = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()
    table = np.full((len(languages), p.cells), p.smoothing)
    for i, lang in enumerate(languages):
        own = rows[rows.lang == lang]
        table[i, own.cell] += own.n
    return languages, np.log(table / table.sum(axis=1, keepdims=True)) if languages else table


def text_scores(docs: DataFrame, languages: list[str], logs: np.ndarray, p: LanguageParams, carry: tuple[str, ...]) -> DataFrame:
    """``docs`` (doc_id and ``carry``) with ``scores``: tempered log-likelihoods, 0 at best."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(logs.astype(np.float32))  # languages x cells, whatever the corpus
    schema = docs.select("doc_id", *carry).schema.add("scores", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                found, begin = _cells(batch.column("text").slice(a, b - a), p.cells)
                sums = [np.concatenate(([0.0], np.cumsum(row[found], dtype=np.float64))) for row in table]
                scores = np.stack([s[begin[1:]] - s[begin[:-1]] for s in sums], axis=1) * p.temper
                scores -= scores.max(axis=1, keepdims=True)
                part = [batch.column(c).slice(a, b - a) for c in ("doc_id", *carry)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(list(scores), pa.list_(pa.float64()))], names=["doc_id", *carry, "scores"])
        trim()

    return docs.select("doc_id", *carry, "text").mapInArrow(run, schema)


def page_evidence(pages: DataFrame, doc_id: Column) -> DataFrame:
    """(doc_id, host, declared) of each page that shows a document."""
    host, _ = split_url()
    declared = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1))
    rows = pages.select(doc_id.alias("doc_id"), host.alias("host"), declared.alias("declared")).where("doc_id is not null")
    return rows.select("doc_id", F.nullif("host", F.lit("")).alias("host"), F.nullif("declared", F.lit("")).alias("declared"))


def _soft(scores: Column, n: int) -> Column:
    """Probabilities from log scores."""
    raw = F.zip_with(scores, F.array_repeat(F.array_max(scores), n), lambda x, top: F.exp(x - top))
    return F.zip_with(raw, F.array_repeat(_total(raw), n), lambda x, total: x / total)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(docs: DataFrame, evidence: DataFrame, languages: list[str], logs: np.ndarray, p: LanguageParams = LanguageParams()) -> DataFrame:
    """(doc_id, language, probability, text_language, declared, host) for each row of ``docs``.

    docs has ``doc_id``, ``text`` and ``source`` (stands for the host where
    ``evidence`` has none); evidence has doc_id, host and declared, a row a page.
    Every page counts for its host and declared language. For a document, what its
    pages say is averaged (as logarithms, since they are far from independent): declared
    languages over pages that declare one, suffixes and host priors over all. The
    ``declared`` and ``host`` returned are those of most pages. Other columns are ignored. Null or empty texts have equal
    likelihoods, so other evidence decides; documents without evidence or a
    null doc_id use what there is. Ties go to the language first in the
    alphabet. Repeated rows each get a row; an empty table gives none. Without
    languages (no labelled rows) all are null.
    """
    n = len(languages)
    if not n:
        empty = F.lit(None).cast("string")
        return docs.select("doc_id", empty.alias("language"), F.lit(None).cast("double").alias("probability"), empty.alias("text_language"), empty.alias("declared"), empty.alias("host"))
    scored = text_scores(docs, languages, logs, p, ("source",))
    evidence = cut(evidence.where("doc_id is not null").groupBy("doc_id", "host", "declared").agg(F.count("*").alias("n")), "pages")
    parts = F.split("host", r"\.")
    suffix = F.coalesce(F.element_at(parts, -1), F.lit(""))
    names = F.lit(languages)
    at = lambda c: F.nullif(F.array_position(names, c).cast("int"), F.lit(0)) - 1  # noqa: E731  place among the languages, or null
    spoken = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])
    known = F.when(F.col("declared").isNotNull(), F.coalesce(at(F.col("declared")), F.lit(n)))  # n: some other language
    told = evidence.select(F.col("doc_id").alias("_of"), known.alias("known"), at(F.try_element_at(spoken, suffix)).alias("speaks"), "n")
    told = told.groupBy("_of", "known", "speaks").agg(F.sum("n").alias("c"))
    told = told.groupBy("_of").agg(F.collect_list(F.struct("known", "speaks", "c")).alias("told"))  # at most a row for each two languages
    most = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("n", c)))[c]
    shows = evidence.groupBy(F.col("doc_id").alias("_doc")).agg(F.sum("n").alias("pages"), most("declared").alias("declared"), most("host").alias("host"))
    shows = shows.join(told, F.col("_doc") == F.col("_of")).drop("_of")
    rows = scored.join(shows, scored["doc_id"] == shows["_doc"], "left")
    elsewhere = F.coalesce(F.concat(F.lit("source:"), "source"), F.lit("none"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "scores", "declared", elsewhere.alias("elsewhere"), F.coalesce("host", elsewhere).alias("site"), F.coalesce("pages", F.lit(1)).alias("pages"), "told", _soft(F.col("scores"), n).alias("by_text"))
    rows = cut(rows, "evidence")

    # P(declared | language): one row for each known language, and one for all others
    pairs = rows.select("by_text", F.explode("told").alias("t")).where("t.known is not null")
    pairs = pairs.groupBy("t.known").agg(F.array(*[F.sum(F.col("by_text")[i] * F.col("t.c")) for i in range(n)]).alias("c"))
    seen = np.zeros((n + 1, n))
    for r in pairs.collect():  # a row a language
        seen[r["known"]] = r["c"]
    start = p.declared_weight * np.vstack([np.full((n, n), 0.1 / n) + (0.9 - 0.1 / n) * np.eye(n), np.full((1, n), 0.1 / n)])
    table = F.lit(np.log((seen + start) / (seen.sum(axis=0) + p.declared_weight)).tolist())
    none = F.array_repeat(F.lit(0.0), n)
    declares = F.filter("told", lambda t: t["known"].isNotNull())
    telling = F.aggregate(declares, F.lit(0).cast("long"), lambda x, t: x + t["c"])
    said = F.aggregate(declares, none, lambda x, t: F.zip_with(x, F.get(table, t["known"]), lambda y, z: y + t["c"] * z / telling))
    odds = lambda t: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == t["speaks"], math.log(p.suffix_odds) * t["c"] / F.col("pages")).otherwise(0.0))
    speaks = F.aggregate(F.filter("told", lambda t: t["speaks"].isNotNull()), none, lambda x, t: _plus(x, odds(t)))
    local = F.when(F.col("told").isNull(), F.col("scores")).otherwise(_plus(_plus(F.col("scores"), said), speaks))
    rows = rows.select("row", "doc_id", "declared", "elsewhere", "site", "pages", local.alias("local"), "by_text")
    rows = cut(rows.withColumn("own", _soft(F.col("local"), n)), "local")

    over = rows.agg(*[F.sum(F.col("own")[i]).alias(f"c{i}") for i in range(n)], F.count("*").alias("all")).first()
    prior = [((over[f"c{i}"] or 0.0) + p.prior_weight / n) / (over["all"] + p.prior_weight) for i in range(n)]
    k = p.prior_weight
    # (row, host) with the number of pages there; a document without pages stands for one
    hosts = evidence.groupBy(F.col("doc_id").alias("_doc"), "host").agg(F.sum("n").alias("n"))
    shown = rows.select("row", "doc_id", "elsewhere", "pages", "own").join(hosts, F.col("doc_id") == F.col("_doc"), "left")
    domain = F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2)))
    site = F.coalesce("host", "elsewhere")
    shown = cut(shown.select("row", "pages", "own", F.coalesce("n", F.lit(1)).alias("n"), site.alias("site"), F.coalesce(domain, site).alias("domain"), suffix.alias("suffix")), "shown")
    chain = cut(shown.groupBy("site", "domain", "suffix").agg(F.array(*[F.sum(F.col("own")[i] * F.col("n")) for i in range(n)]).alias("site_c"), F.sum("n").alias("site_n")), "sites")
    up = lambda key: chain.groupBy(key).agg(F.array(*[F.sum(F.col("site_c")[i]) for i in range(n)]).alias(f"{key}_c"), F.sum("site_n").alias(f"{key}_n"))
    chain = chain.join(up("domain"), "domain").join(up("suffix"), "suffix")
    smooth = lambda c, total, above: F.zip_with(c, above, lambda x, y: (x + k * y) / (F.col(total) + k))
    chain = chain.withColumn("by_suffix", smooth("suffix_c", "suffix_n", F.lit(prior))).withColumn("by_domain", smooth("domain_c", "domain_n", F.col("by_suffix")))
    chain = cut(chain.select(F.col("site").alias("_site"), F.col("domain").alias("_domain"), F.col("suffix").alias("_suffix"), "site_c", "site_n", "by_domain"), "priors")
    same = (shown["site"] == chain["_site"]) & (shown["domain"] == chain["_domain"]) & (shown["suffix"] == chain["_suffix"])
    others = [(F.col("site_c")[i] - F.col("own")[i] * F.col("n") + k * F.col("by_domain")[i]) / (F.col("site_n") - F.col("n") + k) for i in range(n)]
    expected = [F.sum(F.col("n") / F.col("pages") * F.log(F.greatest(others[i], F.lit(1e-12)))) for i in range(n)]
    expected = shown.join(chain, same).groupBy("row").agg(F.array(*expected).alias("expected"))
    out = rows.join(expected, "row").withColumn("posterior", _soft(_plus(F.col("local"), F.col("expected")), n))
    best = lambda of: F.get(names, F.array_position(of, F.array_max(of)).cast("int") - 1)
    return out.select(
        "doc_id",
        best(F.col("posterior")).alias("language"),
        F.round(F.array_max("posterior"), 6).alias("probability"),
        best(F.col("by_text")).alias("text_language"),
        "declared",
        F.col("site").alias("host"),
    )

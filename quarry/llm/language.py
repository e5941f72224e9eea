"""Language of web pages by Bayesian evidence fusion.

The posterior of a language joins the likelihood of the visible text (hashed
byte 4-grams, fitted on documents of known language), of the declared markup
language, of the address suffix and of a language code in the path, and a host
prior that is smoothed towards its domain's and the whole table's. Counts for
hosts, declarations and suffixes come from all pages by grouped aggregation of
what the text alone says; a page's own vote is taken out of its host's counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import slices, stored, texts

GRAM, BITS = 4, 16
#: A model has 2^BITS scores of four bytes for each language and is held by each worker: 256 MB for so many.
MOST_LANGS = 1000
#: Overlapping grams repeat their evidence, so the text's log-likelihood is divided by the gram length.
TEMPER = 1.0 / GRAM
OPENS = re.compile(r"<(?:(!--)|(script|style|noscript|template)\b)?", re.I)
CLOSES = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template")}
SPACE = re.compile(r"\s+")


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # langs x 2^BITS: log-odds against the mean of the languages


def visible_text(page: str) -> str:
    """Text outside tags, comments, scripts, styles and templates; one that nothing closes hides no more than its tag. Linear in the page."""
    out, at, missing = [], 0, set()

    def closed(what: str, begin: int) -> int:
        """Where the comment or element that begins here ends, or -1. What isn't found once isn't behind that place either."""
        if what in missing:
            return -1
        if what == "-->":
            end = page.find(what, begin)
            end = end + 3 if end >= 0 else -1
        else:
            found = CLOSES[what].search(page, begin)
            end = found.end() if found else -1
        if end < 0:
            missing.add(what)
        return end

    while opened := OPENS.search(page, at):
        out.append(page[at : opened.start()])
        end = closed("-->", opened.end()) if opened[1] else -1
        if end < 0:
            end = page.find(">", opened.end() if not opened[1] else opened.start()) + 1
            if not end:
                at = opened.start()
                break
            if opened[2]:
                end = max(end, closed(opened[2].lower(), end))
        out.append(" ")
        at = end
    out.append(page[at:])
    return SPACE.sub(" ", entities.unescape("".join(out))).strip()


def _grams(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < GRAM:
        return np.empty(0, np.int64)
    code = np.zeros(len(raw) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code = code << np.uint32(8) | raw[k : len(raw) - GRAM + 1 + k]
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)


def fit_languages(docs: DataFrame, per_lang: int = 400, max_chars: int = 20_000, lang: str = "lang") -> Model:
    """Gram scores from at most per_lang documents of each language, of at most max_chars characters.

    Documents are drawn by a hash of doc_id; languages are the distinct values
    of lang, of which there may be MOST_LANGS: more are no languages, and fail.
    Documents without a language don't count, null texts are empty; without
    any language the model knows none. Repeated rows count as often as drawn.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).alias("lang"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return Model([], np.zeros((0, 1 << BITS), np.float32))
    # Each task keeps its first per_lang rows of a language before the shuffle.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = known.withColumn("place", place).where(F.col("place") <= per_lang).select("doc_id", "lang")
    index = F.create_map(*[v for i, x in enumerate(langs) for v in (F.lit(x), F.lit(i))])
    # per_lang rows of two values for each language, whatever the input.
    sample = texts(docs).where(F.length("text") <= max_chars).join(F.broadcast(drawn.distinct()), "doc_id").select(index[F.col("lang")].alias("y"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                table[y] += np.bincount(_grams(text), minlength=1 << BITS)
        y, bucket = np.nonzero(table)
        yield pa.record_batch([pa.array(y), pa.array(bucket), pa.array(table[y, bucket])], names=["y", "bucket", "n"])

    rows = sample.mapInArrow(count, "y long, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), 1 << BITS))
    counts[rows["y"], rows["bucket"]] = rows["n"]
    share = np.log((counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True))
    return Model(langs, (share - share.mean(axis=0)).astype(np.float32))


def gram_scores(model: Model, grams: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Sum of the grams' scores by language; a long text in parts, so memory doesn't grow with it."""
    out = np.zeros(len(model.langs))
    for low in range(0, len(grams), at_once):
        out += model.scores[:, grams[low : low + at_once]].sum(axis=1, dtype=np.float64)
    return out


def _read(pages: DataFrame, model: Model, slice_bytes: int = 1 << 22) -> DataFrame:
    """page_id, url, declared and the tempered log-likelihoods of the visible text."""
    declared = re.compile(r"<html\b[^<>]{0,2000}?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "html", slice_bytes)):
            logs, said = [], []
            for page in part.column("html").to_pylist():
                found = declared.search(page)
                said.append(found[1].lower() if found else "")
                logs.append((TEMPER * gram_scores(model, _grams(visible_text(page)))).tolist())
            yield pa.record_batch(
                [part.column("page_id"), part.column("url"), pa.array(said, pa.string()), pa.array(logs, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "text_log"]
            )

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("url", "html")]
    return pages.select(F.col("page_id").cast("long").alias("page_id"), *blank).mapInArrow(run, "page_id long, url string, declared string, text_log array<double>")


def _votes(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Of each value of key: the votes by language (a map of at most as many entries as there are languages), and all of them."""
    counts = df.groupBy(key, "vote").agg(F.count("*").alias("c"))
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("vote", "c"))).alias(f"{prefix}_votes"), F.sum("c").alias(f"{prefix}_sum"))


def identify(pages: DataFrame, model: Model, strength: float = 5.0) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host for every page.

    A page without url or html, or with a host, suffix or declaration that no
    other page has, falls back to the evidence it does have, at last to the
    shares of the languages over all pages. Repeated rows are pages of their
    own; a null page_id stays. Of languages that are equally probable the
    first by name counts. Without known languages lang is null. An empty table
    gives no rows; other columns are ignored. Languages are elements of arrays,
    so the plan is as long for many of them as for few.
    """
    n = len(model.langs)
    if not n:
        return pages.select(
            F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"),
        )
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    read = _read(pages, model).select(
        "page_id", "declared", "text_log", host.alias("host"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
        F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1)).alias("path"),
        (F.array_position("text_log", F.array_max("text_log")) - 1).cast("int").alias("vote"),
    )
    read = stored(read, "pages")
    counted = {r["vote"]: r["c"] for r in read.groupBy("vote").agg(F.count("*").alias("c")).collect()}  # a row a language
    votes = [counted.get(i, 0) for i in range(n)]
    every = sum(votes)
    df = read.withColumns({"t_votes": F.array(*[F.lit(float(v)) for v in votes]), "overall": F.array(*[F.lit((v + 1) / (every + n)) for v in votes])})
    for key, prefix in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m"), ("path", "p")):
        # Joins, not broadcasts by hand: there may be as many hosts as pages, and Spark splits a hot one.
        df = df.join(_votes(read, key, prefix), key, "left")

    def log_posterior(log: Column, i: Column) -> Column:
        own = F.when(F.col("vote") == i, 1).otherwise(0)
        others = lambda p: F.coalesce(F.try_element_at(f"{p}_votes", i), F.lit(0)) - own
        domain = (others("d") + strength * F.get("overall", i)) / (F.col("d_sum") - 1 + strength)
        out = F.log((others("h") + strength * domain) / (F.col("h_sum") - 1 + strength)) + log
        for p in "smp":
            # Likelihood of this suffix, declaration or path code in pages of the language, smoothed by its share of all pages.
            share = (F.col(f"{p}_sum") - 1 + strength / n) / (every + strength)
            out = out + F.log((others(p) + strength * share) / (F.get("t_votes", i) + strength))
        return out

    post = df.withColumn("post", F.transform("text_log", log_posterior)).withColumn("top", F.array_max("post"))
    weight = F.aggregate(F.transform("post", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*map(F.lit, model.langs))
    return post.select(
        "page_id",
        F.element_at(names, F.array_position("post", F.col("top")).cast("int")).alias("lang"),
        (1 / weight).alias("probability"),
        F.element_at(names, F.col("vote") + 1).alias("text_lang"),
        "declared",
        "host",
    )

"""Toxicity by maximum-scoring segments of token log-odds.

Each word scores its log-odds between toxic and clean labelled texts, smoothed
by Dirichlet priors: a word's prior is centred on the share of its first
letters, whose own prior is the share of all words, so an unseen word of a
known stem is still told. A drift is taken off, and the linear-time scan of
all maximal segments (Ruzzo and Tompa, 1999) finds every passage whose score
can't be raised by extending or cutting it. Segment scores are calibrated by
the extreme-value distribution of such maxima (Karlin and Altschul, 1990): a
passage becomes an expected number of as good passages in clean text of that
length, the sum of a text's r best ones has a tail probability too (1993), the
least probable r counts, and a logistic fit turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import flat_bytes, slices, stored, texts
from quarry.llm.words import prefix_sums, span_hashes, word_spans

WORD_BITS, STEM_BITS, STEM_BYTES = 18, 16, 4
ALPHA, DRIFT = 2.0, 1.0
EULER = 0.5772156649


@dataclass
class Model:
    counts: np.ndarray  # 2 x words: clean, toxic
    stem_share: np.ndarray  # share of toxic by stem bucket
    log_ratio: float  # log of toxic over clean words
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    slope: float = 1.0
    intercept: float = 0.0


def _buckets(raw: np.ndarray, offsets: np.ndarray):
    begin, end, n = word_spans(raw, offsets)
    sums = prefix_sums(raw)
    word = (span_hashes(sums, begin, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    stem = (span_hashes(sums, begin, np.minimum(end, begin + STEM_BYTES)) >> np.uint64(64 - STEM_BITS)).astype(np.int64)
    return begin, end, n, word, stem


def token_scores(model: Model, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
    share = model.stem_share[stem]
    clean, toxic = model.counts[0][word], model.counts[1][word]
    return np.log((toxic + ALPHA * share) / (clean + ALPHA * (1 - share))) - model.log_ratio - DRIFT


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [first, last) of a sequence, by the linear-time scan."""
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    total = np.cumsum(score)
    rights = total[up].tolist()
    lefts = (total[up] - score[up]).tolist()
    stack: list[list] = []  # first, last, cumulative left, cumulative right, link to the nearest entry with a smaller left
    for i, left, right in zip(up.tolist(), lefts, rights, strict=True):
        first = i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([first, i + 1, left, right, j])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - x) for a, b, x, r, _ in stack]


def _best(model: Model, raw: np.ndarray, offsets: np.ndarray):
    """Words by text, and for each text its segments as (first byte, last byte, score)."""
    begin, end, n, word, stem = _buckets(raw, offsets)
    score = token_scores(model, word, stem)
    at, found = 0, []
    for k, low in zip(n.tolist(), offsets[:-1].tolist(), strict=True):
        segments = maximal_segments(score[at : at + k])
        found.append([(int(begin[at + a]) - low, int(end[at + b - 1]) - low, s) for a, b, s in segments])
        at += k
    return n, found, score


def evidence(model: Model, n: np.ndarray, scores: list[list[float]]) -> np.ndarray:
    """By text: -log of the chance that a clean text of n words has passages as good, over the r best ones for the r that tells most.

    x = the sum of rate * score - log(size * n) over the r best passages has the
    tail exp(-x) x^(r-1) / (r! (r-1)!). Without passages the score 0 counts.
    """
    floor = np.log(model.size * np.maximum(n, 1))
    out = -floor
    for i, own in enumerate(scores):
        x = fact = 0.0
        for r, s in enumerate(sorted(own, reverse=True), 1):
            y = model.rate * s - floor[i]
            if r == 1:
                x = out[i] = y
                continue
            if y <= 0 or x <= 0:
                break  # passages that clean text has anyway add nothing
            x += y
            fact += math.log(r) + math.log(r - 1)
            out[i] = max(out[i], x - (r - 1) * math.log(x) + fact)
    return out


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))


def solve_rate(score: np.ndarray) -> float:
    """lambda > 0 with mean(exp(lambda * score)) = 1 for scores of negative mean; 1 where there is none."""
    if not len(score) or score.mean() >= 0 or score.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while np.exp(np.minimum(high * score, 700)).mean() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(np.minimum(mid * score, 700)).mean() < 1 else (low, mid)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Newton steps with a small ridge; classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    a, mean, sd = np.zeros(2), x.mean(), x.std() + 1e-9
    design = np.stack([(x - mean) / sd, np.ones(len(x))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        g = design.T @ (weight * (y - p)) - ridge * a
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        a = a + np.linalg.solve(h, g)
    return float(a[0] / sd), float(a[1] - a[0] * mean / sd)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: str, per_label: int = 4000, label: str = "toxic") -> Model:
    """A model from at most 2 * per_label labelled rows that meet the SQL condition train, drawn by a hash of doc_id.

    Two thirds of them give counts, by Spark, into tables of fixed size; the
    last third calibrates, a few numbers for each row, 2 * per_label rows at
    most. Null texts are empty; labels that are neither 0 nor 1, and ids without
    a document, don't count; without labels, or with one label alone, every
    text scores a half or so. Whole texts of any length count.
    """
    ids = labels.where(F.expr(train)).where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    drawn = [ids.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    fold = (F.pmod(F.hash(F.col("doc_id"), F.lit("fold")), F.lit(3)) == 0).alias("calibrates")
    # At most 2 * per_label rows of a few numbers, whatever the input.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]).distinct().select("doc_id", "label", fold))
    sample = stored(texts(docs).join(chosen, "doc_id").select("label", "calibrates", "text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = np.zeros((2, 1 << WORD_BITS), np.int64), np.zeros((2, 1 << STEM_BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                raw, offsets = flat_bytes(part.column("text"))
                _, _, n, word, stem = _buckets(raw, offsets)
                y = np.repeat(part.column("label").to_numpy(), n)
                for k in (0, 1):
                    words[k] += np.bincount(word[y == k], minlength=1 << WORD_BITS)
                    stems[k] += np.bincount(stem[y == k], minlength=1 << STEM_BITS)
        for kind, t in ((0, words), (1, stems)):
            used = np.flatnonzero(t.any(axis=0))
            yield pa.record_batch(
                [pa.array(np.full(len(used), kind, np.int32)), pa.array(used), pa.array(t[0][used]), pa.array(t[1][used])], names=["kind", "bucket", "clean", "toxic"]
            )

    counted = sample.where(~F.col("calibrates")).select("label", "text").mapInArrow(count, "kind int, bucket long, clean long, toxic long")
    table = counted.groupBy("kind", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    words, stems = np.zeros((2, 1 << WORD_BITS), np.float32), np.zeros((2, 1 << STEM_BITS), np.float64)
    for kind, t in ((0, words), (1, stems)):
        rows = table[table["kind"] == kind]
        t[0][rows["bucket"]], t[1][rows["bucket"]] = rows["clean"], rows["toxic"]
    total = words.sum(axis=1, dtype=np.float64) + 1
    share = total[1] / total.sum()
    model = Model(words, ((stems[1] + ALPHA * share) / (stems.sum(axis=0) + ALPHA)).astype(np.float32), float(np.log(total[1] / total[0])))

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n, found, score = _best(model, *flat_bytes(part.column("text")))
                parts = np.split(score, np.cumsum(n)[:-1])
                # Of each text, how its scores spread: enough to solve for the rate over all of them.
                bins = [np.bincount(np.clip(np.round((s + 16) * 8), 0, 255).astype(int), minlength=256).astype(np.int32) for s in parts]
                best = [max((s for _, _, s in f), default=0.0) for f in found]
                yield pa.record_batch(
                    [
                        part.column("label"), pa.array(n.astype(np.int64)), pa.array(best, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 256), pa.array(np.concatenate(bins))),
                    ],
                    names=["label", "n", "best", "bins"],
                )

    # One row a drawn id; where ids repeat, so many rows and no more reach the driver.
    held = sample.where("calibrates").orderBy(F.xxhash64("text"), "label").limit(2 * per_label).select("label", "text")
    tried = held.mapInArrow(trial, "label int, n long, best double, bins array<int>").toPandas()
    if len(tried):
        clean, n = tried["label"].to_numpy() == 0, tried["n"].to_numpy()
        spread = np.sum(np.stack(tried["bins"].to_numpy())[clean], axis=0) if clean.any() else np.zeros(256, int)
        model.rate = solve_rate(np.repeat(np.arange(256) / 8 - 16, np.ceil(spread * min(1, 1e6 / max(1, spread.sum()))).astype(int)))
        if clean.any():
            # The mean of a Gumbel maximum is (log(K n) + Euler's constant) / lambda.
            model.size = float(np.exp(np.clip(np.mean(model.rate * tried["best"].to_numpy()[clean] - np.log(np.maximum(n[clean], 1))) - EULER, -20, 5)))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The evidence that scores are made of, by all passages of a text, with the rate and size of above."""
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    n, found, _ = _best(model, *flat_bytes(part.column("text")))
                    x = evidence(model, n, [[s for _, _, s in f] for f in found])
                    yield pa.record_batch([part.column("label"), pa.array(x, pa.float64())], names=["label", "x"])

        rows = held.mapInArrow(told, "label int, x double").toPandas()
        model.slope, model.intercept = _logistic(rows["x"].to_numpy(), rows["label"].to_numpy())
        model.slope = max(model.slope, 1e-3)
    return model


def score_toxicity(docs: DataFrame, model: Model, significance: float = 0.05, slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, score, passages: every significant passage of each whole text as (start, end in UTF-8 bytes, score, expected).

    expected is the number of such passages expected in clean text of the same
    length; passages where it is at most the significance are significant. The
    score is of all passages together. Null and empty texts and texts without words have no passage and
    the score of no evidence. An empty table gives no rows; repeated rows are
    scored each; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                n, found, _ = _best(model, *flat_bytes(part.column("text")))
                told = evidence(model, n, [[s for _, _, s in f] for f in found])
                passages = []
                for f, k in zip(found, n.tolist(), strict=True):
                    scale = model.size * max(k, 1)
                    least = (math.log(scale) - math.log(significance)) / model.rate
                    passages.append([{"start": a, "end": b, "score": s, "expected": scale * math.exp(-model.rate * s)} for a, b, s in f if s >= least])
                yield pa.record_batch([part.column("doc_id"), pa.array(probability(model, told)), pa.array(passages, kind)], names=["doc_id", "score", "passages"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<start:long,end:long,score:double,expected:double>>")

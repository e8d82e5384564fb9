"""Toxic passages by maximum-scoring segments over token log-odds.

A token's log-odds of standing in a toxic document come from labelled rows, smoothed by nested
Dirichlet priors: a whole word leans on its 7-letter beginning, that on the 6-letter one, and so
on down to the share of all tokens. A linear scan (Ruzzo and Tompa) finds every maximal segment
of the token scores. How high the best segment of a clean text gets is an extreme value: its
Gumbel parameters turn segment scores into significances, which a small logistic model turns
into one score per document.

The model is fitted on at most ``max_rows`` labelled rows of each class, those with the smallest
hashes of doc_id; significances and the logistic model use out-of-fold token scores of those rows.
Log-odds ratios and the clean texts' extreme values do not depend on how many rows of each class
are taken. The logistic model does, so it weighs the rows of a class by the labels they stand for,
and a score means the same whether a class was cut or not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, process_store, written

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 3
SIGNIFICANT = 3.0
# What a word without evidence takes from a segment, so that segments end.
DRIFT = 0.02


@dataclass
class ToxicityModel:
    """Feature scores (whole words as "=word", else beginnings) and calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    gumbel: tuple[float, float] = (1.0, 1.0)
    weights: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)


def features(word: str) -> list[str]:
    """From the most general to the whole word."""
    return [word[:n] for n in BEGINNINGS if len(word) >= n] + ["=" + word]


def token_scores(words: list[str], scores: dict[str, float], seen: dict[str, float]) -> np.ndarray:
    """Each word has the score of its most specific known feature."""
    if len(seen) > 300_000:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = next((scores[f] for f in reversed(features(w)) if f in scores), -DRIFT)
    return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))


def best_segment(scores: np.ndarray) -> tuple[float, int, int]:
    """(score, start, end) of the segment with the largest sum; (0, 0, 0) if none is positive."""
    if not len(scores):
        return 0.0, 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    if gain[end] <= 0:
        return 0.0, 0, 0
    return float(gain[end]), int(total[: end + 1].argmin()), end


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, start, end), left to right, in linear time."""
    total, stack = 0.0, []  # stack entries: sum before, sum after, start, end
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, right, start, end = before, total, i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, start, end, j))
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(r - l, a, b) for l, r, a, b, _ in stack]


def _evidence(words: list[str], scores: dict, seen: dict, gumbel: tuple[float, float]):
    """(x, best, segments): regressors, the best segment, significant segments."""
    tokens = token_scores(words, scores, seen)
    best = best_segment(tokens)
    rate, k = gumbel
    size = math.log(k * max(len(words), 1))
    level = rate * best[0] - size
    found = []
    if level > SIGNIFICANT:
        found = [s for s in maximal_segments(tokens.tolist()) if rate * s[0] - size > SIGNIFICANT]
    rest = sum(rate * s[0] - size for s in found) - (level if found else 0)
    x = (1.0, max(level, -10.0) / 5, math.log1p(max(rest, 0.0)), float(tokens.mean()) * 5 if len(words) else 0.0)
    return x, best, found


def _counts(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    process_store("toxicity")  # nothing is kept; what the worker holds of other jobs goes
    for chunk in in_chunks(chunks, "text"):
        counts: dict[tuple[int, int], Counter] = {}
        for text, toxic, fold in zip(*(chunk.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
            words = WORD.findall((text or "").lower())
            mine = counts.setdefault((fold, toxic), Counter())
            mine[""] += len(words)
            mine.update({f for w in set(words) for f in features(w)})  # documents, not places
        rows = [(f, fold, toxic, n) for (fold, toxic), c in counts.items() for f, n in c.items()]
        for at in range(0, len(rows), 100_000):
            part = list(zip(*rows[at : at + 100_000]))
            yield pa.record_batch(
                [pa.array(part[0]), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.int64())],
                ["feature", "fold", "toxic", "n"],
            )


def log_odds(
    counts: dict[str, tuple[int, int]], totals: tuple[int, int], prior: float, z_least: float = 5.0
) -> dict[str, float]:
    """Scores of features from their numbers of (toxic, other) documents.

    The prior of a feature is centred on the next shorter one. A feature that differs from it by
    less than z_least standard deviations says nothing of its own and takes its score; else the
    noise of many rare words would add up over a long text.
    """
    base = totals[0] / max(sum(totals), 1)
    if not 0 < base < 1:
        return {}
    share: dict[str, float] = {}
    # short beginnings first, so that a prior is ready when a longer feature needs it
    for f in sorted(counts, key=lambda f: (f[0] == "=", len(f))):
        word = f.lstrip("=")
        parents = [word[:n] for n in reversed(BEGINNINGS) if n < len(word) or (f[0] == "=" and n == len(word))]
        mean = next((share[p] for p in parents if p in share), base)
        a, b = counts[f]
        z = (a - (a + b) * mean) / math.sqrt((a + b) * mean * (1 - mean) + 1e-9)
        share[f] = (a + prior * mean) / (a + b + prior) if abs(z) > z_least else mean
    odds = {f: math.log(p / (1 - p)) - math.log(base / (1 - base)) for f, p in share.items()}
    return {f: v - DRIFT for f, v in odds.items() if abs(v) > 1e-9 or f[0] != "="}


def _fit_gumbel(best: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Rate and K of P(best >= x) = 1 - exp(-K size exp(-rate x)) by maximum likelihood."""
    if len(best) < 20:
        return 1.0, 0.1
    top = (-math.inf, 1.0, 0.1)
    for rate in np.linspace(0.1, 4.0, 79):
        k = len(best) / (size * np.exp(-rate * best)).sum()
        fit = (np.log(rate * k * size) - rate * best - k * size * np.exp(-rate * best)).sum()
        top = max(top, (float(fit), float(rate), float(k)))
    return top[1], top[2]


def _fit_logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """rows: how many rows each one stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (rows * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, order), one row for each id. Those whose crc32(doc_id) mod 5 is 0 are held out."""
    return (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id"))
    )


def labelled_sample(docs: DataFrame, known: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most max_rows training labels of each class.

    The chosen ids are bounded by 2 x max_rows, so they can be broadcast; the documents are
    scanned once and not shuffled.
    """
    chosen = [known.filter(F.col("toxic") == t).orderBy("order", "doc_id").limit(max_rows) for t in (0, 1)]
    chosen = chosen[0].unionAll(chosen[1]).select("doc_id", "toxic", F.pmod("order", F.lit(FOLDS)).cast("int").alias("fold"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_features: int = 100_000, prior: float = 4.0
) -> ToxicityModel:
    """Learns the model. Without labelled rows of both classes it scores every text alike, low."""
    spark = docs.sparkSession
    # only labels with a document, so that the counts are those the sample is drawn from
    known = written(training_labels(labels).join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi"))
    stands_for = {r["toxic"]: max(1.0, r["count"] / max_rows) for r in known.groupBy("toxic").count().collect()}
    sample = written(labelled_sample(docs, known, max_rows))
    per_fold = [
        F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{k}_{t}")
        for k in range(FOLDS)
        for t in (1, 0)
    ]
    counts = sample.mapInArrow(_counts, "feature string, fold int, toxic int, n long").groupBy("feature").agg(*per_fold)
    total = sum(F.col(f"n{k}_{t}") for k in range(FOLDS) for t in (1, 0))
    toxic = sum(F.col(f"n{k}_1") for k in range(FOLDS))
    rows = (
        counts.filter((total >= 4) | (F.col("feature") == ""))
        .orderBy((F.col("feature") == "").desc(), toxic.desc(), total.desc(), "feature")
        .limit(max_features)
        .collect()
    )
    table = {r[0]: np.array(r[1:]).reshape(FOLDS, 2) for r in rows}
    sums = table.pop("", np.zeros((FOLDS, 2), np.int64))
    if not sums.sum(axis=0).all():
        return ToxicityModel()

    def learned(folds: list[int]) -> dict[str, float]:
        return log_odds({f: tuple(n[folds].sum(axis=0).tolist()) for f, n in table.items()}, tuple(sums[folds].sum(axis=0).tolist()), prior)

    out_of_fold = spark.sparkContext.broadcast([learned([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)])

    def evidence(gumbel):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = [{} for _ in range(FOLDS)]
            for chunk in in_chunks(batches, "text"):
                out = []
                for text, toxic, fold in zip(*(chunk.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                    words = WORD.findall((text or "").lower())
                    x, best, _ = _evidence(words, out_of_fold.value[fold], seen[fold], gumbel)
                    out.append((toxic, float(max(len(words), 1)), best[0], *x))
                yield pa.record_batch([pa.array(c, pa.float64()) for c in zip(*out)], list("abcdefg"))

        return np.array(sample.mapInArrow(run, ", ".join(f"{c} double" for c in "abcdefg")).collect(), float).reshape(-1, 7)

    first = evidence((1.0, 1.0))
    clean = (first[:, 0] == 0) & (first[:, 2] > 0)
    gumbel = _fit_gumbel(first[clean, 2], first[clean, 1])
    second = evidence(gumbel)
    weights = _fit_logistic(second[:, 3:], second[:, 0], np.array([stands_for[t] for t in second[:, 0]]))
    out_of_fold.unpersist()
    return ToxicityModel(learned(list(range(FOLDS))), gumbel, weights)


def _scorer(model: ToxicityModel):
    def score(texts: list, seen: dict) -> list[tuple]:
        out = []
        for text in texts:
            words = WORD.findall((text or "").lower())
            x, best, found = _evidence(words, model.scores, seen, model.gumbel)
            z = sum(a * b for a, b in zip(x, model.weights))
            out.append((1 / (1 + math.exp(-max(min(z, 30.0), -30.0))), len(found), best[1], best[2]))
        return out

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages, and the first and
    last word (exclusive) of the worst passage. Null and empty texts get the score of no evidence."""
    spark = docs.sparkSession
    shared, score = spark.sparkContext.broadcast((model.scores, model.gumbel, model.weights)), _scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, scorer = {}, score(ToxicityModel(*shared.value))
        for chunk in in_chunks(batches, "text"):
            scores, n, a, b = zip(*scorer(chunk.column("text").to_pylist(), seen))
            yield pa.record_batch(
                [chunk.column("doc_id"), pa.array(scores, pa.float64()), *(pa.array(x, pa.int64()) for x in (n, a, b))],
                ["doc_id", "score", "n_passages", "worst_first", "worst_end"],
            )

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, n_passages long, worst_first long, worst_end long"
    )
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_passages", "worst_first", "worst_end",
    )


def without_toxic(docs: DataFrame, model: ToxicityModel, at_least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose score is below at_least."""
    shared, score = docs.sparkSession.sparkContext.broadcast((model.scores, model.gumbel, model.weights)), _scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_store("toxicity")
        seen, scorer = {}, score(ToxicityModel(*shared.value))
        for chunk in in_chunks(batches, "text"):
            scores = scorer(chunk.column("text").to_pylist(), seen)
            yield chunk.filter(pa.array([s[0] < at_least for s in scores]))

    return docs.mapInArrow(run, docs.schema)



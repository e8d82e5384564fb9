"""Scores of texts under a log-bilinear language model, trained by noise-contrastive estimation.

The model predicts a word from the two before it: the vectors of both, each through a matrix of
its position, add up to a prediction, and a word's score is the product of its own vector with
that, and a bias. Words beyond the vocabulary share one entry, and within it go by their smoothed
frequency, so probabilities of all words sum to one.

Noise-contrastive training tells the corpus from words drawn by frequency and needs no
normaliser. Every training token is used: the corpus is dealt to tasks, each takes its share of a
round from the same parameters, and Spark averages what they return before the next round.

Scoring is normalised exactly. The score of a word after (v, u) is A[u, word] + B[v, word], two
products of parameter matrices, so one more product of their exponentials gives the normaliser of
every context.

Word counts are kept for all words: a bounded number of frequent ones is broadcast, the rest meets
its counts in a join.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, process_store, written
from .words import LOWER_CASED, split_words

# Fixed values of the smoothed frequencies and of the split.
SMOOTHING = 0.1
FOLDS = 10

END, RARE, FIRST_WORD = 0, 1, 2
VOCABULARY = 2048
VECTOR = 24
FREQUENT_WORDS = 1 << 18
FREQUENT_BYTES = 64
CHUNK_BYTES = 16 << 20
NUMBER_BYTES = 2 << 20

ROUNDS = 4
TASK_TOKENS = 2_000_000
BATCH = 2048
NOISE = 32
RATE = 0.4
BUCKETS_PER_DOUBLING = 32


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


# --- counts -------------------------------------------------------------------


@dataclass(frozen=True, slots=True)
class Counts:
    """Counts over the training texts: of all words as a table, of frequent ones also in memory."""

    words: DataFrame  # word, train, total
    frequent: pa.Array  # by falling training count
    frequent_counts: np.ndarray
    texts: int
    tokens: int
    distinct: int


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def count_words(documents: DataFrame, frequent_words: int = FREQUENT_WORDS) -> Counts:
    """Counts every word of every text. Tasks count chunk by chunk, Spark adds up by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text", CHUNK_BYTES):
            words, lengths = split_words(batch.column("text"), LOWER_CASED)
            coded = words.dictionary_encode()
            number, n = coded.indices.to_numpy(), len(coded.dictionary)
            learns = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), lengths)
            columns = [coded.dictionary.cast(pa.string()), np.bincount(number[learns], minlength=n), np.bincount(number, minlength=n)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["word", "train", "total"])

    texts = _texts(documents)
    parts = texts.mapInArrow(run, "word string, train long, total long")
    words = written(parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total")))
    n_texts = texts.filter(~F.col("held_out")).count()
    n_words, distinct = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    # The frequent words are those above a count that not too many reach.
    short = words.filter(F.octet_length("word") <= FREQUENT_BYTES)
    level = F.floor(F.log2("total") * BUCKETS_PER_DOUBLING)
    room, least = frequent_words, None
    for bucket, n in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = bucket
    chosen = short.filter(level >= least if least is not None else F.lit(False)).toArrow()
    frequent, train = chosen.column("word").combine_chunks(), chosen.column("train").to_numpy()
    order = np.lexsort((np.array(frequent.to_pylist(), object), -train)) if len(train) else np.zeros(0, np.int64)
    return Counts(
        words, frequent.take(pa.array(order)).cast(pa.large_string()), train[order].astype(np.int64),
        n_texts, n_words + n_texts, distinct + (n_texts > 0),
    )


def _by_text(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, values, n).astype(np.float64)


def _numbered(documents: DataFrame, counts: Counts, vocabulary: int) -> DataFrame:
    """One row for each text: row, doc_id, held_out, n_tokens, the numbers of its tokens as 16-bit
    integers, the counted part of its frequent words, and its rare words with repeats."""
    shared = documents.sparkSession.sparkContext.broadcast((counts.frequent, counts.frequent_counts, counts.texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, learned, texts = shared.value
        logs, end = np.log10(learned + SMOOTHING), math.log10(texts + SMOOTHING)
        listed = min(len(learned), vocabulary - FIRST_WORD)
        listed = int(np.count_nonzero(learned[:listed]))  # words of the training texts only
        for batch in in_chunks(batches, "text"):
            words, lengths = split_words(batch.column("text"), LOWER_CASED)
            found = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy().astype(np.int64)
            n, ends = len(lengths), np.cumsum(lengths + 1)
            text = np.repeat(np.arange(n), lengths)
            ids = np.full(int(ends[-1]) if n else 0, END, "<u2")
            place = np.arange(len(found)) + text  # an end stands after each text before
            ids[place] = np.where((found >= 0) & (found < listed), found + FIRST_WORD, RARE)
            has, beyond = found >= 0, found >= listed
            known = _by_text(text[has], learned[found[has]] > 0, n).astype(np.int64) + (texts > 0)
            log = _by_text(text[has], logs[found[has]], n) + end
            log_rare = _by_text(text[beyond], logs[found[beyond]], n)
            lost = words.filter(pa.array(~has)).dictionary_encode()
            width = max(1, len(lost.dictionary))
            pairs, repeats = np.unique(text[~has] * width + lost.indices.to_numpy(), return_counts=True)
            rows, word = np.divmod(pairs, width)
            bounds = np.searchsorted(rows, np.arange(n + 1))
            rare = pa.StructArray.from_arrays(
                [lost.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(repeats.astype(np.int64))], ["word", "repeats"]
            )
            starts = ends - lengths - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"),
                    pa.array(lengths.astype(np.int64) + 1),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array(known), pa.array(log), pa.array(log_rare),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rare),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "ids", "known", "log", "log_rare", "rare"],
            )

    return written(
        _texts(documents).withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            run,
            "row long, doc_id long, held_out boolean, n_tokens long, ids binary, known long, log double, "
            "log_rare double, rare array<struct<word string, repeats long>>",
        )
    )


# --- the model ----------------------------------------------------------------


@dataclass(slots=True)
class LogBilinear:
    """context, own: a row for each word; near, far: the matrices of the last word and the one before."""

    context: np.ndarray
    own: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def start(cls, frequency: np.ndarray, size: int, seed: int = 3) -> LogBilinear:
        """Small random vectors and biases that give the words' own frequencies."""
        draw, n = np.random.default_rng(seed), len(frequency)
        small = lambda *shape: draw.standard_normal(shape) * 0.1
        return cls(small(n, size), small(n, size), np.log(frequency), np.eye(size), np.eye(size))

    def stacked(self) -> np.ndarray:
        """All parameters as rows of one length."""
        return np.vstack([self.context, self.own, self.near, self.far, np.resize(self.bias, (-(-len(self.bias) // self.near.shape[0]), self.near.shape[0]))])

    @classmethod
    def unstacked(cls, rows: np.ndarray, words: int) -> LogBilinear:
        size = rows.shape[1]
        a, b, c = 2 * words, 2 * words + size, 2 * words + 2 * size
        return cls(rows[:words], rows[words:a], rows[c:].ravel()[:words], rows[a:b], rows[b:c])

    def prediction(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.context[last] @ self.near + self.context[before] @ self.far

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A, B, L): the log probability of w after (v, u) is A[u, w] + B[v, w] - L[u, v]."""
        a = self.context @ self.near @ self.own.T + self.bias
        b = self.context @ self.far @ self.own.T
        top_a, top_b = a.max(axis=1, keepdims=True), b.max(axis=1, keepdims=True)
        total = np.exp(a - top_a) @ np.exp(b - top_b).T
        return a.astype(np.float32), b.astype(np.float32), (np.log(total) + top_a + top_b.T).astype(np.float32)


class Trainer:
    """Noise-contrastive steps from a model on, with AdaGrad's step sizes."""

    def __init__(self, model: LogBilinear, frequency: np.ndarray, rate: float, seed: list[int]):
        self.params = [p.astype(np.float32) for p in (model.context, model.own, model.bias, model.near, model.far)]
        self.squares = [np.full(p.shape, 1e-2, np.float32) for p in self.params]
        self.log_noise = np.log(frequency * NOISE).astype(np.float32)
        self.steps, self.rate, self.draw = np.cumsum(frequency), rate, np.random.default_rng(seed)

    def model(self) -> LogBilinear:
        return LogBilinear(*(p.astype(np.float64) for p in self.params))

    def learn(self, contexts: np.ndarray) -> None:
        """One pass over rows of (before, last, word), in random order."""
        context, own, bias, near, far = self.params
        n, size = own.shape
        columns = np.arange(size)

        def scattered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
            sums = np.bincount((rows[:, None] * size + columns).ravel(), values.ravel(), n * size)
            return sums.reshape(n, size).astype(np.float32)

        contexts = self.draw.permutation(contexts)
        for at in range(0, len(contexts), BATCH):
            before, last, word = contexts[at : at + BATCH].T
            noise = np.searchsorted(self.steps, self.draw.random(NOISE) * self.steps[-1], side="right")
            noise = np.minimum(noise, n - 1)
            c_near, c_far = context[last], context[before]
            guess = c_near @ near + c_far @ far
            own_word, own_noise = own[word], own[noise]
            real = (guess * own_word).sum(axis=1) + bias[word] - self.log_noise[word]
            false = guess @ own_noise.T + bias[noise] - self.log_noise[noise]
            # by score, what raises the chance of telling words from noise
            d_real = 1 / (1 + np.exp(np.clip(real, -30, 30)))
            d_false = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
            d_guess = d_real[:, None] * own_word + d_false @ own_noise
            d_own = scattered(word, d_real[:, None] * guess)
            np.add.at(d_own, noise, d_false.T @ guess)
            d_bias = np.bincount(word, d_real, n) + np.bincount(noise, d_false.sum(axis=0), n)
            d_context = scattered(np.concatenate([last, before]), np.concatenate([d_guess @ near.T, d_guess @ far.T]))
            gradients = d_context, d_own, d_bias.astype(np.float32), c_near.T @ d_guess, c_far.T @ d_guess
            for p, s, g in zip(self.params, self.squares, gradients):
                g /= len(word)
                s += g * g
                p += self.rate * g / np.sqrt(s)


def contexts_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(before, last, word) for every token; texts end at ``ends`` and start after two END."""
    place = np.arange(len(ids))
    start = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    far = np.where(place - 2 >= start, ids[np.maximum(place - 2, 0)], END)
    near = np.where(place - 1 >= start, ids[np.maximum(place - 1, 0)], END)
    return np.stack([far, near, ids], axis=1).astype(np.int64)


def _token_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.cumsum([len(r) // 2 for r in raw])


def fit_model(numbered: DataFrame, frequency: np.ndarray, tokens: int, rounds: int = ROUNDS, rate: float = RATE) -> LogBilinear:
    """Rounds of local training on all texts of the training part, a share of them in each, averaged by tokens."""
    spark, n = numbered.sparkSession, len(frequency)
    model = LogBilinear.start(frequency, VECTOR)
    names = [f"v{j}" for j in range(VECTOR)]
    tasks = -(-tokens // TASK_TOKENS)
    for turn in range(rounds):
        mine = numbered.filter(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn)).select("ids")
        shared, step = spark.sparkContext.broadcast(model), rate / math.sqrt(1 + turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, seen = Trainer(shared.value, frequency, step, [turn, TaskContext.get().partitionId()]), 0
            for batch in in_chunks(batches, "ids", NUMBER_BYTES):
                ids, ends = _token_numbers(batch.column("ids"))
                trainer.learn(contexts_of(ids, ends))
                seen += len(ids)
            if seen:
                rows = trainer.model().stacked()
                columns = [np.arange(len(rows)), np.full(len(rows), seen), *rows.T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["r", "seen", *names])

        parts = mine.coalesce(max(1, tasks)).mapInArrow(run, ", ".join(["r long, seen long", *(f"{c} double" for c in names)]))
        mean = [(F.sum(F.col(c) * F.col("seen")) / F.sum("seen")).alias(c) for c in names]
        rows = parts.groupBy("r").agg(*mean).collect()
        if rows:
            model = LogBilinear.unstacked(np.array([r[1:] for r in sorted(rows)]), n)
        shared.unpersist()
    return model


# --- scores -------------------------------------------------------------------


def score_texts(
    documents: DataFrame, vocabulary: int = VOCABULARY, frequent_words: int = FREQUENT_WORDS, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of documents.

    documents has doc_id and text; ids may be null or repeat. Learned from are the rows that are
    not held out. Null and blank texts consist of the end alone. Without a training row every
    token has probability 1. No rows for an empty table.
    """
    counts = count_words(documents, frequent_words)
    numbered = _numbered(documents, counts, vocabulary)
    listed = counts.frequent_counts[: vocabulary - FIRST_WORD]
    listed = listed[listed > 0]
    covered = int(listed.sum()) + counts.texts
    # The rare entry: all words beyond the vocabulary, and the smoothed share of one never seen.
    rare_mass = counts.tokens - covered + SMOOTHING * (counts.distinct - len(listed) - (counts.texts > 0) + 1)
    weights = np.concatenate([[max(counts.texts, SMOOTHING), rare_mass], listed])
    frequency = weights / weights.sum()
    model = fit_model(numbered, frequency, counts.tokens, rounds)
    total = math.log10(counts.tokens + SMOOTHING * (counts.distinct + 1))
    name, learned = uuid.uuid4().hex, counts.tokens > 0
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = process_store("log_bilinear")
        if name not in store:
            store.clear()
            store[name] = shared.value.tables()
        a, b, normaliser = store[name]
        for batch in in_chunks(batches, "ids", NUMBER_BYTES):
            ids, ends = _token_numbers(batch.column("ids"))
            before, last, word = contexts_of(ids, ends).T
            each = a[last, word].astype(np.float64) + b[before, word] - normaliser[last, before]
            text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            log = _by_text(text, each, len(ends)) / math.log(10)
            rare = _by_text(text, word == RARE, len(ends)) * math.log10(rare_mass)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(log - rare)], [*kept, "model"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "log", "log_rare"]
    texts = numbered.select(*kept, "ids").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, log double, log_rare double, model double"
    )
    seen = F.coalesce("train", F.lit(0))
    rest = (
        numbered.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.repeats")
        .join(counts.words.select("word", "train"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("repeats") * F.log10(seen + SMOOTHING)).alias("rest"),
            F.sum(F.when(seen > 0, F.col("repeats")).otherwise(0)).alias("rest_known"),
        )
    )
    rare = F.coalesce("rest", F.lit(0.0))
    return texts.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("log") + rare - F.col("n_tokens") * total if learned else F.lit(0.0)).alias("base_score"),
        (F.col("model") + F.col("log_rare") + rare if learned else F.lit(0.0)).alias("score"),
    )

"""Ranked lexical search over inverted lists in geometric blocks.

A document is a vector: for each term the share that its frequency earns, saturating and against
the document's length. A query weighs terms by rarity, and a score is a sum of whole numbers.

Documents lie in shards of a few thousand rows. Within a shard every term has a list of its
documents, and the list is cut into blocks of similar documents: some of them are taken as centres
and each joins the nearest one, by a random projection of the vectors. A block keeps the maximum
of its documents in every coordinate, so the product of a query with that summary bounds the score
of all of them, in whole numbers and without rounding. A query visits the blocks of its terms by
falling bound, scores the documents in them, and stops at the first bound below its k-th best
score so far, which a task carries from shard to shard. No other block is skipped, so the result
is that of scoring everything.

Spark counts the collection, deals the shards to tasks and ranks what they found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_chunks, written
from .words import LETTERS_AND_DIGITS, split_words

# Fixed values of the score.
SHARE_SCALE = 1_000_000_000
TERM_SCALE = 1000
LENGTH_SCALE = 12
LENGTH_PERCENT = 25
RARITY_SCALE = 1000

BLOCK_ROWS = 64
SKETCH = 16
SHARD_ROWS = 4096
SHARD_CELLS = 1 << 24
# Queries that are searched for together; more are taken in turn.
QUERY_ROWS = 512
QUERY_BYTES = 4 << 20
EXACT_DOUBLE = 1 << 53


@dataclass(frozen=True, slots=True)
class QueryBlock:
    """Some queries: their ids, the different terms of all, and (terms, repeats) of each."""

    ids: list
    terms: pa.Array
    asked: list[tuple[np.ndarray, np.ndarray]]


def _query_block(ids: list, texts: list[str | None]) -> QueryBlock:
    words, lengths = split_words(pa.array(texts, pa.string()), LETTERS_AND_DIGITS)
    terms = pc.unique(words)
    numbers = pc.index_in(words, value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    return QueryBlock(ids, terms, [np.unique(numbers[e - n : e], return_counts=True) for n, e in zip(lengths, ends)])


def _query_blocks(queries: DataFrame, rows: int, most_bytes: int) -> Iterator[QueryBlock]:
    ids, texts, size = [], [], 0
    for item, text in queries.toLocalIterator(prefetchPartitions=True):
        if ids and (len(ids) >= rows or size + len(text or "") > most_bytes):
            yield _query_block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text or "")
    if ids:
        yield _query_block(ids, texts)


def _vectors(documents: DataFrame, terms: pa.Array) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a word: n words, and the queries' terms in it."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            words, lengths = split_words(batch.column("text"), LETTERS_AND_DIGITS)
            found = pc.index_in(words, value_set=shared.value)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)[known]
            term = found.drop_null().to_numpy().astype(np.int64)
            places, counts = np.unique(row * (len(shared.value) + 1) + term, return_counts=True)
            row, term = np.divmod(places, len(shared.value) + 1)
            ends = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32))
            out = [
                batch.column("doc_id"),
                pa.array(lengths.astype(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "counts"]).filter(pa.array(lengths > 0))

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>"))


def rarity(n_documents: int, holding: int) -> int:
    return math.floor(RARITY_SCALE * math.log((2 * n_documents + 2) / (2 * holding + 1)))


class Shard:
    """Inverted lists of some documents, in blocks with summaries.

    ``shares`` has a row for each document and a column for each term of the queries."""

    def __init__(self, shares: np.ndarray, weights: np.ndarray, block_rows: int = BLOCK_ROWS):
        self.shares, self.block_rows = shares, block_rows
        doc, term = np.nonzero(shares)
        order = np.argsort(term, kind="stable")
        self.docs, self.ends = doc[order], np.searchsorted(term[order], np.arange(shares.shape[1] + 1))
        sketch = (shares * weights).astype(np.float32) @ np.random.default_rng(7).standard_normal((shares.shape[1], SKETCH), np.float32)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a term's list, block by block, and where each block starts."""
        docs = self.docs[self.ends[term] : self.ends[term + 1]]
        centres = docs[:: self.block_rows]
        if len(centres) < 2:
            return docs, np.zeros(len(centres), np.int64)
        nearest = (self.sketch[docs] @ self.sketch[centres].T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        return docs[order], np.flatnonzero(np.diff(nearest[order], prepend=-1))

    def summaries(self, docs: np.ndarray, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The maximum of each block's documents in the given coordinates."""
        return np.maximum.reduceat(self.shares[np.ix_(docs, terms)], starts, axis=0)


def _product(shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whole-number product: in doubles where they hold every sum exactly, else in longs."""
    if int(weights.sum(axis=0).max(initial=0)) * (SHARE_SCALE // TERM_SCALE) < EXACT_DOUBLE:
        return (shares.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64)
    return shares.astype(np.int64) @ weights


class Best:
    """The k best (score, document) of one query; a smaller id comes first, none last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.lost, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def bar(self) -> int:
        """Scores below this cannot enter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, lost: np.ndarray, doc: np.ndarray) -> None:
        enters = score >= self.bar()
        if enters.any():
            parts = [np.concatenate(p) for p in ((self.score, score[enters]), (self.lost, lost[enters]), (self.doc, doc[enters]))]
            order = np.lexsort((parts[2], parts[1], -parts[0]))[: self.k]
            self.score, self.lost, self.doc = (p[order] for p in parts)


def search_shard(shard: Shard, asked: list[tuple[np.ndarray, np.ndarray]], best: list[Best], lost: np.ndarray, ids: np.ndarray) -> int:
    """Adds the shard's documents to the best of each query (terms, weights); the number scored."""
    of_term: dict[int, list[int]] = {}
    for q, (terms, _) in enumerate(asked):
        for t in terms.tolist():
            of_term.setdefault(t, []).append(q)
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    bounds: list[list[tuple[int, np.ndarray]]] = [[] for _ in asked]
    for t, queries in of_term.items():
        docs, starts = shard.blocks(t)
        if not len(docs):
            continue
        blocks[t] = docs, np.append(starts, len(docs))
        coordinates = np.unique(np.concatenate([asked[q][0] for q in queries]))
        weights = np.zeros((len(coordinates), len(queries)), np.int64)
        for j, q in enumerate(queries):
            weights[np.searchsorted(coordinates, asked[q][0]), j] = asked[q][1]
        limits = _product(shard.summaries(docs, starts, coordinates), weights)
        for j, q in enumerate(queries):
            bounds[q].append((t, limits[:, j]))
    scored = 0
    for q, (terms, weights) in enumerate(asked):
        if not bounds[q]:
            continue
        limit = np.concatenate([b for _, b in bounds[q]])
        places = [(t, i) for t, b in bounds[q] for i in range(len(b))]
        order, seen, at, step = np.argsort(-limit, kind="stable"), np.zeros(len(ids), bool), 0, 4
        while at < len(order) and limit[order[at]] >= best[q].bar():
            some = [places[i] for i in order[at : at + step] if limit[i] >= best[q].bar()]
            docs = np.unique(np.concatenate([blocks[t][0][blocks[t][1][i] : blocks[t][1][i + 1]] for t, i in some]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            scored += len(docs)
            best[q].add(_product(shard.shares[np.ix_(docs, terms)], weights[:, None])[:, 0], lost[docs], ids[docs])
            at, step = at + step, 2 * step
    return scored


def _search(vectors: DataFrame, queries: QueryBlock, first: int, k: int, shard_rows: int, block_rows: int) -> DataFrame:
    """(query, item_id, doc_id, score): each task's k best for each query."""
    n_documents, n_words = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    rare = np.array([rarity(n_documents, holding.get(t, 0)) for t in range(len(queries.terms))], np.int64)
    asked = [(terms, counts * rare[terms]) for terms, counts in queries.asked]
    most = min(shard_rows, max(256, SHARD_CELLS // max(1, len(rare))))
    shared = vectors.sparkSession.sparkContext.broadcast((asked, rare, queries.ids))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in kept)
                kept.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in kept) == most:
                    yield pa.Table.from_batches(kept)
                    kept = []
        if kept:
            yield pa.Table.from_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, rare, items = shared.value
        best = [Best(k) for _ in asked]
        for table in shards(batches):
            n, ids = table.column("n").to_numpy(), table.column("doc_id")
            terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
            row = np.repeat(np.arange(len(n)), pc.list_value_length(terms).to_numpy())
            tf = counts.flatten().to_numpy().astype(np.int64)
            length = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_documents) // n_words
            shares = np.zeros((len(n), len(rare)), np.int32)
            shares[row, terms.flatten().to_numpy()] = (SHARE_SCALE * tf) // (TERM_SCALE * tf + LENGTH_SCALE * length[row])
            lost = ids.is_null().to_numpy()
            search_shard(Shard(shares, rare, block_rows), asked, best, lost, ids.fill_null(0).to_numpy())
        query = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(query):
            doc, lost, score = (np.concatenate([getattr(b, name) for b in best]) for name in ("doc", "lost", "score"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + query), pa.array(items, pa.int64()).take(pa.array(query)), pa.array(doc, mask=lost), pa.array(score)],
                ["query", "item_id", "doc_id", "score"],
            )

    return vectors.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def search(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 20,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every query, score above 0.

    documents has doc_id and text, queries has item_id and text. Every row is a document or a query
    of its own, also where ids repeat or are null; null and blank texts hold no terms, so they are
    never found, find nothing and do not count. Fewer documents with a score give fewer rows. Equal
    scores rank by doc_id, documents without one last. Empty tables give no rows.

    Queries are read in blocks of at most ``query_rows`` and 4 MB of text (a longer one comes
    alone); their terms are what is broadcast.
    """
    spark, first, parts = documents.sparkSession, 0, []
    asked = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for block in _query_blocks(asked, query_rows, QUERY_BYTES):
        parts.append(written(_ranked(_search(_vectors(documents, block.terms), block, first, k, shard_rows, block_rows), k)))
        first += len(block.ids)
    return _united(spark, parts)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _united(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    while len(parts) > 1:  # halves, so that the plan stays shallow
        parts = [a.unionAll(b[0]) if b else a for a, *b in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]

"""Removes words in passages that occurred earlier, found through super-k-mers.

A window is ``window`` consecutive words of a document. Its minimiser is the ``gram``-word
piece that comes first in a fixed pseudo-random order (the leftmost such piece). Neighbouring
windows that share the same minimiser place form a super-k-mer: one string of all their words.
Equal windows have equal minimisers, so a bucket of minimisers holds all that is needed to
compare its windows; there they are sorted by content and judged word for word, not by hash.

What travels to a bucket is one zstd-packed block for each chunk of documents, so a window
costs about three words before packing. Copies within a chunk are settled on the spot: only
the earliest of equal super-k-mers travels.

Pieces that are frequent in the corpus (over one in ``4 x partitions`` of all pieces, found by
lossy counting over all texts) come last in the order. A common line then does not gather the
windows of a third of all documents in one bucket: windows around it are filed under their
rarer pieces. The frequent set has at most 8 x partitions entries, and is the same for all.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, key_test, partitions, text_bytes, written

MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
CUT_COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]


def piece_order(words: list[bytes], gram: int) -> np.ndarray:
    """A 63-bit pseudo-random rank of the piece that starts at each word."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h = (h + MIX[1]) * MIX[0]
    h ^= h >> np.uint64(29)
    out = np.zeros(max(len(words) - gram + 1, 0), np.uint64)
    for i in range(gram):
        out = (out ^ h[i : i + len(out)]) * MIX[(i + 1) % 3] + MIX[i % 3]
        out ^= out >> np.uint64(31)
    return out >> np.uint64(1)


def _frequent_of_partition(gram: int, share: float):
    """Lossy counting: every piece with over twice this share of a partition's words is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for chunk in in_chunks(batches, "text"):
            found = []
            for text in text_bytes(chunk.column("text")):
                words = text.split()
                seen += len(words)
                found.append(piece_order(words, gram))
            new, n = np.unique(np.concatenate(found), return_counts=True)
            keys, place = np.unique(np.concatenate([pieces, new]), return_inverse=True)
            total = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            keep = total > max(1, share * seen / 2)
            pieces, counts = keys[keep], total[keep]
        keep = counts > share * seen
        if seen:
            yield pa.record_batch(
                [pa.array(np.r_[pieces[keep].astype(np.int64), -1]), pa.array(np.r_[counts[keep], seen])],
                ["piece", "n"],
            )

    return run


def frequent_pieces(docs: DataFrame, gram: int, n_partitions: int) -> tuple[np.ndarray, int]:
    """(pieces over 1/(4 x partitions) of all words, number of words); at most 8 x partitions."""
    share = 1 / (4 * n_partitions)
    counts = docs.select("text").mapInArrow(_frequent_of_partition(gram, share / 2), "piece long, n long")
    totals = written(counts.groupBy("piece").agg(F.sum("n").alias("n")))
    words = totals.filter("piece = -1").first()
    words = words["n"] if words else 0
    rows = totals.filter((F.col("piece") >= 0) & (F.col("n") > share * words / 2)).select("piece").collect()
    return np.sort(np.array([r[0] for r in rows], np.uint64)), words


def super_kmers(words: list[bytes], window: int, gram: int, frequent: np.ndarray):
    """(minimiser, first window, last window) arrays; together they hold each window once."""
    n = len(words) - window + 1
    order = piece_order(words, gram)
    rank = order
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, order), len(frequent) - 1)
        rank = order | ((frequent[at] == order).astype(np.uint64) << np.uint64(63))
    width, best, place = window - gram + 1, rank, np.arange(len(rank))
    span = 1
    while span < width:  # the minimum of growing stretches; on ties the left one
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        later = right < left
        place = np.where(later, place[step:], place[: len(place) - step])
        best = np.where(later, right, left)
        span += step
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], n] - 1
    return order[place[first]], first, last


def _pack(rows: list) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(rows, protocol=5))


def _unpack(block: bytes) -> list:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def _by_bytes(values: np.ndarray) -> bytes:
    """Numbers with all their first bytes first, then all second ones, which packs well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_bytes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _pack_kmers(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """Super-k-mers (piece, doc_id, first window, words) column by column; ids as differences.

    Half of a piece's bits is enough to keep most groups apart; windows are told by their words."""
    piece, doc_id, first, packed = zip(*rows)
    columns = [
        _by_bytes((np.array(piece, np.int64) >> 31).astype("<u4")),
        _by_bytes(np.diff(np.array(doc_id, "<i8"), prepend=np.int64(0))),
        _by_bytes(np.array(first, "<i8")),
    ]
    head = np.array([len(rows)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *columns, b" \n".join(packed)]))


def _unpack_kmers(block: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, columns = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in ("<u4", "<i8", "<i8"):
        size = n * np.dtype(kind).itemsize
        columns.append(_of_bytes(raw[at : at + size], kind))
        at += size
    return zip(columns[0].tolist(), np.cumsum(columns[1]).tolist(), columns[2].tolist(), raw[at:].split(b" \n"))


def _to_buckets(window: int, gram: int, frequent: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, "text", CHUNK_BYTES):
            earliest: dict[bytes, tuple] = {}
            again: list[tuple[int, int, int]] = []
            ids = chunk.column("doc_id").to_pylist()
            for doc_id, text in sorted(
                (x for x in zip(ids, text_bytes(chunk.column("text"))) if x[0] is not None), key=lambda x: x[0]
            ):
                words = text.split()
                if len(words) < window:
                    continue
                joined = b" ".join(words)
                ends = list(accumulate(len(w) + 1 for w in words))
                pieces, first, last = super_kmers(words, window, gram, frequent)
                for piece, a, b in zip(pieces.tolist(), first.tolist(), last.tolist()):
                    packed = joined[ends[a - 1] if a else 0 : ends[b + window - 1] - 1]
                    # equal strings hold equal windows, whose minimisers are equal too
                    mine = (piece, doc_id, a)
                    # a row that repeats a doc_id is the same place, not a later one
                    if earliest.setdefault(packed, mine) != mine:
                        again.append((doc_id, a, b))
            parts: dict[int, list] = {}
            for packed, (piece, doc_id, a) in earliest.items():
                parts.setdefault(piece % buckets, []).append((piece, doc_id, a, packed))
            del earliest
            rows = [(k, _pack_kmers(parts.pop(k)), None) for k in sorted(parts)]
            spread = (again[0][0] if again else 0) % buckets
            rows += [
                ((spread + i) % buckets, None, _pack(again[at : at + 20_000]))
                for i, at in enumerate(range(0, len(again), 20_000))
            ]
            for at in range(0, len(rows), 64):
                yield pa.record_batch(
                    [pa.array(x, t) for x, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.binary(), pa.binary()))],
                    ["bucket", "kmers", "again"],
                )

    return run


def _later_windows(group: list, window: int) -> Iterator[tuple[int, int]]:
    """(doc_id, start) of each window of one minimiser that is not the earliest of its content."""
    windows = []
    for _, doc_id, start, packed in group:
        words = packed.split(b" ")
        for i in range(len(words) - window + 1):
            windows.append((b" ".join(words[i : i + window]), doc_id, start + i))
    windows.sort()
    first = None
    for window_at in windows:
        if first is None or window_at[0] != first[0]:
            first = window_at
        elif window_at != first:
            yield window_at[1:]


def _stretches(doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(doc_id, first, last) of runs of neighbouring windows, as rows."""
    order = np.lexsort((start, doc_id))
    doc_id, start = doc_id[order], start[order]
    if not len(order):
        return np.zeros((0, 3), np.int64)
    opens = np.r_[True, (doc_id[1:] != doc_id[:-1]) | (start[1:] > start[:-1] + 1)]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(order)] - 1
    return np.stack([doc_id[first], start[first], start[last]], axis=1)


def _judge(window: int):
    """Judges buckets one after the other: (doc_id, first, last) of windows seen earlier."""

    def judged(earliest: dict) -> np.ndarray:
        by_piece = sorted(earliest, key=lambda packed: earliest[packed][2])
        found, i = [np.zeros((0, 2), np.int64)], 0
        while i < len(by_piece):
            j, piece = i + 1, earliest[by_piece[i]][2]
            while j < len(by_piece) and earliest[by_piece[j]][2] == piece:
                j += 1
            # windows of a single super-k-mer differ, as their minimiser stands at another place
            if j > i + 1:
                later = list(_later_windows([(piece, *earliest[k][:2], k) for k in by_piece[i:j]], window))
                if later:
                    found.append(np.array(later, np.int64))
            i = j
        return _stretches(*np.concatenate(found).T)

    def batches_of(rows) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 50_000):
            part = np.array(rows[at : at + 50_000], np.int64)
            yield pa.record_batch([pa.array(part[:, i]) for i in range(3)], ["doc_id", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: int | None = None
        earliest: dict[bytes, tuple] = {}  # different strings only: copies do not pile up
        for batch in batches:
            for key, kmers, again in zip(*(batch.column(i) for i in range(3))):
                key, kmers, again = key.as_py(), kmers.as_py(), again.as_py()  # a block at a time
                if key != bucket:
                    yield from batches_of(judged(earliest))
                    bucket, earliest = key, {}
                if again is not None:
                    yield from batches_of(_unpack(again))
                later = []
                for piece, doc_id, a, packed in _unpack_kmers(kmers) if kmers is not None else ():
                    mine = (doc_id, a, piece)
                    other = earliest.setdefault(packed, mine)
                    if other != mine:
                        earliest[packed], (doc_id, a, _) = min(other, mine), max(other, mine)
                        later.append((doc_id, a, a + packed.count(b" ") + 1 - window))
                yield from batches_of(later)
        yield from batches_of(judged(earliest))

    return run


def repeated_windows(docs: DataFrame, window: int = 20, gram: int = 4) -> DataFrame:
    """(doc_id, first, last): runs of windows whose word sequence also starts earlier."""
    if not 1 <= gram <= window:
        raise ValueError("a minimiser must fit into a window")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = partitions(docs.sparkSession)
    frequent, words = frequent_pieces(texts, gram, n)
    # about 24 bytes of packed words per window before compression
    buckets = max(4 * n, int(words * 24 / BUCKET_BYTES) + 1)
    return (
        texts.mapInArrow(_to_buckets(window, gram, frequent, buckets), "bucket int, kmers binary, again binary")
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_judge(window), "doc_id long, first long, last long")
    )


def _kept(text: bytes, runs: list | None, window: int) -> tuple[int, bytes]:
    """(number of words, the kept words joined by one space)."""
    words = text.split()
    if not runs:
        return len(words), b" ".join(words)
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r["first"] : r["last"] + window] = False
    return len(words), b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _digest(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, "text"):
            out = []
            for text, runs in zip(text_bytes(chunk.column("text")), chunk.column("_runs").to_pylist()):
                n, kept = _kept(text, runs, window)
                out.append((n, n - len(kept.split()), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, sha, kept = zip(*out)
            columns = [chunk.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.record_batch(columns, CUT_COLUMNS[: len(columns)])

    return run


def _shortened(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, "text"):
            place, texts = chunk.schema.get_field_index("text"), chunk.column("text").to_pylist()
            for i, runs in enumerate(chunk.column("_runs").to_pylist()):
                if runs and texts[i] is not None:
                    texts[i] = _kept(texts[i].encode(), runs, window)[1].decode()
            chunk = chunk.set_column(place, "text", pa.array(texts, pa.string()))
            yield chunk.select([c for c in chunk.schema.names if c != "_runs"])

    return run


def _with_runs(docs: DataFrame, found_in: DataFrame, window: int, gram: int, finish, schema) -> DataFrame:
    """``finish`` over the documents with their runs; those without any are not shuffled."""
    runs = written(repeated_windows(found_in, window, gram))
    hashed, part = key_test(docs, "doc_id", runs.select("doc_id").distinct())
    runs = runs.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    cut = hashed.mapInArrow(part(True), docs.schema)
    joined = cut.join(runs, cut["doc_id"].cast("long") == F.col("_id"), "left").drop("_id")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one worker does both, so that a task holds one at a time
        def without_runs() -> Iterator[pa.RecordBatch]:
            for batch in part(False)(batches):
                none = pa.nulls(batch.num_rows, RUNS)
                yield pa.RecordBatch.from_arrays([*batch.columns, none], [*batch.schema.names, "_runs"])

        yield from finish(without_runs())

    return joined.mapInArrow(finish, schema).unionByName(hashed.mapInArrow(untouched, schema))


def remove_repeated_passages(docs: DataFrame, window: int = 20, gram: int = 4, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text.

    Words are runs of anything but ASCII white space, unchanged. A word is removed if a window
    over it holds the same words as one with a smaller doc_id, or an earlier start in the same
    document. Null, empty and short texts lose nothing. Rows without a doc_id are returned whole
    and neither judge nor are judged; rows that repeat a doc_id with the same text
    count as one document, and each gets its result (with different texts, the windows found
    under an id cut all of its rows: make ids distinct before).
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return _with_runs(texts, docs, window, gram, _digest(window, with_text), schema)


def without_repeated_passages(docs: DataFrame, window: int = 20, gram: int = 4) -> DataFrame:
    """The documents, all other columns as they are, with passages that occurred earlier cut out.

    A text that loses words becomes its kept words joined by one space; the others stay as they
    are. Only texts that lose words are shuffled, and few others.
    """
    return _with_runs(docs, docs, window, gram, _shortened(window), docs.schema)

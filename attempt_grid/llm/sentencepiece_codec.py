"""SentencePiece encoding and decoding with a forward table shared between words.

Text is marked (a leading space, spaces as U+2581) and cut before each run of marks, over which
no piece of the vocabulary reaches. The distinct marked words of a chunk are sorted, so that
walking from one to the next is a depth-first traversal of their trie: only the characters after
the common prefix are computed, the forward states of the prefix stay on the stack.

The forward state of a prefix is the last piece of its encoding. For a unigram model that is the
best-scoring path (Viterbi). For a BPE model, whose result is defined by the order of merges and
not by a sum of scores, the state is the only piece that is compatible with the encoding before
it: a sequence is what BPE yields exactly if each two neighbours, merged on their own, stay two.
Prefixes of the same text thus share all their states in either case.

Characters without a piece become the bytes of their UTF-8 form where the model has byte pieces,
else the unknown piece.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, process_store

MARK = "▁"
CACHED_WORDS = 500_000
CACHED_CHARACTERS = 32 << 20


class Codec:
    """Encoder and decoder for a SentencePiece model file (BPE or unigram)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = messages.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        self.prefix = rules.add_dummy_prefix
        self.unigram = model.trainer_spec.model_type == 1
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if 4 in kinds or any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, kinds) if k == 1):
            raise ValueError("pieces may not hold a mark after other characters, nor be user-defined")
        self.normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {i: int(p[1:-1], 16) for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.unknown = kinds.index(2)
        self.longest = max(map(len, self.normal))
        self.least_score = min(self.scores[i] for i in self.normal.values())
        self.known: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.cached = 0

    def _merged(self, text: str) -> list[str]:
        """BPE of a short text by repeated best merge; the leftmost on ties."""
        parts = list(text)
        following = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = following[i]
            if j >= 0 and (k := self.normal.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            following[i] = following[j]
            if following[j] >= 0:
                before[following[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _last_piece(self, word: str, end: int, states: list) -> tuple:
        """(piece, start, 0) of the encoding's last piece for word[:end] by merge order."""
        known, normal = self.known, self.normal
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            piece = word[start:end]
            if piece not in normal:
                if start == end - 1:  # a lone character without a piece takes part in no merge
                    return piece, start, 0.0
                continue
            key = (states[start][0], piece)
            stays = known.get(key)
            if stays is None:
                if len(known) > 1_000_000:
                    known.clear()
                stays = known[key] = self._merged(key[0] + piece) == [p for p in key if p]
            if stays:
                return piece, start, 0.0
        raise AssertionError(f"no encoding of {word[:end]!r}")

    def _best_piece(self, word: str, end: int, states: list) -> tuple:
        """(piece, start, score) of the best-scoring path to word[:end]."""
        found = []
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            k = self.normal.get(word[start:end])
            if k is not None or start == end - 1:
                score = self.least_score - 10 if k is None else self.scores[k]
                found.append((word[start:end], start, states[start][2] + score))
        return max(found, key=lambda f: f[2])

    def _ids(self, piece: str) -> list[int]:
        k = self.normal.get(piece)
        if k is not None:
            return [k]
        coded = [self.byte_ids.get(b) for b in piece.encode()]
        return [self.unknown] if None in coded else coded

    def learn(self, words: set[str]) -> None:
        """Encodes words in sorted order: a depth-first walk over their trie."""
        last, states = "", [("", 0, 0.0)]
        step = self._best_piece if self.unigram else self._last_piece
        for word in sorted(words):
            shared = len(os.path.commonprefix([last, word]))
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(step(word, end, states))
            pieces, at = [], len(word)
            while at > 0:
                pieces.append(states[at][0])
                at = states[at][1]
            self.words[word] = np.array([i for p in reversed(pieces) for i in self._ids(p)], "<u4").tobytes()
            last = word

    def marked(self, text: str) -> list[str]:
        """The marked words of a text: each a run of marks with what follows up to the next."""
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        cut = text.split(MARK)
        out, marks = [cut[0]] if cut[0] else [], 0
        for part in cut[1:]:
            marks += 1
            if part:
                out.append(MARK * marks + part)
                marks = 0
        return out + [MARK * marks] * (marks > 0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit bytes."""
        split = [self.marked(t) for t in texts]
        new = set().union(*split) - self.words.keys()
        self.cached += sum(map(len, new))
        if len(self.words) + len(new) > CACHED_WORDS or self.cached > CACHED_CHARACTERS:
            self.words.clear()
            new = set().union(*split)
            self.cached = sum(map(len, new))
        self.learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        out, pending = [], bytearray()
        for i in ids.tolist():
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i])
        text = "".join(out) + pending.decode(errors="replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _codec(path: str, make) -> Codec:
    kept = process_store("sentencepiece")
    return kept.get(path) or kept.setdefault(path, make(path))


def encode(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (of unsigned little-endian 32-bit ids), round_trip
    (whether decoding gives the text) and, with_ids, ids. Null and empty texts have no tokens."""
    make, codec_of = Codec, _codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, make)
        for chunk in in_chunks(batches, "text"):
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            coded = codec.encode(texts)
            ids = [np.frombuffer(c, "<u4") for c in coded]
            columns = [
                chunk.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                pa.array([codec.decode(i) == t for i, t in zip(ids, texts)]),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.record_batch(columns, names + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids: array<int>). Null ids give an empty text; ids outside the
    vocabulary are an error."""
    make, codec_of = Codec, _codec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, make)
        for batch in batches:
            texts = [codec.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")

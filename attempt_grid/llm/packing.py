"""Packs tokenised documents into windows of fixed length with a controlled mixture of sources.

Each source is a queue of tokens. Deficit round-robin with token quanta is a fixed order: token m
of queue j is due at time (2m + 1) / w_j, and windows take the tokens in order of due time. A
queue that got a little less than its share in one window is owed the rest, so it comes earlier
in the next; nothing is lost at the borders of windows, phases or partitions, and every window
holds each source's share to within a token or so. When a queue runs dry, the others go on at
their weights. By default the weights are the queues' own sizes, so all last to the end.

How many tokens each queue has given before window W follows from W alone. Partitions therefore
place their documents independently once they know where their queues start, which takes one
small table of token sums per queue and block. A window lists its queues one after the other,
so a document lies in it as one piece.
"""

from __future__ import annotations

import bisect
import gc
import heapq
import os
import zlib
from collections.abc import Callable, Collection, Iterator
from fractions import Fraction
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_chunks, process_store, text_bytes, written

END_ID = 1
MAX_QUEUES = 256
# of each of the cache's two generations
CACHED_WORDS = 400_000
CACHED_BYTES = 40 << 20
CHUNK_BYTES = 1 << 20
JOINED_WORDS = 64
SHORT_BYTES = 4
END_OF_RUN = "</w>"  # how the vocabulary marks it
TAIL = ".,;:!?$%&#*|"
# ASCII digits and those characters of up to two bytes that any Unicode version sees as letters; U+0130 ends in a mark in lower case
ENDS_BODY = np.array([chr(c).isalnum() if c < 0x80 else c < 0x530 and c != 0x130 and chr(c).isalpha() for c in range(0x800)])
UNIT = 1 << 64


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.large_string())


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def _ends(strings: pa.Array) -> np.ndarray:
    """Where the strings of a new array with 64-bit offsets begin in its bytes, and where the last one ends."""
    return np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1)


def _halves(words: pa.Array, longer: int) -> pa.Array:
    """Each word's body and the punctuation behind it, in turn. Only after a letter or digit it is a token run
    of its own; other words, and those not longer than so many bytes, are bodies as a whole."""
    n, at = len(words), np.zeros(2 * len(words) + 1, np.int64)
    at[::2] = _ends(words)
    first, last, bodies = at[:-1:2], at[2::2], pc.binary_length(pc.ascii_rtrim(words, characters=TAIL)).to_numpy()
    at[1::2], some = last, np.flatnonzero((bodies > 0) & (bodies < last - first) & (last - first > longer))
    if len(some):
        cuts, data = first[some] + bodies[some], np.frombuffer(words.buffers()[2], np.uint8)
        one, two = data[cuts - 1].astype(int), data[cuts - 2].astype(int)
        letter = np.where(one < 0x80, ENDS_BODY[one], (two >= 0xC0) & ENDS_BODY[(two & 31) << 6 | one & 63])
        at[2 * some[letter] + 1] = cuts[letter]
    return pa.Array.from_buffers(words.type, 2 * n, [None, pa.py_buffer(at), words.buffers()[2]])


def _joined(words: pa.Array, longer: int, ids_of: Callable[[list[bytes]], list[bytes]]) -> pa.Array:
    """Ids of words: those of their halves, each of which is asked for once."""
    halves = _halves(words, longer).dictionary_encode()
    both = pa.array(ids_of(_bytes(halves.dictionary)), pa.large_binary()).take(halves.indices)
    # the halves of a word lie one after the other
    ends = pa.py_buffer(np.ascontiguousarray(_ends(both)[::2]))
    return pa.Array.from_buffers(both.type, len(words), [None, ends, both.buffers()[2]])


def _one_run(word: str) -> bool:
    """Letters that any Unicode version sees as letters, also in lower case: Latin, Greek, Cyrillic."""
    return word.isascii() or (max(word) < "\u0530" and "\u0130" not in word)


class WordEncoder:
    """Token ids of texts as little-endian 16-bit bytes, from a cache of space-separated words.

    The tokenizer drops white space and never joins across it, and lower-cases anyway. Texts
    with "<|" may hold special tokens and are encoded as they are. Arrow numbers the different words
    of a call, so that each is looked up once, without the punctuation behind it. When the cache is
    full, its words become the old generation, from which those still in use come back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for words of one run each: the same model without the patterns that look for white space and runs
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(END_OF_RUN)]] = True
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cached = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [
            np.array(e.ids, "<u2").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _word_ids(self, words: list[str], tokenizer=None) -> list[bytes]:
        """Ids of words of letters only. Some go in one text, which costs half: a word's last id, and
        no other, is one that ends a run, so that ids are cut there. Letters that the tokenizer does
        not see as one run give more ends than words; the words of such a call go one by one."""
        joined = [" ".join(words[at : at + JOINED_WORDS]) for at in range(0, len(words), JOINED_WORDS)]
        ids = np.concatenate([np.array(e.ids, "<u2") for e in (tokenizer or self.tokenizer).encode_batch_fast(joined, add_special_tokens=False)])
        cuts = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
        if len(cuts) != len(words):
            return self._ids(words)
        flat = ids.tobytes()
        return [flat[a:b] for a, b in pairwise([0, *cuts])]

    def _tokenised(self, words: list[bytes]) -> list[bytes]:
        texts, known = [w.decode() for w in words], {}
        kinds = [t.isalpha() and 1 + _one_run(t) for t in texts]
        for wanted, ids in ((2, lambda some: self._word_ids(some, self.plain)), (1, self._word_ids), (0, self._ids)):
            names, some = ([x for x, kind in zip(xs, kinds) if kind == wanted] for xs in (words, texts))
            for at in range(0, len(some), 4096):
                known.update(zip(names[at : at + 4096], ids(some[at : at + 4096])))
        return [known[w] for w in words]

    def _keep(self, more: dict[bytes, bytes]) -> None:
        size = sum(map(len, more))
        if len(self.words) + len(more) > CACHED_WORDS or self.cached + size > CACHED_BYTES:
            self.old, self.words, self.cached = self.words, {}, 0
        self.words.update(more)
        self.cached += size

    def _found(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, which are in the cache afterwards."""
        found = list(map(self.words.get, words))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        if lacking:
            more = {w: self.old.get(w) for w in (words[i] for i in lacking)}
            if new := [w for w, ids in more.items() if ids is None]:
                more.update(zip(new, _bytes(_joined(_strings(new), 0, self._tokenised))))
            for i in lacking:
                found[i] = more[words[i]]
            self._keep(more)
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Nothing here refers back to itself, so no collector has to walk through the cache meanwhile."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        special = [b"<|" in t for t in texts]
        split = pc.ascii_split_whitespace(pc.ascii_lower(_strings([b"" if odd else t for t, odd in zip(texts, special)])))
        words = split.flatten().dictionary_encode()
        # short words come often and are cached as they are
        ids = _joined(words.dictionary, SHORT_BYTES, self._found).take(words.indices)
        ends, data = _ends(ids)[split.offsets.to_numpy()].tolist(), (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return [self._ids([t.decode()])[0] if odd else data[a:b] for t, odd, (a, b) in zip(texts, special, pairwise(ends))]


class Mixture:
    """The order in which queues of the given sizes and integer weights give their tokens."""

    def __init__(self, sizes: list[int], weights: list[int]):
        self.sizes, self.weights = sizes, weights
        self.total = sum(sizes)
        dry = sorted((Fraction(n, w), w) for n, w in zip(sizes, weights))
        self.times, self.given, self.rates = [Fraction(0)], [Fraction(0)], [sum(weights)]
        for time, w in dry:
            self.given.append(self.given[-1] + (time - self.times[-1]) * self.rates[-1])
            self.times.append(time)
            self.rates.append(self.rates[-1] - w)

    def before(self, tokens: int) -> list[int]:
        """How many tokens of each queue are among the first so many."""
        if tokens >= self.total:
            return list(self.sizes)
        near = max(0, tokens - len(self.sizes))
        i = max(0, bisect.bisect_right(self.given, near) - 1)
        time = self.times[i] + (near - self.given[i]) / self.rates[i] if self.rates[i] else self.times[i]
        due = int(2 * time * UNIT)
        counts = [min(n, max(0, -((UNIT - due * w) // (2 * UNIT)))) for n, w in zip(self.sizes, self.weights)]
        # the few tokens left, in order of due time
        heap = [(((2 * c + 1) * UNIT) // w, j) for j, (c, n, w) in enumerate(zip(counts, self.sizes, self.weights)) if c < n]
        heapq.heapify(heap)
        for _ in range(tokens - sum(counts)):
            _, j = heap[0]
            counts[j] += 1
            if counts[j] < self.sizes[j]:
                heapq.heapreplace(heap, (((2 * counts[j] + 1) * UNIT) // self.weights[j], j))
            else:
                heapq.heappop(heap)
        return counts


def _source(docs: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def folded(docs: DataFrame, max_queues: int = MAX_QUEUES, named: Collection[str] = ()) -> Column | None:
    """The queue of each source where there are more than max_queues of them, else None.

    Sources in named and the heaviest others keep a queue of their own; the rest share a quarter of
    the queues, at least two, whose names are numbers that no source with its own queue has.
    """
    source = _source(docs)
    if docs.agg(F.countDistinct(source)).first()[0] <= max_queues:
        return None
    shared = min(max_queues, max(2, max_queues // 4))
    sizes = docs.groupBy(source.alias("queue")).agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).alias("n"))
    others = sizes.filter(~F.col("queue").isin(list(named))) if named else sizes
    heavy = others.orderBy(F.desc("n"), "queue").limit(max(0, max_queues - shared - len(named))).collect()
    own = {*named, *(r["queue"] for r in heavy)}
    numbers = [n for n in map(str, range(shared + len(own))) if n not in own][:shared]
    number = F.element_at(F.array(*map(F.lit, numbers)), (F.pmod(F.xxhash64(source), F.lit(shared)) + 1).cast("int"))
    return F.when(source.isin(list(own)), source).otherwise(number) if own else number


def tokenised(docs: DataFrame, tokenizer: str, queue: Column | None = None) -> DataFrame:
    """(doc_id, queue, block, place, n_tokens, ids): place counts the queue's tokens in its block."""
    queue = _source(docs) if queue is None else queue
    texts = docs.select(F.col("doc_id").cast("long"), queue.alias("queue"), F.col("text").cast("string"))

    make, store = WordEncoder, process_store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = store("word_encoders")
        encoder = kept.get(tokenizer) or kept.setdefault(tokenizer, make(tokenizer))
        block, filled = TaskContext.get().partitionId(), {}
        for chunk in in_chunks(batches, "text", CHUNK_BYTES):
            ids = [x + b"\x01\x00" for x in encoder.encode(text_bytes(chunk.column("text")))]
            places = []
            for queue, x in zip(chunk.column("queue").to_pylist(), ids):
                places.append(filled.get(queue, 0))
                filled[queue] = places[-1] + len(x) // 2
            yield pa.record_batch(
                [chunk.column("doc_id"), chunk.column("queue"), pa.array([block] * len(ids), pa.int64()),
                 pa.array(places, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "block", "place", "n_tokens", "ids"],
            )

    return texts.mapInArrow(
        run, "doc_id long, queue string, block long, place long, n_tokens long, ids binary"
    )


def _pieces(mixture_of, queues: list[str], sizes: list[int], weights: list[int], length: int):
    names = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture, number = mixture_of(sizes, weights), {q: k for k, q in enumerate(queues)}
        known: dict[int, tuple[list[int], list[int]]] = {}
        window_of: dict[int, int] = {}

        def before(window: int) -> tuple[list[int], list[int]]:
            """Tokens of each queue before a window, and of all queues in front of each."""
            if window not in known:
                if len(known) > 20_000:
                    known.clear()
                counts = mixture.before(window * length)
                known[window] = counts, list(accumulate(counts, initial=0))
            return known[window]

        for batch in batches:
            out = []
            for doc_id, queue, base, place, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "base", "place", "ids"))):
                k, x = number[queue], base + place
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                n, at = len(ids) // 2, 0
                w = window_of.get(k, -1)
                if w < 0 or x < before(w)[0][k]:
                    w = bisect.bisect_right(range(mixture.total // length + 1), x, key=lambda v: before(v)[0][k]) - 1
                (a, a_front), (b, b_front) = before(w), before(w + 1)
                while at < n:
                    while b[k] <= x + at:
                        w += 1
                        a, a_front, (b, b_front) = b, b_front, before(w + 1)
                    end = min(n, b[k] - x)
                    offset = b_front[k] - a_front[k] + x + at - a[k]
                    out.append((doc_id, at, end - at, zlib.crc32(wide[4 * at : 4 * end]), n, w, offset, queue))
                    at = end
                window_of[k] = w
                if len(out) >= 50_000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        *numbers, source = zip(*out)
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in numbers), pa.array(source, pa.string())], [*names, "queue"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, length: int = 2048, weights: dict[str, float] | None = None, max_queues: int = MAX_QUEUES
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    A document's tokens are its ids and a final END_ID; a null or empty text is that id alone.
    Every token lies in one piece, and only the last sequence may be shorter than length.
    weights gives sources their target share (sources left out: 1); without it each source has
    the share of its size. Of more than max_queues sources those in weights and the heaviest have
    a queue each; the light ones are hashed into the others (see folded), whose share is that of
    their sources together. A null source is the queue "". Rows that repeat are packed each; no
    documents give no pieces.
    """
    queue = folded(docs, max_queues, weights or ())
    table = written(tokenised(docs, tokenizer, queue))
    sums = written(table.groupBy("queue", "block").agg(F.sum("n_tokens").alias("tokens")))
    totals = sorted((r["queue"], r["n"]) for r in sums.groupBy("queue").agg(F.sum("tokens").alias("n")).collect())
    queues, sizes = [q for q, _ in totals], [int(n) for _, n in totals]
    shares = sizes
    if weights is not None:
        held = {}  # sources of each queue
        if queue is not None:
            held = dict(docs.groupBy(queue.alias("queue")).agg(F.countDistinct(_source(docs))).collect())
        shares = [max(1, round(1_000_000 * weights.get(q, held.get(q, 1)))) for q in queues]
    so_far = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("queue", "block", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)).alias("base")))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    return table.join(starts, ["queue", "block"]).mapInArrow(_pieces(Mixture, queues, sizes, shares, length), schema)

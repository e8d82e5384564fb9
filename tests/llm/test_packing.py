import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attempt_grid.llm.packing import Mixture, WordEncoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("weights", [None, {"src1": 5.0, "": 0.5}])
def test_every_token_lies_in_one_place(docs, texts, weights):
    pieces = pack(docs, PATH, 64, weights).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids, at = expected(texts[doc_id]), 0
        for p in sorted(parts, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for window, parts in by_window.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or window == len(by_window) - 1
    assert set(by_window) == set(range(len(by_window)))


def test_windows_hold_the_shares():
    sizes = [5000, 70, 1, 12_345, 0, 900]
    mixture, total = Mixture(sizes, [max(n, 1) for n in sizes]), sum(sizes)
    last = [0] * len(sizes)
    for tokens in range(0, total + 128, 128):
        now = mixture.before(tokens)
        assert sum(now) == min(tokens, total) and all(a <= b for a, b in zip(last, now))
        assert all(abs(n - min(tokens, total) * s / total) <= 2 for n, s in zip(now, sizes))
        last = now


def test_weights_hold_until_a_queue_is_dry():
    mixture = Mixture([1000, 1000, 100], [3, 1, 1])
    assert all(abs(a - b) <= 1 for a, b in zip(mixture.before(400), (240, 80, 80)))
    assert mixture.before(2100) == [1000, 1000, 100]
    assert all(abs(a - b) <= 2 for a, b in zip(mixture.before(900), (600, 200, 100)))


def test_cached_words_are_the_tokenizers(texts):
    odd = ["It's <|endoftext|> odd", "A.B, c!? ((x)). ÉCOLE,, 12.5% don't 'S", "a b c \x1c d", "İstanbul Σας K.", "é. x́,", "naïve…»."]
    encoder = WordEncoder(PATH)
    for text in [*odd, *(t for t in texts.values() if t)]:
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == expected(text)[:-1]


def test_odd_tables(docs, no_docs, clashing, broken):
    assert pack(no_docs, PATH).collect() == []
    assert sorted(map(tuple, pack(clashing, PATH).collect())) == sorted(map(tuple, pack(docs, PATH).collect()))
    assert sum(p.length for p in pack(broken, PATH).collect() if p.doc_id == 0) == 3 * len(expected(broken.first().text))
    hashed = pack(docs, PATH, 64, max_queues=2).collect()
    assert {p.queue for p in hashed} <= {"0", "1"}


def test_cache_is_bounded_by_size(monkeypatch):
    monkeypatch.setattr("attempt_grid.llm.packing.CACHED_BYTES", 400)
    encoder = WordEncoder(PATH)
    for i in range(6):
        texts = [f"word{i} {'long' * 60}{i}, again", f"Word{i} end."]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode([t.encode() for t in texts])] == [expected(t)[:-1] for t in texts]
        assert sum(map(len, encoder.words)) < 1000 and sum(map(len, encoder.old)) < 1000
        assert b"end." in encoder.words or b"end." in encoder.old


def test_words_in_one_call_are_cut_where_they_end():
    encoder = WordEncoder(PATH)
    words = [f"w{'xyz' * (i % 5)}{c}" for i, c in enumerate("aéßøñçšžłαβжя漢字ءअ")] + ["straße", "x" * 300]
    assert encoder._word_ids(words) == encoder._ids(words)
    assert encoder._word_ids([*words, "İstanbul"]) == encoder._ids([*words, "İstanbul"])


def test_words_of_one_run_take_the_short_way():
    """Same ids by the tokenizer without its patterns; what may be several runs never goes there."""
    encoder = WordEncoder(PATH)
    asked = []
    plain = encoder.plain
    encoder.plain = type("Asked", (), {"encode_batch_fast": lambda _, texts, **k: asked.extend(texts) or plain.encode_batch_fast(texts, **k)})()
    words = ["Äpfel", "ÉCOLE", "ǅungla", "ςΣΑΣ", "жЁлка", "ªº", "x" * 300, "don", "İstanbul", "漢字", "ſtraße", "e\u0301a", "l'eau", "a1b2", "end."]
    text = " ".join([*words, *words, *map(str.lower, words)])
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == expected(text)[:-1]
    went = set(" ".join(asked).split())
    assert {"x" * 300, "don", "end"} <= went and not went & {"İstanbul", "漢字", "a1b2", "l'eau"}


def test_words_are_cached_without_the_punctuation_behind_them():
    """One body in five spellings is one entry, whose ids each spelling shares."""
    encoder = WordEncoder(PATH)
    text = "wordy wordy. Wordy, wordy!! wordy.&&& wordy. niño; niño %% ..."
    for _ in range(2):
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == expected(text)[:-1]
    assert sorted(w for w in encoder.words if w) == sorted(w.encode() for w in "wordy niño . , !! .&&& ; %% ...".split())


def test_punctuation_is_cut_off_after_letters_and_digits_only():
    """Every character before punctuation, among them letters whose lower case ends in a mark (İ)."""
    encoder, tokenizer = WordEncoder(PATH), Tokenizer.from_file(PATH)
    chars = [chr(c) for c in (*range(0x21, 0x3000), *range(0xAC00, 0xAC80), *range(0xF900, 0x10000), *range(0x1D400, 0x1D500))]
    texts = [f"abcdef{c}{tail}" for c in chars for tail in (".", "!?&")]
    wanted = [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, encoder.encode([t.encode() for t in texts]), wanted) if x != y] == []


def test_odd_calls():
    tokenizer = Tokenizer.from_file(PATH)
    for texts in ([], [""], ["", ""], [" "], ["<|endoftext|>"], ["\n\t a \x0b b\x0c", ""], ["."], ["", "....."], ["a" * 5000, "x" + "." * 5000]):
        ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u2").tolist() for x in WordEncoder(PATH).encode([t.encode() for t in texts])] == ids


def test_weighted_and_heavy_sources_are_not_folded(spark):
    """300 light sources, a heavy one and two with weights, one of them named as a shared queue."""
    rows = [(i, "some plain words of text " * 4, f"site{i}") for i in range(300)]
    rows += [(1000 + i, "many more words " * 20, "hot") for i in range(60)]
    rows += [(2000 + i, "chosen words " * 40, name) for i, name in enumerate(["0", "chosen"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source = {i: s for i, _, s in rows}
    for weights in (None, {"0": 30.0, "chosen": 60.0}):
        pieces = pack(docs, PATH, 512, weights).collect()
        own = {"hot", *(weights or {})}
        assert all((p.queue == source[p.doc_id]) for p in pieces if {p.queue, source[p.doc_id]} & own)
        assert len({p.queue for p in pieces}) <= 256 and {p.doc_id for p in pieces} == set(source)
        assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    first = defaultdict(int)
    for p in pieces:
        if p.sequence_id == 0:
            first[p.queue] += p.length
    assert abs(first["chosen"] - 2 * first["0"]) <= 3
    held = defaultdict(set)
    for p in pieces:
        held[p.queue].add(source[p.doc_id])
    assert max(map(len, held.values())) > 1
    # a shared queue has the weights of its sources together
    assert all(abs(first[q] - len(held[q]) * first["chosen"] / 60) <= 1.1 for q in held if q not in own - {"hot"})

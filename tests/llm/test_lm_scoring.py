import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from attempt_grid.llm.lm_scoring import LogBilinear, Trainer, contexts_of, score_texts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOC_SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]  # None: the end


def is_held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def brute_force(rows):
    """[(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]"""
    counts = Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((i, is_held_out(i), len(own), sum(counts[t] > 0 for t in own), n, base))
    return out


def compare(frame, rows):
    found = sorted(frame.collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    wanted = sorted(brute_force(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in found] == [r[:5] for r in wanted]
    assert [r.base_score for r in found] == pytest.approx([r[5] for r in wanted], rel=1e-9, abs=1e-9)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)
    return found


@pytest.mark.parametrize("settings", [{"vocabulary": 64}, {"vocabulary": 8, "frequent_words": 12}, {"vocabulary": 3, "frequent_words": 0}])
def test_base_scores(spark, docs, texts, settings):
    compare(score_texts(docs, rounds=1, **settings), list(texts.items()))


def test_odd_tables(spark, broken, no_docs, clashing, texts):
    small = {"vocabulary": 16, "frequent_words": 8, "rounds": 1}
    assert score_texts(no_docs, **small).count() == 0
    compare(score_texts(clashing, **small), list(texts.items()))
    compare(score_texts(broken, **small), [(r.doc_id, r.text) for r in broken.collect()])


def test_without_training_rows_every_token_is_certain(spark):
    rows = [(i, "some words") for i in range(200) if is_held_out(i)]
    found = score_texts(spark.createDataFrame(rows, DOC_SCHEMA), vocabulary=16).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(3, 0, 0, 0.0, 0.0)}
    assert len(found) == len(rows) > 5


def test_untrained_scores_against_plain_softmax(spark, docs, texts):
    """Without rounds the model is its start, so scores can be computed word by word."""
    rows, vocabulary = list(texts.items()), 10
    counts = Counter(t for i, text in rows if not is_held_out(i) for t in tokens(text))
    end, n, v = counts.pop(None), sum(counts.values()), len(counts)
    listed = sorted(counts, key=lambda t: (-counts[t], t))[: vocabulary - 2]
    rare = sum(c for t, c in counts.items() if t not in listed) + 0.1 * (v - len(listed) + 1)
    weights = np.array([end, rare, *(counts[t] for t in listed)], float)
    model = LogBilinear.start(weights / weights.sum(), 24)
    number = {t: k + 2 for k, t in enumerate(listed)} | {None: 0}
    for r in score_texts(docs, vocabulary=vocabulary, rounds=0).collect():
        score, before, last = 0.0, 0, 0
        for t in tokens(texts[r.doc_id]):
            k = number.get(t, 1)
            logits = model.own @ model.prediction(np.array([last]), np.array([before]))[0] + model.bias
            score += (logits[k] - np.log(np.exp(logits).sum())) / math.log(10)
            if k == 1:
                score += math.log10((counts[t] + 0.1) / rare)
            before, last = last, k
        assert r.score == pytest.approx(score, rel=1e-4)


def test_tables_are_normalised():
    draw = np.random.default_rng(1)
    model = LogBilinear(*(draw.standard_normal(s) for s in ((30, 5), (30, 5), 30, (5, 5), (5, 5))))
    a, b, normaliser = model.tables()
    for last in range(30):
        chance = np.exp(a[last][None] + b - normaliser[last][:, None])
        assert chance.sum(axis=1) == pytest.approx(np.ones(30), rel=1e-4)
    again = LogBilinear.unstacked(model.stacked(), 30)
    assert all((getattr(model, f) == getattr(again, f)).all() for f in ("context", "own", "bias", "near", "far"))


def test_contexts_do_not_cross_texts():
    found = contexts_of(np.array([5, 6, 0, 7, 0, 0]), np.array([3, 5, 6]))
    assert found.tolist() == [[0, 0, 5], [0, 5, 6], [5, 6, 0], [0, 0, 7], [0, 7, 0], [0, 0, 0]]


def test_training_finds_the_order_of_words():
    draw, n = random.Random(5), 20
    ids = [0]
    for _ in range(60_000):  # each word is mostly followed by its successor
        ids.append(draw.randrange(n) if draw.random() < 0.3 else (ids[-1] * 7 + 3) % n)
    contexts = contexts_of(np.array(ids), np.array([len(ids)]))
    frequency = np.bincount(ids, minlength=n) / len(ids)
    trainer = Trainer(LogBilinear.start(frequency, 24), frequency, 0.4, [1])
    trainer.learn(contexts)
    before, last, word = contexts.T
    a, b, normaliser = trainer.model().tables()
    assert (a[last, word] + b[before, word] - normaliser[last, before]).mean() > np.log(frequency[word]).mean() + 0.5


def test_held_out_texts_score_above_their_base(spark):
    draw = random.Random(9)
    verbs, things = [f"v{i}" for i in range(15)], [f"t{i}" for i in range(15)]
    rows = [(i, " ".join(f"{draw.choice(verbs)} the {draw.choice(things)} ," for _ in range(30))) for i in range(1500)]
    found = compare(score_texts(spark.createDataFrame(rows, DOC_SCHEMA).repartition(4), vocabulary=40), rows)
    kept = [r for r in found if r.held_out]
    assert sum(r.score for r in kept) > 0.8 * sum(r.base_score for r in kept)

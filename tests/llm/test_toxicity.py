import random
import zlib

import pytest

from attempt_grid.llm.toxicity import (
    best_segment,
    fit_toxicity,
    log_odds,
    maximal_segments,
    score_toxicity,
    without_toxic,
)


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    total, _, _, i, j = best
    if total <= 0:
        return []
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments():
    draw = random.Random(3)
    for _ in range(300):
        scores = [draw.choice([-3, -2, -1, 1, 2, 4]) + draw.random() / 100 for _ in range(draw.randint(0, 14))]
        found = maximal_segments(scores)
        assert [(a, b) for _, a, b in found] == brute_segments(scores)
        assert best_segment(scores)[0] == pytest.approx(max((s for s, _, _ in found), default=0.0))


def test_priors_nest():
    scores = log_odds({"abcd": (0, 200), "abcde": (50, 2), "=abcdef": (1, 1), "zzzz": (10, 90)}, (1000, 9000), 4.0)
    assert scores["abcde"] > 3 > 0 > scores["abcd"]
    assert scores["=abcdef"] == pytest.approx(scores["abcde"])
    assert scores["zzzz"] == pytest.approx(-0.02)


@pytest.fixture(scope="module")
def labelled(spark):
    draw, rows = random.Random(5), []
    plain = [a + b for a in "ba co di fo gu ha li mo".split() for b in "ran tel vis pok den".split()]
    for i in range(1200):
        toxic = int(i % 8 == 0)
        words = [draw.choice(plain) for _ in range(draw.randint(20, 120))]
        for _ in range(4 * toxic):
            words[draw.randrange(len(words))] = draw.choice(["rotten", "nasty", "vilest", "vilely", "vileness"])
        rows.append((i, " ".join(words), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), {r[0]: r[2] for r in rows}


def test_held_out_documents(spark, labelled):
    docs, labels, truth = labelled
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, model).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    gone = {r.doc_id for r in rows if r.predicted}
    assert {r.doc_id for r in without_toxic(docs, model).collect()} == set(truth) - gone


def test_labels_of_held_out_rows_do_not_matter(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert fit_toxicity(docs, labels) == fit_toxicity(docs, turned)


def test_odd_tables(docs, no_docs, clashing, broken, texts, labelled):
    model = fit_toxicity(*labelled[:2])
    assert score_toxicity(no_docs, model).collect() == []
    assert score_toxicity(clashing, model).count() == len(texts)
    assert without_toxic(clashing, model).columns == clashing.columns
    assert all(0 <= r.score < 0.5 for r in score_toxicity(broken, model).collect())
    untaught = fit_toxicity(no_docs, labelled[1])
    assert {r.predicted for r in score_toxicity(docs, untaught).collect()} == {0}


def test_a_cut_class_keeps_its_weight(spark):
    """Three in ten texts with a doubtful word are toxic: below 0.5, however many clean rows are taken."""
    draw, rows = random.Random(9), []
    plain = [a + b for a in "ba co di fo gu ha li mo".split() for b in "ran tel vis pok den".split()]
    for i in range(3000):
        words = [draw.choice(plain) for _ in range(40)]
        doubtful = i % 5 == 0
        if doubtful:
            words[7] = words[20] = "doubtful"
        rows.append((i, " ".join(words), int(doubtful and draw.random() < 0.3)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    toxic = sum(r[2] for r in rows)
    for max_rows in (6000, 140, 100):
        found = score_toxicity(docs, fit_toxicity(docs, labels, max_rows)).collect()
        assert sum(r.predicted for r in found) <= 30
        assert 0.7 * toxic < sum(r.score for r in found) < 1.4 * toxic

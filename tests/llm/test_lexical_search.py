import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from attempt_grid.llm.lexical_search import Best, Shard, search, search_shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(documents, items, k=20):
    """Sorted (item_id, rank, doc_id, score) by scoring every document for every item."""
    counted = [(i, c) for i, t in documents if (c := Counter(terms(t)))]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_words
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        found = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r, doc, -score) for r, (score, _, doc) in enumerate(found, 1)]
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [
    (0, "Alpha, beta the GAMMA license"), (1, "épée Über über x1 42"), (2, ""), (3, None), (4, "nowhere to be found"),
    (5, "the the the under"), (5, "cc by-nc"), (None, "mit license"), (7, "alpha " * 50),
]
QUERY_SCHEMA = "item_id long, text string"


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 7, "block_rows": 2}, {"query_rows": 2, "k": 3}])
def test_against_scoring_everything(spark, docs, texts, settings):
    found = search(docs, spark.createDataFrame(ITEMS, QUERY_SCHEMA), **settings)
    assert result(found) == brute_force(texts.items(), ITEMS, settings.get("k", 20))


def test_odd_tables(spark, broken, no_docs, clashing, texts):
    items = spark.createDataFrame(ITEMS, QUERY_SCHEMA)
    assert search(no_docs, items).count() == 0
    assert search(clashing, items.filter("false")).count() == 0
    assert result(search(clashing, items)) == brute_force(texts.items(), ITEMS)
    assert result(search(broken, items)) == brute_force([(r.doc_id, r.text) for r in broken.collect()], ITEMS)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, "same words") for i in range(50, 0, -1)] + [(None, "same words"), (7, "same words")]
    found = search(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, "words")], QUERY_SCHEMA))
    assert result(found) == brute_force(rows, [(1, "words")])


def test_blocks_are_skipped_only_below_the_bar():
    draw = random.Random(2)
    topics = [[draw.randrange(300) for _ in range(12)] for _ in range(20)]
    shares = np.zeros((2000, 300), np.int32)
    for doc in range(2000):
        for t in topics[doc % 20]:
            shares[doc, t] = draw.randrange(1, 1_000_000)
    weights = np.array([draw.randrange(1, 9000) for _ in range(300)], np.int64)
    asked = [(u := np.unique(topics[i % 20]), weights[u]) for i in range(10)]
    best, ids = [Best(10) for _ in asked], np.arange(2000)
    scored = search_shard(Shard(shares, weights, 16), asked, best, np.zeros(2000, bool), ids)
    for (t, w), b in zip(asked, best):
        score = shares[:, t].astype(np.int64) @ w
        order = np.lexsort((ids, -score))[:10]
        assert (b.doc == order).all() and (b.score == score[order]).all()
    assert 0 < scored < 2000 * 10 / 3  # similar documents share blocks, so most are never scored


def test_summaries_bound_their_blocks():
    draw = np.random.default_rng(4)
    shares = (draw.random((500, 40)) < 0.2) * draw.integers(1, 1_000_000, (500, 40))
    shard = Shard(shares.astype(np.int32), np.arange(1, 41), 8)
    for t in range(40):
        docs, starts = shard.blocks(t)
        assert sorted(docs) == np.flatnonzero(shares[:, t]).tolist()
        for block, top in zip(np.split(docs, starts[1:]), shard.summaries(docs, starts, np.arange(40))):
            assert (shares[block].max(axis=0) == top).all()

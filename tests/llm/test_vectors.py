import math
import random

import numpy as np
import pytest

from attempt_grid.llm.embedding_dedup import embedding_components
from attempt_grid.llm.neighbours import VantageTree, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1),
    (904, [float("inf")] + [1.0] * 7, 1), (905, [], 1), (906, [1.0] * 8, None), (907, [1.0, 2.0], 1), (None, [1.0] * 8, 1),
]


def clustered(n=240, seed=6):
    draw, rows = random.Random(seed), []
    centre = [draw.gauss(0, 1) for _ in range(8)]
    for i in range(n):
        if draw.random() < 0.2:
            centre = [draw.gauss(0, 1) for _ in range(8)]
        spread = draw.choice([0.0, 0.05, 0.2])
        rows.append((i, [float(np.float32(c + draw.gauss(0, spread))) for c in centre], draw.choice([1, 1, 2])))
    return rows


def brute_force(rows, least=0.93):
    ids = [r[0] for r in rows]
    v = np.array([r[1] for r in rows], np.float64)
    labels = np.array([r[2] for r in rows])
    size = np.sqrt((v**2).sum(axis=1))
    near = (v @ v.T / (size[:, None] * size) >= least) & (labels[:, None] == labels)
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(k), int(c), i == c) for i, k, c in zip(ids, near.sum(axis=1), label)}
        label = new


@pytest.mark.parametrize("settings", [{}, {"lists": 20, "tile_rows": 4, "codes": 4}, {"sample_rows": 5, "lists": 8}])
def test_near_copies(spark, settings):
    rows = clustered()
    frame = spark.createDataFrame([*rows, *ODD], SCHEMA).repartition(4)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_components(frame, **settings).collect()}
    expected = brute_force(rows)
    assert sum(k for k, _, _ in expected.values()) > 500
    assert {i: found[i] for i in expected} == expected
    assert all(found[i] == (0, i, True) for i, _, _ in ODD if i is not None)


def test_no_vectors(spark):
    assert embedding_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert embedding_components(spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 20, "query_rows": 7}])
def test_neighbours_are_exact(spark, settings):
    rows = clustered() + [(500 + i, [1.0] * 8, 1) for i in range(70)]  # ties beyond a leaf
    frame = spark.createDataFrame([*rows, *ODD], SCHEMA).repartition(4).selectExpr("*", "0 AS asks", "'x' AS score", "1 AS shard")
    found = {}
    for r in nearest(frame, frame.vec_id % 20 == 0, **settings).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = {r[0]: np.array(r[1], np.float64) for r in [*rows, ODD[6]]}
    asked = [i for i in [*usable, 907] if i % 20 == 0]
    assert set(found) == set(asked)
    for i in asked:
        best = sorted((math.sqrt(float(((v - usable[i]) ** 2).sum())), j) for j, v in usable.items() if j != i)[:10]
        got = sorted(found[i])
        assert [g[0] for g in got] == list(range(1, 11))
        assert [g[2] for g in got] == pytest.approx([d for d, _ in best], rel=1e-13, abs=1e-300)
        assert {g[1] for g in got} == {j for _, j in best} or got[-1][2] == pytest.approx(best[-1][0], rel=1e-12)


def test_ties_and_few_candidates(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in (0, 20, 3, 7)], SCHEMA)
    rows = sorted(nearest(frame, frame.vec_id == 0).collect())
    assert [(r[1], r.vec_id, r.score) for r in rows] == [(1, 3, 0.0), (2, 7, 0.0), (3, 20, 0.0)]
    assert nearest(frame.filter("vec_id < 0"), frame.vec_id == 0).collect() == []
    assert nearest(frame.filter("vec_id = 0"), frame.vec_id == 0).collect() == []


def test_relaxed_pruning_keeps_most():
    draw = np.random.default_rng(2)
    points = draw.normal(size=(3000, 6))
    tree, ids = VantageTree(points, np.arange(3000)), np.arange(0, 3000, 30)
    exact, _ = tree.search(points[ids], ids, 10, 1.0)
    relaxed, _ = tree.search(points[ids], ids, 10, 1.5)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, relaxed)])
    assert 0.9 <= recall


def test_extreme_lengths(spark):
    """Cosines do not depend on lengths, not even where squares underflow or overflow."""
    rows = [(10 * k + j, [s * x for x in v], 1) for k, v in enumerate(([1.0, 2.0, 3.0], [3.0, -1.0, 0.5])) for j, s in enumerate((1.0, 1e-200, 1e200, 5e-324))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(frame, lists=2).collect()}
    # the smallest doubles keep only whole multiples: (1, 2, 3) and (3, -1, 0)
    assert found == {i: (3, 10 * (i // 10)) for i, _, _ in rows}
    with pytest.raises(ValueError):
        embedding_components(frame, codes=257)


def test_a_point_is_shipped_once(spark):
    """Queries go to every shard, points to one, however many blocks of queries there are."""
    frame = spark.createDataFrame(clustered(), SCHEMA)
    found = nearest(frame, frame.vec_id % 2 == 0, shard_rows=30, query_rows=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("RepartitionByExpression") == 1

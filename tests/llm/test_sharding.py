import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from attempt_grid.llm.sharding import shard_documents


def test_rows_and_slots(docs, texts):
    found = shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert len(found) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_growing_and_weights(spark):
    keys = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    small = {r.doc_id: r for r in shard_documents(keys, (1.0,) * 4).collect()}
    large = {r.doc_id: r.shard for r in shard_documents(keys, (1.0,) * 5).collect()}
    assert all(large[i] == r.grown_shard for i, r in small.items())
    assert 600 < sum(s == 4 for s in large.values()) < 1000
    counts = Counter(r.shard for r in shard_documents(keys, (1.0, 3.0)).collect())
    assert 2800 < counts[1] < 3200
    heavier = {r.doc_id: r.shard for r in shard_documents(keys, (1.0, 2.0, 1.5)).collect()}
    before = {r.doc_id: r.shard for r in shard_documents(keys, (1.0, 2.0, 1.0)).collect()}
    assert {heavier[i] for i in before if heavier[i] != before[i]} == {2}
    with pytest.raises(ValueError):
        shard_documents(keys, (1.0, 0.0))


def test_odd_tables(no_docs, clashing, broken, texts):
    assert shard_documents(no_docs).collect() == []
    assert shard_documents(clashing).count() == len(texts)
    odd = shard_documents(broken).collect()
    assert len(odd) == 16 and len({(r.shard, r.slot) for r in odd}) == 16
    assert len({r.shard for r in odd if r.doc_id == 0}) == 1
    plan = shard_documents(broken)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_winning_shard(spark):
    """Draws and winners computed apart, key by key."""
    keys = [*range(300), -1, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")

    def winner(key, weights):
        def score(shard):
            number = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42))
            return -weights[shard] / math.log(((number >> 11) + 0.5) / 2**53)

        return max(range(len(weights)), key=lambda s: (score(s), -s))

    for weights in [(1.0,) * 16, (1.0, 2.0, 0.5)]:
        for r in shard_documents(frame, weights, 3.0).collect():
            assert (r.shard, r.grown_shard) == (winner(r.doc_id, weights), winner(r.doc_id, (*weights, 3.0)))

import random

import numpy as np
import pytest
import xxhash

from attempt_grid.llm.components import connected_components
from attempt_grid.llm.simhash import fingerprint, fingerprint_links, simhash_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(codes, max_bits=3):
    codes = np.array(codes, np.uint64)
    label = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= max_bits
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_documents(docs, texts):
    ids = sorted(texts)
    codes = [plain_fingerprint(texts[i]) for i in ids]
    assert codes == [fingerprint((texts[i] or "").encode()) for i in ids]
    label = components_of(codes)
    expected = {i: (f"{c:016x}", ids[k]) for i, c, k in zip(ids, codes, label)}
    assert {r[0]: (r[1], r[2]) for r in simhash_components(docs).collect()} == expected


@pytest.mark.parametrize("cell_rows", [3, 40, 4096])
def test_links_connect_all_within_three_bits(spark, cell_rows):
    draw, codes = random.Random(8), set()
    for _ in range(40):
        code = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 25])):
            codes.add(code)
            for _ in range(draw.randint(0, 4)):
                code ^= 1 << draw.randrange(64)
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3)
    links = fingerprint_links(frame, 3, cell_rows)
    rows = links.collect()
    assert all(0 < bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in rows)
    found = {r.node: r.component for r in connected_components(links).collect()}
    groups = {}
    for c, k in zip(signed, components_of(codes)):
        groups.setdefault(int(k), set()).add(c)
    for members in groups.values():
        assert {found.get(c, c) for c in members} == {min(members)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (300, 299), (299, 300)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[x] for x in range(200, 260)} == {7} == {found[7]}
    assert found[300] == 299 and 5 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_tables(docs, no_docs, clashing, broken, texts):
    assert simhash_components(no_docs).collect() == []
    assert sorted(simhash_components(clashing).collect()) == sorted(simhash_components(docs).collect())
    odd = simhash_components(broken).collect()
    assert len(odd) == broken.count()
    assert {r.component_id for r in odd if r.fingerprint == "0" * 16} == {min(i for i in range(12) if not (texts[i] or "").split())}
    with pytest.raises(ValueError):
        fingerprint_links(docs.selectExpr("doc_id AS fp"), 4)

import hashlib

import pytest

from attempt_grid.llm import substring_dedup as operator


def brute_force(texts, window):
    seen, out = set(), {}
    for doc_id in sorted(texts):
        words = (texts[doc_id] or "").encode().split()
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            content = tuple(words[i : i + window])
            if content in seen:
                keep[i : i + window] = [False] * window
            seen.add(content)
        kept = b" ".join(w for w, k in zip(words, keep) if k)
        out[doc_id] = (len(words), keep.count(False), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize(("window", "gram"), [(20, 4), (3, 2), (5, 5), (1, 1)])
def test_removes_what_started_earlier(docs, texts, window, gram):
    found = {r[0]: tuple(r)[1:] for r in operator.remove_repeated_passages(docs, window, gram).collect()}
    assert found == brute_force(texts, window)


def test_frequent_pieces_change_nothing(docs, texts, monkeypatch):
    all_of = operator.frequent_pieces

    def plenty(frame, gram, n):
        return all_of(frame, gram, 2_000)[0], all_of(frame, gram, n)[1]

    monkeypatch.setattr(operator, "frequent_pieces", plenty)
    found = {r[0]: tuple(r)[1:] for r in operator.remove_repeated_passages(docs).collect()}
    assert found == brute_force(texts, 20)


def test_frequent_pieces_are_found_and_bounded(spark):
    docs = spark.createDataFrame([(i, f"a common line of words {i} {i * 7} {i * 13}") for i in range(400)], "doc_id long, text string")
    pieces, words = operator.frequent_pieces(docs, 3, 4)
    assert words == 400 * 8
    assert 0 < len(pieces) <= 32


def test_odd_tables(docs, no_docs, clashing, broken):
    assert operator.remove_repeated_passages(no_docs).collect() == []
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    plain = sorted(operator.remove_repeated_passages(docs).collect(), key=key)
    assert sorted(operator.remove_repeated_passages(clashing).collect(), key=key) == plain
    odd = [r for r in operator.remove_repeated_passages(broken).collect() if r[0] is None]
    assert sorted((r.n_words, r.n_removed) for r in odd) == [(0, 0), (60, 0)]
    one = {r.doc_id: r for r in plain if r.doc_id in range(12)}
    again = operator.remove_repeated_passages(broken.filter("doc_id IS NOT NULL")).collect()
    assert len(again) == 14 and len([r for r in again if r.doc_id == 0]) == 3
    assert all(r.n_removed == 0 for r in again if r.doc_id == 0) and one[0].n_removed == 0
    with pytest.raises(ValueError):
        operator.repeated_windows(docs, 3, 4)

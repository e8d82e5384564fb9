import re
import time

from attempt_grid.llm.license_scan import PHRASES, scan_licenses

NOTICES = {
    1: ("Released under the MIT License.", "mit", "mit"),
    2: ("Licensed under the Apache-License, Version 2.0. Licensed under CC BY-NC 4.0!", "apache-2,cc-by-nc", "apache-2,cc-by-nc"),
    3: ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3"),
    4: ("the gnu is a general animal, public in version 3 of this work under license", "", ""),
    5: ("under the mit license under the mit license", "mit", "mit"),
    6: ("Under the Kit license", "", ""),
    7: ("é. permission is hereby granted, free of charge, to any person obtaining a copy of this software", "", "mit"),
    8: (None, "", ""),
    9: ("under, the--mit\nlicense", "mit", "mit"),
}


def brute_force(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases_and_templates(spark, docs, texts):
    every = {**{1000 + i: t for i, (t, _, _) in NOTICES.items()}, **texts}
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for r in scan_licenses(frame).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_force(every[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or r.base_labels == ""
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
        if r.doc_id >= 1000:
            assert (r.base_labels, r.labels) == NOTICES[r.doc_id - 1000][1:]


def test_stays_in_sql(docs):
    plan = scan_licenses(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(no_docs, clashing, broken, texts):
    assert scan_licenses(no_docs).collect() == []
    assert scan_licenses(clashing).count() == len(texts)
    assert scan_licenses(broken).count() == broken.count()


GNU = "under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def test_versions_and_standard_headers(spark):
    notices = {
        "licensed under the GNU Lesser General Public License version 2.1": "lgpl-2.1",
        "licensed under the GNU Lesser General Public License version 3": "lgpl-3",
        "subject to the Mozilla Public License, v. 1.1": "",
        "subject to the Mozilla Public License Version 1.1": "mpl-1.1",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        GNU.format("", "3"): "gpl-3",
        GNU.format("", "2"): "gpl-2",
        GNU.format("Lesser ", "2.1"): "lgpl-2.1",
        GNU.format("Lesser ", "3"): "lgpl-3",
        GNU.format("Affero ", "3"): "agpl-3",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "",
        "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    }
    rows = [(i, f"some text before it. {t} And after.") for i, t in enumerate(notices)] + [(100 + i, "plain prose of no rights") for i in range(40)]
    found = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(notices))] == list(notices.values())
    assert {found[100 + i] for i in range(40)} == {""}


def test_work_is_linear_in_a_text_of_notices(spark):
    """8,000 notices in one text; only the last has its key phrase."""
    near = "this work is licensed under the gnu general public license 3 it says. "
    text = near * 8000 + NOTICES[3][0]
    docs = spark.createDataFrame([(1, text), (2, near), *((3 + i, "other words") for i in range(20))], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert time.time() - began < 60
    assert found[1].labels == "gpl-3" and found[1].score == 1.0 and found[2].labels == ""
    assert (found[1].n_words, found[1].n_base) == brute_force(text)[:2]

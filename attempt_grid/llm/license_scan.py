"""Licence notices by a positional index of rare words, in DataFrame expressions.

One pass over the texts keeps, per document, where words of the licence vocabulary stand. From
that table come the document frequencies of these words over all documents, hence for each
template its words of highest IDF: the index. A document's occurrences of indexed words are
looked up; postings of one template that agree on where the template would start are added up,
and a start whose words reach ``least_share`` of the template's indexed IDF is a candidate. It
counts if the template's key phrases stand word for word within reach of that start.

Fixed phrases are found in the same table by intersecting the shifted places of their words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label: (template text, key phrases that must stand in it). Where licences differ by
# version only, the version is part of a key phrase.
TEMPLATES = {
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software",
         ["hereby granted free of charge", "copy of this software"]),
    ],
    "apache-2": [("licensed under the apache license version 2 0", ["apache license version 2"])],
    "cc-by": [("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"])],
    "cc-by-nc": [
        ("licensed under cc by nc 4 0", ["cc by nc"]),
        ("licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4"]),
    ],
    "cc-by-sa": [
        ("licensed under cc by sa 4 0", ["cc by sa"]),
        ("licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4"]),
    ],
    "gpl-2": [
        ("this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
        ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
         ["gnu general public license", "version 2 of the license"]),
    ],
    "gpl-3": [
        ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
        ("this work is licensed under the gnu general public license v3", ["gnu general public license v3"]),
        ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
         ["gnu general public license", "version 3 of the license"]),
    ],
    "lgpl-2.1": [
        ("licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license version 2 1"]),
        ("under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
         ["gnu lesser general public license", "version 2 1 of the license"]),
    ],
    "lgpl-3": [
        ("licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
        ("under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
         ["gnu lesser general public license", "version 3 of the license"]),
    ],
    "agpl-3": [
        ("licensed under the gnu affero general public license version 3", ["gnu affero general public license version 3"]),
        ("under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
         ["gnu affero general public license", "version 3 of the license"]),
    ],
    "mpl-1.1": [("subject to the mozilla public license version 1 1", ["mozilla public license version 1 1"])],
    "mpl-2": [
        ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2"]),
        ("licensed under the mozilla public license version 2 0", ["mozilla public license version 2"]),
    ],
    "bsd-3": [("redistribution and use in source and binary forms with or without modification are permitted provided",
               ["source and binary forms", "with or without modification"])],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ["for any purpose with or without fee"])],
    "unlicense": [("this is free and unencumbered software released into the public domain",
                   ["free and unencumbered software"])],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaced(text: Column) -> Column:
    """A-Z lowered, words joined by one space."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(low, BETWEEN_WORDS, " "))


def licence_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(row, doc_id, n_words, hits): places of vocabulary words in each whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = texts.select("doc_id", _spaced(F.col("text")).alias("spaced")).select(
        "doc_id", F.when(F.col("spaced") == "", F.array().cast("array<string>")).otherwise(F.split("spaced", " ")).alias("words")
    )
    placed = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at"))))
    return words.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array_compact(placed).alias("hits"),
    )


def _places(phrase: str, hits: str = "hits") -> Column:
    """Starts of a phrase, ascending."""

    def start(k: int, word: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: h["at"] - k)

    return reduce(F.array_intersect, (start(k, word) for k, word in enumerate(phrase.split())))


def _index(table: DataFrame, words_per_template: int) -> list[tuple]:
    """(word, template, label, at, idf, total) postings of each template's rarest words."""
    frequencies = {
        r["word"]: r["n"]
        for r in table.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).collect()  # one row per vocabulary word
    }
    n_docs = table.count()
    idf = lambda w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 0.5))
    out, number = [], 0
    for label, templates in TEMPLATES.items():
        for text, _ in templates:
            words = text.split()
            rare = sorted(set(words), key=lambda w: (-idf(w), w))[:words_per_template]
            total = sum(max(idf(w), 0.0) for w in words if w in rare)
            out += [(w, number, label, at, max(idf(w), 0.0), total) for at, w in enumerate(words) if w in rare]
            number += 1
    return out


def scan_licenses(docs: DataFrame, words_per_template: int = 5, least_share: float = 0.7) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the fixed phrases, first_word and last_word are the smallest and
    the largest start (null without any). labels adds those of verified templates. score is 1 for
    a fixed phrase, else the best verified share of indexed IDF to nine digits, 0 without a label. Null and empty
    texts have no words and no labels; repeated rows are each answered.
    """
    spark = docs.sparkSession
    pairs = [(text, keys) for templates in TEMPLATES.values() for text, keys in templates]
    vocabulary = sorted({w for text, keys in pairs for part in (text, *keys) for w in part.split()} | {w for p in PHRASES for w in p.split()})
    table = written(licence_words(docs, vocabulary))

    postings = spark.createDataFrame(
        _index(table, words_per_template), "word string, template int, label string, template_at int, idf double, total double"
    )
    starts = (
        table.select("row", F.explode("hits").alias("hit"))
        .select("row", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
        .join(F.broadcast(postings), "word")  # at most words_per_template rows a template
        .groupBy("row", "template", "label", (F.col("at") - F.col("template_at")).alias("start"))
        .agg((F.sum("idf") / F.max("total")).alias("share"))
        .filter(F.col("share") >= least_share)
        .withColumn("share", F.round(F.least("share", F.lit(1.0)), 9))
        .groupBy("row", "template", "label", "share")  # a template's few words have few sums
        .agg(F.collect_list("start").alias("at"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("template", "label", "share", "at")).alias("starts"))
    )

    found = table.join(starts, "row", "left")
    base = {p: F.when(F.size("hits") > 0, _places(p)).otherwise(F.array().cast("array<int>")) for p in PHRASES}
    found = found.withColumns({f"base{k}": base[p] for k, p in enumerate(PHRASES)})

    def verified(group: Column) -> Column:
        """At one of the starts every key phrase stands within the template, give or take two words.

        The starts that a phrase allows are listed, a template's length for each place, and
        intersected by hashing, so the work is linear in the text."""
        ok = F.lit(False)
        for number, (text, keys) in enumerate(pairs):
            last = len(text.split()) + 2
            allowed = [F.flatten(F.transform(_places(k), lambda at: F.sequence(at - last, at + 2))) for k in keys]
            ok = F.when(group["template"] == number, F.size(reduce(F.array_intersect, allowed, group["at"])) > 0).otherwise(ok)
        return ok

    found = found.withColumn("kept", F.filter("starts", verified))
    places = F.array_sort(F.concat(*(F.col(f"base{k}") for k in range(len(PHRASES)))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    added = F.coalesce(F.transform("kept", lambda s: s["label"]), F.array().cast("array<string>"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("kept", lambda s: s["share"])), F.lit(0.0))
    return found.withColumn("places", places).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("long").alias("last_word"),
        listed(base_labels).alias("base_labels"),
        listed(F.concat(base_labels, added)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.round(best, 9)).alias("score"),
    )

"""DuckDB SQL for the queries that SQL can express, with the same columns and rows.

The other queries use trained models, tokenizers or hashes that DuckDB lacks; tests hold them
against brute force.
"""

from __future__ import annotations

from .license_scan import LOWER, PHRASES, TEMPLATES, UPPER

SUBSTRING_DEDUP = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
    SELECT doc_id, start, array_to_string(list_slice(words, start, start + 19), ' ') AS content
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM split WHERE len(words) >= 20)
),
later AS (
    SELECT doc_id, start FROM windows
    QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, start) > 1
),
covered AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM later),
gone AS (SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id),
judged AS (
    SELECT doc_id, words, coalesce(len(places), 0) AS n_removed,
           CASE WHEN places IS NULL THEN words
                ELSE list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)))) END AS kept
    FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM judged
"""

# Vectors that take part in a comparison, in double precision.
USABLE = """
usable AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS v
    FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      AND vec_id IS NOT NULL
)
"""

EMBEDDING_NEAR_DEDUP = f"""
WITH RECURSIVE {USABLE},
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, b) AS component_id,
       coalesce(vec_id = least(vec_id, b), true) AS kept
FROM embeddings
LEFT JOIN counts ON counts.a = vec_id
LEFT JOIN (SELECT a AS member, b FROM least) ON member = vec_id
"""

NEIGHBOURS = f"""
WITH {USABLE},
found AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score
FROM found
QUALIFY rank <= 10
"""


def license_scan(words_per_template: int = 5, least_share: float = 0.7) -> str:
    """The licence scan with the operator's own phrases and templates as tables."""
    templates = [(label, text.split(), keys) for label, of_label in TEMPLATES.items() for text, keys in of_label]
    listed = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    phrases = [(f"base {label}", word, k, len(p.split())) for p, label in PHRASES.items() for k, word in enumerate(p.split())]
    keys = sorted({key for _, _, of_template in templates for key in of_template})
    phrases += [(key, word, k, len(key.split())) for key in keys for k, word in enumerate(key.split())]
    words = [(t, label, len(text), k, word) for t, (label, text, _) in enumerate(templates) for k, word in enumerate(text)]
    needs = [(t, key) for t, (_, _, of_template) in enumerate(templates) for key in of_template]
    return rf"""
WITH phrases(phrase, word, k, n) AS (VALUES {listed(phrases)}),
templates(template, label, n, k, word) AS (VALUES {listed(words)}),
needs(template, phrase) AS (VALUES {listed(needs)}),
split AS MATERIALIZED (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
placed AS MATERIALIZED (
    SELECT * FROM (SELECT doc, unnest(words) AS word, unnest(range(len(words))) AS place FROM split)
    WHERE word IN (SELECT word FROM phrases) OR word IN (SELECT word FROM templates)
),
stands AS MATERIALIZED (
    SELECT doc, phrase, place - k AS start FROM placed JOIN phrases USING (word)
    GROUP BY ALL HAVING count(*) = any_value(n)
),
base AS (
    SELECT doc, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
           string_agg(DISTINCT phrase[6:], ',' ORDER BY phrase[6:]) AS base_labels
    FROM stands WHERE phrase LIKE 'base %' GROUP BY doc
),
frequencies AS (SELECT word, count(DISTINCT doc) AS n FROM placed GROUP BY word),
weighted AS (
    SELECT t.*, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(f.n, 0) + 0.5)::DOUBLE) AS idf,
           dense_rank() OVER (PARTITION BY template ORDER BY coalesce(f.n, 0), word) AS rarity
    FROM templates t LEFT JOIN frequencies f USING (word)
),
postings AS (
    SELECT *, sum(idf) OVER (PARTITION BY template) AS total FROM weighted WHERE rarity <= {words_per_template}
),
starts AS (
    SELECT doc, template, label, postings.n, place - k AS start, sum(idf) / any_value(total) AS share
    FROM placed JOIN postings USING (word)
    GROUP BY ALL HAVING sum(idf) / any_value(total) >= {least_share}
),
kept AS (
    SELECT doc, label, least(share, 1.0) AS share FROM starts s
    WHERE NOT EXISTS (
        SELECT 1 FROM needs
        WHERE needs.template = s.template AND NOT EXISTS (
            SELECT 1 FROM stands
            WHERE stands.doc = s.doc AND stands.phrase = needs.phrase
              AND stands.start BETWEEN s.start - 2 AND s.start + s.n + 2
        )
    )
),
labelled AS (
    SELECT doc, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc, label FROM kept UNION SELECT doc, phrase[6:] FROM stands WHERE phrase LIKE 'base %')
    GROUP BY doc
),
scored AS (SELECT doc, max(share) AS share FROM kept GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(round(share::DOUBLE, 9), 0.0::DOUBLE) END AS score
FROM split LEFT JOIN base USING (doc) LEFT JOIN labelled USING (doc) LEFT JOIN scored USING (doc)
"""

LEXICAL_SEARCH = rf"""
WITH split AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
),
counted AS (SELECT doc, doc_id, words, len(words)::BIGINT AS n FROM split WHERE len(words) > 0),
everything AS (SELECT count(*)::BIGINT AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_words FROM counted),
items AS (
    SELECT row_number() OVER () AS item, item_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM benchmark
),
asked AS (SELECT item, item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item, item_id, unnest(words) AS term FROM items) GROUP BY ALL),
held AS (
    SELECT doc, term, count(*)::BIGINT AS tf
    FROM (SELECT doc, unnest(words) AS term FROM counted) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weighed AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), everything
),
shares AS (
    SELECT doc, doc_id, term,
           (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_words)) AS share
    FROM held JOIN counted USING (doc), everything
),
scored AS (
    SELECT item, item_id, doc, doc_id, sum(repeats * w * share)::BIGINT AS score
    FROM asked JOIN weighed USING (term) JOIN shares USING (term)
    GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scored WHERE score > 0
)
WHERE rank <= 20
"""


ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op4_license_scan": license_scan(),
    "op5_embedding_near_dedup": EMBEDDING_NEAR_DEDUP,
    "op10_vantage_point_neighbours": NEIGHBOURS,
    "op11_lexical_search": LEXICAL_SEARCH,
}

"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

_SMALL = "translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The columns of op2 that its base phrases give.
OP2_BASE_SQL = rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all({_SMALL.format(text="text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(phrase, label) AS (
    VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')
), places AS (
    SELECT doc_id, w, unnest(range(len(w))) AS pos FROM words WHERE len(w) > 1
), hits AS (
    SELECT doc_id, pos, label FROM places, phrases WHERE w[pos + 1] = phrase[1] AND w[pos + 1 : pos + len(phrase)] = phrase
)
SELECT words.doc_id, len(any_value(w))::BIGINT AS n_words, count(pos)::BIGINT AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN hits ON hits.doc_id = words.doc_id
GROUP BY words.doc_id
"""

OP4_SQL = rf"""
WITH lines AS (
    SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS line FROM documents
), numbered AS (
    SELECT doc_id, site, unnest(line) AS line, unnest(range(len(line))) AS k FROM lines
), words AS (
    SELECT *, array_to_string(regexp_extract_all({_SMALL.format(text="line")}, '[^\x20\x09-\x0D]+'), ' ') AS norm FROM numbered
), bad AS (
    SELECT norm FROM words WHERE norm != '' GROUP BY norm HAVING count(DISTINCT site) >= 10
), kept AS (
    SELECT doc_id, k, line, norm IN (SELECT norm FROM bad) AS gone FROM words
), cleaned AS (
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
    FROM kept GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars_left, sha256(text) AS text_sha256 FROM cleaned
"""

OP6_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_SMALL.format(text="text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS shingle FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION
    SELECT r.node, l.b FROM reached r JOIN both_ways l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reached r ON r.node = d.doc_id
GROUP BY d.doc_id, s.n
"""

OP9_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id != y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reached AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other
), degrees AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(any_value(d.n), 0)::BIGINT AS n_links, min(r.other) AS component_id, min(r.other) = e.vec_id AS kept
FROM embeddings e JOIN reached r ON r.node = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
GROUP BY e.vec_id
"""

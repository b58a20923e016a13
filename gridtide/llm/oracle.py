"""SQL twins of the text queries that SQL can express, for an engine other than Spark.

They work on words and texts themselves, without hashes, sketches or fingerprints.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS a FROM documents
    ), shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))
        WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS s FROM words
    ), sizes AS (
      SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
    ), common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
      FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
      SELECT x, y FROM common c JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
      WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)
    ), both_ways AS (
      SELECT x, y FROM links UNION ALL SELECT y, x FROM links
    ), reached AS (
      SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x
    )
    SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM reached WHERE x = doc_id) AS component_id FROM sizes
"""

ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all({LOWER}, {ITEM_WORDS}) AS a FROM documents
    ), items AS (
      SELECT item_id, regexp_extract_all({LOWER}, {ITEM_WORDS}) AS a FROM benchmark
    ), windows AS (
      SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(a) - m + 2),
                                         lambda i: array_to_string(a[i:i + m - 1], ' '))) AS g
      FROM (SELECT *, CAST(least(13, len(a)) AS BIGINT) AS m FROM items WHERE len(a) > 0)
    ), places AS (
      SELECT doc_id, m, p, array_to_string(a[p:p + m - 1], ' ') AS g
      FROM (SELECT doc_id, a, m, unnest(range(1, len(a) - m + 2)) AS p
            FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(a) >= m)
    ), hits AS (
      SELECT doc_id, item_id, p, m FROM places JOIN windows USING (m, g)
    ), hit_words AS (
      SELECT doc_id, count(*) AS n_hit
      FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS w FROM hits) GROUP BY doc_id
    ), hit_items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, len(a) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(a) AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"


ORDERED = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt"
UP_TO_HERE = f"({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

CHAT = rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
      UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
    ), sized AS (
      SELECT *, 15 + length({_escaped('role')}) + length({_escaped('txt')}) AS size FROM turns
    ), counted AS (
      SELECT *, CAST(ceil(size / 4) AS BIGINT) AS tokens, row_number() OVER ({ORDERED}) AS n FROM sized
    ), summed AS (
      SELECT *, n = 1 AND role = 'system' AS is_system, sum(tokens) OVER {UP_TO_HERE} - tokens AS begin FROM counted
    ), shared AS (
      SELECT *, greatest(1, (2048 - 256 - max(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) // 2) AS share
      FROM summed
    ), broken AS (
      SELECT *, CAST(tokens > share OR coalesce(lag(tokens > share) OVER ({ORDERED}), false) AS INTEGER) AS fresh FROM shared
    ), parted AS (
      SELECT *, sum(fresh) OVER {UP_TO_HERE} AS part FROM broken
    ), celled AS (
      SELECT *, (begin - min(begin) OVER (PARTITION BY conv_id, part)) // share AS cell FROM parted
    ), windowed AS (
      SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY part, cell) AS w,
             max(begin + tokens) OVER (PARTITION BY conv_id, part, cell) AS stop FROM celled
    ), repeated AS (
      SELECT *, max(w) OVER (PARTITION BY conv_id) AS last FROM windowed
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY n)) AS turns_sha256,
           CAST(coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(txt, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(size * CASE WHEN is_system THEN last WHEN w < last AND stop - begin <= 256 THEN 2 ELSE 1 END) AS BIGINT)
             AS formatted_chars
    FROM repeated GROUP BY conv_id
"""

HARD_NEGATIVES = """
    WITH vectors AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)
    ), scores AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""

ORACLE = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op3_decontaminate": DECONTAMINATE,
    "op8_chat": CHAT,
    "op12_hard_negatives": HARD_NEGATIVES,
}

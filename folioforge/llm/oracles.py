"""DuckDB SQL for the contract queries that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP10 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[]
         WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
-- copies of one set count once in the join: they are one class
c AS (SELECT min(doc_id) AS node, hash(list_sort(sh)) AS h, any_value(sh) AS sh, any_value(len(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), hash(list_sort(sh))),
x AS (SELECT node, n, unnest(sh) AS g FROM c),
p AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.g = b.g AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT node AS start, node AS reach FROM c UNION SELECT r.start, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT start AS node, min(reach) AS component FROM r GROUP BY start),
k AS (SELECT s.doc_id, coalesce(m.component, s.doc_id) AS component_id
      FROM s LEFT JOIN c ON len(s.sh) > 0 AND hash(list_sort(s.sh)) = c.h AND list_sort(s.sh) = list_sort(c.sh) LEFT JOIN m ON m.node = c.node)
SELECT k.doc_id, n.n AS n_shingles, k.component_id, k.doc_id = k.component_id AS kept FROM k JOIN n USING (doc_id)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents),
full_docs AS (SELECT doc_id, row_number() OVER () AS r, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM full_docs),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, r, n, term, count(*) AS tf
      FROM (SELECT doc_id, r, n, unnest(terms) AS term FROM full_docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
h AS (SELECT q.item_id, p.doc_id, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * s.big_n) // s.big_l))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, p.doc_id, p.r)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM h WHERE score > 0)
WHERE rank <= 10
"""

ORACLES = {"op4_hyperminhash": OP4, "op10_chunk_recipes": OP10, "op11_heap_merge_search": OP11}

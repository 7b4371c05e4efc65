"""DuckDB SQL of those queries that SQL can express over whole tables."""

from cashtide.llm.filter_audit import OP12_SQL
from cashtide.llm.line_runs import OP11_SQL
from cashtide.llm.secret_ledger import OP10_SQL
from cashtide.llm.vector_clusters import OP13_SQL

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w
        WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM sides UNION SELECT r.x, t.y FROM reach r JOIN sides t ON t.x = r.y),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
  least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_id l ON l.x = d.doc_id
"""

_BENCH = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_BENCH}, []) AS w FROM documents),
items AS (SELECT DISTINCT item_id, {_BENCH} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS size,
          unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
seen AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i
        FROM d CROSS JOIN sizes)),
hits AS (SELECT seen.doc_id, seen.i, seen.size, win.item_id
  FROM seen JOIN win ON win.g = seen.g AND win.size = seen.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""

OP6_SQL = rf"""
WITH tf AS (SELECT doc_id, t, count(*) AS c
  FROM (SELECT doc_id, unnest({_WORDS}) AS t FROM documents) GROUP BY ALL),
len_of AS (SELECT doc_id, sum(c) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, (SELECT sum(n) FROM len_of) / count(*) AS mean FROM documents),
idf AS (SELECT t, ln(1 + (any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM tf CROSS JOIN whole GROUP BY t),
q AS (SELECT doc_id AS query_id, t FROM tf WHERE doc_id % 100 = 0),
scored AS (SELECT query_id, tf.doc_id, round(sum(idf * c * 2.2 /
    (c + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score
  FROM q JOIN tf USING (t) JOIN idf USING (t) JOIN len_of ON len_of.doc_id = tf.doc_id
  CROSS JOIN whole GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, round(score, 6) AS score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w <= 10
"""

ORACLE = {
    "op4_jaccard_components": OP4_SQL,
    "op5_benchmark_overlap": OP5_SQL,
    "op6_bm25_topk": OP6_SQL,
    "op10_secret_ledger": OP10_SQL,
    "op11_line_dedup": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_vector_clusters": OP13_SQL,
}

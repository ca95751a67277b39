"""DuckDB SQL that gives the rows of the queries it is named after."""

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1),
           lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams
  FROM w),
distinct_sets AS MATERIALIZED (
  SELECT md5(array_to_string(list_sort(grams), chr(10))) AS k, min(doc_id) AS id, any_value(grams) AS grams
  FROM s WHERE len(grams) > 0 GROUP BY 1),
g AS MATERIALIZED (SELECT id, len(grams) AS n, unnest(grams) AS gram FROM distinct_sets),
pairs AS MATERIALIZED (
  SELECT a.id AS x, b.id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(id, to_id) AS (
  SELECT id, id FROM distinct_sets
  UNION
  SELECT r.id, e.y FROM reach r JOIN edges e ON r.to_id = e.x),
parts AS (SELECT id, min(to_id) AS component FROM reach GROUP BY id)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(p.component, s.doc_id) AS component_id
FROM s LEFT JOIN distinct_sets d ON len(s.grams) > 0 AND d.k = md5(array_to_string(list_sort(s.grams), chr(10)))
LEFT JOIN parts p ON p.id = d.id
"""

BLOCK_JOIN = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS MATERIALIZED (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) / (q.size * c.size) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

LINE_SPREAD = r"""
WITH parts AS MATERIALIZED (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS p FROM documents),
lines AS MATERIALIZED (
  SELECT doc_id, source, i AS n, trim(p[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, p[i] AS full_line
  FROM (SELECT doc_id, source, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
hot AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 4),
firsts AS (
  SELECT l.line, min(l.doc_id) AS keeper, min(l.n) AS n
  FROM lines l JOIN hot h ON l.line = h.line AND l.doc_id = h.keeper GROUP BY l.line),
marked AS (
  SELECT l.*, f.line IS NOT NULL AND NOT (l.doc_id = f.keeper AND l.n = f.n) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line),
cleaned AS (
  SELECT doc_id, count(*)::INTEGER AS lines, count(*) FILTER (WHERE gone)::INTEGER AS removed_lines,
    coalesce(string_agg(full_line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT parts.doc_id, coalesce(c.lines, 0) AS lines, coalesce(c.removed_lines, 0) AS removed_lines,
  CASE WHEN parts.text IS NOT NULL THEN c.text END AS text
FROM parts LEFT JOIN cleaned c ON parts.doc_id = c.doc_id
"""

DECONTAMINATION = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT DISTINCT gram, size FROM windows),
places AS (
  SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
  FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS MATERIALIZED (
  SELECT r, i, p.size, gram FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM places) p
  JOIN grams USING (gram, size)),
hit AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + size)) AS x FROM found) GROUP BY r),
held AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items
  FROM (SELECT DISTINCT r, gram FROM found) JOIN windows USING (gram) WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN held ON held.r = d.r
"""


def lloyd(clusters: int, rounds: int) -> str:
    """Lloyd's rounds as one chain of tables: a for assignments, c for centroids."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min(near * {clusters} + cluster) AS best FROM (
    SELECT r, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS near
    FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT cluster, CASE WHEN m.c IS NULL THEN o.c ELSE m.c END AS c FROM c{n} o LEFT JOIN (
    SELECT cluster, list(((total - (total % n + n) % n) // n)::BIGINT ORDER BY dim) AS c FROM (
      SELECT best % {clusters} AS cluster, dim, sum(x)::BIGINT AS total, count(*) AS n FROM (
        SELECT best, unnest(v) AS x, unnest(range(len(v))) AS dim FROM a{n} JOIN kept USING (r)) GROUP BY ALL)
    GROUP BY cluster) m USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, v, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) AS r FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (SELECT r - 1 AS cluster, v AS c FROM kept WHERE r <= {clusters}),
{", ".join(steps)},
rows AS (SELECT vec_id, best % {clusters} AS cluster, best // {clusters} AS distance FROM a{rounds} JOIN kept USING (r))
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
  sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM rows JOIN c{rounds} USING (cluster)
"""

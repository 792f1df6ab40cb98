"""SQL twins of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight
  FROM d GROUP BY source
), filling AS (
  SELECT *, 3 * source_size AS most,
         row_number() OVER w AS place,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_left
  FROM s WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source IS NULL, source)
), levels AS (
  SELECT *, CAST(words_left AS DOUBLE) / CAST(weights_left AS DOUBLE) AS level FROM filling
), first_open AS (
  SELECT min(place) AS place FROM levels WHERE CAST(most AS DOUBLE) > level * weight
), t AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.place >= f.place THEN (SELECT x.level FROM levels x, first_open y WHERE x.place = y.place) * l.weight
              ELSE CAST(l.most AS DOUBLE) END AS target
  FROM levels l, first_open f
), ends AS (
  SELECT d.doc_id, d.size, d.order_key, d.source, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key, d.doc_id ROWS UNBOUNDED PRECEDING) AS ends
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), sent AS (
  SELECT *, CAST(r.round * source_size + ends AS DOUBLE) / target AS finish
  FROM ends, (VALUES (0), (1), (2)) r(round) WHERE size > 0
), queue AS (
  SELECT doc_id, size,
         sum(size) OVER (ORDER BY finish, source IS NULL, source, order_key, doc_id, round ROWS UNBOUNDED PRECEDING) AS to_here
  FROM sent
), taken AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queue
  WHERE to_here <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT e.doc_id, CAST(e.size AS BIGINT) AS size, e.source_size, e.target, coalesce(taken.taken, 0) AS taken
FROM ends e LEFT JOIN taken ON e.doc_id = taken.doc_id
"""

ORACLES["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

ORACLES["op8_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), many AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < many.last_doc, false) AS gone FROM k LEFT JOIN many ON k.key = many.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLES["op11_lexical_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS item,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (
  SELECT item, item_id, term, count(*) AS often FROM i GROUP BY ALL
), corpus AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d
), tf AS (
  SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus
), m AS (
  SELECT row_id, doc_id, 75 + ((25 * len(terms) * n_docs) // n_terms) AS m FROM d, corpus WHERE len(terms) > 0
), s AS (
  SELECT a.item, a.item_id, m.doc_id, m.row_id,
         CAST(sum(a.often * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
  FROM asked a JOIN tf ON a.term = tf.term JOIN w ON a.term = w.term JOIN m ON tf.row_id = m.row_id GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
"""

ORACLES["op12_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []
         WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingles
  FROM d
), n AS (
  SELECT shingles, min(doc_id) AS node, len(shingles) AS size FROM s WHERE len(shingles) > 0 GROUP BY shingles
), t AS (
  SELECT node, size, unnest(shingles) AS shingle FROM n
), links AS (
  SELECT x.node AS a, y.node AS b FROM t x JOIN t y ON x.shingle = y.shingle AND x.node <> y.node
  GROUP BY x.node, y.node, x.size, y.size HAVING 100 * count(*) >= 80 * (x.size + y.size - count(*))
), reach AS (
  SELECT node AS a, node AS b FROM n
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), roots AS (
  SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(roots.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN n ON s.shingles = n.shingles LEFT JOIN roots ON n.node = roots.node
"""

ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), q AS (
  SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), t AS (
  SELECT lang, piece_id, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM q
), g AS (
  SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM t WINDOW s AS (PARTITION BY piece_id ORDER BY pos)
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL
), f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL
), c2 AS (
  SELECT x.lang, x.w1, x.w2, x.f AS a, y.f AS l, z.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * x.f * x.f) // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score
  FROM f2 x JOIN f1 y ON x.lang = y.lang AND x.w1 = y.w1 JOIN f1 z ON x.lang = z.lang AND x.w2 = z.w1 WHERE x.f >= 10
), cuts AS (
  SELECT x.lang, x.w1, x.w2, x.w3, x.f AS a, 1 AS k, y.f AS l, z.f AS r
  FROM f3 x JOIN f1 y ON x.lang = y.lang AND x.w1 = y.w1 JOIN f2 z ON x.lang = z.lang AND x.w2 = z.w1 AND x.w3 = z.w2 WHERE x.f >= 10
  UNION ALL
  SELECT x.lang, x.w1, x.w2, x.w3, x.f AS a, 2 AS k, y.f AS l, z.f AS r
  FROM f3 x JOIN f2 y ON x.lang = y.lang AND x.w1 = y.w1 AND x.w2 = y.w2 JOIN f1 z ON x.lang = z.lang AND x.w3 = z.w1 WHERE x.f >= 10
), scored AS (
  SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), c3 AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1
), longer AS (
  SELECT lang, w1, w2, max(a) AS most FROM (
    SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2 AS w1, w3 AS w2, a FROM c3
  ) GROUP BY ALL
), kept AS (
  SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, l, r, score FROM c3
  UNION ALL
  SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, a, l, r, score
  FROM c2 LEFT JOIN longer ON c2.lang = longer.lang AND c2.w1 = longer.w1 AND c2.w2 = longer.w2
  WHERE most IS NULL OR 100 * most < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(f) AS BIGINT) FROM f1 WHERE f1.lang = ranked.lang) AS n, score
FROM ranked WHERE rank <= 2000
"""

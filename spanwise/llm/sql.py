"""SQL of the training-data queries that SQL can express over whole tables."""

_PROXY = "proxy_structured_merged"
_MASTER = "master_table_xsum_n300_seed42_v4_dcq4_frozen"

_WINDOWS = f"""
WITH rec AS (
  SELECT 'proxy' AS rec_table, CAST(row_id AS VARCHAR) AS rec_key, summary_ref AS t FROM {_PROXY}
  UNION ALL SELECT 'master', xsum_id, summary_ref_norm FROM {_MASTER}),
own AS (SELECT rec_table, rec_key, t, unnest(range(1, length(t) - 98)) AS pos FROM rec WHERE length(t) >= 100),
win AS (SELECT rec_table, rec_key, pos, md5(substring(t, pos, 100)) AS w FROM own),
many AS (SELECT w FROM (SELECT DISTINCT w, rec_table, rec_key FROM win) GROUP BY w HAVING count(*) > 1),
hit AS (SELECT rec_table, rec_key, pos, pos - lag(pos) OVER (PARTITION BY rec_table, rec_key ORDER BY pos) AS gap FROM win WHERE w IN (SELECT w FROM many))
"""

_KEYED = rf"""
WITH keyed AS (
  SELECT *, regexp_replace(lower(summary_ref), '[^\p{{L}}\p{{N}}]+', '', 'g') AS k FROM {_PROXY} WHERE summary_ref IS NOT NULL),
grp AS (SELECT k, min(row_id) AS first_id FROM keyed WHERE k <> '' GROUP BY k HAVING count(*) > 1)
"""

_BEST = _KEYED + rf""",
man AS (SELECT lower(sha256) AS sha, max(ts) AS latest FROM proxy_sources_manifest WHERE sha256 IS NOT NULL GROUP BY 1),
tr AS (SELECT lower(trim(source)) AS s, max(trust) AS trust FROM source_trust GROUP BY 1),
own AS (SELECT g.first_id, d.row_id, d.document, d.xsum_id, coalesce(tr.trust, 0) AS trust, d.source_sha256, man.latest
  FROM keyed d JOIN grp g USING (k)
  LEFT JOIN tr ON tr.s = regexp_replace(lower(d.source), '^\s+|\s+$', '', 'g')
  LEFT JOIN man ON man.sha = lower(d.source_sha256) AND regexp_full_match(d.source_sha256, '[0-9a-fA-F]{{64}}')),
doc AS (SELECT first_id, row_id, row_number() OVER (PARTITION BY first_id ORDER BY length(document) DESC, row_id) AS r FROM own WHERE regexp_matches(document, '\S')),
xs AS (SELECT first_id, row_id, row_number() OVER (PARTITION BY first_id ORDER BY trust DESC, row_id) AS r FROM own WHERE regexp_full_match(xsum_id, '[0-9]{{8}}')),
sh AS (SELECT first_id, row_id, row_number() OVER (PARTITION BY first_id ORDER BY latest DESC, row_id) AS r FROM own WHERE latest IS NOT NULL)"""
_BEST_ROWS = """
SELECT g.first_id, coalesce(d.row_id, 0) AS document_row_id, coalesce(x.row_id, 0) AS xsum_row_id, coalesce(s.row_id, 0) AS sha_row_id
FROM grp g LEFT JOIN doc d ON d.first_id = g.first_id AND d.r = 1 LEFT JOIN xs x ON x.first_id = g.first_id AND x.r = 1 LEFT JOIN sh s ON s.first_id = g.first_id AND s.r = 1"""

_PAIRS = rf"""
f AS (SELECT 'summary_ref' AS field_name, row_id, summary_ref AS t FROM {_PROXY} UNION ALL SELECT 'document', row_id, document FROM {_PROXY}),
w AS (SELECT DISTINCT field_name, row_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+')) AS word FROM f WHERE t IS NOT NULL),
n AS (SELECT field_name, row_id, count(*) AS n FROM w GROUP BY 1, 2),
c AS (SELECT a.field_name, a.row_id AS row_a, b.row_id AS row_b, count(*) AS c FROM w a JOIN w b ON a.field_name = b.field_name AND a.word = b.word AND a.row_id < b.row_id GROUP BY 1, 2, 3),
pairs AS (SELECT c.field_name, c.row_a, c.row_b FROM c JOIN n x ON x.field_name = c.field_name AND x.row_id = c.row_a JOIN n y ON y.field_name = c.field_name AND y.row_id = c.row_b
  WHERE c.c * 10 >= 6 * (x.n + y.n - c.c))
"""

# the canonical keys of both sources: letters and digits, and for JSON objects those of each field, sorted
_LAYOUT = rf"""
WITH line AS (SELECT raw_id, raw FROM raw_corpus_records WHERE raw IS NOT NULL AND json_valid(raw) AND json_type(raw) = 'OBJECT'),
field AS (SELECT raw_id, lower(e.key) || ':' || regexp_replace(lower(CASE WHEN e.type = 'VARCHAR' THEN e.value ->> '$' ELSE CAST(e.value AS VARCHAR) END), '[^\p{{L}}\p{{N}}]+', '', 'g') AS f FROM line, json_each(line.raw) e),
keyed AS (
  SELECT 'raw' AS rec_table, raw_id AS id, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM field WHERE field.raw_id = line.raw_id), '') AS k FROM line
  UNION ALL SELECT 'proxy', row_id, regexp_replace(lower(summary_ref), '[^\p{{L}}\p{{N}}]+', '', 'g') FROM {_PROXY} WHERE regexp_matches(summary_ref, '[\p{{L}}\p{{N}}]')),
grp AS (SELECT rec_table, k, min(id) AS first_id, count(*) AS copies FROM keyed GROUP BY 1, 2)
"""

_LEAKS = rf"""
WITH it AS (SELECT xsum_id, unnest([summary_ref_norm, document_norm]) AS t FROM {_MASTER} WHERE coalesce(lower(trim(split)), '') <> 'train'),
iw AS (SELECT xsum_id, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM it WHERE t IS NOT NULL),
ig AS (SELECT DISTINCT xsum_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT xsum_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw WHERE len(w) >= 13)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13))
"""

SQL: dict[str, str] = {
    "p1_found": _WINDOWS + "SELECT DISTINCT rec_table, rec_key FROM hit",
    "p1_spans": _WINDOWS + """SELECT h.rec_table, h.rec_key, CAST(length(r.t) AS INTEGER) AS n_chars, CAST(h.n AS BIGINT) AS n_shared
FROM (SELECT rec_table, rec_key, sum(least(coalesce(gap, 100), 100)) AS n FROM hit GROUP BY 1, 2) h
JOIN rec r ON r.rec_table = h.rec_table AND r.rec_key = h.rec_key""",
    "p1_clusters": _WINDOWS.replace("WITH rec", "WITH RECURSIVE rec") + """,
least AS (SELECT w, min((rec_table, rec_key)) AS m FROM win WHERE w IN (SELECT w FROM many) GROUP BY 1),
star AS (SELECT DISTINCT (win.rec_table, win.rec_key) AS x, m AS y FROM win JOIN least ON least.w = win.w),
edge AS MATERIALIZED (SELECT x, y FROM star UNION SELECT y, x FROM star),
reach(x, c) USING KEY (x) AS (SELECT x, x FROM edge GROUP BY 1
  UNION SELECT e.x, min(r.c) FROM edge e JOIN reach r ON r.x = e.y JOIN recurring.reach o ON o.x = e.x GROUP BY 1 HAVING min(r.c) < min(o.c))
SELECT x[1] AS rec_table, x[2] AS rec_key, c[1] AS first_rec_table, c[2] AS first_rec_key FROM reach""",
    "p3_found": _BEST + _BEST_ROWS,
    "p3_record": _BEST + f""", ch AS ({_BEST_ROWS})
SELECT (SELECT count(*) FROM own o WHERE o.first_id = ch.first_id) AS n, ch.first_id, d.document, x.xsum_id, x.source, s.source_sha256, s.source_detail
FROM ch LEFT JOIN {_PROXY} d ON d.row_id = document_row_id LEFT JOIN {_PROXY} x ON x.row_id = xsum_row_id LEFT JOIN {_PROXY} s ON s.row_id = sha_row_id""",
    "p3_bundles": _BEST + """,
cd AS (SELECT first_id, document AS v, length(document) AS r, min(row_id) AS i FROM own WHERE regexp_matches(document, '\\S') GROUP BY 1, 2, 3),
cx AS (SELECT first_id, xsum_id AS v, trust AS r, row_id AS i FROM (SELECT *, row_number() OVER (PARTITION BY first_id, xsum_id ORDER BY trust DESC, row_id) AS k FROM own WHERE regexp_full_match(xsum_id, '[0-9]{8}')) WHERE k = 1),
pd AS (SELECT *, dense_rank() OVER (PARTITION BY first_id ORDER BY r) AS p FROM cd), px AS (SELECT *, dense_rank() OVER (PARTITION BY first_id ORDER BY r) AS p FROM cx),
sd AS (SELECT first_id, v, p::DOUBLE / max(p) OVER (PARTITION BY first_id) AS score, i FROM pd UNION ALL SELECT first_id, NULL, 0.0, 0 FROM grp),
sx AS (SELECT first_id, v, p::DOUBLE / max(p) OVER (PARTITION BY first_id) AS score, i FROM px UNION ALL SELECT first_id, NULL, 0.0, 0 FROM grp),
seen AS (SELECT DISTINCT first_id, xsum_id AS x, document AS y FROM own WHERE regexp_full_match(xsum_id, '[0-9]{8}') AND document IS NOT NULL),
pr AS (SELECT a.first_id, a.i AS x, b.i AS d, row_number() OVER (PARTITION BY a.first_id ORDER BY a.score + b.score DESC, b.score DESC, b.i = 0, b.i, a.score DESC, a.i = 0, a.i) AS k FROM sx a JOIN sd b USING (first_id)
  WHERE b.v IS NULL OR a.v IS NULL OR NOT EXISTS (SELECT 1 FROM seen s WHERE s.first_id = a.first_id AND s.x = a.v) OR EXISTS (SELECT 1 FROM seen s WHERE s.first_id = a.first_id AND s.x = a.v AND s.y = b.v))
SELECT pr.first_id, d AS document_row_id, x AS xsum_row_id, coalesce(s.row_id, 0) AS sha_row_id FROM pr LEFT JOIN sh s ON s.first_id = pr.first_id AND s.r = 1 WHERE k = 1""",
    "p4_found": _LAYOUT + "SELECT rec_table, first_id, id AS copy_id FROM keyed JOIN grp USING (rec_table, k) WHERE id <> first_id",
    "p4_collapsed": _LAYOUT + "SELECT rec_table, first_id, copies FROM grp",
    "p5_found": f"WITH {_PAIRS} SELECT field_name, row_a, row_b FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS},
edge AS MATERIALIZED (SELECT field_name, row_a AS x, row_b AS y FROM pairs UNION SELECT field_name, row_b, row_a FROM pairs),
reach(field_name, row_id, group_id) USING KEY (field_name, row_id) AS (
  SELECT field_name, x, x FROM edge GROUP BY 1, 2
  UNION SELECT e.field_name, e.x, min(r.group_id) FROM edge e JOIN reach r ON r.field_name = e.field_name AND r.row_id = e.y
    JOIN recurring.reach o ON o.field_name = e.field_name AND o.row_id = e.x GROUP BY 1, 2 HAVING min(r.group_id) < min(o.group_id))
SELECT field_name, row_id, group_id FROM reach""",
    "p5_classes": f"""WITH {_PAIRS},
s AS (SELECT field_name, row_id, list_sort(list(word)) AS words FROM w GROUP BY 1, 2),
cl AS (SELECT *, min(row_id) OVER (PARTITION BY field_name, words) AS class_id FROM s),
ends AS (SELECT field_name, row_a AS row_id, row_b AS other FROM pairs UNION ALL SELECT field_name, row_b, row_a FROM pairs),
links AS (SELECT e.field_name, e.row_id, count(DISTINCT o.class_id) AS n FROM ends e JOIN cl m ON m.field_name = e.field_name AND m.row_id = e.row_id
  JOIN cl o ON o.field_name = e.field_name AND o.row_id = e.other WHERE o.class_id <> m.class_id GROUP BY 1, 2)
SELECT cl.field_name, cl.row_id, cl.class_id, coalesce(l.n, 0) AS n_links FROM cl LEFT JOIN links l ON l.field_name = cl.field_name AND l.row_id = cl.row_id""",
    "p7_integrity": """SELECT pack_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_texts, CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_divided, CAST(0 AS BIGINT) AS n_over
FROM pack_targets""",
    "p8_found": _LEAKS + "SELECT DISTINCT doc_id, xsum_id FROM dg JOIN ig USING (g)",
    "p8_spans": _LEAKS + """,
hit AS (SELECT DISTINCT doc_id, xsum_id, i - 1 AS pos FROM dg JOIN ig USING (g)),
cut AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 13 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id, xsum_id ORDER BY pos)),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, xsum_id ORDER BY pos) AS k FROM cut)
SELECT doc_id, xsum_id, CAST(min(pos) AS BIGINT) AS first_word, CAST(max(pos) + 13 AS BIGINT) AS end_word FROM isle GROUP BY doc_id, xsum_id, k""",
}

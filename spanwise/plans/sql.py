"""The SQL (DuckDB's dialect) that each query of ``spanwise.plans.queries`` must equal, over whole tables."""

from __future__ import annotations

from spanwise.functions.text import ACCENTED, JOINED, LEXICAL_REPLACEMENTS, PLAIN, _folded

M, P, E = "master_table_xsum_n300_seed42_v4_dcq4_frozen", "proxy_structured_merged", "proxy_sources_manifest"
MODELS = "(SELECT unnest(['model_a', 'model_b', 'model_c']) AS model_id)"
SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def canon(c: str) -> str:
    out = f"coalesce({c}, '')"
    for a, b in (*LEXICAL_REPLACEMENTS, *((x, _folded(x)) for x in JOINED)):
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    out = f"translate({out}, {_q(ACCENTED)}, {_q(PLAIN)})"
    return collapse(rf"lower(regexp_replace({out}, '[^\x00-\x7F]', '', 'g'))")


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '[a-z0-9]+')"


def seed(c: str) -> str:
    return f"CAST('0x' || substr(sha256({c}), 1, 8) AS BIGINT)"


def grams(src: str, key: str, k: int = 13, limit: int | None = None) -> str:
    cut = f" AND i <= {limit}" if limit else ""
    return f"(SELECT DISTINCT {key}, array_to_string(w[i : i + {k - 1}], ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {k - 2})) AS i FROM {src} WHERE len(w) >= {k}) WHERE true{cut})"


NORM_LINE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\x20-\x7E]+', ' ', 'g'), '\s+', ' ', 'g'))"


def line_like(c: str) -> str:
    w = f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
    return rf"(len({w}) BETWEEN 12 AND 140 AND length({c}) - length(replace({c}, '.', '')) <= 4 AND 2 * len(list_filter({w}, lambda x: regexp_full_match(x, '[a-z]+'))) >= len({w}))"


def median(c: str, q: float, dp: int = 6) -> str:
    return f"round(quantile_cont({c}, {q}), {dp})"


_LEX = f"""
WITH it AS (SELECT xsum_id AS item, {canon('summary_ref_norm')} AS text FROM {M}),
ln AS (SELECT * FROM (SELECT row_id AS line, {canon('summary_ref')} AS text FROM {P}) WHERE text <> ''),
iw AS (SELECT item, {words('text')} AS w FROM it), lw AS (SELECT line, {words('text')} AS w FROM ln),
ig AS {grams('iw', 'item')}, lg AS {grams('lw', 'line')},
hits AS (SELECT item, line, count(*) AS hits FROM ig JOIN lg USING (gram) GROUP BY 1, 2),
cand AS (SELECT item, line, hits FROM hits)
"""
_SPANS = _LEX + """,
pr AS (SELECT c.item, c.line, a.text AS a, b.text AS b FROM cand c JOIN it a ON a.item = c.item JOIN ln b ON b.line = c.line),
ca AS (SELECT item, line, i, substr(a, i, 1) AS ch FROM (SELECT item, line, a, unnest(range(1, length(a) + 1)) AS i FROM pr)),
cb AS (SELECT item, line, j, substr(b, j, 1) AS ch FROM (SELECT item, line, b, unnest(range(1, length(b) + 1)) AS j FROM pr)),
di AS (SELECT ca.item, ca.line, i, i - j AS dg FROM ca JOIN cb ON ca.item = cb.item AND ca.line = cb.line AND ca.ch = cb.ch),
isl AS (SELECT item, line, dg, i - row_number() OVER (PARTITION BY item, line, dg ORDER BY i) AS g FROM di),
sp AS (SELECT item, line, max(n) AS span FROM (SELECT item, line, dg, g, count(*) AS n FROM isl GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
best AS (SELECT item, max(span) AS max_span_len, count(*) FILTER (WHERE span >= 50) AS proxy_count FROM sp GROUP BY 1),
ng AS (SELECT item, count(*) AS ngram_hits FROM (SELECT DISTINCT ig.item, ig.gram FROM ig JOIN cand ON cand.item = ig.item JOIN lg ON lg.line = cand.line AND lg.gram = ig.gram) GROUP BY 1),
ex AS (SELECT it.item, coalesce(max_span_len, 0) AS max_span_len, coalesce(ngram_hits, 0) AS ngram_hits, coalesce(proxy_count, 0) AS proxy_count FROM it LEFT JOIN best ON best.item = it.item LEFT JOIN ng ON ng.item = it.item),
sx AS (SELECT *, CAST(CASE WHEN max_span_len >= 100 THEN 3 WHEN max_span_len >= 50 OR ngram_hits >= 3 THEN 2 WHEN max_span_len >= 30 OR ngram_hits >= 1 THEN 1 ELSE 0 END AS BIGINT) AS slex FROM ex)
"""
_LEX_LEVEL = "CAST(CASE WHEN {n} = 0 OR {p} = 0 THEN 0 WHEN {n3} > 0 OR {t} / {n} >= 0.1 THEN 3 WHEN {t} > 0 OR {p} / {n} >= 0.05 THEN 2 ELSE 1 END AS BIGINT)"
_LABEL = "CASE WHEN {0} IS NULL THEN '' WHEN {0} = 0 THEN 'Not detected' WHEN {0} = 1 THEN 'Weak presence' WHEN {0} = 2 THEN 'Moderate presence' ELSE 'Widely available' END"
_LEX_AGG = (
    _SPANS
    + f""",
ag AS (SELECT count(*) AS n_items, count(*) FILTER (WHERE slex = 0) AS n0, count(*) FILTER (WHERE slex = 1) AS n1, count(*) FILTER (WHERE slex = 2) AS n2, count(*) FILTER (WHERE slex = 3) AS n3,
  round(avg(max_span_len), 6) AS max_span_len_mean, round(avg(ngram_hits), 6) AS ngram_hits_mean, round(avg(proxy_count), 6) AS proxy_count_mean FROM sx),
sa AS (SELECT *, {_LEX_LEVEL.format(n='n_items', p='(n1 + n2 + n3)', n3='n3', t='(n2 + n3)')} AS slex_aggregate FROM ag)
"""
)

_MERGED = f"(SELECT *, CAST(CASE WHEN lower(trim(coalesce(source, ''))) = 'github' THEN 0 ELSE 1 END AS INTEGER) AS source_rank FROM {P})"
_DEDUPE_KEY = collapse("lower(coalesce(summary_ref, ''))")


def _dedupe(key: str) -> str:
    return f"SELECT row_id, source_rank FROM (SELECT row_id, source_rank, row_number() OVER (PARTITION BY {key} ORDER BY source_rank, row_id) AS r FROM {_MERGED}) WHERE r = 1"


_HASH = "md5(coalesce(document, '') || '||' || coalesce(summary_ref, ''))"

_QUIZ = f"""
WITH qi AS (SELECT xsum_id AS item, dcq_a_canonical AS canonical, unnest(['P1', 'P2', 'P3', 'P4']) AS label, unnest([dcq_b_para1, dcq_c_para2, dcq_d_para3, dcq_e_para4]) AS text FROM {M}
  WHERE coalesce(trim(dcq_a_canonical), '') <> '' AND coalesce(trim(dcq_b_para1), '') <> '' AND coalesce(trim(dcq_c_para2), '') <> '' AND coalesce(trim(dcq_d_para3), '') <> '' AND coalesce(trim(dcq_e_para4), '') <> ''),
ids AS (SELECT DISTINCT item, canonical FROM qi),
ans AS (SELECT model_id, item, what, trim(substr('ABBBBCCCDDDE ', CAST({seed("model_id || '::' || item || '::' || what")} % 13 AS INTEGER) + 1, 1)) AS choice FROM ids, {MODELS}, (SELECT unnest(['bdq', 'bcq']) AS what)),
hist AS (SELECT model_id, count(*) AS n_valid, count(*) FILTER (WHERE choice = 'A') AS n_a, count(*) FILTER (WHERE choice = 'B') AS n_b, count(*) FILTER (WHERE choice = 'C') AS n_c, count(*) FILTER (WHERE choice = 'D') AS n_d, count(*) FILTER (WHERE choice = 'E') AS n_e FROM ans WHERE what = 'bdq' AND choice <> '' GROUP BY 1),
bias AS (SELECT *, CASE least(n_a, n_b, n_c, n_d) WHEN n_a THEN 'A' WHEN n_b THEN 'B' WHEN n_c THEN 'C' ELSE 'D' END AS least_slot, least(n_a, n_b, n_c, n_d) / n_valid AS pe FROM hist)
"""
_NONE = "SELECT item, 'E' AS slot, 'NONE' AS label, 'None of the provided options.' AS option FROM ids"
_DCQ = (
    _QUIZ
    + """,
bc AS (SELECT a.model_id, count(*) AS n_bcq, avg(CASE WHEN choice = least_slot THEN 1.0 ELSE 0.0 END) AS cps, avg(CASE WHEN choice = 'E' THEN 1.0 ELSE 0.0 END) AS e_rate FROM ans a JOIN bias USING (model_id) WHERE what = 'bcq' AND choice <> '' GROUP BY 1),
kp AS (SELECT bias.model_id, n_valid, pe, n_bcq, cps, e_rate, CASE WHEN n_valid >= 50 AND pe < 1 THEN (cps - pe) / (1 - pe) END AS kappa FROM bias LEFT JOIN bc USING (model_id)),
ds AS (SELECT *, CASE WHEN cps IS NULL THEN 'no_bcq_data' WHEN kappa < 0 AND e_rate <= 0.4 THEN 'negative_kappa_clean' WHEN kappa IS NULL AND cps < 0.1 AND e_rate <= 0.4 THEN 'very_low_cps_no_kappa'
  WHEN cps >= 0.6 AND coalesce(kappa, 1) >= 0.2 THEN 'high_cps_confirmed' WHEN cps >= 0.6 THEN 'high_cps_weak_kappa' WHEN cps >= 0.45 AND coalesce(kappa, 1) >= 0.1 THEN 'moderate_cps_confirmed' WHEN cps >= 0.45 THEN 'moderate_cps_weak_kappa'
  WHEN cps >= 0.25 THEN 'weak_cps_above_chance' WHEN e_rate > 0.4 THEN 'high_e_rate_signal' ELSE 'below_chance_cps_nonzero_kappa' END AS ssem_reason FROM kp)
"""
)

_MEM = f"""
WITH mi AS (SELECT xsum_id AS item, {canon('summary_ref_norm')} AS ref, {canon('prefix_ref')} AS prefix FROM {M}),
ms AS (SELECT item, prefix, CASE WHEN prefix <> '' AND starts_with(ref, prefix) THEN trim(substr(ref, length(prefix) + 1)) ELSE '' END AS suffix FROM mi),
li AS (SELECT row_id, {canon('summary_ref')} AS line FROM {P}),
lh AS (SELECT *, array_to_string(string_split(line, ' ')[1:8], ' ') AS head FROM li WHERE line <> ''),
fo AS (SELECT item, row_id, trim(substr(line, length(prefix) + 1)) AS text FROM ms JOIN lh ON lh.head = array_to_string(string_split(prefix, ' ')[1:8], ' ') WHERE prefix <> '' AND starts_with(line, prefix)),
bm AS (SELECT model_id, item, text FROM (SELECT model_id, item, text, row_number() OVER (PARTITION BY model_id, item ORDER BY {seed("model_id || '::' || row_id::VARCHAR")}, row_id) AS r FROM fo, {MODELS}) WHERE r = 1),
co AS (SELECT m.model_id, ms.item, suffix, coalesce(text, '') AS completion FROM ms CROSS JOIN {MODELS} m LEFT JOIN bm ON bm.item = ms.item AND bm.model_id = m.model_id),
sc AS (SELECT model_id, item, CASE WHEN suffix <> '' THEN CAST(completion = suffix AS INTEGER) END AS exact,
  CASE WHEN suffix = '' THEN NULL WHEN completion = suffix THEN 0.0::DOUBLE WHEN completion = '' THEN 1.0::DOUBLE ELSE levenshtein(completion, suffix)::DOUBLE / greatest(length(completion), length(suffix)) END AS distance FROM co),
sm AS (SELECT *, CAST(distance <= 0.1 AS INTEGER) AS near, CASE WHEN exact = 1 THEN 3 WHEN distance <= 0.1 THEN 2 WHEN distance <= 0.25 THEN 1 WHEN exact IS NOT NULL THEN 0 END AS smem FROM sc)
"""
_WILSON = "((e / n + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n) {0} 1.96 / (1 + 3.8416 / n) * sqrt(e / n * (1 - e / n) / n + 3.8416 / (4.0 * n * n)))"
_MEM_SUMMARY = (
    _MEM
    + f""",
mr AS (SELECT model_id, count(*)::DOUBLE AS n, sum(exact)::DOUBLE AS e, sum(near)::DOUBLE AS ne, avg(distance) AS dm, {median('distance', .1)} AS d10, {median('distance', .5)} AS d50, {median('distance', .9)} AS d90,
  count(*) FILTER (WHERE smem = 0) AS l0, count(*) FILTER (WHERE smem = 1) AS l1, count(*) FILTER (WHERE smem = 2) AS l2, count(*) FILTER (WHERE smem = 3) AS l3 FROM sm WHERE exact IS NOT NULL GROUP BY 1),
mu AS (SELECT model_id, n::BIGINT AS n, e::BIGINT AS n_exact, (ne - e)::BIGINT AS n_near_only, (n - ne)::BIGINT AS n_none, round(e / n, 6) AS em_rate, round(ne / n, 6) AS ne_rate, round_even(greatest(0.0, {_WILSON.format('-')}), 6) AS em_low, round_even(least(1.0, {_WILSON.format('+')}), 6) AS em_high,
  round(dm, 6) AS distance_mean, d10 AS distance_p10, d50 AS distance_p50, d90 AS distance_p90, CAST(CASE greatest(l0, l1, l2, l3) WHEN l0 THEN 0 WHEN l1 THEN 1 WHEN l2 THEN 2 ELSE 3 END AS BIGINT) AS dominant_level FROM mr)
"""
)

_STAB = f"""
WITH m AS (SELECT xsum_id AS item, {canon('summary_ref_norm')} AS anchor, [{', '.join(canon(f'dcq_{x}') for x in ('a_canonical', 'b_para1', 'c_para2', 'd_para3', 'e_para4'))}] AS t FROM {M}),
tk AS (SELECT DISTINCT item, unnest(list_concat({words('anchor')}, flatten(list_transform(t, lambda x: {words('x')})))) AS tok FROM m),
vo AS (SELECT item, tok, chr(CAST(32 + row_number() OVER (PARTITION BY item ORDER BY tok) AS INTEGER)) AS c FROM tk),
tx AS (SELECT DISTINCT item, unnest(list_append(t, anchor)) AS text FROM m),
tp AS (SELECT item, text, pos, w[pos] AS tok FROM (SELECT item, text, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT item, text, {words('text')} AS w FROM tx))),
en AS (SELECT tp.item, tp.text, string_agg(c, '' ORDER BY pos) AS code FROM tp JOIN vo ON vo.item = tp.item AND vo.tok = tp.tok GROUP BY 1, 2),
co AS (SELECT tx.item, tx.text, coalesce(code, '') AS code FROM tx LEFT JOIN en ON en.item = tx.item AND en.text = tx.text),
sa AS (SELECT model_id, m.item, idx, m.anchor, m.t[CAST({seed("model_id || '::' || m.item || '::' || idx::VARCHAR")} % k AS INTEGER) + 1] AS output FROM m CROSS JOIN (SELECT unnest(['model_a', 'model_b', 'model_c']) AS model_id, unnest([1, 3, 5]) AS k) CROSS JOIN (SELECT unnest(range(0, 6)) AS idx)),
sd AS (SELECT s.*, a.code AS oc, b.code AS ac FROM sa s JOIN co a ON a.item = s.item AND a.text = s.output JOIN co b ON b.item = s.item AND b.text = s.anchor),
pd AS (SELECT x.model_id, x.item, CASE WHEN x.oc = y.oc THEN 0.0::DOUBLE WHEN x.oc = '' OR y.oc = '' THEN 1.0::DOUBLE ELSE levenshtein(x.oc, y.oc)::DOUBLE / greatest(length(x.oc), length(y.oc)) END AS d FROM sd x JOIN sd y ON x.model_id = y.model_id AND x.item = y.item AND x.idx < y.idx),
mn AS (SELECT model_id, item, avg(d) AS mned FROM pd GROUP BY 1, 2),
an AS (SELECT model_id, item, avg(d) AS anchor_mned, avg(CASE WHEN d <= 0.15 THEN 1.0 ELSE 0.0 END) AS peak_eps FROM (SELECT model_id, item, CASE WHEN oc = ac THEN 0.0::DOUBLE WHEN oc = '' OR ac = '' THEN 1.0::DOUBLE ELSE levenshtein(oc, ac)::DOUBLE / greatest(length(oc), length(ac)) END AS d FROM sd WHERE anchor <> '') GROUP BY 1, 2),
ow AS (SELECT model_id, item, count(*) AS n_samples, count(DISTINCT output) / count(*) AS uar FROM sa GROUP BY 1, 2),
st AS (SELECT ow.*, mned, anchor_mned, peak_eps FROM ow LEFT JOIN mn ON mn.model_id = ow.model_id AND mn.item = ow.item LEFT JOIN an ON an.model_id = ow.model_id AND an.item = ow.item),
ct AS (SELECT avg(uar) AS uc, avg(mned) AS mc FROM st WHERE model_id = 'model_c'),
bd AS (SELECT st.*, CASE WHEN uar IS NULL OR mned IS NULL THEN 1 WHEN uar > 0.6 AND mned > 0.25 THEN 0 WHEN uar BETWEEN 0.4 AND 0.6 OR mned BETWEEN 0.15 AND 0.25 THEN 1 WHEN (uar >= 0.2 AND uar < 0.4) OR (mned >= 0.08 AND mned < 0.15) THEN 2 ELSE 3 END AS ba,
  CASE WHEN NOT (uar > 0 AND mned > 0) THEN 0 WHEN greatest(uc / uar, mc / mned) >= 2 THEN 3 WHEN greatest(uc / uar, mc / mned) >= 1.5 THEN 2 WHEN greatest(uc / uar, mc / mned) >= 1.25 THEN 1 ELSE 0 END AS bc,
  CASE WHEN anchor_mned IS NULL OR peak_eps IS NULL THEN 1 WHEN anchor_mned >= 0.25 AND peak_eps < 0.25 THEN 0 WHEN anchor_mned < 0.08 OR peak_eps >= 0.75 THEN 3 WHEN anchor_mned < 0.15 OR peak_eps >= 0.5 THEN 2 ELSE 1 END AS bn FROM st, ct),
sb AS (SELECT *, CAST(greatest(ba, bc, bn) AS BIGINT) AS sprob FROM bd)
"""
_BASE = (
    _STAB
    + f""",
lt AS (SELECT xsum_id AS item, len({words(canon('document_norm'))}) AS n_tokens FROM {M}),
cl AS (SELECT st.*, n_tokens FROM st JOIN lt USING (item) WHERE model_id = 'model_c'),
ed AS (SELECT quantile_cont(n_tokens, [0.25, 0.5, 0.75]) AS e FROM cl),
bk AS (SELECT cl.*, CAST(len(list_distinct(list_filter(e, lambda x: x < n_tokens))) AS BIGINT) AS bucket FROM cl, ed),
ba4 AS (SELECT bucket, CAST(min(n_tokens) AS BIGINT) AS low, CAST(max(n_tokens) AS BIGINT) AS high, quantile_cont(uar, 0.5) AS um, quantile_cont(mned, 0.5) AS mm FROM bk GROUP BY 1)
"""
)

_LEVELS = f"""
WITH lv AS (SELECT model_id, xsum_id AS item, {', '.join(f"CASE WHEN {s}_h < 8 THEN CAST({s}_h // 2 AS BIGINT) END AS {s}" for s in ('slex', 'ssem', 'smem', 'sprob'))}
  FROM (SELECT model_id, xsum_id, {', '.join(seed(f"model_id || '::' || xsum_id || '::{s}'") + f' % 9 AS {s}_h' for s in ('slex', 'ssem', 'smem', 'sprob'))} FROM {M}, {MODELS}))
"""
_RAW = "0.35 * {0}ssem::DOUBLE / 3 + 0.35 * {0}smem::DOUBLE / 3 + 0.30 * {0}sprob::DOUBLE / 3".replace("{0}", "")
_BAND = "CASE WHEN crs < 0.25 THEN 'LOW' WHEN crs < 0.5 THEN 'MODERATE' WHEN crs < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END"
_COVER = "(CASE WHEN ssem > 0 THEN 1.0::DOUBLE ELSE 0.0 END + CASE WHEN smem > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN sprob > 0 THEN 1.0 ELSE 0.0 END) / 3"
_MEAN = "((ssem + smem + sprob) / 3)"
_AGREE = f"greatest(0.0, least(1.0, 1 - ((ssem - {_MEAN}) * (ssem - {_MEAN}) + (smem - {_MEAN}) * (smem - {_MEAN}) + (sprob - {_MEAN}) * (sprob - {_MEAN})) / 3 / 3))"
_RISK = (
    _LEVELS
    + f""",
r1 AS (SELECT *, {_RAW} AS raw, (ssem = 3 OR smem = 3 OR sprob = 3) AS override_active, {_COVER} AS cov, CASE WHEN ssem + smem + sprob IS NOT NULL THEN {_AGREE} END AS agr FROM lv),
r2 AS (SELECT *, round_even(raw, 6) AS crs_raw, round_even(CASE WHEN raw IS NOT NULL THEN greatest(0.0, least(1.0, CASE WHEN override_active THEN greatest(raw, 0.6) ELSE raw END)) END, 6) AS crs, CAST(round_even(100 * (cov + agr) / 2, 0) AS BIGINT) AS confidence_pct FROM r1),
ri AS (SELECT model_id, item, slex, ssem, smem, sprob, crs_raw, crs, override_active, CASE WHEN crs IS NOT NULL THEN {_BAND} END AS risk_level, round(cov, 6) AS coverage, round(agr, 6) AS agreement, confidence_pct, CASE WHEN confidence_pct >= 70 THEN 'HIGH' WHEN confidence_pct < 70 THEN 'LOW' END AS confidence_level FROM r2)
"""
)
_MODELRISK = (
    _LEVELS
    + f""",
md AS (SELECT model_id, count(*) AS n_total, {', '.join(f'quantile_cont({s}, 0.5)::DOUBLE AS {s}' for s in ('slex', 'ssem', 'smem', 'sprob'))}, {', '.join(f'round(avg(CASE WHEN {s} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {s}_missing' for s in ('slex', 'ssem', 'smem', 'sprob'))} FROM lv GROUP BY 1),
m1 AS (SELECT *, {_RAW} AS raw, {_COVER} AS cov, {_AGREE} AS agr, greatest(0.0, least(1.0, slex / 3)) AS exposure FROM md),
m2 AS (SELECT *, round_even(raw, 6) AS crs_raw, round_even(greatest(0.0, least(1.0, CASE WHEN ssem = 3 OR smem = 3 OR sprob = 3 THEN greatest(raw, 0.6) ELSE raw END)), 6) AS crs, CAST(round_even(100 * (cov + agr + exposure) / 3, 0) AS BIGINT) AS confidence_pct FROM m1),
mk AS (SELECT model_id, n_total, slex, ssem, smem, sprob, slex_missing, ssem_missing, smem_missing, sprob_missing, crs_raw, crs, {_BAND} AS risk_level, round(cov, 4) AS coverage, round(agr, 4) AS agreement, confidence_pct, CASE WHEN confidence_pct >= 70 THEN 'HIGH' ELSE 'LOW' END AS confidence_level FROM m2)
"""
)
_DIST = (
    _RISK
    + f""",
ds AS (SELECT model_id, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE risk_level = '{b}') AS n_{b.lower()}" for b in ('LOW', 'MODERATE', 'HIGH', 'CRITICAL'))}, {', '.join(f"round_even(100.0::DOUBLE * count(*) FILTER (WHERE risk_level = '{b}') / count(*), 2) AS pct_{b.lower()}" for b in ('LOW', 'MODERATE', 'HIGH', 'CRITICAL'))},
  round(avg(crs), 4) AS crs_mean, {median('crs', .1, 4)} AS crs_p10, {median('crs', .5, 4)} AS crs_p50, {median('crs', .9, 4)} AS crs_p90, min(crs) AS crs_min, max(crs) AS crs_max, count(*) FILTER (WHERE override_active) AS n_override FROM ri WHERE crs IS NOT NULL GROUP BY 1),
dt AS (SELECT *, CASE greatest(n_low, n_moderate, n_high, n_critical) WHEN n_low THEN 'LOW' WHEN n_moderate THEN 'MODERATE' WHEN n_high THEN 'HIGH' ELSE 'CRITICAL' END AS dominant_band FROM ds)
"""
)


def _checks() -> str:
    n = lambda c: collapse(f"coalesce({c}, '')")
    ref, pre = n("summary_ref_norm"), n("prefix_ref")
    suffix = f"(CASE WHEN {pre} <> '' AND starts_with({ref}, {pre}) THEN trim(substr({ref}, length({pre}) + 1)) ELSE '' END)"
    words_of = lambda c: f"len(string_split({c}, ' '))"
    rules = [(f"blank_{c}", "critical", f"coalesce(trim({c}), '') = ''") for c in ("xsum_id", "prefix_ref", "summary_ref_norm", "control_prefix", "split")] + [
        ("prefix_alignment", "critical", f"NOT starts_with({ref}, {pre}) OR {pre} = ''"),
        ("gold_suffix", "critical", f"{suffix} = ''"),
        ("suffix_length", "advisory", f"greatest(1, length({suffix}) // 4) > 128"),
        ("prefix_too_short", "advisory", f"{words_of(pre)} < 4"),
        ("prefix_too_long", "advisory", f"{words_of(pre)} * 100 > {words_of(ref)} * 85"),
        ("xsum_id_unique", "critical", f"xsum_id IN (SELECT xsum_id FROM {M} GROUP BY 1 HAVING count(*) > 1)"),
        ("split_known", "advisory", "coalesce(trim(split), '') NOT IN ('train', 'validation', 'test')"),
        ("control_alignment", "advisory", f"NOT starts_with({ref}, {n('control_prefix')}) OR {n('control_prefix')} = ''"),
        ("short_document", "advisory", f"length({n('document')}) < 200"),
        ("repeated_paraphrase", "advisory", f"len(list_distinct([{', '.join(n(f'dcq_{x}') for x in ('a_canonical', 'b_para1', 'c_para2', 'd_para3', 'e_para4'))}])) < 5"),
    ]
    return " UNION ALL ".join(f"SELECT '{a}' AS \"check\", '{b}' AS severity, count(*) FILTER (WHERE {c}) AS bad, count(*) AS total, count(*) FILTER (WHERE {c}) = 0 AS ok FROM {M}" for a, b, c in rules)


_LINES = rf"(SELECT doc_id, {NORM_LINE.format('raw')} AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS raw FROM documents WHERE text IS NOT NULL))"
_FIELDS = ("summary", "target", "reference", "highlights", "output", "prediction", "decoded", "text")
_BASENAME = r"lower(regexp_extract(path, '([^/:]+)$', 1))"
_PREFIX = f"array_to_string(string_split(c, ' ')[1:CAST(least(greatest(12, CAST(floor(len(string_split(c, ' ')) * 0.4) AS INTEGER)), greatest(1, len(string_split(c, ' ')) - 1)) AS INTEGER)], ' ')"

SQL: dict[str, str] = {
    "slex_candidates": _LEX + "SELECT item, line, hits FROM cand",
    "slex_items": _SPANS + "SELECT item, max_span_len, ngram_hits, proxy_count, slex FROM sx",
    "slex_aggregate": _LEX_AGG + "SELECT * FROM sa",
    "slex_documents": f"""WITH iw AS (SELECT xsum_id AS item, {words(canon('document_norm'))} AS w FROM {M}), lw AS (SELECT doc_id AS line, {words(canon('text'))} AS w FROM documents),
ig AS {grams('iw', 'item')}, lg AS {grams('lw', 'line')} SELECT item, line, count(*) AS hits FROM ig JOIN lg USING (gram) GROUP BY 1, 2""",
    "slex_runs": f"""WITH r AS (SELECT DISTINCT run_id, valid_items, slex_counts, slex_aggregate FROM v3_lexical_summary WHERE slex_counts IS NOT NULL),
c AS (SELECT run_id, slex_aggregate, {', '.join(f"coalesce(CAST(json_extract_string(slex_counts, '$.{k}') AS BIGINT), 0) AS n{k}" for k in range(4))} FROM r),
t AS (SELECT *, n0 + n1 + n2 + n3 AS n FROM c)
SELECT run_id, n, CASE WHEN n > 0 THEN CAST(round_even(100.0::DOUBLE * (n1 + n2 + n3) / n, 0) AS BIGINT) END AS pct_found, CASE WHEN n > 0 THEN CAST(round_even(100.0::DOUBLE * n3 / n, 0) AS BIGINT) END AS pct_strong,
{_LEX_LEVEL.format(n='n', p='(n1 + n2 + n3)', n3='n3', t='(n2 + n3)')} AS level, {_LABEL.format('slex_aggregate')} AS label FROM t""",
    "canonical_text": f"""WITH c AS (SELECT row_id, {canon('summary_ref')} AS canonical FROM {P})
SELECT row_id, canonical, len({words('canonical')}) AS n_tokens, greatest(0, len({words('canonical')}) - 12) AS n_grams, CAST(greatest(1, length(canonical) // 4) AS BIGINT) AS estimate FROM c""",
    "document_lines": f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {line_like('line')}) AS n_kept FROM {_LINES} WHERE line <> '' GROUP BY 1",
    "summary_like_lines": f"SELECT DISTINCT line FROM {_LINES} WHERE line <> '' AND {line_like('line')}",
    "json_summaries": rf"""WITH r AS (SELECT path, trim(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS j FROM raw_corpus_records),
ok AS (SELECT path, j FROM r WHERE regexp_full_match(j, '(?s)\{{.*\}}') AND json_valid(j) AND json_exists(j, '$.xsum_id')),
v AS ({' UNION ALL '.join(f"SELECT path, json_extract_string(j, '$.{f}') AS v FROM ok WHERE json_type(j, '$.{f}') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')" for f in _FIELDS)}),
l AS (SELECT path, {NORM_LINE.format('v')} AS value FROM v) SELECT DISTINCT path, value FROM l WHERE {line_like('value')}""",
    "source_files": f"""SELECT DISTINCT event_id, CASE WHEN {_BASENAME} IN ('xsum_test.csv', 'xsum_train.csv', 'xsum_validation.csv', 'xsum_val.csv') THEN 'structured' WHEN lower(path) LIKE '%.jsonl' THEN 'jsonl' WHEN lower(path) LIKE '%.csv' OR lower(path) LIKE '%.tsv' THEN 'tabular' ELSE 'text' END AS extractor,
CASE WHEN contains({_BASENAME}, 'test') THEN 'test' WHEN contains({_BASENAME}, 'train') THEN 'train' WHEN contains({_BASENAME}, 'val') THEN 'validation' END AS split,
CASE WHEN NOT ({' OR '.join(f"ends_with(lower(path), '{x}')" for x in ('.txt', '.jsonl', '.json', '.csv', '.tsv'))}) THEN 'extension' WHEN {' OR '.join(f"contains(lower(path), '{x}')" for x in ('eval', 'evaluation', 'results', 'outputs', 'metrics'))} THEN 'path' WHEN {' OR '.join(f"contains(lower(repo), '{x}')" for x in ('tutorial', 'demo', 'homework', 'course', 'leaderboard', 'benchmark-results', 'model-card'))} THEN 'repo'
  WHEN bytes > 2700000 AND {_BASENAME} NOT IN ('xsum_test.csv', 'xsum_train.csv', 'xsum_validation.csv', 'xsum_val.csv') THEN 'size' ELSE 'ok' END AS verdict,
CASE WHEN contains(lower(coalesce(query, '')), 'xsum_id') THEN 'hint_contains_xsum_id' WHEN contains(lower(coalesce(query, '')), 'xsum') AND (contains(lower(query), 'summary') OR contains(lower(query), 'document') OR contains(lower(query), 'article')) THEN 'hint_contains_xsum_and_schema'
  WHEN contains(lower(coalesce(repo, '')), 'xsum') OR contains(lower(coalesce(path, '')), 'xsum') OR contains(lower(coalesce(name, '')), 'xsum') THEN 'meta_contains_xsum' ELSE 'no_xsum_signal' END AS reason
FROM {E} WHERE ends_with(type, 'download_ok')""",
    "search_queries": f"""WITH w AS (SELECT unnest(['xsum_id', 'xsum dataset', 'huggingface xsum', 'bbc xsum', '"document" "summary" xsum']) AS w), i AS (SELECT '"' || xsum_id || '"' AS q FROM {M} ORDER BY xsum_id LIMIT 40)
SELECT w || ' summary' AS query FROM w UNION ALL SELECT w || ' summaries' FROM w UNION ALL SELECT q FROM i UNION ALL SELECT q || ' xsum' FROM i""",
    "merge_stats": f"""WITH r AS (SELECT *, {_DEDUPE_KEY} AS k FROM {P}), a AS (SELECT count(*) AS rows_before, count(*) FILTER (WHERE k = '') AS rows_empty_summary, count(DISTINCT k) AS rows_unique_norm, count(*) FILTER (WHERE coalesce(trim(source_sha256), '') <> '') AS rows_with_sha256 FROM r)
SELECT *, rows_unique_norm AS rows_after, rows_before - rows_unique_norm AS rows_removed, round_even(100.0::DOUBLE * rows_with_sha256 / rows_before, 2) AS pct_with_sha256 FROM a""",
    "source_counts": f"SELECT coalesce(nullif({collapse("lower(coalesce(source, ''))")}, ''), 'unknown') AS source, count(*) AS n, count(DISTINCT source_repo) AS repos FROM {P} GROUP BY 1",
    "build_summary": """SELECT DISTINCT build_id, rows_before_dedupe - rows_after_dedupe AS removed, round(CASE WHEN rows_before_dedupe <> 0 THEN 100.0::DOUBLE * (rows_before_dedupe - rows_after_dedupe) / rows_before_dedupe END, 4) AS pct_removed,
(rows_before_dedupe - rows_after_dedupe) = rows_removed_by_dedupe AS agrees FROM proxy_structured_merged_build_summary""",
    "manifest_files": f"SELECT sha256, event_id, path FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY ts, event_id) AS r FROM (SELECT DISTINCT sha256, ts, event_id, path FROM {E} WHERE sha256 IS NOT NULL)) WHERE r = 1",
    "query_cache": f"""WITH n AS (SELECT max(ts) AS now FROM {E}), f AS (SELECT query, max(ts) AS cached_at FROM {E}, n WHERE query IS NOT NULL AND ts >= now - INTERVAL 10 DAY GROUP BY 1)
SELECT q.query, strftime(cached_at, '%Y-%m-%d %H:%M:%S.%f') AS cached_at, cached_at IS NOT NULL AS hit FROM (SELECT DISTINCT query FROM {E} WHERE query IS NOT NULL) q LEFT JOIN f USING (query)""",
    "events_by_type": f"SELECT type, strftime(at, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT event_id, type, min(logged_at) AS at FROM {E} GROUP BY 1, 2) x GROUP BY 1, 2".replace(" AS at ", " AS t ").replace("strftime(at", "strftime(t"),
    "master_prefixes": f"""WITH m AS (SELECT xsum_id, {collapse("coalesce(summary_ref_norm, '')")} AS c FROM {M}), p AS (SELECT xsum_id, c, {_PREFIX} AS prefix FROM m),
w AS (SELECT xsum_id, i, w FROM (SELECT xsum_id, unnest(string_split(prefix, ' ')) AS w, unnest(range(0, len(string_split(prefix, ' ')))) AS i FROM p)),
o AS (SELECT xsum_id, string_agg(w, ' ' ORDER BY sha256(xsum_id || '::' || w), w) AS control FROM w GROUP BY 1)
SELECT xsum_id, prefix, CASE WHEN prefix <> '' THEN trim(substr(c, length(prefix) + 1)) ELSE '' END AS suffix, control FROM p JOIN o USING (xsum_id)""",
    "validate_items": _checks(),
    "bdq_options": _QUIZ + f"SELECT item, substr('ABCD', CAST(row_number() OVER (PARTITION BY item ORDER BY sha256('BDQ::' || item || '::' || label)) AS INTEGER), 1) AS slot, label, text AS option FROM qi UNION ALL {_NONE}",
    "bcq_options": _QUIZ + f""", tg AS (SELECT model_id, least_slot AS target FROM bias),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sha256('BCQ_PICK::' || item || '::' || label)) AS r FROM qi) WHERE r <= 3),
fl AS (SELECT model_id, item, label, text, target, row_number() OVER (PARTITION BY model_id, item ORDER BY sha256('BCQ_FILL::' || item || '::' || target || '::' || label)) AS r FROM pk, tg)
SELECT model_id, item, substr(replace('ABCD', target, ''), CAST(r AS INTEGER), 1) AS slot, label, text AS option FROM fl UNION ALL SELECT model_id, item, target, 'CANONICAL', canonical FROM ids, tg UNION ALL SELECT model_id, x.* FROM ({_NONE}) x, tg""",
    "dcq_bias": _QUIZ + "SELECT model_id, n_valid, n_a, n_b, n_c, n_d, n_e, least_slot, round(pe, 6) AS pe FROM bias",
    "dcq_scores": _DCQ + """SELECT model_id, n_valid, n_bcq, round(pe, 6) AS pe, round(cps, 6) AS cps, round(e_rate, 6) AS e_rate, round(kappa, 6) AS kappa, CAST(CASE WHEN ssem_reason IN ('negative_kappa_clean', 'very_low_cps_no_kappa') THEN 0 WHEN ssem_reason = 'high_cps_confirmed' THEN 3
WHEN ssem_reason IN ('high_cps_weak_kappa', 'moderate_cps_confirmed') THEN 2 WHEN ssem_reason = 'no_bcq_data' THEN NULL ELSE 1 END AS BIGINT) AS ssem, ssem_reason FROM ds""",
    "mem_items": _MEM + "SELECT model_id, item, CAST(exact AS BIGINT) AS exact, CAST(near AS BIGINT) AS near, CAST(smem AS BIGINT) AS smem, round(distance, 6) AS distance FROM sm",
    "mem_summary": _MEM_SUMMARY + "SELECT * FROM mu",
    "mem_levels": _MEM_SUMMARY + """, j AS (SELECT a.*, b.em_rate AS ec FROM mu a LEFT JOIN mu b ON b.model_id = CASE a.model_id WHEN 'model_a' THEN 'model_b' WHEN 'model_b' THEN 'model_c' ELSE 'model_a' END),
l AS (SELECT *, CASE WHEN em_rate < 0.01 THEN 0 WHEN em_rate < 0.05 THEN 1 WHEN em_rate < 0.15 THEN 2 ELSE 3 END AS el, CASE WHEN ne_rate < 0.05 THEN 0 WHEN ne_rate < 0.15 THEN 1 WHEN ne_rate < 0.35 THEN 2 ELSE 3 END AS nl FROM j)
SELECT model_id, CAST(el AS BIGINT) AS em_level, CAST(nl AS BIGINT) AS ne_level, el <> nl AS conflict, round(CASE WHEN ec > 0 THEN em_rate / ec END, 4) AS contrast,
CAST(CASE WHEN n_exact = 0 THEN 0 WHEN em_rate >= 0.15 AND ne_rate >= 0.35 THEN CASE WHEN ec IS NULL THEN 2 WHEN ec = 0 THEN 3 WHEN em_rate / ec >= 2 THEN 3 ELSE 2 END WHEN em_rate >= 0.05 OR ne_rate >= 0.15 THEN 2 ELSE 1 END AS BIGINT) AS smem,
CAST(CASE WHEN em_rate < 0.01 AND ne_rate < 0.05 THEN 0 WHEN em_rate < 0.05 AND ne_rate < 0.15 THEN 1 WHEN em_rate < 0.15 AND ne_rate < 0.35 THEN 2 WHEN ec IS NOT NULL AND (ec = 0 OR em_rate / ec >= 2) THEN 3 ELSE 2 END AS BIGINT) AS smem_rates FROM l""",
    "line_distances": f"""WITH m AS (SELECT xsum_id, {canon('dcq_a_canonical')} AS a, unnest(['P1', 'P2', 'P3', 'P4']) AS label, unnest([{', '.join(canon(c) for c in ('dcq_b_para1', 'dcq_c_para2', 'dcq_d_para3', 'dcq_e_para4'))}]) AS t FROM {M})
SELECT xsum_id, label, round(CASE WHEN a = t THEN 0.0::DOUBLE WHEN a = '' OR t = '' THEN 1.0::DOUBLE ELSE levenshtein(a, t)::DOUBLE / greatest(length(a), length(t)) END, 6) AS distance FROM m""",
    "stab_items": _STAB + """SELECT model_id, item, n_samples, round(uar, 6) AS uar, round(mned, 6) AS mned, round(anchor_mned, 6) AS anchor_mned, round(peak_eps, 6) AS peak_eps, sprob,
CAST(CASE WHEN uar IS NULL OR mned IS NULL THEN 0 WHEN uar < 0.2 OR mned < 0.08 THEN 3 WHEN uar < 0.4 OR mned < 0.15 THEN 2 WHEN uar <= 0.6 AND mned <= 0.25 THEN 1 WHEN uar > 0.6 AND mned > 0.25 THEN 0 ELSE 1 END AS BIGINT) AS sprob_two,
CAST(CASE WHEN uar IS NULL OR mned IS NULL OR anchor_mned IS NULL OR peak_eps IS NULL THEN 1 WHEN uar > 0.6 AND mned > 0.25 AND anchor_mned >= 0.25 AND peak_eps < 0.25 THEN 0 WHEN (uar < 0.2 AND mned < 0.08) OR peak_eps >= 0.75 OR anchor_mned < 0.08 THEN 3 WHEN (uar < 0.4 AND mned < 0.15) OR peak_eps >= 0.5 OR anchor_mned < 0.15 THEN 2 ELSE 1 END AS BIGINT) AS sprob_four FROM sb""",
    "stab_summary": _STAB + f""", g AS (SELECT model_id, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE sprob = {k}) AS n{k}' for k in range(4))}, round(avg(uar), 6) AS uar_mean, round(avg(mned), 6) AS mned_mean, {', '.join(f'{median(c, q)} AS {c}_p{int(q * 100)}' for c in ('uar', 'mned') for q in (.1, .5, .9))} FROM sb GROUP BY 1)
SELECT model_id, n, n0, n1, n2, n3, {', '.join(f'round_even(100.0::DOUBLE * n{k} / n, 2) AS pct{k}' for k in range(4))}, uar_mean, mned_mean, uar_p10, uar_p50, uar_p90, mned_p10, mned_p50, mned_p90, CAST(CASE greatest(n0, n1, n2, n3) WHEN n0 THEN 0 WHEN n1 THEN 1 WHEN n2 THEN 2 ELSE 3 END AS BIGINT) AS mode_level,
CAST(CASE WHEN n = 0 OR n1 + n2 + n3 = 0 THEN 0 WHEN n3 >= 2 OR n3 / n >= 0.05 OR (n2 + n3) / n >= 0.15 THEN 3 WHEN n2 >= 1 OR (n1 + n2 + n3) / n >= 0.1 OR (n2 + n3) / n >= 0.05 THEN 2 ELSE 1 END AS BIGINT) AS sprob_aggregate FROM g""",
    "length_baseline": _BASE + "SELECT bucket, low, high, round(um, 6) AS uar_median, round(mm, 6) AS mned_median FROM ba4",
    "length_contrast": _BASE + """, ra AS (SELECT st.model_id, st.item, uar, mned, um, mm, row_number() OVER (PARTITION BY st.model_id, st.item ORDER BY greatest(low - n_tokens, n_tokens - high, 0), low) AS r FROM st JOIN lt USING (item), ba4)
SELECT model_id, item, round(um, 6) AS uar_control, round(mm, 6) AS mned_control, CAST(CASE WHEN NOT (uar > 0 AND mned > 0) THEN 0 WHEN greatest(um / uar, mm / mned) >= 2 THEN 3 WHEN greatest(um / uar, mm / mned) >= 1.5 THEN 2 WHEN greatest(um / uar, mm / mned) >= 1.25 THEN 1 ELSE 0 END AS BIGINT) AS band FROM ra WHERE r = 1""",
    "risk_items": _RISK + "SELECT * FROM ri",
    "risk_models": _MODELRISK + "SELECT *, risk_level IN ('HIGH', 'CRITICAL') AND confidence_level = 'LOW' AS conflicting_evidence FROM mk",
    "risk_distribution": _DIST + "SELECT * FROM dt",
    "risk_ranking": _DIST + "SELECT model_id, crs_mean, dominant_band, row_number() OVER (ORDER BY crs_mean NULLS LAST, model_id) AS rank, round(max(crs_mean) OVER () - min(crs_mean) OVER (), 4) AS spread FROM dt",
    "risk_flagged": _RISK + """SELECT model_id, place, item, crs, risk_level, CASE WHEN smem >= 3 THEN 'exact reconstruction' WHEN sprob >= 2 THEN 'low variability of repeated generations' WHEN ssem >= 1 THEN 'semantic familiarity' ELSE 'public overlap' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY crs DESC NULLS LAST, item) AS place FROM ri) WHERE place <= 3""",
    "match_overlap": _LEVELS + """, s AS (SELECT DISTINCT model_id, item FROM lv WHERE smem = 3), z AS (SELECT model_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.model_id AS a, y.model_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.item = y.item AND x.model_id < y.model_id GROUP BY 1, 2)
SELECT x.model_id AS a, y.model_id AS b, coalesce(n_both, 0) AS n_both, x.n + y.n - coalesce(n_both, 0) AS n_either, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard FROM z x JOIN z y ON x.model_id < y.model_id LEFT JOIN b ON b.a = x.model_id AND b.b = y.model_id""",
    "match_patterns": _LEVELS + "SELECT pattern, count(*) AS n FROM (SELECT item, string_agg(model_id, ' + ' ORDER BY model_id) AS pattern FROM (SELECT DISTINCT model_id, item FROM lv WHERE smem = 3) GROUP BY 1) GROUP BY 1",
    "dedupe_none": f"SELECT row_id, source_rank FROM {_MERGED}",
    "dedupe_summary_norm": _dedupe(_DEDUPE_KEY),
    "dedupe_doc_summary_hash": _dedupe(_HASH),
    "dedupe_record_md5": _dedupe(_HASH),
    "dedupe_source": _dedupe("summary_ref, source_sha256"),
}

SQL["slex_capped"] = (
    SQL["slex_items"].replace(grams("lw", "line"), grams("lw", "line", limit=200))
    .replace("cand AS (SELECT item, line, hits FROM hits)", "cand AS (SELECT item, line, hits FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY hits DESC, line) AS r FROM hits) WHERE r <= 200)")
)
SQL["report_rows"] = f"""SELECT r.model_id, crs, risk_level, confidence_pct, cps, kappa, ssem_reason, em_rate, ne_rate, distance_mean, uar_mean, mned_mean, sprob_aggregate, {_LABEL.format('slex_aggregate')} AS slex_label, n_items AS lexical_items
FROM ({SQL['risk_models']}) r LEFT JOIN ({SQL['dcq_scores']}) q ON q.model_id = r.model_id LEFT JOIN ({SQL['mem_summary']}) m ON m.model_id = r.model_id LEFT JOIN ({SQL['stab_summary']}) s ON s.model_id = r.model_id, ({SQL['slex_aggregate']}) l"""
SQL["query_ids"] = f"""SELECT event_id, xsum_id FROM (SELECT event_id, xsum_id, row_number() OVER (PARTITION BY event_id ORDER BY xsum_id) AS r FROM (SELECT DISTINCT event_id, m.xsum_id FROM
(SELECT event_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS word FROM {E} WHERE query IS NOT NULL) q JOIN {M} m ON lower(m.xsum_id) = q.word)) WHERE r <= 3"""
ID_RULES = rf"""coalesce(nullif(regexp_extract({{0}}, '(?i)["'']?xsum_id["'']?\s*[:=]\s*["'']?(\d+)["'']?', 1), ''), nullif(regexp_extract({{0}}, '["'']?id["'']?\s*[:=]\s*["'']?(\d{{{{8}}}})["'']?', 1), ''), nullif(regexp_extract({{0}}, '\b(\d{{{{8}}}})\b', 1), ''))"""
SQL["record_ids"] = rf"""WITH r AS (SELECT path, regexp_replace(raw, ',\s*([}}\]])', '\1', 'g') AS raw FROM raw_corpus_records WHERE raw IS NOT NULL),
i AS (SELECT path, {ID_RULES.format('raw')} AS id FROM r)
SELECT path, count(*) AS n, count(id) AS named, count(DISTINCT id) AS ids FROM i GROUP BY 1"""
SQL["text_lengths"] = f"""WITH x AS (SELECT unnest(['document', 'document_norm', 'summary_ref', 'summary_ref_norm', 'prefix_ref']) AS field, unnest([document, document_norm, summary_ref, summary_ref_norm, prefix_ref]) AS t FROM {M})
SELECT field, count(*) AS n, min(length(t)) AS shortest, max(length(t)) AS longest, round(avg(length(t)), 6) AS mean, {median('length(t)', .1)} AS p10, {median('length(t)', .5)} AS p50, {median('length(t)', .9)} AS p90, count(*) - count(DISTINCT t) AS repeats FROM x WHERE t IS NOT NULL GROUP BY 1"""
SQL["span_histogram"] = _SPANS + f"""SELECT b.slex, bar, n, q1, q2, q3 FROM (SELECT slex, CAST(least(max_span_len // 10, 29) AS BIGINT) AS bar, count(*) AS n FROM sx GROUP BY 1, 2) b
JOIN (SELECT slex, {median('max_span_len', .25)} AS q1, {median('max_span_len', .5)} AS q2, {median('max_span_len', .75)} AS q3 FROM sx GROUP BY 1) q ON q.slex = b.slex"""
SQL["missing_samples"] = _STAB + "SELECT model_id, item, idx FROM (SELECT model_id, item, idx, row_number() OVER (PARTITION BY model_id, item, output ORDER BY idx) AS r FROM sa) WHERE r > 1"

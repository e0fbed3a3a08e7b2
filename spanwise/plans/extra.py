"""Further queries over the project's tables, each with the SQL (DuckDB's dialect) that it must equal beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import report, rubrics
from spanwise.functions import text as tx
from spanwise.functions.distance import char_distance, token_distance
from spanwise.operators import corpus, detectors, fusion, lexical, probes, records, sampling
from spanwise.plans import queries as q
from spanwise.plans import sql as s
from spanwise.runtime import table
from spanwise.sources import providers, readers
from spanwise.streaming import journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _registered(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{s.SPACE}|{s.SPACE}$', '', 'g')"


# --- structured rows -------------------------------------------------------------


def _value(f: str, lists: bool) -> str:
    plain = f"WHEN 'VARCHAR' THEN nullif(json_extract_string(j, '$.{f}'), '') WHEN 'BIGINT' THEN nullif(json_extract_string(j, '$.{f}'), '0') WHEN 'UBIGINT' THEN nullif(json_extract_string(j, '$.{f}'), '0') WHEN 'DOUBLE' THEN nullif(json_extract_string(j, '$.{f}'), '0.0') WHEN 'BOOLEAN' THEN nullif(json_extract_string(j, '$.{f}'), 'false')"
    many = f" WHEN 'ARRAY' THEN nullif(array_to_string(CAST(json_extract(j, '$.{f}') AS VARCHAR[]), ' '), '')" if lists else ""
    return f"CASE json_type(j, '$.{f}') {plain}{many} END"


def _picked(names: tuple[str, ...], lists: bool) -> str:
    return _strip("coalesce(" + ", ".join(_value(n, lists) for n in names) + ")")


_RECORDS = rf"""
WITH r AS (SELECT raw_id, path, {_strip('raw')} AS t FROM raw_corpus_records WHERE raw IS NOT NULL),
f AS (SELECT raw_id, path, t, regexp_replace(t, ',\s*([}}\]])', '\1', 'g') AS u FROM r WHERE regexp_full_match(t, '(?s)\{{.*\}}')),
o AS (SELECT raw_id, path, CASE WHEN json_valid(t) THEN t WHEN json_valid(u) THEN u END AS j FROM f WHERE json_valid(t) OR json_valid(u)),
x AS (SELECT raw_id, path, {_picked(records.DOCUMENT_NAMES, True)} AS document, {_picked(records.SUMMARY_NAMES, True)} AS summary, {_picked(records.ID_NAMES, False)} AS id, lower({_picked(records.SPLIT_NAMES, False)}) AS split FROM o),
y AS (SELECT raw_id, path, document, summary, coalesce(id, {s.ID_RULES.format('(document || summary)')}) AS id, split FROM x WHERE document IS NOT NULL AND summary IS NOT NULL)
"""


@_registered(_RECORDS + f""", k AS (SELECT xsum_id, min(split) AS known FROM {s.M} GROUP BY 1)
SELECT raw_id, 'gi_' || substr(sha256(path), 1, 12) AS item_id, id AS xsum_id, coalesce(nullif(split, ''), known) AS split, document, summary AS summary_ref FROM y LEFT JOIN k ON k.xsum_id = y.id""")
def structured_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of raw lines as corpus rows; a missing split is that of the benchmark's item."""
    rows = records.structured(table(spark, d, "raw_corpus_records").where("raw is not null"), ["raw_id", "path"], "raw")
    rows = records.with_known_split(rows, q._master(spark, d))
    return rows.select("raw_id", records.item_id(F.lit("github"), F.col("path")).alias("item_id"), F.col("id").alias("xsum_id"), "split", "document", F.col("summary").alias("summary_ref"))


@_registered(rf"""WITH r AS (SELECT path, {_strip('raw')} AS t FROM raw_corpus_records),
p AS (SELECT path, t, CASE WHEN t IS NOT NULL AND regexp_full_match(t, '(?s)\{{.*\}}') THEN json_valid(t) ELSE false END AS ok, t IS NULL OR t = '' AS blank FROM r)
SELECT path, count(*) AS lines, count(*) FILTER (WHERE ok) AS parsed, count(*) FILTER (WHERE CASE WHEN ok THEN json_exists(t, '$.xsum_id') ELSE false END) AS kept, count(*) FILTER (WHERE NOT ok AND NOT blank) AS errors FROM p GROUP BY 1""")
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per file of JSON lines: lines, those parsed, those with the key that is asked for, and those that are neither blank nor valid."""
    raw = tx.strip(F.col("raw"))
    v = F.try_parse_json(F.when(raw.rlike(r"(?s)^\{.*\}$"), raw))
    rows = table(spark, d, "raw_corpus_records").select("path", raw.alias("t"), v.alias("v"))
    has = F.expr("try_variant_get(v, '$.xsum_id', 'variant') is not null")
    blank = F.col("t").isNull() | (F.col("t") == "")
    return rows.groupBy("path").agg(F.count("*").alias("lines"), F.count("v").alias("parsed"), F.count_if(has).alias("kept"), F.count_if(F.col("v").isNull() & ~blank).alias("errors"))


_SPLIT = s._BASENAME.replace("(path,", "(detail,")


@_registered(f"""WITH p AS (SELECT row_id, coalesce(source, '') AS source, coalesce(source_detail, '') AS detail, document, summary_ref, xsum_id FROM {s.P})
SELECT row_id, substr(source, 1, 2) || '_' || substr(sha256(detail), 1, 12) AS item_id, {_strip('xsum_id')} AS xsum_id,
CASE WHEN contains({_SPLIT}, 'test') THEN 'test' WHEN contains({_SPLIT}, 'train') THEN 'train' WHEN contains({_SPLIT}, 'val') THEN 'validation' END AS split,
{_strip('document')} AS document, {s.NORM_LINE.format('summary_ref')} AS summary_ref FROM p WHERE {s.NORM_LINE.format('summary_ref')} <> ''""")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Proxy rows as a table of documents, summaries and ids would give them."""
    rows = q._proxy(spark, d).select("row_id", "document", F.col("summary_ref").alias("summary"), F.col("xsum_id").alias("id"), F.coalesce("source", F.lit("")).alias("s"), F.coalesce("source_detail", F.lit("")).alias("at"))
    kept = rows.where(tx.normalize_line(F.col("summary")) != "")
    return kept.select("row_id", records.item_id(F.col("s"), F.col("at")).alias("item_id"), tx.strip(F.col("id")).alias("xsum_id"), tx.file_split(F.col("at")).alias("split"), tx.strip(F.col("document")).alias("document"), tx.normalize_line(F.col("summary")).alias("summary_ref"))


@_registered(rf"""WITH h AS (SELECT DISTINCT event_id, query, lower(query) AS low FROM {s.E} WHERE query IS NOT NULL),
w AS (SELECT event_id, unnest(regexp_extract_all(low, '\w+')) AS word FROM h),
n AS (SELECT event_id, unnest(regexp_extract_all(low, 'id\s*[:=]\s*"?(\w+)', 1)) AS word FROM h),
b AS (SELECT event_id, substr(word, 1, CAST(k AS INTEGER)) AS word FROM (SELECT event_id, word, unnest(range(1, length(word) + 1)) AS k FROM n)),
m AS (SELECT event_id, list_sort(list(DISTINCT xsum_id))[1:3] AS ids FROM (SELECT * FROM w UNION SELECT * FROM b) JOIN {s.M} ON lower(xsum_id) = word GROUP BY 1)
SELECT h.event_id, contains(low, 'split') AND contains(low, 'test') AS has_split_test, ids IS NOT NULL AS has_id, coalesce(array_to_string(ids, ','), '') AS ids FROM h LEFT JOIN m USING (event_id)""")
def hint_signals(spark: SparkSession, d: str) -> DataFrame:
    hints = table(spark, d, q.MANIFEST).where("query is not null").select("event_id", "query").distinct()
    return records.hint_signals(hints, "event_id", "query", q._master(spark, d), "xsum_id").withColumn("ids", F.array_join("ids", ","))


@_registered(f"""SELECT row_id, CASE WHEN {_strip('document')} <> '' THEN document ELSE '' END AS document FROM {s.P}""")
def first_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document of each row from the first of its columns that isn't blank."""
    return q._proxy(spark, d).select("row_id", records.first_text(["document"]).alias("document"))


@_registered(f"""SELECT xsum_id AS item, coalesce(nullif({_strip('document_norm')}, ''), {_strip('document')}, '') = '' AS lacks_document,
length(document) >= 200 AND length(summary_ref) >= 20 AS valid, lower(split) = 'test' AS in_test FROM {s.M}""")
def item_filters(spark: SparkSession, d: str) -> DataFrame:
    """Which items have a document, are long enough, and belong to the test split."""
    m = q._master(spark, d)
    doc = records.first_text(["document_norm", "document"])
    return m.select(F.col("xsum_id").alias("item"), (doc == "").alias("lacks_document"), ((F.length("document") >= 200) & (F.length("summary_ref") >= 20)).alias("valid"), (F.lower("split") == "test").alias("in_test"))


_MATERIAL = f"coalesce(nullif({s.collapse('dcq_a_canonical')}, ''), {s.collapse('summary_ref_norm')}, '')"


@_registered(f"SELECT xsum_id AS item, {_MATERIAL} AS canonical, {', '.join(f'coalesce({s.collapse(c)}, {chr(39) * 2}) AS p{k}' for k, c in enumerate(('dcq_b_para1', 'dcq_c_para2', 'dcq_d_para3', 'dcq_e_para4'), 1))} FROM {s.M}")
def item_material(spark: SparkSession, d: str) -> DataFrame:
    """An item's canonical text, its summary where that is missing, and its paraphrases."""
    c = lambda n: tx.collapse(F.col(n))
    paras = [F.coalesce(c(n), F.lit("")).alias(f"p{k}") for k, n in enumerate(("dcq_b_para1", "dcq_c_para2", "dcq_d_para3", "dcq_e_para4"), 1)]
    return q._master(spark, d).select(F.col("xsum_id").alias("item"), F.coalesce(F.nullif(c("dcq_a_canonical"), F.lit("")), c("summary_ref_norm"), F.lit("")).alias("canonical"), *paras)


_PARAS = ("dcq_b_para1", "dcq_c_para2", "dcq_d_para3", "dcq_e_para4")


@_registered(f"""SELECT xsum_id AS item, {' OR '.join(f"len(regexp_extract_all(coalesce({c}, ''), '[.!?]')) > 2" for c in _PARAS)} AS sentence_warning,
len(list_distinct([{', '.join(s.collapse(f"coalesce({c}, '')") for c in ('summary_ref', *_PARAS))}])) < 5 AS duplicate_warning FROM {s.M}""")
def paraphrase_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Paraphrases of more than one sentence, and items whose summary and paraphrases repeat."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    several = ~(tx.is_one_sentence(text(_PARAS[0])) & tx.is_one_sentence(text(_PARAS[1])) & tx.is_one_sentence(text(_PARAS[2])) & tx.is_one_sentence(text(_PARAS[3])))
    forms = F.array(*[tx.collapse(text(c)) for c in ("summary_ref", *_PARAS)])
    return q._master(spark, d).select(F.col("xsum_id").alias("item"), several.alias("sentence_warning"), (F.size(F.array_distinct(forms)) < 5).alias("duplicate_warning"))


_LISTED = "'1. ' || coalesce(dcq_b_para1, '') || chr(10) || '2) ' || coalesce(dcq_c_para2, '') || chr(10) || '- ' || coalesce(dcq_d_para3, '') || chr(10) || '• ' || coalesce(dcq_e_para4, '')"


@_registered(rf"""WITH a AS (SELECT xsum_id AS item, string_split({_LISTED}, chr(10)) AS l FROM {s.M}),
b AS (SELECT item, list_filter(list_transform(list_filter(list_transform(l, lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: {_strip(r"regexp_replace(x, '^(\d+[\).\s]+|[-•]\s+)', '')")}), lambda x: x <> '') AS k FROM a)
SELECT item, k[1] AS p1, k[4] AS p4 FROM b WHERE len(k) >= 4""")
def listed_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Paraphrases read back from a numbered list."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(F.lit("1. "), t(_PARAS[0]), F.lit("\n2) "), t(_PARAS[1]), F.lit("\n- "), t(_PARAS[2]), F.lit("\n• "), t(_PARAS[3]))
    rows = q._master(spark, d).select(F.col("xsum_id").alias("item"), tx.four_lines(text).alias("k")).where("k is not null")
    return rows.select("item", F.col("k")[0].alias("p1"), F.col("k")[3].alias("p4"))


# --- samples and pairs --------------------------------------------------------------


@_registered(f"SELECT xsum_id FROM (SELECT xsum_id, row_number() OVER (ORDER BY sha256('42::' || xsum_id), xsum_id) AS r FROM {s.M}) WHERE r <= 100")
def sampled_items(spark: SparkSession, d: str) -> DataFrame:
    """A hundred items in hash order, as a control set takes them."""
    return sampling.sample(q._master(spark, d).select("xsum_id"), "xsum_id", 100).orderBy("xsum_id")


@_registered(f"""WITH done AS (SELECT xsum_id FROM (SELECT xsum_id, row_number() OVER (ORDER BY sha256('42::' || xsum_id), xsum_id) AS r FROM {s.M}) WHERE r <= 100)
SELECT xsum_id FROM {s.M} WHERE xsum_id NOT IN (SELECT xsum_id FROM done) ORDER BY xsum_id LIMIT 25""")
def pilot_items(spark: SparkSession, d: str) -> DataFrame:
    """The next 25 items of a pilot run that has scored a hundred."""
    items = q._master(spark, d).select("xsum_id")
    return sampling.limited_unscored(items, sampling.sample(items, "xsum_id", 100), "xsum_id", 25)


_PAIRED = s._STAB + """,
pr AS (SELECT x.model_id, x.item, x.idx AS i, y.idx AS j, CASE WHEN x.oc = y.oc THEN 0.0::DOUBLE WHEN x.oc = '' OR y.oc = '' THEN 1.0::DOUBLE ELSE levenshtein(x.oc, y.oc)::DOUBLE / greatest(length(x.oc), length(y.oc)) END AS d
  FROM sd x JOIN sd y ON x.model_id = y.model_id AND x.item = y.item AND x.idx < y.idx)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.pairs(q._samples(spark, d), ("model_id", "item"), "idx", "tokens")


def _mned(chosen: DataFrame) -> DataFrame:
    return sampling.mean_distance(chosen, ("model_id", "item"), token_distance("a", "b")).withColumn("mned", F.round("mned", 6))


@_registered(_PAIRED + """SELECT model_id, item, count(*) AS n_pairs, round(avg(d), 6) AS mned FROM (SELECT *, row_number() OVER (PARTITION BY model_id, item ORDER BY sha256('42::' || i::VARCHAR || '::' || j::VARCHAR), i, j) AS r FROM pr) WHERE r <= 8 GROUP BY 1, 2""")
def mned_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of eight pairs of samples an item, chosen by hash."""
    return _mned(sampling.sampled_pairs(_pairs(spark, d), ("model_id", "item"), 8))


@_registered(_PAIRED + """SELECT model_id, item, count(*) AS n_pairs, round(avg(d), 6) AS mned FROM (SELECT *, row_number() OVER (PARTITION BY model_id, item ORDER BY i, j) - 1 AS p FROM pr) WHERE p % (15 // 6) = 0 AND p // (15 // 6) < 6 GROUP BY 1, 2""")
def mned_strided(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of six pairs of samples an item, evenly spread."""
    return _mned(sampling.strided_pairs(_pairs(spark, d), ("model_id", "item"), 6))


# --- detectors ---------------------------------------------------------------------


@_registered(s._LEVELS + f""", a AS (SELECT * FROM lv WHERE slex IS NOT NULL), j AS (SELECT m.item, m.model_id, m.slex, b.ssem, c.smem, e.sprob FROM a m
LEFT JOIN (SELECT item, model_id, ssem FROM lv WHERE ssem IS NOT NULL) b ON b.item = m.item AND b.model_id = m.model_id LEFT JOIN (SELECT item, model_id, smem FROM lv WHERE smem IS NOT NULL) c ON c.item = m.item AND c.model_id = m.model_id
LEFT JOIN (SELECT item, model_id, sprob FROM lv WHERE sprob IS NOT NULL) e ON e.item = m.item AND e.model_id = m.model_id) SELECT * FROM j""")
def joined_levels(spark: SparkSession, d: str) -> DataFrame:
    """The tables of the four detectors, each of the items it has scored, on the lexical one."""
    lv = q._levels(spark, d)
    own = [lv.where(F.col(x).isNotNull()).select("item", "model_id", x) for x in fusion.SIGNALS]
    return detectors.joined(own[0], own[1:], ("item", "model_id"))


@_registered(SQL["joined_levels"].removesuffix("SELECT * FROM j") + f"SELECT model_id, {', '.join(f'round(avg(CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {x}_missing' for x in fusion.SIGNALS)} FROM j GROUP BY 1")
def joined_missing(spark: SparkSession, d: str) -> DataFrame:
    return detectors.missing_rates(joined_levels(spark, d), fusion.SIGNALS, ("model_id",))


@_registered(s._MEM + """, g AS (SELECT model_id, item, exact, distance, CASE WHEN ascii(right(item, 1)) % 2 = 0 THEN near END AS near, CASE WHEN ascii(right(item, 1)) % 3 = 0 THEN smem END AS smem, near AS nb FROM sm)
SELECT model_id, item, CAST(coalesce(near, CAST(distance <= 0.1 AS INTEGER)) AS BIGINT) AS near,
CAST(coalesce(smem, CASE WHEN exact = 1 THEN 3 WHEN distance <= 0.1 THEN 2 WHEN distance <= 0.25 THEN 1 WHEN exact IS NOT NULL THEN 0 END) AS BIGINT) AS smem, smem IS NULL AND exact IS NOT NULL AND distance IS NOT NULL AS smem_backfilled,
CAST(CASE WHEN exact = 1 THEN 3 WHEN nb = 1 THEN 2 WHEN nb IS NOT NULL THEN 0 END AS BIGINT) AS derived_binary, CAST(CASE WHEN exact = 1 THEN 3 WHEN distance <= 0.1 THEN 2 WHEN distance <= 0.25 THEN 1 WHEN distance IS NOT NULL THEN 0 END AS BIGINT) AS derived FROM g""")
def mem_backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Levels of a stored run that lacks some, filled in from exact match and distance, and levels derived from these alone."""
    sc = probes.completion_scores(q._completions(spark, d))
    last = F.ascii(F.right("item", F.lit(1)))
    gaps = sc.withColumn("all_near", F.col("near")).withColumns({"near": F.when(last % 2 == 0, F.col("near")), "smem": F.when(last % 3 == 0, F.col("smem"))})
    out = detectors.backfilled(gaps).withColumns({"derived_binary": detectors.smem_derived(F.col("exact"), F.col("all_near"), True), "derived": detectors.smem_derived(F.col("exact"), F.col("distance"), False)})
    return out.select("model_id", "item", *[F.col(c).cast("bigint").alias(c) for c in ("near", "smem")], "smem_backfilled", *[F.col(c).cast("bigint").alias(c) for c in ("derived_binary", "derived")])


_CONTROL = s._MEM + f""", cp AS (SELECT xsum_id AS item, {s.canon('summary_ref_norm')} AS ref, {s.canon('control_prefix')} AS cp FROM {s.M}),
ct AS (SELECT item, coalesce(nullif(CASE WHEN cp <> '' AND starts_with(ref, cp) THEN trim(substr(ref, length(cp) + 1)) ELSE '' END, ''), ref) AS target FROM cp),
cs AS (SELECT co.model_id, co.item, completion, target, CASE WHEN target <> '' THEN CAST(completion = target AS INTEGER) END AS exact,
  CASE WHEN target = '' THEN NULL WHEN completion = target THEN 0.0::DOUBLE WHEN completion = '' THEN 1.0::DOUBLE ELSE levenshtein(completion, target)::DOUBLE / greatest(length(completion), length(target)) END AS distance FROM co JOIN ct USING (item))
"""


@_registered(_CONTROL + "SELECT model_id, count(exact) AS n, round(avg(exact), 6) AS exact_control, round(avg(CAST(distance <= 0.1 AS INTEGER)), 6) AS near_control, round(avg(distance), 6) AS distance_control FROM cs GROUP BY 1")
def control_means(spark: SparkSession, d: str) -> DataFrame:
    """A control pass: completions scored against what follows the control prompt, or the whole reference."""
    m = q._master(spark, d).select(F.col("xsum_id").alias("item"), tx.canonical(F.col("summary_ref_norm")).alias("ref"), tx.canonical(F.col("control_prefix")).alias("cp"))
    target = m.select("item", detectors.control_target(F.col("ref"), F.col("cp")).alias("suffix"))
    return detectors.control_means(probes.completion_scores(q._completions(spark, d).drop("suffix").join(target, "item")))


@_registered(s._MEM + """SELECT model_id, item, CAST(exact AS BIGINT) AS exact FROM sm WHERE model_id <> 'model_a' UNION ALL SELECT model_id, item, CAST(0 AS BIGINT) FROM sm WHERE model_id = 'model_a'""")
def reused_pass(spark: SparkSession, d: str) -> DataFrame:
    """A new pass of one model beside the stored results of the others."""
    stored = q.mem_items(spark, d).select("model_id", "item", "exact")
    fresh = stored.where(F.col("model_id") == q.MODELS[0]).withColumn("exact", F.lit(0).cast("bigint"))
    return detectors.reused(stored, fresh)


@_registered(s._QUIZ + """, st AS (SELECT model_id, CASE model_id WHEN 'model_a' THEN 'C' WHEN 'model_b' THEN NULL ELSE 'E' END AS stored FROM bias)
SELECT model_id, CASE WHEN stored IN ('A', 'B', 'C', 'D') THEN stored ELSE least_slot END AS least_slot, coalesce(stored IN ('A', 'B', 'C', 'D'), false) AS frozen FROM bias JOIN st USING (model_id)""")
def frozen_positions(spark: SparkSession, d: str) -> DataFrame:
    """The least chosen position of each model, that of an earlier run where it stored a valid one; too few answers are an error."""
    bias = detectors.require_valid(probes.position_bias(q._answers(spark, d, "bdq")))
    earlier = F.when(F.col("model_id") == "model_a", "C").when(F.col("model_id") != "model_b", "E")
    return detectors.frozen(bias.select("model_id", earlier.alias("least_slot")), bias)


@_registered(s._STAB + "SELECT model_id, item, round(uar - uc, 6) AS delta_uar, round(CASE WHEN mc > 0 THEN mned / mc END, 6) AS mned_ratio FROM st, ct")
def stab_contrast(spark: SparkSession, d: str) -> DataFrame:
    own = probes.sample_scores(q._samples(spark, d))
    out = detectors.contrast(own, own.where(F.col("model_id") == q.MODELS[-1]))
    return out.select("model_id", "item", F.round("delta_uar", 6).alias("delta_uar"), F.round("mned_ratio", 6).alias("mned_ratio"))


_METRICS = ("uar", "mned", "anchor_mned", "peak_eps", "delta_uar", "mned_ratio")


@_registered(s._STAB + f""", u AS (SELECT *, uar - uc AS delta_uar, CASE WHEN mc > 0 THEN mned / mc END AS mned_ratio FROM st, ct),
l AS ({' UNION ALL '.join(f"SELECT model_id, '{c}' AS metric, {c} AS x FROM u" for c in _METRICS)})
SELECT model_id, metric, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(min(x), 6) AS low, round(max(x), 6) AS high FROM l GROUP BY 1, 2""")
def stab_described(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and extremes of the six metrics of repeated samples."""
    own = probes.sample_scores(q._samples(spark, d))
    return detectors.described(detectors.contrast(own, own.where(F.col("model_id") == q.MODELS[-1])), _METRICS, ("model_id",))


@_registered(s._STAB + """, w AS (SELECT model_id, item, uar, mned, ba, bn, (uar < 0.2 OR mned < 0.08) AS fl, (CASE WHEN uar > 0 THEN uc / uar >= 2 ELSE true END OR CASE WHEN mned > 0 THEN mc / mned >= 2 ELSE true END) AS tw FROM bd, ct)
SELECT model_id, item, CAST(CASE WHEN uar IS NULL OR mned IS NULL THEN 0 WHEN uar > 0.6 AND mned > 0.25 THEN 0 WHEN uar BETWEEN 0.4 AND 0.6 AND mned BETWEEN 0.15 AND 0.25 THEN 1 WHEN fl THEN CASE WHEN tw THEN 3 ELSE 2 END
  WHEN (uar >= 0.2 AND uar < 0.4) OR (mned >= 0.08 AND mned < 0.15) THEN 2 ELSE 1 END AS BIGINT) AS capped, coalesce(fl AND tw, false) AS contrast_met, CAST(greatest(ba, bn) AS BIGINT) AS two_bands FROM w""")
def stab_rubrics(spark: SparkSession, d: str) -> DataFrame:
    """Levels by two earlier rubrics: capped without contrast, and of two bands."""
    st = q._stability(spark, d)
    c = [F.col(x) for x in ("uar", "mned", "uar_control", "mned_control")]
    level, met = rubrics.sprob_capped(*c)
    return st.select("model_id", "item", level.cast("bigint").alias("capped"), met.alias("contrast_met"), rubrics.sprob_two_bands(F.col("uar"), F.col("mned"), F.col("anchor_mned"), F.col("peak_eps")).cast("bigint").alias("two_bands"))


@_registered(s._DCQ + "SELECT model_id, CAST(CASE WHEN cps IS NULL THEN NULL WHEN cps < 0.3 THEN 0 WHEN cps < 0.45 THEN 1 WHEN cps < 0.6 THEN 2 ELSE 3 END AS BIGINT) AS ssem FROM ds")
def ssem_from_cps(spark: SparkSession, d: str) -> DataFrame:
    """The semantic level from the share of canonical choices alone."""
    return q.dcq_scores(spark, d).select("model_id", rubrics.ssem_from_cps(F.col("cps")).cast("bigint").alias("ssem"))


@_registered(s._MEM + """, a AS (SELECT ms.item, left(prefix, 90) AS prefix, left(ms.suffix, 90) AS suffix, CASE WHEN ms.suffix = '' THEN 0 ELSE len(string_split(ms.suffix, ' ')) END AS n_words FROM ms)
SELECT a.item, a.prefix, a.suffix, n_words, co.model_id, CAST(coalesce(exact, 0) AS BIGINT) AS exact, left(completion, 90) AS completion FROM a JOIN co ON co.item = a.item JOIN sm ON sm.item = a.item AND sm.model_id = co.model_id""")
def row_details(spark: SparkSession, d: str) -> DataFrame:
    """What each model answered to each item, beside what was asked."""
    m = q._master(spark, d).select(F.col("xsum_id").alias("item"), tx.canonical(F.col("summary_ref_norm")).alias("ref"), tx.canonical(F.col("prefix_ref")).alias("prefix"))
    return detectors.row_details(m.select("item", "prefix", tx.gold_suffix(F.col("ref"), F.col("prefix")).alias("suffix")), probes.completion_scores(q._completions(spark, d)))


@_registered(s._LEVELS + "SELECT DISTINCT model_id FROM lv WHERE model_id <> 'model_b'")
def all_models(spark: SparkSession, d: str) -> DataFrame:
    """Models that any summary has, without one for trials."""
    return detectors.all_models(q.mem_summary(spark, d), q.stab_summary(spark, d), q.dcq_scores(spark, d), excluded=("model_b",))


@_registered(s._MODELRISK + "SELECT model_id, slex, ssem, smem, sprob FROM mk")
def checked_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each model's levels, with an error where one lies outside 0 to 3."""
    return fusion.medians(q._levels(spark, d)).select("model_id", *[detectors.in_range(F.col(x), x).alias(x) for x in fusion.SIGNALS])


# --- reports -----------------------------------------------------------------------


def _fmt(c: str, n: int = 4) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' ELSE regexp_replace(regexp_replace(printf('%.{n}f', round_even({c}::DOUBLE, {n})), '0+$', ''), '\\.$', '.0') END"


@_registered(f"""SELECT model_id, {_fmt('crs')} AS crs, CASE WHEN confidence_pct IS NULL THEN '' ELSE confidence_pct::VARCHAR END AS confidence, {_fmt('cps')} AS cps, {_fmt('kappa')} AS kappa, {_fmt('em_rate')} AS em_rate, {_fmt('distance_mean')} AS distance, {_fmt('uar_mean', 2)} AS uar, risk_level, slex_label
FROM ({s.SQL['report_rows']}) t""")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The report's rows as text, as a sheet prints them."""
    r = q.report_rows(spark, d)
    cols = {"crs": ("crs", 4), "confidence": ("confidence_pct", 0), "cps": ("cps", 4), "kappa": ("kappa", 4), "em_rate": ("em_rate", 4), "distance": ("distance_mean", 4), "uar": ("uar_mean", 2)}
    return r.select("model_id", *[report.fmt(F.col(c), n).alias(name) for name, (c, n) in cols.items()], "risk_level", "slex_label")


_STEM = r"regexp_replace(regexp_extract(coalesce({0}, ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


def _named(c: str) -> str:
    stem = _STEM.format(c)
    title = f"array_to_string(list_transform(string_split(replace({stem}, '_', ' '), ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ')"
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL WHEN contains(lower({stem}), 'github') THEN 'GitHub' WHEN contains(lower({stem}), 'kaggle') THEN 'Kaggle' ELSE {title} END"


@_registered(f"""WITH b AS (SELECT DISTINCT build_id, github_csv, kaggle_csv, rows_before_dedupe AS n, rows_unique_summary_norm AS u FROM proxy_structured_merged_build_summary),
c AS (SELECT *, {_named('github_csv')} AS g, {_named('kaggle_csv')} AS k FROM b)
SELECT build_id, CASE WHEN g IS NULL THEN coalesce(k, '') WHEN k IS NULL OR k = g THEN g ELSE g || ' and ' || k END AS sources, CASE WHEN n > 0 THEN printf('%.2f%%', round_even((1 - u::DOUBLE / n) * 100, 2)) ELSE '0%' END AS dedup_rate,
CASE WHEN n > 0 THEN round_even(100.0::DOUBLE * u / n, 0)::BIGINT::VARCHAR ELSE '' END AS pct_unique FROM c""")
def build_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each merge's sources in words, and its rates as text."""
    b = table(spark, d, "proxy_structured_merged_build_summary").select("build_id", "github_csv", "kaggle_csv", "rows_before_dedupe", "rows_unique_summary_norm").distinct()
    name = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", report.source_name(F.col(c)))
    n, u = F.col("rows_before_dedupe"), F.col("rows_unique_summary_norm")
    return b.select("build_id", report.listed(F.array(name("github_csv"), name("kaggle_csv"))).alias("sources"), report.rate(u, n).alias("dedup_rate"), report.pct(u, n).alias("pct_unique"))


@_registered("""WITH r AS (SELECT DISTINCT run_id, slex_counts, valid_items, n_rows_total FROM v3_lexical_summary),
c AS (SELECT run_id, coalesce(nullif(json_extract_string(slex_counts, '$."3"'), ''), '-') AS strong, coalesce(TRY_CAST(json_extract_string(slex_counts, '$."2"') AS BIGINT), 0) AS n2, coalesce(TRY_CAST(json_extract_string(slex_counts, '$."3"') AS BIGINT), 0) AS n3, coalesce(valid_items, n_rows_total) AS n FROM r)
SELECT run_id, strong, CASE WHEN coalesce(n, 0) <= 0 THEN 'Moderate' WHEN (n2 + n3) / n >= 0.8 THEN 'Strong' WHEN (n2 + n3) / n >= 0.4 THEN 'Moderate' WHEN n2 + n3 > 0 THEN 'Low' ELSE 'None' END AS strength FROM c""")
def lexical_strength(spark: SparkSession, d: str) -> DataFrame:
    """Earlier runs: the count of the top level by a path that may be missing, and the evidence in words."""
    r = table(spark, d, "v3_lexical_summary").select("run_id", "slex_counts", "valid_items", "n_rows_total").distinct()
    at = lambda k: report.whole(report.safe(F.col("slex_counts"), k))
    return r.select("run_id", report.safe(F.col("slex_counts"), "3", default="-").alias("strong"), report.lexical_strength(at("2"), at("3"), F.coalesce("valid_items", "n_rows_total")).alias("strength"))


@_registered(s._RISK + """, c AS (SELECT model_id, count(*) FILTER (WHERE confidence_level = 'LOW') AS n_low, count(*) FILTER (WHERE confidence_pct >= 70 AND confidence_pct < 85) AS n_medium, count(*) FILTER (WHERE confidence_pct >= 85) AS n_high,
  count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS n_grave, count(*) AS n, count(*) FILTER (WHERE override_active) AS n_override FROM ri WHERE crs IS NOT NULL GROUP BY 1),
g AS (SELECT *, CASE WHEN n_low + n_medium + n_high > 0 THEN round_even((60.0::DOUBLE * n_medium + 100.0 * n_high) / (n_low + n_medium + n_high), 2) ELSE 0.0 END AS score, CASE WHEN n_low + n_medium + n_high > 0 THEN round_even((30.0::DOUBLE * n_low + 60.0 * n_medium + 100.0 * n_high) / (n_low + n_medium + n_high), 2) ELSE 0.0 END AS score_older FROM c)
SELECT model_id, n_low, n_medium, n_high, score, score_older, CASE WHEN score >= 75 THEN 'High' WHEN score >= 45 THEN 'Medium' ELSE 'Low' END AS label, n_grave, round_even(100.0::DOUBLE * n_grave / n, 2) AS pct_grave, round_even(100.0::DOUBLE * n_override / n, 2) AS pct_override FROM g""")
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items by confidence, the score made of the counts, and the shares of the two upper bands and of overrides."""
    r = fusion.item_risk(q._levels(spark, d)).where("crs is not null")
    pct = F.col("confidence_pct")
    c = r.groupBy("model_id").agg(F.count_if(pct < 70).alias("n_low"), F.count_if((pct >= 70) & (pct < 85)).alias("n_medium"), F.count_if(pct >= 85).alias("n_high"), F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("n_grave"), F.count("*").alias("n"), F.count_if("override_active").alias("n_override"))
    counts = [F.col(x) for x in ("n_low", "n_medium", "n_high")]
    score = report.confidence_score(*counts)
    share = lambda x: F.bround(100.0 * F.col(x) / F.col("n"), 2)
    return c.select("model_id", *counts, score.alias("score"), report.confidence_score(*counts, (30.0, 60.0, 100.0)).alias("score_older"), report.confidence_label(score).alias("label"), "n_grave", share("n_grave").alias("pct_grave"), share("n_override").alias("pct_override"))


@_registered(s._LEVELS + "SELECT model_id, item, " + ", ".join(f"CASE WHEN coalesce({x}, 0) <= 0 THEN 'None' WHEN {x} = 1 THEN 'Low' WHEN {x} = 2 THEN 'Moderate' ELSE 'Strong' END AS {x}" for x in fusion.SIGNALS) + " FROM lv")
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every level in words."""
    return q._levels(spark, d).select("model_id", "item", *[rubrics.evidence_strength(F.col(x)).alias(x) for x in fusion.SIGNALS])


@_registered(s._SPANS + """, e AS (SELECT min(max_span_len) AS lo, max(max_span_len) AS hi FROM sx)
SELECT CAST(CASE WHEN hi = lo THEN 0 WHEN max_span_len = hi THEN 29 ELSE floor((max_span_len - lo) * 30.0::DOUBLE / (hi - lo)) END AS BIGINT) AS bar, count(*) AS n FROM sx, e GROUP BY 1""")
def span_bins(spark: SparkSession, d: str) -> DataFrame:
    """Thirty bars of equal width over the range of the longest spans."""
    return lexical.histogram(q.slex_items(spark, d), "max_span_len", 30)


@_registered(f"""SELECT raw, "unique", CASE WHEN raw > 0 THEN printf('%.2f%%', round_even((1 - "unique"::DOUBLE / raw) * 100, 2)) ELSE '0%' END AS dedup_rate, n_sources FROM
(SELECT count(summary_ref) AS raw, count(DISTINCT summary_ref) AS "unique", count(DISTINCT source_detail) AS n_sources FROM {s.P})""")
def corpus_rates(spark: SparkSession, d: str) -> DataFrame:
    """Summaries in the corpus, distinct ones, and the rate of repeats as text."""
    c = q._proxy(spark, d).agg(F.count("summary_ref").alias("raw"), F.count_distinct("summary_ref").alias("unique"), F.count_distinct("source_detail").alias("n_sources"))
    return c.select("raw", "unique", report.rate(F.col("unique"), F.col("raw")).alias("dedup_rate"), "n_sources")


@_registered(s._LEVELS + """, p AS (SELECT pattern, len(string_split(pattern, ' + ')) AS size, count(*) AS n FROM (SELECT item, string_agg(model_id, ' + ' ORDER BY model_id) AS pattern FROM (SELECT DISTINCT model_id, item FROM lv WHERE smem = 3) GROUP BY 1) GROUP BY 1)
SELECT pattern, CAST(size AS BIGINT) AS size, n, row_number() OVER (ORDER BY size DESC, n DESC, pattern) AS place FROM p""")
def ordered_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Sets of models that share matches, the largest first."""
    return fusion.by_size(fusion.overlap_patterns(q._levels(spark, d).where("smem = 3"), "model_id", "item"))


@_registered(f"SELECT DISTINCT lower(regexp_extract(path, '([^/:]+)$', 1)) IN ('xsum_test.csv', 'xsum_train.csv', 'xsum_validation.csv', 'xsum_val.csv') OR contains(replace(lower(left(coalesce(raw, ''), 4096)), ' ', ''), 'document,summary,id') AS special, raw_id FROM raw_corpus_records")
def special_files(spark: SparkSession, d: str) -> DataFrame:
    """Which raw texts begin a table of documents, summaries and ids."""
    return table(spark, d, "raw_corpus_records").select("raw_id", corpus.is_special_file(F.col("path"), F.col("raw")).alias("special"))


@_registered(f"""SELECT raw_id, CASE WHEN contains(lower(raw), 'split') THEN CASE WHEN contains(lower(raw), 'test') THEN 'test' WHEN contains(lower(raw), 'train') THEN 'train' WHEN contains(lower(raw), 'val') THEN 'validation' END END AS split FROM raw_corpus_records""")
def detected_splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_corpus_records").select("raw_id", records.split_of(F.col("raw")).alias("split"))


@_registered(f"""WITH p AS (SELECT xsum_id AS item, {s.canon('dcq_a_canonical')} AS a, {s.canon('summary_ref_norm')} AS b FROM {s.M})
SELECT item, round(CASE WHEN a = b THEN 0.0::DOUBLE WHEN a = '' OR b = '' THEN 1.0::DOUBLE ELSE levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS distance FROM p""")
def canonical_distances(spark: SparkSession, d: str) -> DataFrame:
    """Character distance of each item's canonical text to its summary."""
    m = q._master(spark, d).select(F.col("xsum_id").alias("item"), tx.canonical(F.col("dcq_a_canonical")).alias("a"), tx.canonical(F.col("summary_ref_norm")).alias("b"))
    return m.select("item", F.round(char_distance(F.col("a"), F.col("b")), 6).alias("distance"))


_ACTIONS = f"(SELECT event_id, min(ts) AS ts, min(type) AS type FROM {s.E} GROUP BY 1)"


@_registered(f"""WITH g AS (SELECT type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {_ACTIONS} WINDOW w AS (PARTITION BY type ORDER BY ts)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY type ORDER BY ts) AS k FROM g)
SELECT type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n FROM k GROUP BY type, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of manifest events of one type with less than half an hour between them."""
    events = table(spark, d, q.MANIFEST).groupBy("event_id").agg(F.min("ts").alias("ts"), F.min("type").alias("type"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return journal.sessions(events, "ts", "type").select("type", text("start"), text("end"), "n")


# Published results that the rubrics must give for the published counts.
GOLDENS = {
    "slex_aggregate 9/50/237 of 296": "3",
    "kappa of cps .320946, pe .104730": "0.241509",
    "ssem of cps .320946, kappa .241509": "1 weak_cps_above_chance",
    "kappa of cps .364865, pe 19/294": "0.320983",
    "wilson 1 of 296": "0.000597 0.018886",
    "wilson 7 of 296": "0.011501 0.048002",
    "wilson 8 of 296": "0.013757 0.052416",
    "sprob_aggregate 219/57/16/4": "3",
    "sprob_aggregate 165/79/33/19": "3",
    "crs of 1, 1, 3": "0.533333 0.6 HIGH",
    "confidence of 3, 1, 1, 3": "90 HIGH",
    "rate of 24963 in 25856": "3.45%",
    "pct 287 of 296": "97",
    "pct 237 of 296": "80",
    "slex_label 3": "Widely available",
}


@_registered("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GOLDENS.items()) + ") t(golden, value)")
def goldens(spark: SparkSession, d: str) -> DataFrame:
    """The rubrics' results for published counts."""
    n = lambda x: F.lit(float(x))
    six = lambda c: F.round(c, 6).cast("string")
    pair = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    kappa = lambda cps, pe: (n(cps) - pe) / (1 - pe)
    semantic = rubrics.ssem(n(0.32094594594594594), n(0.24150943396226415), n(11 / 296))
    raw, crs = rubrics.crs(F.lit(1), F.lit(1), F.lit(3))
    sure = rubrics.confidence(F.lit(3), F.lit(1), F.lit(1), F.lit(3))
    values = [
        rubrics.slex_aggregate(F.lit(296), F.lit(287), F.lit(287), F.lit(237)).cast("string"),
        six(kappa(0.32094594594594594, n(0.10472972972972973))), pair(semantic["level"], semantic["reason"]), six(kappa(0.36486486486486486, n(19 / 294))),
        *[F.format_string("%.6f %.6f", *rubrics.wilson(F.lit(k), F.lit(296))) for k in (1, 7, 8)],
        rubrics.sprob_aggregate(F.lit(296), F.lit(57), F.lit(16), F.lit(4)).cast("string"), rubrics.sprob_aggregate(F.lit(296), F.lit(79), F.lit(33), F.lit(19)).cast("string"),
        F.concat_ws(" ", raw.cast("string"), crs.cast("string"), rubrics.risk_level(crs)), pair(sure["confidence_pct"], sure["confidence_level"]),
        report.rate(F.lit(24963), F.lit(25856)), report.pct(F.lit(287), F.lit(296)), report.pct(F.lit(237), F.lit(296)), rubrics.slex_label(F.lit(3)),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("golden"), v.alias("value")) for k, v in zip(GOLDENS, values, strict=True)])
    return spark.range(1).select(F.explode(each).alias("x")).select("x.golden", "x.value")


@_registered(s.SQL["search_queries"] + " UNION ALL SELECT unnest([" + ", ".join(s._q(x) for x in corpus.ADVANCED_QUERIES) + "]) AS query")
def advanced_queries(spark: SparkSession, d: str) -> DataFrame:
    return corpus.advanced_queries(q.search_queries(spark, d))


@_registered(f"""WITH c AS ({s.SQL['validate_items']}) SELECT count(*) FILTER (WHERE severity = 'critical' AND NOT ok) = 0 AS ready,
coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE severity = 'critical' AND NOT ok), '') AS failed, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (WHERE severity = 'advisory' AND NOT ok), '') AS warned FROM c""")
def items_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether the benchmark's table may be used, and what speaks against it."""
    return fusion.verdict(q.validate_items(spark, d))


TEMPLATE = "Continue the summary of this article.\n{DOCUMENT}\nSummary: {PREFIX}"


@_registered(f"SELECT xsum_id AS item, replace(replace({s._q(TEMPLATE)}, '{{DOCUMENT}}', coalesce(document_norm, '')), '{{PREFIX}}', coalesce(prefix_ref, '')) AS prompt FROM {s.M}")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each item's prompt from a template that a run names or gives as text."""
    template = providers.chosen_template({"continue": TEMPLATE}, "continue", "DOCUMENT")
    return q._master(spark, d).select(F.col("xsum_id").alias("item"), providers.render(template, DOCUMENT=F.col("document_norm"), PREFIX=F.col("prefix_ref")).alias("prompt"))


@_registered(s._QUIZ + """, r AS (SELECT model_id, item, max(choice) FILTER (WHERE what = 'bdq') AS a, max(choice) FILTER (WHERE what = 'bcq') AS b FROM ans GROUP BY 1, 2)
SELECT model_id, item, CASE WHEN a <> '' THEN a ELSE b END AS choice, CASE WHEN a <> '' THEN 'ok' WHEN b <> '' THEN 'ok_after_retry' ELSE 'parse_failed' END AS status FROM r""")
def retried_choices(spark: SparkSession, d: str) -> DataFrame:
    """Quiz letters, those of a second answer where the first has none."""
    first, second = (q._answers(spark, d, w).select("model_id", "item", F.col("choice").alias(w)) for w in ("bdq", "bcq"))
    choice, status = probes.first_choice(F.col("bdq"), F.col("bcq"), lambda c: c)
    return first.join(second, ["model_id", "item"]).select("model_id", "item", choice.alias("choice"), status.alias("status"))


@_registered(s._MEM + """, d AS (SELECT model_id, item FROM sm WHERE model_id = 'model_a' AND exact = 1) SELECT sm.model_id, sm.item FROM sm WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.model_id = sm.model_id AND d.item = sm.item)""")
def resumed_items(spark: SparkSession, d: str) -> DataFrame:
    """What a run resumes with: all items but those that a stored run has scored."""
    rows = q.mem_items(spark, d)
    return readers.unscored(rows.select("model_id", "item"), rows.where((F.col("model_id") == q.MODELS[0]) & (F.col("exact") == 1)), ["model_id", "item"])

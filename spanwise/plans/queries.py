"""Queries over the project's tables; ``spanwise.plans.sql`` has the SQL that each must equal.

Stored model answers aren't among the tables. The queries that score them take replayed answers that
any engine derives alike: levels and quiz letters from hashes of item and model, completions from the
corpus line that continues an item's opening words, repeated samples from an item's paraphrases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import rubrics
from spanwise.functions import text as tx
from spanwise.functions.distance import char_distance
from spanwise.operators import corpus, fusion, lexical, probes
from spanwise.runtime import spread, table

MASTER = "master_table_xsum_n300_seed42_v4_dcq4_frozen"
PROXY = "proxy_structured_merged"
MANIFEST = "proxy_sources_manifest"
MODELS = ("model_a", "model_b", "model_c")
# The collection's configured search words, file suffixes, words of paths and repositories that are passed over, and largest file.
KEYWORDS = ("xsum_id", "xsum dataset", "huggingface xsum", "bbc xsum", '"document" "summary" xsum')
EXTENSIONS = (".txt", ".jsonl", ".json", ".csv", ".tsv")
DENY_REPOS = ("tutorial", "demo", "homework", "course", "leaderboard", "benchmark-results", "model-card")
DENY_PATHS = ("eval", "evaluation", "results", "outputs", "metrics")
MOST_BYTES = 2_700_000


def _master(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, MASTER)


def _proxy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PROXY)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d).select(F.col("xsum_id").alias("item"), tx.canonical(F.col("summary_ref_norm")).alias("text"))


def _models(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, MODELS))).alias("model_id"))


def _hashed(model: Column, item: Column, what: str, n: int) -> Column:
    return F.pmod(tx.seed_of(F.concat_ws("::", model, item, F.lit(what))), F.lit(n))


# --- lexical exposure ---------------------------------------------------------


def slex_items(spark: SparkSession, d: str) -> DataFrame:
    return lexical.exposure(_items(spark, d), lexical.lines(_proxy(spark, d), "row_id", "summary_ref"))


def slex_capped(spark: SparkSession, d: str) -> DataFrame:
    """Exposure as an index with the usual caps finds it: the first 200 grams of a line, 200 lines an item."""
    return lexical.exposure(_items(spark, d), lexical.lines(_proxy(spark, d), "row_id", "summary_ref"), per_line=lexical.PER_LINE, most=lexical.MAX_CANDIDATES)


def slex_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return lexical.aggregate(slex_items(spark, d))


def slex_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lexical.candidates(_items(spark, d), lexical.lines(_proxy(spark, d), "row_id", "summary_ref"))


def slex_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as lines: how many items and documents share grams."""
    docs = lexical.lines(table(spark, d, "documents"), "doc_id", "text")
    items = _master(spark, d).select(F.col("xsum_id").alias("item"), tx.canonical(F.col("document_norm")).alias("text"))
    return lexical.candidates(items, docs)


def slex_runs(spark: SparkSession, d: str) -> DataFrame:
    """Earlier runs: the level recomputed from each run's counts, shares found and strong, once a run."""
    runs = table(spark, d, "v3_lexical_summary").where("slex_counts is not null").select("run_id", "valid_items", "slex_counts", "slex_aggregate").distinct()
    n = [F.coalesce(F.get_json_object("slex_counts", f"$.{k}").cast("bigint"), F.lit(0).cast("bigint")).alias(f"n{k}") for k in range(4)]
    out = runs.select("run_id", "slex_aggregate", *n).withColumn("n", F.expr("n0 + n1 + n2 + n3"))
    pct = lambda c: F.bround(F.try_divide(100.0 * c, F.col("n"))).cast("bigint")
    return out.select(
        "run_id", "n", pct(F.expr("n1 + n2 + n3")).alias("pct_found"), pct(F.col("n3")).alias("pct_strong"),
        rubrics.slex_aggregate(F.col("n"), F.expr("n1 + n2 + n3"), F.expr("n2 + n3"), F.col("n3")).cast("bigint").alias("level"),
        rubrics.slex_label(F.col("slex_aggregate")).alias("label"),
    )


# --- text and corpus ----------------------------------------------------------


def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(_proxy(spark, d).select("row_id", "summary_ref")).select("row_id", tx.canonical(F.col("summary_ref")).alias("canonical"))
    rows = rows.withColumn("w", tx.tokens(F.col("canonical")))
    return rows.select("row_id", "canonical", F.size("w").cast("bigint").alias("n_tokens"), F.size(tx.ngrams(F.col("w"), 13)).cast("bigint").alias("n_grams"), tx.token_estimate(F.col("canonical")).cast("bigint").alias("estimate"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.text_lines(table(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.count_if("keep").alias("n_kept"))


def summary_like_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.text_lines(table(spark, d, "documents"), "doc_id", "text").where("keep").select("line").distinct()


def json_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The distinct summary-like values of the preferred fields of all records, by file."""
    raw = table(spark, d, "raw_corpus_records")
    values = corpus.json_values(raw, ["path"], "raw", require=("xsum_id",)).withColumn("value", tx.normalize_line(F.col("value")))
    return values.where(tx.looks_like_summary(F.col("value"))).select("path", "value").distinct()


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """For each downloaded file: its reader, split, why it is allowed, and why it looks like the benchmark."""
    m = table(spark, d, MANIFEST).where(F.col("type").endswith("download_ok")).select("event_id", "repo", "path", "name", "query", "bytes").distinct()
    return m.select(
        "event_id", corpus.extractor(F.col("path")).alias("extractor"), tx.file_split(F.col("path")).alias("split"),
        corpus.allowed(F.col("path"), F.col("repo"), F.col("bytes"), EXTENSIONS, DENY_PATHS, DENY_REPOS, MOST_BYTES).alias("verdict"),
        corpus.hit_reason(F.col("repo"), F.col("path"), F.col("name"), F.col("query")).alias("reason"),
    )


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, KEYWORDS))).alias("keyword"))
    return corpus.search_queries(words, _master(spark, d), "xsum_id")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """The proxy rows as two sources, GitHub's first."""
    rows = _proxy(spark, d)
    hub = F.lower(F.trim(F.coalesce("source", F.lit("")))) == "github"
    return corpus.merge(rows.where(hub), rows.where(~hub))


def _deduped(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return corpus.keep_first(_merged(spark, d), mode, ("source_rank", "row_id")).select("row_id", "source_rank")

    return run


def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _merged(spark, d)
    return corpus.merge_stats(rows, corpus.keep_first(rows, "summary_norm", ("source_rank", "row_id")))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.nullif(tx.normalize_for_dedupe(F.col("source")), F.lit("")), F.lit("unknown"))
    return _proxy(spark, d).groupBy(name.alias("source")).agg(F.count("*").alias("n"), F.count_distinct("source_repo").alias("repos"))


def build_summary(spark: SparkSession, d: str) -> DataFrame:
    """Earlier merges: the rows removed recomputed, and the rate of duplicates in words, once a build."""
    b = table(spark, d, "proxy_structured_merged_build_summary").select("build_id", "rows_before_dedupe", "rows_after_dedupe", "rows_removed_by_dedupe").distinct()
    gone = F.expr("rows_before_dedupe - rows_after_dedupe")
    rate = F.try_divide(100.0 * gone, F.col("rows_before_dedupe"))
    return b.select("build_id", gone.alias("removed"), F.round(rate, 4).alias("pct_removed"), (gone == F.col("rows_removed_by_dedupe")).alias("agrees"))


def manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each downloaded file's hash, for replay."""
    m = table(spark, d, MANIFEST).where(F.col("sha256").isNotNull())
    return corpus.first_per_key(m.select("sha256", "ts", "event_id", "path").distinct(), "sha256", ("ts", "event_id")).drop("ts")


def query_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each query with its latest event of the manifest's last ten days."""
    m = table(spark, d, MANIFEST)
    now = m.agg(F.max("ts").alias("now"))
    every = m.where("query is not null").select("query").distinct()
    with_now = m.where("query is not null").join(now)
    latest = corpus.cached(every, with_now.where(F.col("ts") >= F.col("now") - F.expr("interval 10 days")), "query", "ts", F.lit("2100-01-01").cast("timestamp"), 24 * 365 * 200)
    return latest.withColumn("cached_at", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def events_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Manifest events counted once each, by type and day of arrival."""
    m = table(spark, d, MANIFEST).groupBy("event_id", "type").agg(F.min("logged_at").alias("at"))
    return m.groupBy("type", F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def query_ids(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's ids that the manifest's queries name."""
    hints = table(spark, d, MANIFEST).where("query is not null").select("event_id", "query").distinct()
    return corpus.id_matches(hints, "event_id", "query", _master(spark, d), "xsum_id").select("event_id", F.col("id").alias("xsum_id"))


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    """How many raw lines of each file name an item, after repair of trailing commas, and how many items."""
    raw = table(spark, d, "raw_corpus_records").where("raw is not null").select("path", corpus.record_id(corpus.repaired_json(F.col("raw"))).alias("id"))
    return raw.groupBy("path").agg(F.count("*").alias("n"), F.count("id").alias("named"), F.count_distinct("id").alias("ids"))


def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length statistics and repeats of the master table's texts."""
    cols = ("document", "document_norm", "summary_ref", "summary_ref_norm", "prefix_ref")
    long = _master(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in cols])).alias("x")).select("x.*").where("t is not null")
    n = F.length("t")
    q = F.percentile(n, [0.1, 0.5, 0.9])
    out = long.groupBy("field").agg(F.count("*").alias("n"), F.min(n).cast("bigint").alias("shortest"), F.max(n).cast("bigint").alias("longest"), F.round(F.avg(n), 6).alias("mean"), q.alias("q"), (F.count("*") - F.count_distinct("t")).alias("repeats"))
    return out.select("field", "n", "shortest", "longest", "mean", *[F.round(F.col("q")[k], 6).alias(f"p{p}") for k, p in enumerate((10, 50, 90))], "repeats")


def span_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the longest spans, with quartiles by level beside each bar's level counts."""
    bar = F.least(F.floor(F.col("max_span_len") / 10), F.lit(29)).cast("bigint")
    x = slex_items(spark, d)
    quart = x.groupBy("slex").agg(F.percentile("max_span_len", [0.25, 0.5, 0.75]).alias("q"))
    bars = x.groupBy("slex", bar.alias("bar")).agg(F.count("*").alias("n"))
    return bars.join(quart, "slex").select("slex", "bar", "n", *[F.round(F.col("q")[k], 6).alias(f"q{k + 1}") for k in range(3)])


def missing_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the grid of six an item that aren't distinct from an earlier one, as a resumed run would fetch them again."""
    kept = _samples(spark, d).groupBy("model_id", "item", "output").agg(F.min("idx").alias("idx"))
    runs = _items(spark, d).join(_models(spark)).withColumn("run", F.struct("model_id", "item"))
    missing = corpus.missing_samples(runs, "run", kept.withColumn("run", F.struct("model_id", "item")), 6)
    return missing.select("run.model_id", "run.item", F.col("idx").cast("bigint").alias("idx"))


def master_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Openings made anew, the suffix that they leave, and words in a control order."""
    c = tx.collapse(F.coalesce("summary_ref_norm", F.lit("")))
    prefix = tx.make_prefix(c)
    return _master(spark, d).select("xsum_id", prefix.alias("prefix"), tx.gold_suffix(c, prefix).alias("suffix"), F.array_join(tx.hash_order(F.split(prefix, " "), F.col("xsum_id")), " ").alias("control"))


def validate_items(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: tx.collapse(F.coalesce(c, F.lit("")))
    words = lambda c: F.size(F.split(n(c), " "))
    suffix = tx.gold_suffix(n("summary_ref_norm"), n("prefix_ref"))
    texts = F.array(*[n(f"dcq_{x}") for x in ("a_canonical", "b_para1", "c_para2", "d_para3", "e_para4")])
    more = {
        "prefix_alignment": ("critical", ~F.startswith(n("summary_ref_norm"), n("prefix_ref")) | (n("prefix_ref") == "")),
        "gold_suffix": ("critical", suffix == ""),
        "suffix_length": ("advisory", tx.token_estimate(suffix) > 128),
        "prefix_too_short": ("advisory", words("prefix_ref") < 4),
        "prefix_too_long": ("advisory", words("prefix_ref") * 100 > words("summary_ref_norm") * 85),
        "xsum_id_unique": ("critical", F.col("_copies") > 1),
        "split_known": ("advisory", ~F.coalesce(F.trim("split"), F.lit("")).isin("train", "validation", "test")),
        "control_alignment": ("advisory", ~F.startswith(n("summary_ref_norm"), n("control_prefix")) | (n("control_prefix") == "")),
        "short_document": ("advisory", F.length(n("document")) < 200),
        "repeated_paraphrase": ("advisory", F.size(F.array_distinct(texts)) < 5),
    }
    items = _master(spark, d)
    copies = items.groupBy("xsum_id").agg(F.count("*").alias("_copies"))
    return fusion.checks(items.join(copies, "xsum_id", "left"), ("xsum_id", "prefix_ref", "summary_ref_norm", "control_prefix", "split"), more)


# --- quiz ---------------------------------------------------------------------


def _quiz_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose canonical text and four paraphrases aren't blank."""
    cols = {"P1": "dcq_b_para1", "P2": "dcq_c_para2", "P3": "dcq_d_para3", "P4": "dcq_e_para4"}
    m = _master(spark, d)
    for c in ("dcq_a_canonical", *cols.values()):
        m = m.where(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return m.select(F.col("xsum_id").alias("item"), F.col("dcq_a_canonical").alias("canonical"), F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("text")) for k, c in cols.items()]).alias("p"))


def bdq_options(spark: SparkSession, d: str) -> DataFrame:
    return probes.bdq_options(_quiz_items(spark, d))


def _letters(rows: DataFrame, what: str) -> DataFrame:
    """Replayed quiz letters; one in thirteen is no letter."""
    k = _hashed(F.col("model_id"), F.col("item"), what, 13)
    raw = F.concat(F.lit("Answer: "), F.element_at(F.array(*map(F.lit, "ABBBBCCCDDDE?")), (k + 1).cast("int")))
    return rows.withColumn("choice", tx.parse_choice(raw))


def _answers(spark: SparkSession, d: str, what: str) -> DataFrame:
    return _letters(_quiz_items(spark, d).select("item").join(_models(spark)), what)


def dcq_bias(spark: SparkSession, d: str) -> DataFrame:
    return probes.position_bias(_answers(spark, d, "bdq")).withColumn("pe", F.round("pe", 6))


def bcq_options(spark: SparkSession, d: str) -> DataFrame:
    bias = probes.position_bias(_answers(spark, d, "bdq"))
    return probes.bcq_options(_quiz_items(spark, d), bias.select("model_id", F.col("least_slot").alias("slot")))


def dcq_scores(spark: SparkSession, d: str) -> DataFrame:
    bias = probes.position_bias(_answers(spark, d, "bdq"))
    answers = _answers(spark, d, "bcq").join(bias.select("model_id", F.col("least_slot").alias("target")), "model_id")
    out = probes.quiz_scores(answers, bias)
    return out.select("model_id", "n_valid", "n_bcq", *[F.round(c, 6).alias(c) for c in ("pe", "cps", "e_rate", "kappa")], F.col("ssem").cast("bigint").alias("ssem"), "ssem_reason")


# --- completions --------------------------------------------------------------


def _completions(spark: SparkSession, d: str) -> DataFrame:
    """(model_id, item, suffix, completion): what follows an item's opening in a corpus line: of all lines that continue it, in the order of their hashes with the model, the first."""
    m = _master(spark, d).select(F.col("xsum_id").alias("item"), tx.canonical(F.col("summary_ref_norm")).alias("reference"), tx.canonical(F.col("prefix_ref")).alias("prefix"))
    m = m.select("item", "prefix", tx.gold_suffix(F.col("reference"), F.col("prefix")).alias("suffix"))
    head = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 8), " ")
    lines = spread(_proxy(spark, d).select("row_id", "summary_ref")).select("row_id", tx.canonical(F.col("summary_ref")).alias("line")).withColumn("head", head(F.col("line")))
    found = m.where("prefix <> ''").withColumn("head", head(F.col("prefix"))).join(lines, "head").where(F.startswith("line", F.col("prefix"))).join(_models(spark))
    turn = tx.seed_of(F.concat_ws("::", "model_id", F.col("row_id").cast("string")))
    text = F.trim(F.substring("line", F.length("prefix") + 1, F.length("line")))
    best = found.groupBy("model_id", "item").agg(F.min(F.struct(turn.alias("turn"), "row_id", text.alias("text"))).alias("b"))
    return m.join(_models(spark)).join(best, ["model_id", "item"], "left").select("model_id", "item", "suffix", F.coalesce("b.text", F.lit("")).alias("completion"))


def mem_items(spark: SparkSession, d: str) -> DataFrame:
    out = probes.completion_scores(_completions(spark, d))
    return out.select("model_id", "item", *[F.col(c).cast("bigint").alias(c) for c in ("exact", "near", "smem")], F.round("distance", 6).alias("distance"))


def mem_summary(spark: SparkSession, d: str) -> DataFrame:
    return probes.completion_summary(probes.completion_scores(_completions(spark, d)))


def mem_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of each model's rates, with the next model's as control."""
    s = mem_summary(spark, d)
    other = s.select(F.element_at(F.create_map(*[x for k in range(3) for x in (F.lit(MODELS[k]), F.lit(MODELS[k - 1]))]), F.col("model_id")).alias("model_id"), F.col("em_rate").alias("em_control"))
    j = s.join(other, "model_id", "left")
    em, ne, on = F.col("em_rate"), F.col("ne_rate"), F.col("em_control").isNotNull()
    e, n = rubrics.em_level(em), rubrics.ne_level(ne)
    return j.select("model_id", e.cast("bigint").alias("em_level"), n.cast("bigint").alias("ne_level"), (e != n).alias("conflict"), F.round(F.when(F.col("em_control") > 0, em / F.col("em_control")), 4).alias("contrast"),
                    rubrics.smem_aggregate(em, ne, F.col("em_control"), on, F.col("n_exact")).cast("bigint").alias("smem"), rubrics.smem_aggregate_rates(em, ne, F.col("em_control"), on).cast("bigint").alias("smem_rates"))


def line_distances(spark: SparkSession, d: str) -> DataFrame:
    """Character distance of each item's canonical summary to each of its paraphrases."""
    m = _master(spark, d).select("xsum_id", tx.canonical(F.col("dcq_a_canonical")).alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("label"), tx.canonical(F.col(c)).alias("t")) for k, c in (("P1", "dcq_b_para1"), ("P2", "dcq_c_para2"), ("P3", "dcq_d_para3"), ("P4", "dcq_e_para4"))])).alias("p"))
    return m.select("xsum_id", "p.label", F.round(char_distance(F.col("a"), F.col("p.t")), 6).alias("distance"))


# --- repeated samples ---------------------------------------------------------


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Six samples an item and model, drawn by hash from its canonical text and paraphrases; the anchor is its summary."""
    texts = F.array(*[tx.canonical(F.col(c)) for c in ("dcq_a_canonical", "dcq_b_para1", "dcq_c_para2", "dcq_d_para3", "dcq_e_para4")])
    m = _master(spark, d).select(F.col("xsum_id").alias("item"), texts.alias("t"), tx.canonical(F.col("summary_ref_norm")).alias("anchor"))
    rows = m.join(_models(spark)).select("model_id", "item", "t", "anchor", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx"))
    spread = F.element_at(F.create_map(*[x for k, m in enumerate(MODELS) for x in (F.lit(m), F.lit(2 * k + 1))]), F.col("model_id"))
    pick = F.pmod(tx.seed_of(F.concat_ws("::", "model_id", "item", F.col("idx").cast("string"))), spread)
    out = rows.withColumn("output", F.get("t", pick.cast("int")))
    return out.select("model_id", "item", "idx", "output", tx.tokens(F.col("output")).alias("tokens"), "anchor", tx.tokens(F.col("anchor")).alias("anchor_tokens"))


def _stability(spark: SparkSession, d: str) -> DataFrame:
    own = probes.sample_scores(_samples(spark, d))
    control = own.where(F.col("model_id") == MODELS[-1]).groupBy().agg(F.avg("uar").alias("uar_control"), F.avg("mned").alias("mned_control"))
    out = own.join(control)
    level = rubrics.sprob_item(*[F.col(c) for c in ("uar", "mned", "uar_control", "mned_control", "anchor_mned", "peak_eps")])
    return out.withColumn("sprob", level)


def stab_items(spark: SparkSession, d: str) -> DataFrame:
    s = _stability(spark, d)
    c = lambda *names: [F.col(n) for n in names]
    return s.select(
        "model_id", "item", "n_samples", *[F.round(x, 6).alias(x) for x in ("uar", "mned", "anchor_mned", "peak_eps")], F.col("sprob").cast("bigint").alias("sprob"),
        rubrics.sprob_two_metrics(*c("uar", "mned")).cast("bigint").alias("sprob_two"), rubrics.sprob_four_metrics(*c("uar", "mned", "anchor_mned", "peak_eps")).cast("bigint").alias("sprob_four"),
    )


def stab_summary(spark: SparkSession, d: str) -> DataFrame:
    return probes.stability_summary(_stability(spark, d))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d).select(F.col("xsum_id").alias("item"), F.size(tx.tokens(tx.canonical(F.col("document_norm")))).alias("n_tokens"))


def length_baseline(spark: SparkSession, d: str) -> DataFrame:
    control = probes.sample_scores(_samples(spark, d)).where(F.col("model_id") == MODELS[-1]).join(_lengths(spark, d), "item")
    return probes.length_baseline(control).select(F.col("bucket").cast("bigint").alias("bucket"), F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"), *[F.round(c, 6).alias(c) for c in ("uar_median", "mned_median")])


def length_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Bands of each model against the control's medians for its items' lengths."""
    scores = probes.sample_scores(_samples(spark, d)).join(_lengths(spark, d), "item")
    out = probes.with_baseline(scores, probes.length_baseline(scores.where(F.col("model_id") == MODELS[-1])))
    return out.select("model_id", "item", F.round("uar_control", 6).alias("uar_control"), F.round("mned_control", 6).alias("mned_control"), rubrics.band_contrast(*[F.col(c) for c in ("uar", "mned", "uar_control", "mned_control")]).cast("bigint").alias("band"))


# --- fusion -------------------------------------------------------------------


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Replayed detector levels 0..3, one in nine missing."""
    rows = _master(spark, d).select(F.col("xsum_id").alias("item")).join(_models(spark))
    k = {s: _hashed(F.col("model_id"), F.col("item"), s, 9) for s in fusion.SIGNALS}
    return rows.select("model_id", "item", *[F.when(v < 8, F.floor(v / 2)).cast("bigint").alias(s) for s, v in k.items()])


def risk_items(spark: SparkSession, d: str) -> DataFrame:
    return fusion.item_risk(_levels(spark, d))


def risk_models(spark: SparkSession, d: str) -> DataFrame:
    return fusion.model_risk(fusion.medians(_levels(spark, d)))


def risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return fusion.score_distribution(fusion.item_risk(_levels(spark, d)))


def risk_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked(fusion.score_distribution(fusion.item_risk(_levels(spark, d))).select("model_id", "crs_mean", "dominant_band"), "crs_mean")


def risk_flagged(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top_flagged(fusion.item_risk(_levels(spark, d)))


def match_overlap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.overlap_pairs(_levels(spark, d).where("smem = 3"), "model_id", "item")


def match_patterns(spark: SparkSession, d: str) -> DataFrame:
    return fusion.overlap_patterns(_levels(spark, d).where("smem = 3"), "model_id", "item")


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row a model: fused score beside quiz, completion and stability summaries and the benchmark's exposure."""
    quiz = dcq_scores(spark, d).select("model_id", "cps", "kappa", "ssem_reason")
    mem = mem_summary(spark, d).select("model_id", "em_rate", "ne_rate", "distance_mean")
    stab = stab_summary(spark, d).select("model_id", "uar_mean", "mned_mean", "sprob_aggregate")
    lex = slex_aggregate(spark, d).select(rubrics.slex_label(F.col("slex_aggregate")).alias("slex_label"), F.col("n_items").alias("lexical_items"))
    risk = risk_models(spark, d).select("model_id", "crs", "risk_level", "confidence_pct")
    return risk.join(quiz, "model_id", "left").join(mem, "model_id", "left").join(stab, "model_id", "left").join(lex)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        slex_items, slex_capped, slex_aggregate, slex_candidates, slex_documents, slex_runs, canonical_text, document_lines, summary_like_lines, json_summaries, source_files, search_queries, merge_stats, source_counts, build_summary,
        manifest_files, query_ids, record_ids, text_lengths, span_histogram, missing_samples, query_cache, events_by_type, master_prefixes, validate_items, bdq_options, bcq_options, dcq_bias, dcq_scores, mem_items, mem_summary, mem_levels, line_distances, stab_items, stab_summary,
        length_baseline, length_contrast, risk_items, risk_models, risk_distribution, risk_ranking, risk_flagged, match_overlap, match_patterns, report_rows,
    ]
    modes = {f"dedupe_{m}": _deduped(m) for m in ("none", "summary_norm", "doc_summary_hash", "source", "record_md5")}
    from spanwise.plans.extra import QUERIES

    return {f.__name__: f for f in named} | modes | QUERIES


def oracle_sql() -> dict[str, str]:
    from spanwise.plans.extra import SQL as MORE
    from spanwise.plans.sql import SQL

    return SQL | MORE

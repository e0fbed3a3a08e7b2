"""Corpus building: line extraction, source filters, merge and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.text import looks_like_summary, normalize_for_dedupe, normalize_line
from spanwise.runtime import spread

# Fields of a record that may hold a summary, in order of preference; names of files of the benchmark itself.
SUMMARY_FIELDS = ("summary", "target", "reference", "highlights", "output", "prediction", "decoded", "text")
SPECIAL_FILES = ("xsum_test.csv", "xsum_train.csv", "xsum_validation.csv", "xsum_val.csv")


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line, keep): every line in its order, whether it looks like a summary."""
    parts = F.posexplode(F.split(F.col(text_col), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"))
    rows = spread(df.where(F.col(text_col).isNotNull()).select(id_col, text_col))
    out = rows.select(F.col(id_col).alias("id"), parts.alias("line_no", "raw"))
    # a filter isn't pushed below a generator, so that lines are normalised once
    out = out.select("id", "line_no", F.explode(F.array(normalize_line(F.col("raw")))).alias("line")).where("line <> ''")
    return out.withColumn("keep", looks_like_summary(F.col("line")))


def json_values(df: DataFrame, id_cols: Sequence[str], raw_col: str, require: Sequence[str] = ()) -> DataFrame:
    """(ids, field, value) of the preferred fields of valid JSON objects; nested and missing values are skipped."""
    raw = F.trim(F.regexp_replace(F.col(raw_col), r"^\s+|\s+$", ""))
    parsed = df.select(*id_cols, F.try_parse_json(F.when(raw.rlike(r"(?s)^\{.*\}$"), raw)).alias("v")).where("v is not null")
    for key in require:
        parsed = parsed.where(F.expr(f"try_variant_get(v, '$.{key}', 'variant') is not null"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(f"case when schema_of_variant(variant_get(v, '$.{f}')) rlike '^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)' then variant_get(v, '$.{f}', 'string') end").alias("value")) for f in SUMMARY_FIELDS])
    return parsed.select(*id_cols, F.explode(fields).alias("x")).select(*id_cols, "x.field", "x.value").where("value is not null")


def extractor(path: Column) -> Column:
    """Which reader a file's name asks for."""
    p = F.lower(path)
    return F.when(is_special_file(path), "structured").when(p.endswith(".jsonl"), "jsonl").when(p.endswith(".csv") | p.endswith(".tsv"), "tabular").otherwise("text")


def is_special_file(path: Column, head: Column | None = None) -> Column:
    """Whether a file holds documents, summaries and ids: by its name, or by a header among its first 4,096 characters."""
    by_name = F.lower(F.regexp_extract(path, r"([^/:]+)$", 1)).isin(*SPECIAL_FILES)
    if head is None:
        return by_name
    return by_name | F.coalesce(F.replace(F.lower(F.left(head, F.lit(4096))), F.lit(" "), F.lit("")).contains("document,summary,id"), F.lit(False))


def allowed(path: Column, repo: Column, size: Column, extensions: Sequence[str], deny_paths: Sequence[str], deny_repos: Sequence[str], most: int) -> Column:
    """Why a file is passed over, or 'ok': the first rule of extension, path, repository and size that it breaks."""
    p = F.lower(path)
    one = lambda rules: rules[0] if len(rules) == 1 else F.greatest(*rules)
    return (
        F.when(~one([p.endswith(e) for e in extensions]), "extension")
        .when(one([p.contains(x) for x in deny_paths]), "path")
        .when(one([F.lower(repo).contains(x) for x in deny_repos]), "repo")
        .when((size > most) & ~is_special_file(path), "size")
        .otherwise("ok")
    )


def hit_reason(repo: Column, path: Column, name: Column, hint: Column) -> Column:
    """Why a search hit looks like the benchmark, by rules in order of precision."""
    repo, path, name, hint = (F.lower(F.coalesce(c, F.lit(""))) for c in (repo, path, name, hint))
    return (
        F.when(hint.contains("xsum_id"), "hint_contains_xsum_id")
        .when(hint.contains("xsum") & (hint.contains("summary") | hint.contains("document") | hint.contains("article")), "hint_contains_xsum_and_schema")
        .when(repo.contains("xsum") | path.contains("xsum") | name.contains("xsum"), "meta_contains_xsum")
        .otherwise("no_xsum_signal")
    )


def search_queries(keywords: DataFrame, items: DataFrame, id_col: str, cap: int = 40) -> DataFrame:
    """Search phrases: two a keyword, two an item of the first ``cap``."""
    words = keywords.select(F.trim("keyword").alias("w")).where("w <> ''").select(F.explode(F.array(F.concat("w", F.lit(" summary")), F.concat("w", F.lit(" summaries")))).alias("query"))
    first = items.orderBy(id_col).limit(cap).select(F.concat(F.lit('"'), F.col(id_col), F.lit('"')).alias("q"))
    return words.unionByName(first.select(F.explode(F.array("q", F.concat("q", F.lit(" xsum")))).alias("query")))


# Search phrases by file name, suffix and field.
ADVANCED_QUERIES = (
    '"xsum_id" extension:jsonl',
    '"xsum_id" "summary" extension:jsonl',
    '"xsum_id" "split" "test" extension:jsonl',
    '"xsum_id" extension:csv',
    '"xsum_id" "summary" extension:csv',
    "path:data xsum_id extension:jsonl",
    "path:dataset xsum_id extension:jsonl",
    '"xsum" "xsum_id" "summary" extension:jsonl',
    "filename:xsum extension:jsonl",
    "filename:xsum extension:csv",
)


def advanced_queries(queries: DataFrame) -> DataFrame:
    """Search phrases with those by file name, suffix and field."""
    return queries.unionByName(queries.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ADVANCED_QUERIES))).alias("query")))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources in order: ``source_rank`` 0 before 1, columns that one lacks are null."""
    return first.withColumn("source_rank", F.lit(0)).unionByName(second.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def dedupe_key(mode: str) -> Column | None:
    """The key that two rows share when one is to go; None for no deduplication."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keys = {
        "none": None,
        "summary_norm": normalize_for_dedupe(F.col("summary_ref")),
        "doc_summary_hash": F.sha2(F.concat(text("document"), F.lit("||"), text("summary_ref")), 256),
        "source": F.to_json(F.struct("summary_ref", "source_sha256")),
        "record_md5": F.md5(F.concat(text("document"), F.lit("||"), text("summary_ref"))),
    }
    return keys[mode]


def keep_first(df: DataFrame, mode: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order. Partial minima are taken before the shuffle, so no key is gathered."""
    key = dedupe_key(mode)
    if key is None:
        return df
    at = F.struct(*order)
    best = df.select(key.alias("_k"), at.alias("_at")).groupBy("_k").agg(F.min("_at").alias("_at")).select("_at")
    return df.withColumn("_at", at).join(best, "_at", "left_semi").drop("_at")


def merge_stats(df: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: rows before and after, removed, empty summaries, distinct normal forms, rows with a hash."""
    norm = normalize_for_dedupe(F.col("summary_ref"))
    a = df.agg(F.count("*").alias("rows_before"), F.count_if(norm == "").alias("rows_empty_summary"), F.count_distinct(norm).alias("rows_unique_norm"), F.count_if(F.coalesce(F.trim("source_sha256"), F.lit("")) != "").alias("rows_with_sha256"))
    b = kept.agg(F.count("*").alias("rows_after"))
    out = a.join(b)
    return out.withColumn("rows_removed", F.expr("rows_before - rows_after")).withColumn("pct_with_sha256", F.bround(F.try_divide(100.0 * F.col("rows_with_sha256"), F.col("rows_before")), 2))


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The whole first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def cached(queries: DataFrame, cache: DataFrame, key: str, ts: str, now: Column, hours: float) -> DataFrame:
    """Queries with the latest cached entry that is young enough; ``hit`` tells whether there is one."""
    fresh = cache.where((F.col(ts) <= now) & (F.col(ts) >= now - F.make_dt_interval(hours=F.lit(int(hours))))).groupBy(key).agg(F.max(ts).alias("cached_at"))
    return queries.join(fresh, key, "left").withColumn("hit", F.col("cached_at").isNotNull())


def id_matches(hints: DataFrame, key: str, hint_col: str, ids: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(key, id): the first ``most`` known ids, in their order, that stand as whole words in a text.

    Texts explode to their distinct words and meet the ids in an equi-join, instead of one pattern an id.
    """
    found = hints.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(hint_col), F.lit(r"[a-z0-9_]+"), F.lit(0)))).alias("word"))
    known = ids.select(F.col(id_col).alias("id"), F.lower(id_col).alias("word")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return found.join(known, "word").select(key, "id").withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def head_and_tail(c: Column, n: int = 8192) -> Column:
    """The first and last ``n`` characters of a long text, marked; a short one whole."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("\n\n---TAIL---\n\n"), F.right(c, F.lit(n)))).otherwise(c)


def missing_samples(items: DataFrame, key: str, done: DataFrame, n: int) -> DataFrame:
    """(key, idx) of the samples 0..n-1 that a stored run lacks."""
    grid = items.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    return grid.join(done.select(key, "idx"), [key, "idx"], "left_anti")


def repaired_json(raw: Column) -> Column:
    """A JSON text without commas before closing brackets."""
    return F.regexp_replace(raw, r",\s*([}\]])", "$1")


def record_id(text: Column) -> Column:
    """The item id that a text names, by rules in order: any number under its full name, eight digits under ``id``, eight digits by themselves."""
    # The three patterns.
    rules = [
        F.regexp_extract(text, r"""(?i)["']?xsum_id["']?\s*[:=]\s*["']?(\d+)["']?""", 1),
        F.regexp_extract(text, r"""["']?id["']?\s*[:=]\s*["']?(\d{8})["']?""", 1),
        F.regexp_extract(text, r"\b(\d{8})\b", 1),
    ]
    return F.coalesce(*[F.nullif(r, F.lit("")) for r in rules])

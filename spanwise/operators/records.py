"""Structured corpus rows: from records of JSON with fields of many names, and from tables of document, summary and id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.text import detected_split, file_split, normalize_line, strip
from spanwise.operators.corpus import record_id, repaired_json

# Names under which records keep a document, a summary, an id and a split, in order of preference.
DOCUMENT_NAMES = ("document", "text", "article", "src", "source_text", "input", "content")
SUMMARY_NAMES = ("summary", "sum_sents", "tgt", "target", "highlights", "abstract", "reference", "output")
ID_NAMES = ("id", "xsum_id", "doc_id", "article_id", "item_id", "bbcid")
SPLIT_NAMES = ("split", "set", "subset")
# Columns that may hold an item's document, in order.
DOCUMENT_COLUMNS = ("document_norm", "document", "doc_norm", "article", "text")


def item_id(source: Column, detail: Column) -> Column:
    """The first two letters of a row's source and twelve digits of the hash of its place."""
    return F.concat_ws("_", F.left(source, F.lit(2)), F.left(F.sha2(detail, 256), F.lit(12)))


def first_text(names: Sequence[str]) -> Column:
    """The first of some columns that isn't blank, as it is; '' where all are."""
    return F.coalesce(*[F.when(strip(F.col(c)) != "", F.col(c)) for c in names], F.lit(""))


def _field(name: str, lists: bool) -> Column:
    """A JSON object's value as text where it is neither empty, zero nor an object; the members of a list joined by spaces."""
    kind = F.expr(f"schema_of_variant(variant_get(v, '$.{name}'))")
    text = F.expr(f"try_variant_get(v, '$.{name}', 'string')")
    plain = F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.when(~text.isin("0", "0.0", "-0.0", "false"), text))
    if not lists:
        return plain
    many = F.expr(f"try_variant_get(v, '$.{name}', 'array<string>')")
    return F.coalesce(plain, F.when(kind.startswith("ARRAY") & (F.size(many) > 0), F.array_join(many, " ")))


def parsed(df: DataFrame, id_cols: Sequence[str], raw_col: str) -> DataFrame:
    """(ids, v): JSON objects, repaired of commas before closing brackets where they don't parse otherwise; other lines are dropped."""
    raw = strip(F.col(raw_col))
    whole = lambda c: F.try_parse_json(F.when(c.rlike(r"(?s)^\{.*\}$"), c))
    return df.select(*id_cols, F.coalesce(whole(raw), whole(repaired_json(raw))).alias("v")).where("v is not null")


def structured(df: DataFrame, id_cols: Sequence[str], raw_col: str) -> DataFrame:
    """(ids, document, summary, id, split) of JSON records that have both texts; an id that no field has is sought in the texts."""
    pick = lambda names, lists: strip(F.coalesce(*[_field(n, lists) for n in names]))
    fields = F.struct(pick(DOCUMENT_NAMES, True).alias("document"), pick(SUMMARY_NAMES, True).alias("summary"), pick(ID_NAMES, False).alias("id"), F.lower(pick(SPLIT_NAMES, False)).alias("split"))
    # a filter isn't pushed below a generator, so that the fields are computed once
    out = parsed(df, id_cols, raw_col).select(*id_cols, F.explode(F.array(fields)).alias("x")).select(*id_cols, "x.*")
    return out.where("document is not null and summary is not null").withColumn("id", F.coalesce("id", record_id(F.concat("document", "summary"))))


def with_known_split(rows: DataFrame, items: DataFrame, key: str = "id", item_key: str = "xsum_id") -> DataFrame:
    """Rows whose split is missing take that of their item. Items are unique by key or reduced to the smallest split."""
    known = items.groupBy(F.col(item_key).alias(key)).agg(F.min("split").alias("_split"))
    return rows.join(known, key, "left").withColumn("split", F.coalesce(F.nullif("split", F.lit("")), "_split")).drop("_split")


def table_rows(df: DataFrame, source: Column, detail: Column, document: str = "document", summary: str = "summary", id_col: str = "id", hinted_ids: Column | None = None) -> DataFrame:
    """(item_id, xsum_id, split, source_detail, document, summary_ref) of a table of documents, summaries and ids.

    Summaries are normalised, null and blank ones dropped; documents and ids lose outer space; the split is that of the file's name. A row
    without an id takes the first of ``hinted_ids``.
    """
    one = strip(F.col(id_col)) if hinted_ids is None else F.coalesce(F.nullif(strip(F.col(id_col)), F.lit("")), F.get(hinted_ids, F.lit(0)))
    rows = df.select(item_id(source, detail).alias("item_id"), one.alias("xsum_id"), file_split(detail).alias("split"), detail.alias("source_detail"), strip(F.col(document)).alias("document"), normalize_line(F.col(summary)).alias("summary_ref"))
    return rows.where("summary_ref is not null and summary_ref <> ''")


def hint_signals(hints: DataFrame, key: str, hint_col: str, ids: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(key, has_split_test, has_id, ids): whether a search hint names a test split, and the first ``most`` known ids that it names.

    An id counts as a whole word, or as the beginning of what follows ``id:`` or ``id=``. Words and beginnings meet the ids in one equi-join.
    """
    low = F.lower(F.coalesce(F.col(hint_col), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0))
    named = F.regexp_extract_all(low, F.lit(r'id\s*[:=]\s*"?(\w+)'), F.lit(1))
    begins = F.flatten(F.transform(named, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda n: F.left(w, n))))
    rows = hints.select(key, low.alias("low"), F.array_distinct(F.concat(words, begins)).alias("words"))
    known = ids.select(F.col(id_col).alias("id"), F.lower(id_col).alias("word")).where("id <> ''").distinct()
    hit = rows.select(key, F.explode("words").alias("word")).join(known, "word").groupBy(key).agg(F.slice(F.sort_array(F.collect_set("id")), 1, most).alias("ids"))
    flags = rows.select(key, (F.contains("low", F.lit("split")) & F.contains("low", F.lit("test"))).alias("has_split_test"))
    return flags.join(hit, key, "left").select(key, "has_split_test", F.col("ids").isNotNull().alias("has_id"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def split_of(text: Column) -> Column:
    """The split that a record's own text names."""
    return detected_split(text)

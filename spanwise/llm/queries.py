"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import best_record, layout_duplicates, leaks, lookalikes, near_duplicates, packing, page_prose, shared_spans, wrong_encoding
from spanwise.runtime import is_blank, table

MASTER = "master_table_xsum_n300_seed42_v4_dcq4_frozen"
PROXY = "proxy_structured_merged"
MANIFEST = "proxy_sources_manifest"


def _records(spark: SparkSession, d: str) -> DataFrame:
    proxy = table(spark, d, PROXY).select(F.lit("proxy").alias("rec_table"), F.col("row_id").cast("string").alias("rec_key"), F.col("summary_ref").alias("text"))
    master = table(spark, d, MASTER).select(F.lit("master").alias("rec_table"), F.col("xsum_id").alias("rec_key"), F.col("summary_ref_norm").alias("text"))
    return proxy.unionByName(master)


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_records(spark, d), ("rec_table", "rec_key"), "text", 100)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_spans(spark, d).select("rec_table", "rec_key")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Records that share a span, with the smallest record of their cluster; all others of a cluster may be removed."""
    return shared_spans.shared_clusters(_records(spark, d), ("rec_table", "rec_key"), "text", 100)


def _displayed(spark: SparkSession, d: str) -> DataFrame:
    proxy = table(spark, d, PROXY).select(F.lit("proxy").alias("rec_table"), F.col("row_id").cast("string").alias("rec_key"), F.col("summary_ref").alias("text"))
    master = table(spark, d, MASTER).select(F.lit("master").alias("rec_table"), F.col("xsum_id").alias("rec_key"), F.col("document_norm").alias("text"))
    return proxy.unionByName(master)


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_fields(_displayed(spark, d), ("rec_table", "rec_key"), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_canonical(spark, d).select("rec_table", "rec_key")


def _trusted(spark: SparkSession, d: str) -> tuple[DataFrame, list[best_record.Bundle]]:
    """Proxy rows with their duplicate key and what ranks each bundle of fields."""
    plain = F.regexp_replace(F.lower("source"), r"(?U)^\s+|\s+$", "")
    trust = table(spark, d, "source_trust").groupBy(F.lower(F.trim("source")).alias("plain")).agg(F.max("trust").alias("trust"))
    latest = table(spark, d, MANIFEST).where("sha256 is not null").groupBy(F.lower("sha256").alias("sha")).agg(F.max("ts").alias("latest"))
    rows = table(spark, d, PROXY).select(
        F.col("row_id").cast("long").alias("row_id"),
        layout_duplicates.text_key(F.col("summary_ref")).alias("key"),
        F.when(~is_blank(F.col("document")), F.length("document")).alias("chars"),
        F.when(F.col("xsum_id").rlike(r"^[0-9]{8}\z"), F.col("xsum_id")).alias("xsum"),
        plain.alias("plain"),
        F.when(F.col("source_sha256").rlike(r"^[0-9a-fA-F]{64}\z"), F.lower("source_sha256")).alias("sha"),
        F.md5("document").alias("doc"),
    ).where("key is not null")
    rows = rows.join(trust, "plain", "left")
    rows = best_record.looked_up(rows, latest, "sha")
    bundles = [
        best_record.Bundle("document_row_id", F.col("chars"), F.col("doc")),
        best_record.Bundle("xsum_row_id", F.when(F.col("xsum").isNotNull(), F.coalesce("trust", F.lit(0))), F.col("xsum")),
        best_record.Bundle("sha_row_id", F.col("latest").cast("double"), F.col("sha")),
    ]
    return rows, bundles


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, bundles = _trusted(spark, d)
    out = best_record.best_bundles(rows, "key", "row_id", bundles)
    return out.where("n > 1").select("first_id", *[b.name for b in bundles])


def p3_bundles(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, but an item id must go with a document that the group holds beside it."""
    rows, bundles = _trusted(spark, d)
    out = best_record.best_bundles(rows, "key", "row_id", bundles, [("xsum_row_id", "document_row_id")])
    return out.where("n > 1").select("first_id", *[b.name for b in bundles])


def p3_record(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group: its longest document, the most trusted id with the source that vouches for it, the latest hash with its date."""
    rows, bundles = _trusted(spark, d)
    out = best_record.best_bundles(rows, "key", "row_id", bundles).where("n > 1")
    source = table(spark, d, PROXY).select(F.col("row_id").cast("long").alias("row_id"), "document", "xsum_id", "source", "source_detail", "source_sha256")
    fields = {"document_row_id": ("document",), "xsum_row_id": ("xsum_id", "source"), "sha_row_id": ("source_sha256", "source_detail")}
    return best_record.built(source, "key", "row_id", out, fields).drop("key")


def _layouts(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, object]]:
    return [
        ("proxy", table(spark, d, PROXY), "row_id", layout_duplicates.text_key(F.col("summary_ref"))),
        ("raw", table(spark, d, "raw_corpus_records"), "raw_id", layout_duplicates.json_key(F.col("raw"))),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = [layout_duplicates.copies(df, i, key).select(F.lit(name).alias("rec_table"), "first_id", "copy_id") for name, df, i, key in _layouts(spark, d)]
    return a.unionByName(b)


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    a, b = [layout_duplicates.collapse(df, i, key).select(F.lit(name).alias("rec_table"), "first_id", "copies") for name, df, i, key in _layouts(spark, d)]
    return a.unionByName(b)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_pairs(table(spark, d, PROXY), "row_id", ["summary_ref", "document"], 0.6)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every row that has a near duplicate, with the smallest row id of its group."""
    return near_duplicates.near_groups(table(spark, d, PROXY), "row_id", ["summary_ref", "document"], 0.6)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the representative of its class of equal word sets, and the number of classes alike enough."""
    return near_duplicates.near_classes(table(spark, d, PROXY), "row_id", ["summary_ref", "document"], 0.6)


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return wrong_encoding.repair_fields(table(spark, d, PROXY), "row_id", ["summary_ref", "document"]).withColumnRenamed("id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_restored(spark, d).select("row_id", "field_name")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    targets = [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, d, "pack_targets").orderBy("pack_id").collect()]
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", targets).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d), table(spark, d, "pack_targets"))


def p7_integrity(spark: SparkSession, d: str) -> DataFrame:
    """That every text is placed whole in each target, undivided where it fits, and that no container holds more than its capacity."""
    return packing.integrity(p7_packed(spark, d).withColumnRenamed("doc_id", "id"), table(spark, d, "pack_targets"))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    items = leaks.held_out(table(spark, d, MASTER))
    out = leaks.leaked(table(spark, d, "documents"), "doc_id", "text", items, "xsum_id", ("summary_ref_norm", "document_norm"))
    return out.withColumnsRenamed({"id": "doc_id", "item": "xsum_id"})


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch of words to remove, with the item that it gives away."""
    return _leaked(spark, d).select("doc_id", "xsum_id", F.explode("spans").alias("s")).select("doc_id", "xsum_id", F.col("s.first").alias("first_word"), F.col("s.end").alias("end_word"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "xsum_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    model = page_prose.fit(table(spark, d, MASTER), "document_norm")
    return page_prose.page_scores(table(spark, d, "documents"), "doc_id", "text", model).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("share > 0.5").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from spanwise.llm import sql

    return dict(sql.SQL)

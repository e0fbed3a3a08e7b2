"""Lexical exposure: which lines of a corpus share n-grams with a benchmark's items, and how long a span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import rubrics
from spanwise.functions.distance import common_substring
from spanwise.functions.text import canonical, ngrams, tokens
from spanwise.runtime import spread

K, PER_LINE, MAX_CANDIDATES = 13, 200, 200


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(line, raw, text): lines as they are and in canonical form; null ones are dropped.

    Blank ones have no gram and no span. They aren't filtered here: a filter on the canonical form would compute it a second time.
    """
    rows = spread(df.select(F.col(id_col).alias("line"), F.col(text_col).alias("raw")).where("raw is not null"))
    return rows.select("line", "raw", canonical(F.col("raw")).alias("text"))


def grams(df: DataFrame, key: str, k: int = K, limit: int | None = None) -> DataFrame:
    """(key, gram): the distinct k-grams of each text, of its first ``limit`` where one is set. Words are split once a text."""
    words = df.select(key, tokens(F.col("text")).alias("words"))
    return words.select(key, F.explode(F.array_distinct(ngrams(F.col("words"), k, limit))).alias("gram"))


def candidates(items: DataFrame, corpus: DataFrame, k: int = K, per_line: int | None = None, most: int | None = None) -> DataFrame:
    """(item, line, hits): lines that share k-grams with an item, by falling hits and rising line.

    An n-gram equi-join: both sides explode to distinct grams, the count is partially aggregated before
    its shuffle. ``per_line``: grams of a line that are indexed, ``most``: lines kept an item, ranked within partitions first;
    None for all. PER_LINE and MAX_CANDIDATES are the usual caps of an index held in memory.
    """
    hits = grams(items, "item", k).join(grams(corpus, "line", k, per_line), "gram").groupBy("item", "line").agg(F.count("*").alias("hits"))
    if most is None:
        return hits
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("hits"), "line"))
    return hits.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def exposure(items: DataFrame, corpus: DataFrame, k: int = K, per_line: int | None = None, most: int | None = None) -> DataFrame:
    """(item, max_span_len, ngram_hits, proxy_count, slex) of every item; spans are measured on candidates alone."""
    found = candidates(items, corpus, k, per_line, most)
    # only the lines found are brought into canonical form again
    text = corpus.select("line", F.col("raw").alias("line_text")) if "raw" in corpus.columns else corpus.select("line", F.col("text").alias("line_text"))
    pairs = found.join(items.withColumnRenamed("text", "item_text"), "item").join(text, "line")
    if "raw" in corpus.columns:
        pairs = pairs.withColumn("line_text", canonical(F.col("line_text")))
    pairs = pairs.select("item", common_substring("item_text", "line_text").alias("span"), tokens(F.col("item_text")).alias("a"), tokens(F.col("line_text")).alias("b"))
    shared = F.array_intersect(ngrams(F.col("a"), k), ngrams(F.col("b"), k, per_line))
    # an item's shared grams are some of its own, however many lines it meets
    best = pairs.select("item", "span", shared.alias("g")).groupBy("item").agg(
        F.max("span").alias("max_span_len"), F.count_if(F.col("span") >= 50).alias("proxy_count"), F.size(F.array_distinct(F.flatten(F.collect_set("g")))).cast("bigint").alias("ngram_hits")
    )
    out = items.select("item").join(best, "item", "left").fillna(0, ["max_span_len", "proxy_count", "ngram_hits"])
    return out.select("item", F.col("max_span_len").cast("bigint").alias("max_span_len"), "ngram_hits", "proxy_count", rubrics.slex_item(F.col("max_span_len"), F.col("ngram_hits")).cast("bigint").alias("slex"))


def aggregate(levels: DataFrame) -> DataFrame:
    """One row: items, the count of each level, means, and the level of the whole set. An empty input is level 0."""
    n = [F.count_if(F.col("slex") == k).alias(f"n{k}") for k in range(4)]
    mean = [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("max_span_len", "ngram_hits", "proxy_count")]
    out = levels.agg(F.count("slex").alias("n_items"), *n, *mean)
    return out.withColumn("slex_aggregate", rubrics.slex_aggregate(F.col("n_items"), F.expr("n1 + n2 + n3"), F.expr("n2 + n3"), F.col("n3")).cast("bigint"))


def histogram(df: DataFrame, column: str, bars: int = 30) -> DataFrame:
    """(bar, n) of ``bars`` bars of equal width between the smallest and the largest value, which is in the last; empty bars are left out."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = F.col(column)
    bar = F.when(F.col("hi") == F.col("lo"), 0).when(x == F.col("hi"), bars - 1).otherwise(F.floor((x - F.col("lo")) * float(bars) / (F.col("hi") - F.col("lo"))))
    return df.where(x.isNotNull()).join(F.broadcast(ends)).groupBy(bar.cast("bigint").alias("bar")).agg(F.count("*").alias("n"))

"""Tables of the detectors brought together: joins, derived and backfilled levels, control passes, frozen choices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions import rubrics
from spanwise.functions.text import gold_suffix


def joined(lexical: DataFrame, others: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The lexical table with the levels of the other detectors, null where one lacks an item. Each table has one row a key."""
    return reduce(lambda a, b: a.join(b, list(key), "left"), others, lexical)


def missing_rates(levels: DataFrame, signals: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The share of rows that lack each signal."""
    return levels.groupBy(*by).agg(*[F.round(F.avg(F.col(s).isNull().cast("double")), 6).alias(f"{s}_missing") for s in signals])


def smem_derived(exact: Column, near_or_distance: Column, binary: bool) -> Column:
    """A level from an exact match and either a near match (0 or 1) or a distance, where a stored table has no level."""
    x = near_or_distance
    rest = F.when(x == 1, 2).when(x.isNotNull(), 0) if binary else F.when(x <= 0.10, 2).when(x <= 0.25, 1).when(x.isNotNull(), 0)
    return F.when(exact == 1, 3).otherwise(rest)


def backfilled(df: DataFrame) -> DataFrame:
    """(…, near, smem, smem_backfilled): near and level filled in from exact match and distance where a stored run lacks them."""
    known = F.col("exact").isNotNull() & F.col("distance").isNotNull()
    level = rubrics.smem_item(F.col("exact"), F.col("distance"))
    out = df.withColumn("smem_backfilled", F.col("smem").isNull() & known)
    return out.withColumns({"near": F.coalesce("near", F.when(known, (F.col("distance") <= 0.10).cast("int"))), "smem": F.coalesce("smem", F.when(known, level))})


def control_target(reference: Column, control_prefix: Column) -> Column:
    """What a control prompt's answer is compared with: the reference after the prompt, or all of it where it doesn't begin so."""
    return F.coalesce(F.nullif(gold_suffix(reference, control_prefix), F.lit("")), reference)


def control_means(scored: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Means of exact, near and distance over the rows that have them."""
    return scored.groupBy(*by).agg(F.count("exact").alias("n"), *[F.round(F.avg(c), 6).alias(f"{c}_control") for c in ("exact", "near", "distance")])


def reused(stored: DataFrame, fresh: DataFrame | None, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Rows of a new pass, and those of a stored table for what the pass leaves out; the stored table alone without a pass."""
    return stored if fresh is None else fresh.unionByName(stored.join(fresh.select(*by).distinct(), list(by), "left_anti"), allowMissingColumns=True)


def frozen(stored: DataFrame, fresh: DataFrame, by: str = "model_id", value: str = "least_slot") -> DataFrame:
    """(by, value, frozen): a model keeps the position that earlier runs stored, if they stored one of A to D and no other."""
    kept = stored.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where((F.col("_low") == F.col("_high")) & F.col("_low").isin("A", "B", "C", "D"))
    out = fresh.select(by, value).join(kept, by, "left")
    return out.select(by, F.coalesce("_low", value).alias(value), F.col("_low").isNotNull().alias("frozen"))


def require_valid(bias: DataFrame, least: int = 50) -> DataFrame:
    """Position counts, with an error in place of a position chosen from fewer than ``least`` valid answers."""
    message = F.concat(F.lit("too few valid answers of "), "model_id", F.lit(": "), F.col("n_valid").cast("string"))
    return bias.withColumn("least_slot", F.when(F.col("n_valid") >= least, F.col("least_slot")).otherwise(F.raise_error(message).cast("string")))


def contrast(scored: DataFrame, control: DataFrame) -> DataFrame:
    """Adds delta_uar and mned_ratio against the means of a control, a table of one row."""
    one = control.agg(F.avg("uar").alias("uar_control"), F.avg("mned").alias("mned_control"))
    out = scored.join(F.broadcast(one))
    return out.withColumns({"delta_uar": F.col("uar") - F.col("uar_control"), "mned_ratio": F.when(F.col("mned_control") > 0, F.col("mned") / F.col("mned_control"))})


def described(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, mean, median, low, high) of several columns in one pass; nulls are left out."""
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*by, F.explode(each).alias("e")).select(*by, "e.metric", "e.x")
    return long.groupBy(*by, "metric").agg(*[F.round(f("x"), 6).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("low", F.min), ("high", F.max))])


def all_models(*tables: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """(model_id) that any table has, without those excluded."""
    ids = reduce(DataFrame.unionByName, [t.select("model_id") for t in tables]).where("model_id <> ''").distinct()
    return ids.where(~F.col("model_id").isin(*excluded)) if excluded else ids


def in_range(c: Column, name: str, low: float = 0.0, high: float = 3.0) -> Column:
    """A level, with an error where it lies outside its range; nulls pass."""
    message = F.concat(F.lit(f"[{name}] out of range [{low:g}, {high:g}]: "), c.cast("string"))
    return F.when(c.isNull() | c.between(low, high), c).otherwise(F.raise_error(message).cast("double"))


def row_details(items: DataFrame, scored: DataFrame, by: str = "item", width: int = 90) -> DataFrame:
    """(item, prefix, suffix, n_words, model_id, exact, completion): what each model answered, beside what was asked, cut to a line's width."""
    cut = lambda c: F.left(c, F.lit(width))
    asked = items.select(by, cut(F.col("prefix")).alias("prefix"), cut(F.col("suffix")).alias("suffix"), F.when(F.col("suffix") == "", 0).otherwise(F.size(F.split("suffix", " "))).cast("long").alias("n_words"))
    return asked.join(scored.select(by, "model_id", F.coalesce("exact", F.lit(0)).cast("long").alias("exact"), cut(F.col("completion")).alias("completion")), by)

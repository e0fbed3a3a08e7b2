"""Samples and limits that any engine repeats: orders by hash instead of a random generator's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_place(*parts: Column | str, seed: int | str = 42) -> Column:
    """The SHA-256 that places a row in the order of a seed."""
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]), 256)


def sample(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """``n`` rows in the order of the hashes of seed and key: taken from each partition first, so nothing is sorted as a whole."""
    return df.withColumn("_at", hash_place(key, seed=seed)).orderBy("_at", key).limit(n).drop("_at")


def limited(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows of a pilot run; all without a limit."""
    return df if n is None else df.orderBy(*order).limit(n)


def limited_unscored(items: DataFrame, done: DataFrame, key: str, n: int | None, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows that a stored run lacks: a limit on new work, not on the table."""
    return limited(items.join(done.select(key), key, "left_anti"), order or (key,), n)


def pairs(samples: DataFrame, by: Sequence[str], idx: str, value: str) -> DataFrame:
    """(by, i, j, a, b): the pairs i < j of samples of one item; their number is a parameter of the run."""
    one = lambda i, v: samples.select(*by, F.col(idx).alias(i), F.col(value).alias(v))
    return one("i", "a").join(one("j", "b"), list(by)).where("i < j")


def sampled_pairs(rows: DataFrame, by: Sequence[str], most: int, seed: int | str = 42) -> DataFrame:
    """At most ``most`` pairs of each item, in hash order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(hash_place("i", "j", seed=seed), "i", "j"))
    return rows.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def strided_pairs(rows: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` pairs of each item, evenly spread over their order; all where there are no more."""
    over = Window.partitionBy(*by)
    out = rows.withColumn("_p", F.row_number().over(over.orderBy("i", "j")) - 1).withColumn("_n", F.count("*").over(over))
    step = F.when(F.col("_n") > most, F.greatest(F.lit(1), F.floor(F.col("_n") / most))).otherwise(1)
    limit = F.when(F.col("_n") > most, F.lit(most).cast("long")).otherwise(F.col("_n"))
    return out.withColumn("_s", step).where((F.col("_p") % F.col("_s") == 0) & (F.col("_p") / F.col("_s") < limit)).drop("_p", "_n", "_s")


def mean_distance(chosen: DataFrame, by: Sequence[str], distance: Column) -> DataFrame:
    """(by, n_pairs, mned) of chosen pairs."""
    return chosen.withColumn("_d", distance).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("_d").alias("mned"))

"""Fusion of the four signals into scores, and the reports built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import rubrics

SIGNALS = ("slex", "ssem", "smem", "sprob")


def item_risk(levels: DataFrame) -> DataFrame:
    """Adds score, band and confidence to (model_id, item, slex, ssem, smem, sprob); missing signals give nulls."""
    raw, final = rubrics.crs(F.col("ssem"), F.col("smem"), F.col("sprob"))
    conf = rubrics.confidence(None, F.col("ssem"), F.col("smem"), F.col("sprob"))
    out = levels.withColumn("crs_raw", raw).withColumn("crs", final).withColumn("override_active", (F.col("ssem") == 3) | (F.col("smem") == 3) | (F.col("sprob") == 3))
    out = out.withColumn("risk_level", F.when(F.col("crs").isNotNull(), rubrics.risk_level(F.col("crs"))))
    return out.withColumns({"coverage": F.round(conf["coverage"], 6), "agreement": F.round(conf["agreement"], 6), "confidence_pct": conf["confidence_pct"].cast("bigint"), "confidence_level": F.when(conf["confidence_pct"].isNotNull(), conf["confidence_level"])})


def model_risk(signals: DataFrame) -> DataFrame:
    """Score, band, confidence and conflict of (model_id, slex, ssem, smem, sprob), one row a model."""
    raw, final = rubrics.crs(F.col("ssem"), F.col("smem"), F.col("sprob"))
    conf = rubrics.confidence(F.col("slex"), F.col("ssem"), F.col("smem"), F.col("sprob"))
    out = signals.withColumns({"crs_raw": raw, "crs": final}).withColumn("risk_level", rubrics.risk_level(F.col("crs")))
    out = out.withColumns({"coverage": F.round(conf["coverage"], 4), "agreement": F.round(conf["agreement"], 4), "confidence_pct": conf["confidence_pct"].cast("bigint"), "confidence_level": conf["confidence_level"]})
    return out.withColumn("conflicting_evidence", F.col("risk_level").isin("HIGH", "CRITICAL") & (F.col("confidence_level") == "LOW"))


def medians(levels: DataFrame) -> DataFrame:
    """One row a model: the median of each signal and the rows that miss it."""
    return levels.groupBy("model_id").agg(F.count("*").alias("n_total"), *[F.percentile(s, 0.5).alias(s) for s in SIGNALS], *[F.round(F.avg(F.col(s).isNull().cast("double")), 6).alias(f"{s}_missing") for s in SIGNALS])


def score_distribution(scored: DataFrame, by: str = "model_id") -> DataFrame:
    """Per model: mean, quantiles and extremes of the score, the bands' counts and shares, and the first largest band."""
    bands = ("LOW", "MODERATE", "HIGH", "CRITICAL")
    counts = [F.count_if(F.col("risk_level") == b).alias(f"n_{b.lower()}") for b in bands]
    out = scored.where("crs is not null").groupBy(by).agg(F.count("*").alias("n"), *counts, F.round(F.avg("crs"), 4).alias("crs_mean"), F.percentile("crs", [0.1, 0.5, 0.9]).alias("q"), F.min("crs").alias("crs_min"), F.max("crs").alias("crs_max"), F.count_if("override_active").alias("n_override"))
    top = F.array_min(F.array(*[F.struct((-F.col(f"n_{b.lower()}")).alias("m"), F.lit(k).alias("k"), F.lit(b).alias("b")) for k, b in enumerate(bands)]))
    return out.select(by, "n", *[f"n_{b.lower()}" for b in bands], *[F.bround(100.0 * F.col(f"n_{b.lower()}") / F.col("n"), 2).alias(f"pct_{b.lower()}") for b in bands], "crs_mean", *[F.round(F.col("q")[k], 4).alias(f"crs_p{p}") for k, p in enumerate((10, 50, 90))], "crs_min", "crs_max", "n_override", top["b"].alias("dominant_band"))


def ranked(models: DataFrame, score: str) -> DataFrame:
    """Models from the lowest score, ties by name, with the spread between the ends."""
    over = Window.partitionBy()
    return models.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.asc_nulls_last(score), "model_id")).cast("bigint")).withColumn("spread", F.round(F.max(score).over(over) - F.min(score).over(over), 4))


def top_flagged(scored: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` highest scores a model, ties by item, with the reason in words."""
    reason = (
        F.when(F.col("smem") >= 3, "exact reconstruction")
        .when(F.col("sprob") >= 2, "low variability of repeated generations")
        .when(F.col("ssem") >= 1, "semantic familiarity")
        .otherwise("public overlap")
    )
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc_nulls_last("crs"), "item"))
    return scored.withColumn("place", rank.cast("bigint")).where(F.col("place") <= limit).select("model_id", "place", "item", "crs", "risk_level", reason.alias("reason"))


def overlap_pairs(marks: DataFrame, group: str, member: str) -> DataFrame:
    """For each pair of groups: members in both, in either, and their ratio. Counts meet by member, never as whole sets."""
    m = marks.select(group, member).distinct()
    size = m.groupBy(group).agg(F.count("*").alias("n"))
    a, b = m.withColumnRenamed(group, "a"), m.withColumnRenamed(group, "b")
    both = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    names = size.select(F.col(group).alias("a"), F.col("n").alias("na")).join(size.select(F.col(group).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    out = names.join(both, ["a", "b"], "left").fillna(0, ["n_both"])
    return out.withColumn("n_either", F.expr("na + nb - n_both")).withColumn("jaccard", F.round(F.try_divide("n_both", "n_either"), 6)).drop("na", "nb")


def overlap_patterns(marks: DataFrame, group: str, member: str) -> DataFrame:
    """Each set of groups that holds some member together, with the number of such members."""
    pattern = marks.groupBy(member).agg(F.array_join(F.sort_array(F.collect_set(group)), " + ").alias("pattern"))
    return pattern.groupBy("pattern").agg(F.count("*").alias("n"))


def by_size(patterns: DataFrame) -> DataFrame:
    """Patterns with their number of groups, ordered by it, then by members. There are as many as sets of groups, however many members."""
    size = F.size(F.split("pattern", r" \+ ")).cast("bigint")
    over = Window.partitionBy().orderBy(F.desc("size"), F.desc("n"), "pattern")
    return patterns.withColumn("size", size).withColumn("place", F.row_number().over(over).cast("bigint")).select("pattern", "size", "n", "place")


def checks(items: DataFrame, required: tuple[str, ...], checks_of: dict[str, tuple[str, Column]]) -> DataFrame:
    """(check, severity, bad, total, ok): blank required columns and named conditions, in one pass over the items.

    checks_of: name -> (severity, condition of a bad row).
    """
    named = {f"blank_{c}": ("critical", F.coalesce(F.trim(F.col(c)), F.lit("")) == "") for c in required} | checks_of
    row = items.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, (_, c) in named.items()])
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("bad")) for n, (s, _) in named.items()])
    return row.select("total", F.explode(each).alias("c")).select("c.check", "c.severity", "c.bad", "total", (F.col("c.bad") == 0).alias("ok"))


def verdict(found: DataFrame) -> DataFrame:
    """(ready, failed, warned) of a table of checks: whether no critical one has a bad row, and the names of those that have, by severity."""
    names = lambda severity: F.array_join(F.sort_array(F.collect_list(F.when((F.col("severity") == severity) & ~F.col("ok"), F.col("check")))), ",")
    return found.agg((F.count_if((F.col("severity") == "critical") & ~F.col("ok")) == 0).alias("ready"), names("critical").alias("failed"), names("advisory").alias("warned"))

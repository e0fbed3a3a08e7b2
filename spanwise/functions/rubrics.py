"""Ordinal rubrics as ordered CASE expressions; the first branch that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(c: Column, cuts: list[float], names: list) -> Column:
    """The name of the first cut that a value is below, else the last name."""
    out = F
    for cut, name in zip(cuts, names, strict=False):
        out = out.when(c < cut, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def slex_item(span: Column, hits: Column) -> Column:
    return F.when(span >= 100, 3).when((span >= 50) | (hits >= 3), 2).when((span >= 30) | (hits >= 1), 1).otherwise(0)


def slex_aggregate(n: Column, positive: Column, two_up: Column, three: Column) -> Column:
    return F.when((n == 0) | (positive == 0), 0).when((three > 0) | (two_up / n >= 0.10), 3).when((two_up > 0) | (positive / n >= 0.05), 2).otherwise(1)


def ssem(cps: Column, kappa: Column, e_rate: Column) -> Column:
    """A struct of level and reason. kappa may be null."""
    high_e, known = e_rate > 0.40, kappa.isNotNull()
    pair = lambda level, why: F.struct(F.lit(level).alias("level"), F.lit(why).alias("reason"))
    none = F.struct(F.lit(None).cast("int").alias("level"), F.lit("no_bcq_data").alias("reason"))
    return (
        F.when(cps.isNull(), none)
        .when(known & (kappa < 0) & ~high_e, pair(0, "negative_kappa_clean"))
        .when(~known & (cps < 0.10) & ~high_e, pair(0, "very_low_cps_no_kappa"))
        .when((cps >= 0.60) & (~known | (kappa >= 0.20)), pair(3, "high_cps_confirmed"))
        .when(cps >= 0.60, pair(2, "high_cps_weak_kappa"))
        .when((cps >= 0.45) & (~known | (kappa >= 0.10)), pair(2, "moderate_cps_confirmed"))
        .when(cps >= 0.45, pair(1, "moderate_cps_weak_kappa"))
        .when(cps >= 0.25, pair(1, "weak_cps_above_chance"))
        .when(high_e, pair(1, "high_e_rate_signal"))
        .otherwise(pair(1, "below_chance_cps_nonzero_kappa"))
    )


def ssem_from_cps(cps: Column) -> Column:
    return _bands(cps, [0.30, 0.45, 0.60], [0, 1, 2, 3])


def smem_item(exact: Column, distance: Column) -> Column:
    return F.when(exact == 1, 3).when(distance <= 0.10, 2).when(distance <= 0.25, 1).when(distance.isNotNull() | exact.isNotNull(), 0)


def smem_aggregate(em: Column, ne: Column, em_control: Column, use_control: Column, exact: Column) -> Column:
    strong = (em >= 0.15) & (ne >= 0.35)
    return (
        F.when(exact == 0, 0)
        .when(strong & ~use_control, 2)
        .when(strong & (F.coalesce(em_control, F.lit(0.0)) == 0), 3)
        .when(strong & (em / em_control >= 2), 3)
        .when(strong, 2)
        .when((em >= 0.05) | (ne >= 0.15), 2)
        .otherwise(1)
    )


def smem_aggregate_rates(em: Column, ne: Column, em_control: Column, use_control: Column) -> Column:
    """The earlier rubric, from rates alone."""
    return (
        F.when((em < 0.01) & (ne < 0.05), 0)
        .when((em < 0.05) & (ne < 0.15), 1)
        .when((em < 0.15) & (ne < 0.35), 2)
        .when(use_control & ((F.coalesce(em_control, F.lit(0.0)) == 0) | (em / F.nullif(em_control, F.lit(0.0)) >= 2)), 3)
        .otherwise(2)
    )


def em_level(em: Column) -> Column:
    return _bands(em, [0.01, 0.05, 0.15], [0, 1, 2, 3])


def ne_level(ne: Column) -> Column:
    return _bands(ne, [0.05, 0.15, 0.35], [0, 1, 2, 3])


def wilson(count: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clamped and rounded; 0 where n is 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = count / m
    z2 = z * z
    denom = 1 + z2 / m
    centre = (p + z2 / (2 * m)) / denom
    margin = z / denom * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return tuple(F.when(n > 0, F.bround(x, 6)).otherwise(0.0) for x in (low, high))


def band_absolute(uar: Column, mned: Column) -> Column:
    return (
        F.when(uar.isNull() | mned.isNull(), 1)
        .when((uar > 0.60) & (mned > 0.25), 0)
        .when(uar.between(0.40, 0.60) | mned.between(0.15, 0.25), 1)
        .when(((uar >= 0.20) & (uar < 0.40)) | ((mned >= 0.08) & (mned < 0.15)), 2)
        .otherwise(3)
    )


def band_contrast(uar: Column, mned: Column, uar_control: Column, mned_control: Column) -> Column:
    usable = (uar > 0) & (mned > 0) & uar_control.isNotNull() & mned_control.isNotNull()
    c = F.greatest(uar_control / F.nullif(uar, F.lit(0.0)), mned_control / F.nullif(mned, F.lit(0.0)))
    return F.when(~F.coalesce(usable, F.lit(False)), 0).when(c >= 2, 3).when(c >= 1.5, 2).when(c >= 1.25, 1).otherwise(0)


def band_anchor(anchor: Column, peak: Column) -> Column:
    return (
        F.when(anchor.isNull() | peak.isNull(), 1)
        .when((anchor >= 0.25) & (peak < 0.25), 0)
        .when((anchor < 0.08) | (peak >= 0.75), 3)
        .when((anchor < 0.15) | (peak >= 0.50), 2)
        .otherwise(1)
    )


def sprob_item(uar: Column, mned: Column, uar_control: Column, mned_control: Column, anchor: Column, peak: Column) -> Column:
    return F.greatest(band_absolute(uar, mned), band_contrast(uar, mned, uar_control, mned_control), band_anchor(anchor, peak))


def sprob_two_metrics(uar: Column, mned: Column) -> Column:
    """The first rubric: unknown is 0, a metric below its floor is enough."""
    return (
        F.when(uar.isNull() | mned.isNull(), 0)
        .when((uar < 0.20) | (mned < 0.08), 3)
        .when((uar < 0.40) | (mned < 0.15), 2)
        .when((uar <= 0.60) & (mned <= 0.25), 1)
        .when((uar > 0.60) & (mned > 0.25), 0)
        .otherwise(1)
    )


def sprob_four_metrics(uar: Column, mned: Column, anchor: Column, peak: Column) -> Column:
    known = uar.isNotNull() & mned.isNotNull() & anchor.isNotNull() & peak.isNotNull()
    return (
        F.when(~known, 1)
        .when((uar > 0.60) & (mned > 0.25) & (anchor >= 0.25) & (peak < 0.25), 0)
        .when(((uar < 0.20) & (mned < 0.08)) | (peak >= 0.75) | (anchor < 0.08), 3)
        .when(((uar < 0.40) & (mned < 0.15)) | (peak >= 0.50) | (anchor < 0.15), 2)
        .otherwise(1)
    )


def sprob_capped(uar: Column, mned: Column, uar_control: Column, mned_control: Column) -> tuple[Column, Column]:
    """(level, whether the contrast is met): the top level needs a metric below its floor and twice the control's concentration."""
    floor = (uar < 0.20) | (mned < 0.08)
    # a metric of nothing is infinitely below its control
    twice = (F.when(uar > 0, uar_control / uar >= 2).otherwise(True)) | (F.when(mned > 0, mned_control / mned >= 2).otherwise(True))
    met = floor & uar_control.isNotNull() & mned_control.isNotNull() & twice
    level = (
        F.when(uar.isNull() | mned.isNull(), 0)
        .when((uar > 0.60) & (mned > 0.25), 0)
        .when(uar.between(0.40, 0.60) & mned.between(0.15, 0.25), 1)
        .when(floor, F.when(met, 3).otherwise(2))
        .when(((uar >= 0.20) & (uar < 0.40)) | ((mned >= 0.08) & (mned < 0.15)), 2)
        .otherwise(1)
    )
    return level, F.coalesce(met, F.lit(False))


def sprob_two_bands(uar: Column, mned: Column, anchor: Column, peak: Column) -> Column:
    """The larger of the absolute and the anchor's band, without a control."""
    return F.greatest(band_absolute(uar, mned), band_anchor(anchor, peak))


def sprob_aggregate(n: Column, n1: Column, n2: Column, n3: Column) -> Column:
    plus = n1 + n2 + n3
    return (
        F.when((n == 0) | (plus == 0), 0)
        .when((n3 >= 2) | (n3 / n >= 0.05) | ((n2 + n3) / n >= 0.15), 3)
        .when((n2 >= 1) | (plus / n >= 0.10) | ((n2 + n3) / n >= 0.05), 2)
        .otherwise(1)
    )


def crs(ssem_level: Column, smem_level: Column, sprob_level: Column) -> tuple[Column, Column]:
    """(weighted sum, the same with the floor where a signal is at its top)."""
    raw = 0.35 * ssem_level / 3 + 0.35 * smem_level / 3 + 0.30 * sprob_level / 3
    top = (ssem_level == 3) | (smem_level == 3) | (sprob_level == 3)
    final = F.when(top, F.greatest(raw, F.lit(0.60))).otherwise(raw)
    clipped = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), final)))  # greatest and least pass over nulls
    return F.bround(raw, 6), F.bround(clipped, 6)


def risk_level(c: Column) -> Column:
    return _bands(c, [0.25, 0.50, 0.75], ["LOW", "MODERATE", "HIGH", "CRITICAL"])


def confidence(slex: Column | None, ssem_level: Column, smem_level: Column, sprob_level: Column) -> dict[str, Column]:
    """Coverage, agreement and percentage; without ``slex`` the mean of two components instead of three."""
    levels = (ssem_level, smem_level, sprob_level)
    coverage = sum((F.when(x > 0, 1.0).otherwise(0.0) for x in levels), F.lit(0.0)) / 3
    mean = (ssem_level + smem_level + sprob_level) / 3
    variance = sum(((x - mean) * (x - mean) for x in levels), F.lit(0.0)) / 3
    agreement = F.when(variance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - variance / 3)))
    parts = [coverage, agreement] + ([] if slex is None else [F.when(slex.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), slex / 3)))])
    pct = F.bround(100 * sum(parts, F.lit(0.0)) / len(parts)).cast("int")
    return {"coverage": coverage, "agreement": agreement, "confidence_pct": pct, "confidence_level": F.when(pct >= 70, "HIGH").otherwise("LOW")}


def evidence_strength(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(0)) <= 0, "None").when(level == 1, "Low").when(level == 2, "Moderate").otherwise("Strong")


def slex_label(level: Column) -> Column:
    return F.when(level.isNull(), "").when(level == 0, "Not detected").when(level == 1, "Weak presence").when(level == 2, "Moderate presence").otherwise("Widely available")

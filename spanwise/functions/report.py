"""Values as a report prints them, and labels in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt(c: Column, decimals: int = 4) -> Column:
    """A number as text: rounded half to even, without trailing zeros but for one after the point; null and blank as ''."""
    x = c.cast("string").try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    if decimals == 0:
        return F.when(x.isNull(), F.coalesce(c.cast("string"), F.lit(""))).otherwise(F.bround(x).cast("bigint").cast("string"))
    digits = F.format_string(f"%.{decimals}f", F.bround(x, decimals))
    return F.when(x.isNull(), F.coalesce(c.cast("string"), F.lit(""))).otherwise(F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", ".0"))


def pct(part: Column, total: Column) -> Column:
    """A share as a whole percentage in text, half to even; '' without a total."""
    return F.when(total > 0, F.bround(100.0 * part / F.nullif(total, F.lit(0))).cast("bigint").cast("string")).otherwise("")


def rate(kept: Column, total: Column) -> Column:
    """The share that is gone as text with two decimals; '0%' of nothing."""
    return F.when(total > 0, F.format_string("%.2f%%", F.bround((1 - kept / F.nullif(total, F.lit(0))) * 100, 2))).otherwise("0%")


def whole(c: Column, default: int = 0) -> Column:
    """A number cut to a whole one; the default for what is no number."""
    return F.coalesce(F.when(c.cast("string").rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), c.cast("string").cast("double")).cast("bigint"), F.lit(default).cast("bigint"))


def safe(c: Column, *path: str, default: str = "") -> Column:
    """A nested field of JSON text as text; the default where any step is missing, null or blank."""
    at = "$" + "".join(f".{p}" for p in path)
    return F.coalesce(F.nullif(F.get_json_object(c, at), F.lit("")), F.lit(default))


def source_name(path: Column) -> Column:
    """The name of a source from its file's."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    low = F.lower(stem)
    return F.when(low.contains("github"), "GitHub").when(low.contains("kaggle"), "Kaggle").otherwise(F.initcap(F.translate(stem, "_", " ")))


def listed(names: Column) -> Column:
    """Distinct names in their order: 'a, b and c'."""
    d = F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))
    n = F.size(d)
    return F.when(n <= 1, F.coalesce(F.get(d, F.lit(0)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(d, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(d, -1)))


def confidence_score(low: Column, medium: Column, high: Column, weights: tuple[float, float, float] = (0.0, 60.0, 100.0)) -> Column:
    """Counts of confidence levels as a score of 0 to 100; 0 of nothing. The older weights are (30, 60, 100)."""
    total = low + medium + high
    return F.when(total > 0, F.bround((weights[0] * low + weights[1] * medium + weights[2] * high) / F.nullif(total, F.lit(0)), 2)).otherwise(0.0)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 75, "High").when(score >= 45, "Medium").otherwise("Low")


def lexical_strength(n2: Column, n3: Column, n: Column) -> Column:
    """Evidence in words by the share of items at the two upper levels; 'Moderate' where the number of items isn't known."""
    share = (n2 + n3) / F.nullif(n, F.lit(0))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "Moderate").when(share >= 0.8, "Strong").when(share >= 0.4, "Moderate").when(share > 0, "Low").otherwise("None")


def prefixed(name: str, prefix: str | None) -> str:
    """The name of a result column for a named corpus: 'SLex' and 'web_' give 'SLex_web'."""
    p = (prefix or "").strip().rstrip("_")
    return f"{name}_{p}" if p else name

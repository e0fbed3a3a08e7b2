"""What a run's settings must hold, and settings that are known to do harm."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Settings with the bound beyond which a warning is due, and which side of it is bad.
DRIFT = (
    ("github", "rate_limit_threshold", "lt", 20),
    ("github", "max_file_bytes", "gt", 1_000_000),
    ("extraction", "max_periods", "gt", 4),
    ("", "id_query_cap", "gt", 40),
)
# Columns that a benchmark table must have for the quiz.
REQUIRED = ("xsum_id", "split", "document_norm", "summary_ref_norm", "dcq_a_canonical", "dcq_b_para1", "dcq_c_para2", "dcq_d_para3", "dcq_e_para4")


def _number(x: object) -> float | None:
    try:
        return float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def validated(config: Mapping, environ: Mapping[str, str] = os.environ) -> list[str]:
    """The warnings of a run's settings; what makes a run impossible is an error."""
    for section in ("project", "proxy_builder"):
        if section not in config:
            raise ValueError(f"the settings lack the section {section!r}")
    master = config["project"].get("frozen_master_table_path")
    if not master:
        raise ValueError("the settings lack project.frozen_master_table_path")
    if not os.path.exists(master):
        raise ValueError(f"there is no master table at {master}")
    build = config["proxy_builder"]
    hub = build.get("github", {})
    token = hub.get("token_env", "GITHUB_TOKEN")
    if hub.get("enabled") and not environ.get(token, "").strip():
        raise ValueError(f"github is enabled but {token} isn't set")
    warnings = []
    for section, key, side, bound in DRIFT:
        x = _number((build.get(section, {}) if section else build).get(key))
        if x is not None and (x < bound if side == "lt" else x > bound):
            warnings.append(f"{key} = {x:g} is {'below' if side == 'lt' else 'above'} {bound}")
    if "split test" in [str(k).strip().lower() for k in build.get("keywords", [])]:
        warnings.append("the search word 'split test' matches any repository with a test split")
    return warnings


def validated_items(items: DataFrame, required: tuple[str, ...] = REQUIRED, filled: str = "dcq_e_para4") -> DataFrame:
    """The items, unless a column is missing or the last paraphrase is blank throughout. One pass that stops at the first filled row."""
    lacking = [c for c in required if c not in items.columns]
    if lacking:
        raise ValueError(f"the items lack the columns {lacking}")
    if items.where(F.coalesce(F.trim(F.col(filled)), F.lit("")) != "").isEmpty():
        raise ValueError(f"{filled} is blank in every row")
    return items

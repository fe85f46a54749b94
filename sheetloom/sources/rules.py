"""Check rules: shipped defaults and per-job overrides."""
from __future__ import annotations

import copy
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONJUNCTIONS, PLACEHOLDERS

# Check names with their default severity and parameters.
DEFAULT_CHECKS = {
    "whitespace": {"enabled": True, "severity": "warn"},
    "broken_hyphenation": {"enabled": True, "severity": "info"},
    "placeholder_values": {"enabled": True, "severity": "warn", "tokens": list(PLACEHOLDERS)},
    "trailing_conjunction": {"enabled": True, "severity": "info", "words": list(CONJUNCTIONS)},
    "duplicate_array_items": {"enabled": True, "severity": "warn"},
    "empty_vs_null": {"enabled": True, "severity": "info"},
    "numeric_string": {"enabled": True, "severity": "info"},
}
MAX_SAMPLES = 5


def merge_checks(overrides: Mapping[str, Mapping] | None = None,
                 defaults: Mapping[str, Mapping] | None = None) -> dict[str, dict]:
    """Checks with override values winning key by key; new names are added."""
    checks = {k: dict(v) for k, v in copy.deepcopy(dict(defaults or DEFAULT_CHECKS)).items()}
    for name, values in (overrides or {}).items():
        checks.setdefault(name, {}).update(values)
    return checks


def merge_rule_tables(defaults: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """The same merge on rule tables kept as data."""
    if overrides is None:
        return defaults
    on = ["check_name", "param"]
    return defaults.join(overrides.withColumnRenamed("value", "override"), on, "full").select(
        *on, F.coalesce("override", "value").alias("value"))

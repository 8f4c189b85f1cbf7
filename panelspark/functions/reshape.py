"""Wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def to_long(panel: DataFrame, indicators: Sequence[str] | None = None, keys: Sequence[str] = ("entity", "ts")) -> DataFrame:
    """One row per key and indicator; nulls stay."""
    names = list(indicators or [c for c in panel.columns if c not in keys])
    return panel.unpivot(list(keys), names, "indicator", "value").select(
        *[k for k in keys if k != "ts"], "indicator", "ts", "value")

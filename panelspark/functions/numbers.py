"""Small numeric expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: str | Column, digits: int = 6) -> Column:
    """Rounded half up with plain floating-point steps, so that every engine gives the same bits; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c.cast("double") * scale + F.lit(0.5)).cast("double") / scale + F.lit(0.0)


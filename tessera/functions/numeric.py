"""Numeric helpers shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(c) -> Column:
    """Round half up to 6 decimals on the binary value: ``floor(x*1e6 + 0.5) / 1e6``.

    Plain IEEE operations, so every engine evaluating the same expression gets
    the same double (``round`` differs between engines at decimal ties).
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)

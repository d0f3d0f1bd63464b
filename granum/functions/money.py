"""Order-independent sums of two-decimal amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dsum(x: Column | str) -> Column:
    """Sum of a two-decimal amount, exact whatever the order of rows, as a double."""
    c = F.col(x) if isinstance(x, str) else x
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """``100 * part / whole`` rounded; null for an empty whole."""
    return F.round(100.0 * part / F.when(whole != 0, whole), digits)

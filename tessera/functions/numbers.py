"""Rounding that two engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Rounds after a nudge of a thousandth of the last digit, so that exact ties
    (means of short decimals have them) and noise below fall to one side."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 10.0 ** -(digits + 3), digits)

"""Comparing a Spark result with a DuckDB relation."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal


def _plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if hasattr(x, "item"):
        x = x.item()
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else x


def difference(df, relation) -> str | None:
    """What differs between the rows of both, columns in name order; None if
    nothing does."""
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return f"columns {names} and {sorted(relation.columns)}"
    a = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    at = [relation.columns.index(n) for n in names]
    b = Counter(tuple(_plain(r[i]) for i in at) for r in relation.fetchall())
    if a == b:
        return None
    return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b))[:3]}; only there {list((b - a))[:3]}"

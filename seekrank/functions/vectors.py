"""Vector expressions (Catalyst higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v) -> Column:
    """Euclidean norm as a double; null for a null vector."""
    col = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))

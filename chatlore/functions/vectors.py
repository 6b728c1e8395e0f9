"""Vector distances as Column expressions (higher-order functions, no UDF).

Spark 4.1 has no vector function, so distances are folds over ``zip_with``.
All arithmetic is in double, whatever the element type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlore.functions.text import _col

METRICS = ("l2sq", "cosine", "ip")


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2sq(a: Column | str, b: Column | str) -> Column:
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return _dsum(diffs)


def dot(a: Column | str, b: Column | str) -> Column:
    return _dsum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_dsum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def distance(a: Column | str, b: Column | str, metric: str = "l2sq") -> Column:
    """Smaller is nearer for every metric: l2sq, cosine (1 - cos), ip (1 - a.b)."""
    if metric == "l2sq":
        return l2sq(a, b)
    if metric == "cosine":
        both = norm(a) * norm(b)
        return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.nullif(both, F.lit(0.0)))
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


def dimension(a: Column | str) -> Column:
    return F.size(_col(a))

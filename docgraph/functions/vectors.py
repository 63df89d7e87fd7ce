"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, over their common length; 0 if one is null, empty or zero."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v
    )
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(b) > 0) & (norms > 0)
    return F.coalesce(F.when(usable, dot(a, b) / norms), F.lit(0.0))

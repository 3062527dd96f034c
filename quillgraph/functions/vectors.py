"""Vector scalars; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(inner(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))

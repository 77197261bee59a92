"""Embedding vectors as integers: which rows take part, and how components are quantised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def quantised(vec: Column, scale: int, bound: int) -> Column:
    """array<int> of floor(scale * x), x as double. A value of ``bound`` or more in size stops the job: products
    of such values would not fit the long integers of the result."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        too_large = F.raise_error(F.lit(f"a vector's component is beyond {bound} after scaling")).cast("bigint")
        return F.when(F.abs(x.cast("double") * scale) >= bound, too_large).otherwise(y).cast("int")

    return F.transform(vec, one)

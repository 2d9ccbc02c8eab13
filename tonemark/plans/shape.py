"""Output shaping shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def product_round(c: Column, digits: int) -> Column:
    """Round as SQL engines do in doubles: scale up, round, scale down; c if that overflows.

    Above 2**53 / 10**digits that is off by a unit in the last place, which decimals are not.
    """
    scaled = F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)
    return F.when(F.isnan(scaled) | (F.abs(scaled) == F.lit(float("inf"))), c).otherwise(scaled)


def tidy(df: DataFrame, digits: int = 6, rounding: Callable[[Column, int], Column] = F.round) -> DataFrame:
    """Round doubles and widen integers, so two engines agree on every value."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns -0.0 into 0.0.
            c = rounding(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)

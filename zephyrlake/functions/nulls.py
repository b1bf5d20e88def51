"""Missing values. Inside the engine NULL is the only missing marker; NaN becomes NULL at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float columns with NaN as NULL, in one projection."""
    floats = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def clip(x: Column, low: float, high: float | Column) -> Column:
    """NULL stays NULL: greatest and least skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high) if isinstance(high, (int, float)) else high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is over 0, else NULL; never a division by zero under ANSI."""
    return F.when(b > 0, a / b)


def strict_avg(x: Column) -> Column:
    """NULL as soon as one value is NULL, as a mean that carries NaN along."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def std(x: Column, ddof: int) -> Column:
    """Standard deviation with ddof degrees taken off; NULL where no more rows than that are there."""
    if ddof == 0:
        return F.stddev_pop(x)
    if ddof == 1:
        return F.when(F.count(x) > 1, F.stddev_samp(x))
    n = F.count(x)
    return F.when(n > ddof, F.sqrt(F.var_pop(x) * n / (n - ddof)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

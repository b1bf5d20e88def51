"""Median imputation fitted on training rows only, with exact medians."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.functions.nulls import nan_to_null
from zephyrlake.operators.contracts import check_columns, check_schema_match, require


@dataclass(frozen=True)
class MedianImputer:
    columns: tuple[str, ...]
    medians: tuple[float, ...]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
        """keep and the fitted columns with gaps filled. exact: the frame has just these columns, in this order."""
        if exact:
            check_schema_match(self.columns, [c for c in df.columns if c not in keep], "imputer columns")
        check_columns(df, [*keep, *self.columns], "imputer input")
        df = nan_to_null(df)
        return df.select(*keep, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)).alias(c) for c, m in zip(self.columns, self.medians, strict=True)])


def exact_medians(df: DataFrame, columns: list[str], accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact medians of double columns; None where a column has no values.

    A sketch gives bounds that the middle ranks lie between, a count tells how many values are under them, and only values
    between the bounds, about 4 / accuracy of a column's, are ranked: no task orders a whole column. Should
    a bound miss, the bounds of all columns are widened.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    wide = 2
    while True:
        shares = [max(0.0, 0.5 - wide / accuracy), min(1.0, 0.5 + wide / accuracy)]
        told = df.agg(
            *[
                F.percentile_approx(x[c], shares, accuracy).alias(f"b{k}")
                for k, c in enumerate(columns)
            ], *[F.count(x[c]).alias(f"n{k}") for k, c in enumerate(columns)],
        ).first()
        n, bounds = {c: told[f"n{k}"] for k, c in enumerate(columns)}, {c: told[f"b{k}"] for k, c in enumerate(columns)}
        some = [c for c in columns if n[c]]
        if not some:
            return dict.fromkeys(columns)
        between = [F.when(x[c].between(*bounds[c]), x[c]).alias(c) for c in some]
        under = df.agg(*[F.count_if(x[c] < bounds[c][0]).alias(f"u{k}") for k, c in enumerate(some)]).first()
        long = df.select(*between).unpivot([], [F.col(f"`{c}`") for c in some], "column", "value").filter("value is not null")
        upto = F.sum("m").over(Window.partitionBy("column").orderBy("value"))
        ranked = long.groupBy("column", "value").agg(F.count("*").alias("m")).withColumn("upto", upto)
        start = {c: under[f"u{k}"] for k, c in enumerate(some)}
        wanted = [(c, r - start[c]) for c in some for r in {(n[c] - 1) // 2, n[c] // 2}]  # places from 0 among the values between
        wanted = df.sparkSession.createDataFrame(wanted, "column string, place long")
        at = ranked.join(F.broadcast(wanted), "column").filter(
            (F.col("place") >= F.col("upto") - F.col("m")) & (F.col("place") < F.col("upto"))
        )  # two rows a column
        middle = {
            r["column"]: r
            for r in at.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("place").alias("places")).collect()
        }
        if all(c in middle and middle[c]["places"] == len({(n[c] - 1) // 2, n[c] // 2}) for c in some):
            return {c: middle[c]["low"] + (middle[c]["high"] - middle[c]["low"]) * 0.5 if c in middle else None for c in columns}
        wide *= 8


def fit_median_imputer(df: DataFrame, columns: list[str] | None = None) -> MedianImputer:
    """Exact medians of numeric columns."""
    columns = list(df.columns if columns is None else columns)
    require(bool(columns), "imputer: no columns")
    check_columns(df, columns, "imputer input")
    require(len(set(columns)) == len(columns), "imputer: columns repeat")
    odd = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    require(not odd, f"imputer: columns aren't numeric: {odd}")
    medians = exact_medians(nan_to_null(df.select(*columns)), columns)
    empty = [c for c in columns if medians[c] is None]
    require(not empty, f"imputer: columns have no values: {empty}")
    wild = [c for c in columns if not math.isfinite(medians[c])]
    require(not wild, f"imputer: medians aren't finite: {wild}")
    return MedianImputer(tuple(columns), tuple(float(medians[c]) for c in columns))

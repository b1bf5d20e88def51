"""Spatial statistics of gridded forecasts, one row for each forecast time."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions.nulls import nan_to_null, std
from zephyrlake.functions.scalars import hours_between
from zephyrlake.operators.contracts import check_columns, check_cutoff, check_grid, check_prefix, check_schema_match, check_source, check_statistics, require, value_columns
from zephyrlake.schema import AVAILABLE, FORECAST, GRID, META

LEAD = "lead_hour"


def aggregate_grid(
    df: DataFrame, source: str, statistics: str | Iterable[str] = ("mean",), include_lead: bool = False, prefix: str | None = None,
    std_ddof: int = 0, strict: bool = True
) -> DataFrame:
    """{prefix}_{column}_{statistic} by forecast time, statistics in the order mean, std, min, max, lead last.

    Missing cells are left out of a statistic; where all are missing it is missing. One
    aggregation, for min, max and lead with a partial step on the map side; strict adds the contract's job.
    """
    check_source(source)
    prefix = check_prefix(source if prefix is None else prefix)
    wanted = check_statistics(statistics, std_ddof)
    df = nan_to_null(df)
    columns = value_columns(df)
    if strict:
        check_grid(df, source)
    if {"mean", "std"} & set(wanted):
        df = by_cell(df, columns)
    made = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        by = {"mean": F.avg(x), "std": std(x, std_ddof), "min": F.min(x), "max": F.max(x)}
        made += [by[s].alias(f"{prefix}_{c}_{s}") for s in wanted]
    if include_lead:
        made.append(F.min(hours_between(F.col(AVAILABLE), F.col(FORECAST))).alias(f"{prefix}_{LEAD}"))
    return df.groupBy(FORECAST).agg(*made)


def by_cell(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each time's rows in one task, cell by cell. Sums of doubles depend on the order of their terms, and partial sums of several tasks meet in
    any: without this, means change in their last bits from scan to scan, and models fitted on them change with these."""
    order = [c for c in (FORECAST, GRID) if c in df.columns]
    return df.repartition(FORECAST).sortWithinPartitions(*order, *[F.col(f"`{c}`") for c in columns])


def mean_weather(df: DataFrame, prefix: str, lead: bool = True) -> DataFrame:
    """The light form: only the availability rule is checked; means of the numeric columns and the lead."""
    check_cutoff(df, prefix)
    return aggregate_grid(df, "ldaps", "mean", include_lead=lead, prefix=prefix, strict=False)


def quantile_grid(df: DataFrame, prefix: str, shares: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Exact quantiles over the cells: {prefix}_{column}_q25 and so on."""
    df = nan_to_null(df)
    return df.groupBy(FORECAST).agg(
        *[F.percentile(F.col(c).cast("double"), s).alias(f"{prefix}_{c}_q{round(100 * s):02d}") for c in value_columns(df) for s in shares]
    )


def axis_difference(left: DataFrame, right: DataFrame, key: str = FORECAST) -> tuple[int, int]:
    """How many keys only the left and only the right has, in one job."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    r = a.join(b, key, "full").agg(F.count_if(F.col("r").isNull()).alias("l"), F.count_if(F.col("l").isNull()).alias("r")).first()
    return r["l"], r["r"]


def merge_sources(left: DataFrame, right: DataFrame, how: str = "outer", key: str = FORECAST, check_axes: bool = False) -> DataFrame:
    """Two sources' features side by side. outer keeps all times, inner the common ones; check_axes demands equal times."""
    clash = sorted(set(left.columns) & set(right.columns) - {key})
    require(not clash, f"feature names clash: {clash}")
    if check_axes:
        only = axis_difference(left, right, key)
        require(only == (0, 0), f"forecast axes differ: {only[0]} only left, {only[1]} only right")
    return left.join(right, key, "full" if how == "outer" else how)


@dataclass(frozen=True)
class FramePair:
    """Train and test features with one schema."""

    train: DataFrame
    test: DataFrame
    columns: tuple[str, ...]


def weather_features(
    ldaps: DataFrame, gfs: DataFrame, statistics: str | Iterable[str] = ("mean",), include_lead: bool = False,
    prefixes: tuple[str, str] = ("ldaps", "gfs"), std_ddof: int = 0, strict: bool = True
) -> DataFrame:
    """Both sources' statistics over equal forecast axes, LDAPS first."""
    require(len(prefixes) == 2 and len(set(prefixes)) == 2, f"two different prefixes are needed, got {prefixes}")
    made = [
        aggregate_grid(df, s, statistics, include_lead, check_prefix(p), std_ddof, strict)
        for df, s, p in zip((ldaps, gfs), ("ldaps", "gfs"), prefixes, strict=True)
    ]
    return merge_sources(*made, how="inner", check_axes=strict)


def weather_feature_pair(ldaps: tuple[DataFrame, DataFrame], gfs: tuple[DataFrame, DataFrame], **options) -> FramePair:
    """(train, test) of each source to features with equal names in equal order, raw columns checked first."""
    for name, (train, test) in (("ldaps", ldaps), ("gfs", gfs)):
        check_columns(train, META, name)
        check_columns(test, META, name)
        check_schema_match(value_columns(train), value_columns(test), f"{name} train and test")
    train, test = (weather_features(ldaps[k], gfs[k], **options) for k in (0, 1))
    check_schema_match(train.columns, test.columns, "train and test features")
    return FramePair(train, test, tuple(c for c in train.columns if c != FORECAST))

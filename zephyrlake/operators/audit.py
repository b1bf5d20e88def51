"""Data-quality audits: missing values, labels, time axes, quantiles, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.functions.nulls import nan_to_null
from zephyrlake.functions.scalars import capacity_of, hours_between
from zephyrlake.operators.contracts import value_columns
from zephyrlake.operators.scoring import long_targets
from zephyrlake.schema import AVAILABLE, FORECAST, GRID, VALID_SHARE


def missing_by_forecast(df: DataFrame) -> DataFrame:
    """By variable: forecasts with all cells missing, and with some."""
    df = nan_to_null(df)
    columns = value_columns(df)
    long = df.select(FORECAST, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([FORECAST], columns, "variable", "value")
    by = long.groupBy("variable", FORECAST).agg(F.count("value").alias("have"), F.count("*").alias("n"))
    return by.groupBy("variable").agg(
        F.count_if(F.col("have") == 0).alias("all_missing"),
        F.count_if((F.col("have") > 0) & (F.col("have") < F.col("n"))).alias("some_missing")
    )


def weather_profile(df: DataFrame) -> DataFrame:
    """One row: rows, forecasts, periods, cells and rows of a forecast, leads, missing cells."""
    df = nan_to_null(df)
    lead = hours_between(F.col(AVAILABLE), F.col(FORECAST))
    gaps = sum((F.col(f"`{c}`").isNull().cast("long") for c in value_columns(df)), F.lit(0).cast("long"))
    rows = df.select(FORECAST, AVAILABLE, GRID, lead.alias("lead"), gaps.alias("gaps"))
    by = rows.groupBy(FORECAST).agg(
        F.count("*").alias("rows"), F.countDistinct(GRID).alias("cells"), F.min(AVAILABLE).alias("a0"), F.max(AVAILABLE).alias("a1"), F.min("lead").alias("l0"), F.max("lead").alias("l1"), F.sum("gaps").alias("gaps"), F.collect_set("lead").alias("leads")
    )
    return by.agg(
        F.sum("rows").alias("rows"), F.count("*").alias("forecast_rows"), F.min(FORECAST).alias("forecast_start"), F.max(FORECAST).alias("forecast_end"), F.min("a0").alias("available_start"), F.max("a1").alias("available_end"),
        F.min("cells").alias("grid_count_min"), F.max("cells").alias("grid_count_max"), F.min("rows").alias("rows_per_forecast_min"), F.max("rows").alias("rows_per_forecast_max"), F.min("l0").alias("lead_hour_min"), F.max("l1").alias("lead_hour_max"),
        F.size(F.array_distinct(F.flatten(F.collect_set("leads")))).cast("long").alias("lead_hour_unique"), F.sum("gaps").alias("missing_cells"),
    )


def label_profile(labels: DataFrame, time: str) -> DataFrame:
    """By target: rows, missing, negative and over-capacity rows, range, quartiles, valid rows and share, first and last time with a value."""
    rows = long_targets(labels, time, "y")
    cap, y = capacity_of(F.col("target")), F.col("y")
    have, valid = y.isNotNull(), y >= cap * F.lit(VALID_SHARE)
    q = F.percentile(y, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    by = rows.groupBy("target").agg(
        F.count("*").alias("rows"), F.count("y").alias("non_null"), F.count_if(~have).alias("missing"), F.count_if(y < 0).alias("negative"), F.count_if(y > cap).alias("over_capacity"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), q.alias("q"),
        F.count_if(valid).alias("valid_rows"), F.avg(F.when(have, valid.cast("double"))).alias("valid_share"), F.min(F.when(have, F.col(time))).alias("first_time"), F.max(F.when(have, F.col(time))).alias("last_time"),
    )
    return by.select("*", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q25", "q50", "q75"))]).drop("q")


def matrix_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: missing cells, rows with any, columns with any."""
    df = nan_to_null(df.select(*columns))
    gap = [F.col(f"`{c}`").isNull() for c in columns]
    some = gap[0]
    for g in gap[1:]:
        some = some | g
    r = df.agg(*[F.count_if(g).alias(f"n{k}") for k, g in enumerate(gap)], F.count_if(some).alias("rows_with_missing"))
    total = sum((F.col(f"n{k}") for k in range(len(gap))), F.lit(0).cast("long"))
    with_any = sum(((F.col(f"n{k}") > 0).cast("long") for k in range(len(gap))), F.lit(0).cast("long"))
    return r.select(total.alias("missing_cells"), "rows_with_missing", with_any.alias("columns_with_missing"))


def quantiles(df: DataFrame, column: str, by: list[str], shares: tuple[float, ...] = (0.01, 0.5, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*by).agg(*[F.percentile(F.col(column), s).alias(f"p{round(100 * s):02d}") for s in shares])


def correlation(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson correlation over rows with both values."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*by).agg(F.corr(a, b).alias("corr"), F.count_if(both).alias("pairs"))


def time_audit(df: DataFrame, time: str, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """One row: start, end, rows, distinct, expected, repeated and missing times."""
    span = df.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(time).alias("rows"), F.countDistinct(time).alias("distinct_times"))
    n = F.size(F.sequence("start", "end", F.expr(step))).cast("long")
    return span.select("*", n.alias("expected"), (F.col("rows") - F.col("distinct_times")).alias("repeated"), (n - F.col("distinct_times")).alias("missing"))


def missing_times(df: DataFrame, time: str, step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Times of the regular axis between first and last that no row has."""
    axis = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).select(F.explode(F.sequence("a", "b", F.expr(step))).alias(time))
    return axis.join(df.select(time).distinct(), time, "left_anti")


def dominant_interval(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """The commonest step in seconds between neighbours of a group's time axis, and how often it occurs. by keeps axes apart, so none needs a single task."""
    w = Window.partitionBy(*by).orderBy(time)
    steps = df.select(*by, F.timestamp_diff("SECOND", F.lag(time).over(w), F.col(time)).alias("seconds")).filter("seconds is not null")
    counts = steps.groupBy(*by, "seconds").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(
        F.max(F.struct("n", (-F.col("seconds")).alias("s"))).alias("x")
    ).select(*by, (-F.col("x.s")).alias("seconds"), F.col("x.n").alias("n"))


def resample(df: DataFrame, time: str, value: str, unit: str = "DAY") -> DataFrame:
    """Means by calendar unit, with a row also for units without data."""
    at = F.date_trunc(unit, F.col(time)).cast("timestamp_ntz")
    means = df.groupBy(at.alias("bucket")).agg(
        F.avg(value).alias("mean"), F.count("*").alias("rows"), F.avg(F.col(value).isNull().cast("double")).alias("missing_rate")
    )
    axis = means.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("bucket")
    )
    return axis.join(means, "bucket", "left").select("bucket", "mean", F.coalesce("rows", F.lit(0)).alias("rows"), "missing_rate")


def forward_fill(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """Gaps take the last value before them within a group. by keeps groups apart, so none needs a single task."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def flag_copies(df: DataFrame, keys: list[str], name: str = "is_copy") -> DataFrame:
    """Every row whose key occurs more than once is flagged."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)) > 1)


def every_nth(df: DataFrame, order: str, n: int, by: list[str]) -> DataFrame:
    """Rows 0, n, 2n, ... of a group's order; a systematic sample. by keeps groups apart, so none needs a single task."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_place", F.row_number().over(w) - 1).filter(F.col("_place") % n == 0).drop("_place")


def fixed_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of their key: the same rows in any layout."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def content_hash(df: DataFrame) -> DataFrame:
    """One number for a frame's rows in any order."""
    return df.agg(F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")).alias("content_hash"), F.count("*").alias("rows"))


def distinct_text(c: Column, sep: str = ", ") -> Column:
    """An aggregate: distinct values, sorted, in one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def columns_equal(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each pair of columns whether all rows agree, missing values agreeing with each other."""
    r = df.agg(*[F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(True)).alias(f"e{k}") for k, (a, b) in enumerate(pairs)])
    return r.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"e{k}").alias("equal")) for k, (a, b) in enumerate(pairs)])
        ).alias("x")
    ).select("x.*")


def schema_audit(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """(column, dtype, missing, role) of each column."""
    r = nan_to_null(df).agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{k}").alias("missing"),
            F.lit((roles or {}).get(f.name, "value")).alias("role")
        )
        for k, f in enumerate(df.schema)
    ]
    return r.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def missing_rate(df: DataFrame, columns: list[str], by: Column, name: str) -> DataFrame:
    """By group the plain mean of the columns' missing rates."""
    rates = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in columns]
    return df.groupBy(by.alias(name)).agg((sum(rates[1:], rates[0]) / len(rates)).alias("missing_rate"))


def missing_cells(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, variable, missing) where any are missing."""
    long = nan_to_null(df.select(by, *columns)).select(
        by, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    ).unpivot([by], columns, "variable", "value")
    return long.groupBy(by, "variable").agg(F.count_if(F.col("value").isNull()).alias("missing")).filter("missing > 0")


def power_curve(df: DataFrame, speed: str, power: str, width: float = 0.5) -> DataFrame:
    """Mean and spread of power by bin of wind speed."""
    bin_ = (F.floor(F.col(speed) / width) * width).alias("speed_bin")
    return df.filter(F.col(speed).isNotNull() & F.col(power).isNotNull()).groupBy(bin_).agg(
        F.avg(power).alias("power_mean"), F.stddev_pop(power).alias("power_std"), F.count("*").alias("rows")
    )


def null_out(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values outside [low, high] become missing and their rows go."""
    return df.withColumn(column, F.when(F.col(column).between(low, high), F.col(column))).filter(F.col(column).isNotNull())


def column_inventory(df: DataFrame) -> DataFrame:
    """(column_name, dtype, missing, distinct_values) of each column: the template of a column inventory, in one pass."""
    df = nan_to_null(df)
    r = df.agg(
        *[x for k, c in enumerate(df.columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{k}"))]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{k}").alias("missing"),
            F.col(f"d{k}").alias("distinct_values")
        )
        for k, f in enumerate(df.schema)
    ]
    return r.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def file_inventory(df: DataFrame, name: str, time: str, keys: list[str]) -> DataFrame:
    """(name, rows, columns, first_time, last_time, keys, copies): a table's line in a file inventory."""
    r = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    return r.agg(
        F.lit(name).alias("name"), F.sum("n").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.min("a").alias("first_time"),
        F.max("b").alias("last_time"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("copies")
    )

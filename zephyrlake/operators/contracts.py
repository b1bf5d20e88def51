"""Fail-closed contracts. A check runs one action, raises on the driver, and returns the lazy frame."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.functions.nulls import finite
from zephyrlake.functions.scalars import hours_between
from zephyrlake.schema import AVAILABLE, FORECAST, GRID, GRID_CELLS, LAT, LEAD_HOURS, LON, META, STATISTICS


class ContractError(ValueError):
    """A contract doesn't hold."""


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ContractError(message)


def check_source(source: str) -> str:
    require(source in GRID_CELLS, f"source must be one of {sorted(GRID_CELLS)}, got {source!r}")
    return source


def check_prefix(prefix: str) -> str:
    require(isinstance(prefix, str) and re.fullmatch(r"[a-z][a-z0-9_]*", prefix) is not None, f"prefix {prefix!r} doesn't fit [a-z][a-z0-9_]*")
    return prefix


def check_statistics(statistics: str | Iterable[str], ddof: int) -> tuple[str, ...]:
    """The statistics in their fixed order."""
    wanted = [statistics] if isinstance(statistics, str) else list(statistics)
    require(bool(wanted), "statistics are empty")
    require(len(set(wanted)) == len(wanted), f"statistics repeat: {wanted}")
    require(set(wanted) <= set(STATISTICS), f"statistics must be among {STATISTICS}, got {wanted}")
    require(isinstance(ddof, int) and not isinstance(ddof, bool) and ddof >= 0, f"std_ddof must be an integer of 0 or more, got {ddof!r}")
    return tuple(s for s in STATISTICS if s in wanted)


def check_number(value: float, name: str, over: float | None = None, least: float | None = None) -> float:
    require(isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value), f"{name} must be a finite number, got {value!r}")
    require(over is None or value > over, f"{name} must be over {over}, got {value!r}")
    require(least is None or value >= least, f"{name} must be {least} or more, got {value!r}")
    return float(value)


def check_columns(df: DataFrame, needed: Sequence[str], name: str = "frame") -> None:
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} must be a DataFrame, got {type(df).__name__}")
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    require(not twice, f"{name} has columns twice: {twice}")
    missing = [c for c in needed if c not in df.columns]
    require(not missing, f"{name} lacks columns {missing}")


def value_columns(df: DataFrame) -> list[str]:
    """Numeric columns besides the metadata, in the frame's order; booleans don't count."""
    columns = [f.name for f in df.schema if f.name not in META and isinstance(f.dataType, T.NumericType)]
    require(bool(columns), "no numeric value column")
    return columns


def check_cutoff(df: DataFrame, name: str = "frame", day_ahead: bool = False) -> DataFrame:
    """Only the availability rule: available no later than forecast; with day_ahead no later than 14:00 of the day before."""
    check_columns(df, META, name)
    limit = F.col(FORECAST) if not day_ahead else (F.date_trunc("DAY", F.col(FORECAST)) - F.expr("INTERVAL 10 HOURS")).cast("timestamp_ntz")
    late = df.filter(F.col(AVAILABLE) > limit).count()
    require(late == 0, f"{name}: cutoff violated, {late} rows become available after their forecast time")
    return df


def audit(df: DataFrame, source: str) -> dict[str, int]:
    """All counts of the grid contract in one job: nulls by column, cutoff, leads, cells, repeats."""
    cells = GRID_CELLS[check_source(source)]
    lead = hours_between(F.col(AVAILABLE), F.col(FORECAST))
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in META]
    by_time = df.groupBy(FORECAST).agg(
        F.count("*").alias("rows"),
        F.countDistinct(GRID).alias("cells"),
        F.min(lead).alias("lead_min"),
        F.max(lead).alias("lead_max"),
        F.sum((F.col(AVAILABLE) > F.col(FORECAST)).cast("long")).alias("late"),
        *nulls,
    )
    total = by_time.agg(
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).cast("long").alias(f"null_{c}") for c in META],
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"),
        F.count("*").alias("forecasts"),
        F.coalesce(F.sum("late"), F.lit(0)).cast("long").alias("late_rows"),
        F.count_if(F.col("lead_min") < F.col("lead_max")).alias("mixed_leads"),
        F.count_if((F.col("lead_min") < LEAD_HOURS[0]) | (F.col("lead_max") > LEAD_HOURS[1])).alias("leads_out_of_range"),
        F.count_if((F.col("rows") != cells) | (F.col("cells") != cells)).alias("wrong_cells"),
        F.count_if(F.col("rows") > F.col("cells")).alias("repeated_cells"),
    )
    return total.first().asDict()


def check_grid(df: DataFrame, source: str) -> DataFrame:
    """The strict contract of a gridded forecast, in its order: metadata, nulls, cutoff, one lead, lead range, cells, repeats."""
    check_source(source)
    check_columns(df, META, source)
    value_columns(df)
    for c in (FORECAST, AVAILABLE):
        require(isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.TimestampType)), f"{source}: {c} is no timestamp")
    found = audit(df, source)
    require(found["rows"] > 0, f"{source}: no rows")
    nulls = {c: found[f"null_{c}"] for c in META if found[f"null_{c}"]}
    require(not nulls, f"{source}: metadata is missing: {nulls}")
    require(not found["late_rows"], f"{source}: cutoff violated, {found['late_rows']} rows become available after their forecast time")
    require(not found["mixed_leads"], f"{source}: {found['mixed_leads']} forecasts have several leads")
    require(not found["leads_out_of_range"], f"{source}: {found['leads_out_of_range']} forecasts have a lead outside {LEAD_HOURS} hours")
    require(not found["wrong_cells"], f"{source}: {found['wrong_cells']} forecasts don't have {GRID_CELLS[source]} distinct cells")
    require(not found["repeated_cells"], f"{source}: {found['repeated_cells']} forecasts repeat a cell")
    return df


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def check_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    n = repeated_keys(df, keys).count()
    require(n == 0, f"{name}: {n} values of {list(keys)} repeat")
    return df


def check_schema_match(left: Sequence[str], right: Sequence[str], what: str) -> None:
    require(
        list(left) == list(right),
        f"{what}: names or order differ; only left {[c for c in left if c not in right]}, only right {[c for c in right if c not in left]}"
    )


def check_turbines(turbines: DataFrame) -> DataFrame:
    check_columns(turbines, ("turbine_id", "group_id", LAT, LON, "capacity_mw"), "turbines")
    for c in (LAT, LON, "capacity_mw"):
        require(isinstance(turbines.schema[c].dataType, T.NumericType), f"turbines: {c} must be numeric")
    cap, lat, lon = (F.col(c).cast("double") for c in ("capacity_mw", LAT, LON))
    r = turbines.agg(
        F.count("*").alias("n"),
        F.countDistinct("turbine_id").alias("ids"),
        F.count_if(F.coalesce(F.trim("turbine_id"), F.lit("")) == "").alias("blank"),
        F.count_if(~F.coalesce(F.col("group_id").rlike("^group_[1-9][0-9]*$"), F.lit(False))).alias("groups"),
        F.count_if(~finite(lat) | ~finite(lon) | (F.abs(lat) > 90) | (F.abs(lon) > 180)).alias("places"),
        F.count_if(~finite(cap) | (cap <= 0)).alias("capacities"),
    ).first()
    require(r["n"] > 0, "turbines: no rows")
    require(r["blank"] == 0, f"turbines: {r['blank']} blank ids")
    require(r["ids"] == r["n"], "turbines: ids repeat")
    require(r["groups"] == 0, f"turbines: {r['groups']} group ids don't fit group_n")
    require(r["places"] == 0, f"turbines: {r['places']} coordinates are missing or out of range")
    require(r["capacities"] == 0, f"turbines: {r['capacities']} capacities aren't finite and over 0")
    return turbines

"""Scalar expressions: calendar, geometry, prices, texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrlake.schema import CAPACITY, EARTH_KM, TIGHT_ERROR, TIGHT_PRICE, WIDE_ERROR, WIDE_PRICE


def hours_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / F.lit(3600.0)


def calendar(ts: Column) -> dict[str, Column]:
    """month, day, hour, dayofweek (Monday 0), is_weekend and the circular forms of hour and month."""
    hour, month = F.hour(ts), F.month(ts)
    turn = 2 * math.pi
    return {
        "month": month,
        "day": F.dayofmonth(ts),
        "hour": hour,
        "dayofweek": F.weekday(ts),
        "is_weekend": F.weekday(ts).isin(5, 6).cast("int"),
        "hour_sin": F.sin(F.lit(turn) * hour / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(turn) * hour / F.lit(24.0)),
        "month_sin": F.sin(F.lit(turn) * month / F.lit(12.0)),
        "month_cos": F.cos(F.lit(turn) * month / F.lit(12.0)),
    }


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def capacity_of(target: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CAPACITY.items() for x in kv])[target]


def unit_price(error: Column, tight: float = TIGHT_ERROR, wide: float = WIDE_ERROR) -> Column:
    """4 up to the tight error, 3 up to the wide one, else (also for a missing error) 0."""
    return F.when(error <= tight, TIGHT_PRICE).when(error <= wide, WIDE_PRICE).otherwise(0.0)


_DMS = r"""^\s*([NSEW])?\s*(\d+(?:\.\d+)?)\s*[°d]\s*(?:(\d+(?:\.\d+)?)\s*['′m]\s*)?(?:(\d+(?:\.\d+)?)\s*(?:"|″|''|s)\s*)?([NSEW])?\s*$"""


def dms(text: Column, strict: bool = False) -> Column:
    """Degrees of a coordinate such as 37°15'30"N; S and W are negative. A text of another form gives NULL, or an error where strict."""
    part = lambda g: F.coalesce(F.regexp_extract(text, _DMS, g).try_cast("double"), F.lit(0.0))
    value = part(2) + part(3) / 60 + part(4) / 3600
    side = F.concat(F.regexp_extract(text, _DMS, 1), F.regexp_extract(text, _DMS, 5))
    good = text.rlike(_DMS)
    wrong = F.raise_error(F.concat(F.lit("not a coordinate: "), text)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(good, F.when(side.rlike("[SW]"), -value).otherwise(value)).otherwise(F.when(text.isNotNull(), wrong))


def slug(text: Column) -> Column:
    """Other characters than letters, digits, _ . and - become -, trimmed; NULL where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", "")
    return F.when(s != "", s)


def unit_id(vendor: Column, number: Column) -> Column:
    """VENDOR-01."""
    return F.concat(F.upper(F.trim(vendor)), F.lit("-"), F.lpad(number.cast("int").cast("string"), 2, "0"))


def period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def submission_name(experiment: Column, day: Column, commit: Column) -> Column:
    """submission_{YYYYMMDD}_{slug}_{first seven of the commit}.csv"""
    return F.concat(
        F.lit("submission_"), F.date_format(day, "yyyyMMdd"), F.lit("_"), slug(experiment), F.lit("_"),
        F.coalesce(F.substring(F.nullif(commit, F.lit("")), 1, 7), F.lit("unknown")), F.lit(".csv")
    )


def run_name(experiment: Column, created: Column, config_sha: Column, commit: Column) -> Column:
    """{YYYYmmddTHHMMSS}-{slug}-{eight of the configuration's hash}-{seven of the commit}"""
    at = F.concat(F.date_format(created, "yyyyMMdd"), F.lit("T"), F.date_format(created, "HHmmss"))
    return F.concat_ws("-", at, slug(experiment), F.substring(config_sha, 1, 8), F.substring(F.coalesce(commit, F.lit("unknown")), 1, 7))


# --- wind and power: shear, density, circular direction ---


def shear_exponent(v_low: Column, v_high: Column, z_low: float, z_high: float, low: float = -0.2, high: float = 0.6) -> Column:
    """Exponent of the power law between two heights, within bounds; NULL where a speed isn't over 0."""
    a = F.when((v_low > 0) & (v_high > 0), F.log(v_high / v_low) / F.lit(math.log(z_high / z_low)))
    return F.when(a.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), a)))


def at_height(v: Column, exponent: Column, z: float, hub: float = 117.0) -> Column:
    return v * F.pow(F.lit(hub / z), exponent)


def air_density(pressure_pa: Column, kelvin: Column) -> Column:
    return F.when(kelvin > 0, pressure_pa / (F.lit(287.05) * kelvin))


def power_density(density: Column, v: Column) -> Column:
    return F.lit(0.5) * density * v * v * v


def circular_degrees(mean_sin: Column, mean_cos: Column) -> Column:
    """Direction in [0, 360) of mean sine and cosine."""
    d = F.degrees(F.atan2(mean_sin, mean_cos))
    return F.when(d < 0, d + 360.0).otherwise(d)


def direction_bin(degrees: Column, bins: int = 16) -> Column:
    width = 360.0 / bins
    return F.pmod(F.floor((degrees + width / 2) / width).cast("int"), F.lit(bins))


def speed_powers(v: Column) -> dict[str, Column]:
    """Squared and cubed speed."""
    return {"v2": v * v, "v3": v * v * v}


#: Cut-in, rated and cut-out speed in m/s of the turbines of each group.
POWER_SPEEDS = {"group_1": (3.0, 12.0, 22.5), "group_2": (3.0, 12.0, 22.5), "group_3": (3.0, 12.5, 22.0)}


def speed_margins(v: Column, group: str) -> dict[str, Column]:
    """How far a speed is over cut-in, over rated, and under cut-out; and whether turbines stand still for either."""
    low, rated, high = POWER_SPEEDS[group]
    return {"cut_in_margin": v - low, "rated_margin": v - rated, "cut_out_margin": high - v, "stands_still": (v < low) | (v >= high)}

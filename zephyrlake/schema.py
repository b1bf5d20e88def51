"""Names, constants and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

FORECAST, AVAILABLE, GRID, LAT, LON = "forecast_kst_dtm", "data_available_kst_dtm", "grid_id", "latitude", "longitude"
META = (FORECAST, AVAILABLE, GRID, LAT, LON)
LABEL_TIME = "kst_dtm"

#: Targets and capacities (kWh in an hour), cells of a forecast by source, lead times in hours.
TARGETS = ("kpx_group_1", "kpx_group_2", "kpx_group_3")
CAPACITY = {"kpx_group_1": 21600.0, "kpx_group_2": 21600.0, "kpx_group_3": 21000.0}
GRID_CELLS = {"ldaps": 16, "gfs": 9}
LEAD_HOURS = (12.0, 35.0)
STATISTICS = ("mean", "std", "min", "max")
EARTH_KM = 6371.0088
CALM_SPEED = 1e-6
VALID_SHARE, TIGHT_ERROR, WIDE_ERROR, TIGHT_PRICE, WIDE_PRICE = 0.10, 0.06, 0.08, 4.0, 3.0
SUBMISSION_ROWS = 8760
SUBMISSION_COLUMNS = ("forecast_id", FORECAST, *TARGETS)

#: Component columns of the wind vectors by source: name, u, v.
WIND_PAIRS = {
    "ldaps": (("10m", "heightAboveGround_10_10u", "heightAboveGround_10_10v"),),
    "gfs": (
        ("10m", "heightAboveGround_10_10u", "heightAboveGround_10_10v"),
        ("80m", "heightAboveGround_80_u", "heightAboveGround_80_v"),
        ("100m", "heightAboveGround_100_100u", "heightAboveGround_100_100v"),
    ),
}

LABELS = T.StructType([T.StructField(LABEL_TIME, T.TimestampNTZType()), *[T.StructField(t, T.DoubleType()) for t in TARGETS]])
SUBMISSION = T.StructType(
    [T.StructField("forecast_id", T.StringType()), T.StructField(FORECAST, T.StringType()), *[T.StructField(t, T.DoubleType()) for t in TARGETS]]
)
TURBINES = T.StructType(
    [
        T.StructField("turbine_id", T.StringType()), T.StructField("group_id", T.StringType()), T.StructField(LAT, T.DoubleType()),
        T.StructField(LON, T.DoubleType()), T.StructField("capacity_mw", T.DoubleType())
    ]
)


def weather(values: list[str], grid: T.DataType | None = None) -> T.StructType:
    """The schema of a gridded forecast with these value columns."""
    head = [
        T.StructField(FORECAST, T.TimestampNTZType()), T.StructField(AVAILABLE, T.TimestampNTZType()),
        T.StructField(GRID, grid or T.LongType()), T.StructField(LAT, T.DoubleType()), T.StructField(LON, T.DoubleType())
    ]
    return T.StructType([*head, *[T.StructField(v, T.DoubleType()) for v in values]])

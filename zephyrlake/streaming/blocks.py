"""Forecast blocks that arrive as files: a stream of statistics, one row for each forecast time once its block is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.functions.nulls import nan_to_null
from zephyrlake.operators.contracts import check_source, value_columns
from zephyrlake.schema import AVAILABLE, FORECAST, GRID, GRID_CELLS, LEAD_HOURS


def grid_stream(spark: SparkSession, path: str, schema: T.StructType, source: str, delay: str = "24 hours", files: int | None = None) -> DataFrame:
    """Means and row counts by forecast time of a folder of parquet files, with a watermark on the forecast time.

    Rows that break the availability rule or the lead range are left out of the means and counted. The event time is cast to a
    zoned timestamp (session time zone), as watermarks need one.
    """
    check_source(source)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = nan_to_null(reader.parquet(path))
    columns = value_columns(rows)
    rows = rows.withColumn("event_time", F.col(FORECAST).cast("timestamp")).withWatermark("event_time", delay)
    lead = F.timestamp_diff("SECOND", F.col(AVAILABLE), F.col(FORECAST)) / F.lit(3600.0)
    good = (lead >= LEAD_HOURS[0]) & (lead <= LEAD_HOURS[1])
    means = [F.avg(F.when(good, F.col(f"`{c}`").cast("double"))).alias(f"{source}_{c}_mean") for c in columns]
    by = rows.groupBy(F.window("event_time", "1 hour").alias("hour"))
    out = by.agg(*means, F.count("*").alias("rows"), F.count_if(~good).alias("late_rows"), F.approx_count_distinct(GRID).alias("cells"))
    return out.select(F.col("hour.start").alias(FORECAST), *[c for c in out.columns if c != "hour"], (F.col("rows") == GRID_CELLS[source]).alias("complete"))

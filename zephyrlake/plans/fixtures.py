"""The model's tables derived from the test tables, by the same rules in Spark and in SQL.

events become a gridded forecast of n cells: event_id counts through cells and hours. Labels, predictions
and turbines follow from it. Values are invented; shapes and gaps are those of real forecasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zephyrlake.schema import CAPACITY, TARGETS, TURBINES

#: id, group, latitude, longitude, capacity in MW.
TURBINE_ROWS = [
    (f"g{1 + (k > 5) + (k > 11)}_{k:02d}", f"group_{1 + (k > 5) + (k > 11)}", 37.0 + 0.003 * k, 128.9 + 0.0025 * ((k * 7) % 17), 3.6 if k < 12 else 4.2)
    for k in range(17)
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str, n: int = 16) -> DataFrame:
    """Forecast rows with value columns u, v (components) and t; u is missing in some cells, and everywhere in hour 5."""
    return spark.sql(
        f"""
        WITH e AS (SELECT *, event_id div {n} AS f, event_id % {n} AS g FROM {{events}})
        SELECT timestamp_ntz'2024-01-01 01:00:00' + make_dt_interval(0, int(f)) AS forecast_kst_dtm,
          timestamp_ntz'2024-01-01 01:00:00' + make_dt_interval(0, int(f - 12 - f % 24)) AS data_available_kst_dtm,
          g AS grid_id, 37.0D + 0.015D * (g div 4) AS latitude, 128.9D + 0.015D * (g % 4) AS longitude,
          CASE WHEN event_id % 97 = 0 OR f = 5 THEN NULL ELSE value / 10D - 4D END AS u, (user_id % 50) / 5D - 5D AS v, value + (g % 3) AS t
        FROM e WHERE f < (SELECT count(*) div {n} FROM {{events}})
        """,
        events=table(spark, sf_dir, "events"),
    )


def grid_sql(n: int = 16, name: str = "grid") -> str:
    return f"""{name}_e AS (SELECT *, event_id // {n} AS f, event_id % {n} AS g FROM events),
{name} AS (
  SELECT TIMESTAMP '2024-01-01 01:00:00' + to_hours(f) AS forecast_kst_dtm, TIMESTAMP '2024-01-01 01:00:00' + to_hours(f - 12 - f % 24) AS data_available_kst_dtm,
    g AS grid_id, 37.0e0 + 0.015e0 * (g // 4) AS latitude, 128.9e0 + 0.015e0 * (g % 4) AS longitude,
    CASE WHEN event_id % 97 = 0 OR f = 5 THEN NULL ELSE value / 10e0 - 4e0 END AS u, (user_id % 50) / 5e0 - 5e0 AS v, value + (g % 3) AS t
  FROM {name}_e WHERE f < (SELECT count(*) // {n} FROM events))"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kst_dtm and three targets within 2 % over capacity; the third is missing in the first third of the hours."""
    y = ", ".join(
        f"CASE WHEN {k} = 3 AND f * 3 < max(f) OVER () THEN NULL ELSE {CAPACITY[t] * 1.02}D * ((s * {k}) % 1000) / 999D END AS {t}"
        for k, t in enumerate(TARGETS, 1)
    )
    return spark.sql(
        f"""
        WITH h AS (SELECT event_id div 16 AS f, sum(cast(floor(value * 100) AS bigint)) AS s FROM {{events}} GROUP BY 1)
        SELECT timestamp_ntz'2024-01-01 01:00:00' + make_dt_interval(0, int(f)) AS kst_dtm, {y}, f FROM h
        """.replace("max(f) OVER ()", "(SELECT max(f) FROM h)"),
        events=table(spark, sf_dir, "events"),
    )


def labels_sql() -> str:
    y = ", ".join(
        f"CASE WHEN {k} = 3 AND f * 3 < (SELECT max(f) FROM hourly) THEN NULL ELSE {CAPACITY[t] * 1.02}e0 * ((s * {k}) % 1000) / 999e0 END AS {t}"
        for k, t in enumerate(TARGETS, 1)
    )
    return f"""hourly AS (SELECT event_id // 16 AS f, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1),
labels AS (SELECT TIMESTAMP '2024-01-01 01:00:00' + to_hours(f) AS kst_dtm, {y}, f FROM hourly)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels off by -10 to +10 %; 500 where a label is missing."""
    y = ", ".join(f"coalesce({t} * (0.9D + (f % 21) / 100D), 500D) AS {t}" for t in TARGETS)
    return spark.sql(f"SELECT kst_dtm, {y} FROM {{labels}}", labels=labels(spark, sf_dir))


def predictions_sql() -> str:
    y = ", ".join(f"coalesce({t} * (0.9e0 + (f % 21) / 100e0), 500e0) AS {t}" for t in TARGETS)
    return f"predictions AS (SELECT kst_dtm, {y} FROM labels)"


def long_sql() -> str:
    """pairs: (kst_dtm, target, actual, forecast, cap)."""
    rows = " UNION ALL ".join(f"SELECT kst_dtm, '{t}' AS target, {{}}.{t} AS y, {CAPACITY[t]}e0 AS cap FROM {{}}" for t in TARGETS)
    a, p = rows.format(*["labels"] * 6), rows.format(*["predictions"] * 6)
    return f"pairs AS (SELECT a.kst_dtm, a.target, a.y AS actual, p.y AS forecast, a.cap FROM ({a}) a LEFT JOIN ({p}) p USING (kst_dtm, target))"


def turbines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TURBINE_ROWS, TURBINES)


def turbines_sql() -> str:
    rows = ", ".join(f"('{i}', '{g}', {a!r}e0, {o!r}e0, {c!r}e0)" for i, g, a, o, c in TURBINE_ROWS)
    return f"turbines(turbine_id, group_id, latitude, longitude, capacity_mw) AS (VALUES {rows})"

"""Named queries, each with the SQL that gives the same rows.

Doubles are rounded to nine places and counts are BIGINT on both sides; missing values are NULL.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.functions import scalars
from zephyrlake.functions.nulls import clip
from zephyrlake.operators import audit, baseline, contracts, grid, impute, pooling, scoring, wind
from zephyrlake.plans import fixtures as fx
from zephyrlake.plans.catalog import ORACLE, QUERIES, query, r
from zephyrlake.plans.submission import violations
from zephyrlake.schema import AVAILABLE, CAPACITY, FORECAST, GRID, TARGETS

G16, G9, LAB = f"WITH {fx.grid_sql(16)}", f"WITH {fx.grid_sql(9)}", f"WITH {fx.labels_sql()}"
PAIRS = f"WITH {fx.labels_sql()}, {fx.predictions_sql()}, {fx.long_sql()}"
WGRID = f"WITH {fx.grid_sql(16)}, {fx.turbines_sql()}"
LEAD_SQL = "date_diff('second', data_available_kst_dtm, forecast_kst_dtm) / 3600e0"
PAIR = (wind.WindPair("10m", "u", "v"),)


def pairs(s: SparkSession, d: str) -> DataFrame:
    return scoring.pair_up(fx.labels(s, d), fx.predictions(s, d), "kst_dtm")


# --- grid statistics ---


@query(
    "grid_mean",
    G16 + f" SELECT forecast_kst_dtm, {r('avg(u)')} AS ldaps_u_mean, {r('avg(v)')} AS ldaps_v_mean, {r('avg(t)')} AS ldaps_t_mean FROM grid GROUP BY 1"
)
def _(s, d):
    return grid.aggregate_grid(fx.grid(s, d), "ldaps", strict=False)


_ALL4 = ", ".join(f"{r(f'{f}({c})')} AS ldaps_{c}_{n}" for c in "uvt" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("grid_stats", G16 + f" SELECT forecast_kst_dtm, {_ALL4} FROM grid GROUP BY 1")
def _(s, d):
    return grid.aggregate_grid(fx.grid(s, d), "ldaps", ("max", "min", "std", "mean"), strict=False)


@query("grid_stats_lead", G16 + f" SELECT forecast_kst_dtm, {_ALL4}, {r(f'min({LEAD_SQL})')} AS ldaps_lead_hour FROM grid GROUP BY 1")
def _(s, d):
    return grid.aggregate_grid(fx.grid(s, d), "ldaps", ("mean", "std", "min", "max"), include_lead=True)


@query(
    "grid_stats_ddof1",
    G9 + f" SELECT forecast_kst_dtm, {r('stddev_samp(u)')} AS gfs_u_std, {r('stddev_samp(v)')} AS gfs_v_std, {r('stddev_samp(t)')} AS gfs_t_std FROM grid GROUP BY 1"
)
def _(s, d):
    return grid.aggregate_grid(fx.grid(s, d, 9), "gfs", "std", std_ddof=1, strict=False)


@query(
    "grid_quantiles",
    G16 + f" SELECT forecast_kst_dtm, {', '.join(f'{r(f"quantile_cont({c}, {q})")} AS ldaps_{c}_q{n}' for c in 'uvt' for q, n in ((0.25, 25), (0.75, 75)))} FROM grid GROUP BY 1"
)
def _(s, d):
    return grid.quantile_grid(fx.grid(s, d), "ldaps")


@query(
    "lead_audit",
    G16 + f", l AS (SELECT forecast_kst_dtm, min({LEAD_SQL}) AS a, max({LEAD_SQL}) AS b FROM grid GROUP BY 1) SELECT {r('a')} AS lead_hour, count(*) AS forecasts, count(*) FILTER (a < b) AS mixed FROM l GROUP BY 1"
)
def _(s, d):
    lead = scalars.hours_between(F.col(AVAILABLE), F.col(FORECAST))
    by = fx.grid(s, d).groupBy(FORECAST).agg(F.min(lead).alias("a"), F.max(lead).alias("b"))
    return by.groupBy(F.round("a", 9).alias("lead_hour")).agg(F.count("*").alias("forecasts"), F.count_if(F.col("a") < F.col("b")).alias("mixed"))


_BROKEN = ", broken AS (SELECT * FROM grid WHERE NOT (grid_id = 3 AND extract('hour' FROM forecast_kst_dtm) = 7))"


@query(
    "contract_audit",
    G16 + _BROKEN + f""", f AS (SELECT forecast_kst_dtm, count(*) AS n, count(DISTINCT grid_id) AS cells, min({LEAD_SQL}) AS a, max({LEAD_SQL}) AS b, count(*) FILTER (data_available_kst_dtm > forecast_kst_dtm) AS late FROM broken GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS forecasts, CAST(sum(late) AS BIGINT) AS late_rows, count(*) FILTER (a < b) AS mixed_leads, count(*) FILTER (a < 12 OR b > 35) AS leads_out_of_range, count(*) FILTER (n <> 16 OR cells <> 16) AS wrong_cells, count(*) FILTER (n > cells) AS repeated_cells FROM f""",
)
def _(s, d):
    found = contracts.audit(fx.grid(s, d).filter(~((F.col(GRID) == 3) & (F.hour(FORECAST) == 7))), "ldaps")
    names = ["rows", "forecasts", "late_rows", "mixed_leads", "leads_out_of_range", "wrong_cells", "repeated_cells"]
    return s.createDataFrame([tuple(int(found[n]) for n in names)], ", ".join(f"{n} long" for n in names))


@query(
    "allgrid_missing",
    G16 + ", f AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, forecast_kst_dtm, count({c}) AS have, count(*) AS n FROM grid GROUP BY 2"
        for c in "uvt"
    ) + ") SELECT variable, count(*) FILTER (have = 0) AS all_missing, count(*) FILTER (have > 0 AND have < n) AS some_missing FROM f GROUP BY 1"
)
def _(s, d):
    return audit.missing_by_forecast(fx.grid(s, d))


# --- wind ---

_WIND = ", w AS (SELECT *, sqrt(u*u + v*v) AS speed, CASE WHEN sqrt(u*u + v*v) > 1e-6 THEN -u / sqrt(u*u + v*v) END AS from_sin, CASE WHEN sqrt(u*u + v*v) > 1e-6 THEN -v / sqrt(u*u + v*v) END AS from_cos FROM grid)"


@query(
    "wind_vector",
    G16 + _WIND + f" SELECT forecast_kst_dtm, grid_id, {r('speed')} AS windvec_10m_speed, {r('from_sin')} AS windvec_10m_from_sin, {r('from_cos')} AS windvec_10m_from_cos FROM w"
)
def _(s, d):
    return wind.wind_vectors(fx.grid(s, d), "ldaps", PAIR).select(FORECAST, GRID, *PAIR[0].outputs)


@query(
    "wind_vector_stats",
    G16 + _WIND + f" SELECT forecast_kst_dtm, {r('avg(speed)')} AS speed_mean, {r('stddev_pop(speed)')} AS speed_std, {r('avg(from_sin)')} AS from_sin_mean, {r('avg(from_cos)')} AS from_cos_mean FROM w GROUP BY 1"
)
def _(s, d):
    made = grid.aggregate_grid(wind.wind_vectors(fx.grid(s, d), "ldaps", PAIR, strict=False), "ldaps", ("mean", "std"), strict=False)
    p = "ldaps_windvec_10m_"
    return made.select(
        FORECAST, F.col(f"{p}speed_mean").alias("speed_mean"), F.col(f"{p}speed_std").alias("speed_std"),
        F.col(f"{p}from_sin_mean").alias("from_sin_mean"), F.col(f"{p}from_cos_mean").alias("from_cos_mean")
    )


@query(
    "wind_resultant",
    G16 + _WIND + f" SELECT forecast_kst_dtm, {r('sqrt(avg(from_sin) * avg(from_sin) + avg(from_cos) * avg(from_cos))')} AS resultant FROM w GROUP BY 1"
)
def _(s, d):
    return wind.resultant_length(wind.wind_vectors(fx.grid(s, d), "ldaps", PAIR, strict=False), [FORECAST], PAIR[0].outputs[1], PAIR[0].outputs[2])


@query("wind_unit_norm", G16 + _WIND + " SELECT max(abs(sqrt(from_sin*from_sin + from_cos*from_cos) - 1e0)) < 1e-12 AS unit FROM w")
def _(s, d):
    return wind.unit_norm_error(
        wind.wind_vectors(fx.grid(s, d), "ldaps", PAIR, strict=False), *PAIR[0].outputs[1:]
    ).select((F.col("worst") < 1e-12).alias("unit"))


@query(
    "wind_direction_bins",
    G16 + _WIND + ", m AS (SELECT forecast_kst_dtm, degrees(atan2(avg(from_sin), avg(from_cos))) AS a FROM w GROUP BY 1), b AS (SELECT CASE WHEN a < 0 THEN a + 360e0 ELSE a END AS deg FROM m) SELECT CAST(floor((deg + 11.25e0) / 22.5e0) AS BIGINT) % 16 AS bin, count(*) AS forecasts FROM b GROUP BY 1"
)
def _(s, d):
    w = wind.wind_vectors(fx.grid(s, d), "ldaps", PAIR, strict=False).groupBy(FORECAST).agg(
        F.avg(PAIR[0].outputs[1]).alias("a"), F.avg(PAIR[0].outputs[2]).alias("b")
    )
    return w.groupBy(scalars.direction_bin(scalars.circular_degrees(F.col("a"), F.col("b"))).alias("bin")).agg(F.count("*").alias("forecasts"))


@query(
    "hub_height",
    G16 + ", x AS (SELECT forecast_kst_dtm, grid_id, t, t * 1.1e0 + 0.5e0 AS hi FROM grid WHERE t > 0), y AS (SELECT *, greatest(-0.2e0, least(0.6e0, ln(hi / t) / ln(10e0))) AS a FROM x) SELECT forecast_kst_dtm, grid_id, " + r("a") + " AS alpha, " + r("hi * pow(1.17e0, a)") + " AS hub_speed, " + "round(0.5e0 * (101325e0 / (287.05e0 * 288.15e0)) * t * t * t, 3) + 0e0" + " AS power_density FROM y"
)
def _(s, d):
    x = fx.grid(s, d).filter("t > 0").withColumn("hi", F.col("t") * 1.1 + 0.5).withColumn("a", scalars.shear_exponent(F.col("t"), F.col("hi"), 10.0, 100.0))
    density = scalars.air_density(F.lit(101325.0), F.lit(288.15))
    return x.select(
        FORECAST, GRID, F.col("a").alias("alpha"), scalars.at_height(F.col("hi"), F.col("a"), 100.0, 117.0).alias("hub_speed"),
        F.round(scalars.power_density(density, F.col("t")), 3).alias("power_density")
    )


# --- calendar and assembly ---


@query(
    "calendar",
    LAB + f" SELECT kst_dtm, month(kst_dtm) AS month, day(kst_dtm) AS day, hour(kst_dtm) AS hour, isodow(kst_dtm) - 1 AS dayofweek, CASE WHEN isodow(kst_dtm) >= 6 THEN CAST(1 AS BIGINT) ELSE 0 END AS is_weekend, {r('sin(2*pi()*hour(kst_dtm)/24e0)')} AS hour_sin, {r('cos(2*pi()*hour(kst_dtm)/24e0)')} AS hour_cos, {r('sin(2*pi()*month(kst_dtm)/12e0)')} AS month_sin, {r('cos(2*pi()*month(kst_dtm)/12e0)')} AS month_cos FROM labels"
)
def _(s, d):
    return baseline.add_calendar(fx.labels(s, d).select("kst_dtm"), "kst_dtm")


_TWO = f"WITH {fx.grid_sql(16, 'ga')}, {fx.grid_sql(9, 'gb')}, a AS (SELECT forecast_kst_dtm, avg(t) AS x, avg({LEAD_SQL}) AS l FROM ga GROUP BY 1), b AS (SELECT forecast_kst_dtm, avg(t) AS y FROM gb GROUP BY 1)"


def _two(s, d):
    a = grid.aggregate_grid(fx.grid(s, d, 16), "ldaps", strict=False).select(FORECAST, "ldaps_t_mean")
    b = grid.aggregate_grid(fx.grid(s, d, 9), "gfs", strict=False).select(FORECAST, "gfs_t_mean")
    return a, b


@query(
    "source_outer",
    _TWO + f" SELECT coalesce(a.forecast_kst_dtm, b.forecast_kst_dtm) AS forecast_kst_dtm, {r('x')} AS ldaps_t_mean, {r('y')} AS gfs_t_mean FROM a FULL JOIN b ON a.forecast_kst_dtm = b.forecast_kst_dtm"
)
def _(s, d):
    return grid.merge_sources(*_two(s, d))


@query("source_inner", _TWO + f" SELECT forecast_kst_dtm, {r('x')} AS ldaps_t_mean, {r('y')} AS gfs_t_mean FROM a JOIN b USING (forecast_kst_dtm)")
def _(s, d):
    return grid.merge_sources(*_two(s, d), how="inner")


@query("source_spread", _TWO + f" SELECT forecast_kst_dtm, {r('x - y')} AS spread FROM a JOIN b USING (forecast_kst_dtm)")
def _(s, d):
    return grid.merge_sources(*_two(s, d), how="inner").select(FORECAST, (F.col("ldaps_t_mean") - F.col("gfs_t_mean")).alias("spread"))


@query(
    "axis_difference",
    _TWO + " SELECT (SELECT count(*) FROM a ANTI JOIN b USING (forecast_kst_dtm)) AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (forecast_kst_dtm)) AS right_only"
)
def _(s, d):
    return s.createDataFrame([grid.axis_difference(*_two(s, d))], "left_only long, right_only long")


@query("axis_anti", _TWO + " SELECT forecast_kst_dtm FROM b ANTI JOIN a USING (forecast_kst_dtm)")
def _(s, d):
    a, b = _two(s, d)
    return b.join(a, FORECAST, "left_anti").select(FORECAST)


@query(
    "label_left",
    LAB + f", {fx.grid_sql(16)}, w AS (SELECT forecast_kst_dtm, avg(t) AS t FROM grid WHERE grid_id <> 2 AND hour(forecast_kst_dtm) <> 3 GROUP BY 1) SELECT kst_dtm AS forecast_kst_dtm, {', '.join(f'{r(t)} AS {t}' for t in TARGETS)}, {r('t')} AS ldaps_t_mean FROM labels LEFT JOIN w ON kst_dtm = forecast_kst_dtm"
)
def _(s, d):
    w = grid.aggregate_grid(fx.grid(s, d).filter((F.col(GRID) != 2) & (F.hour(FORECAST) != 3)), "ldaps", strict=False).select(FORECAST, "ldaps_t_mean")
    return baseline.training_features(fx.labels(s, d), w)[0].select(FORECAST, *TARGETS, "ldaps_t_mean")


@query(
    "model_matrix",
    LAB + f", {fx.grid_sql(16)}, w AS (SELECT forecast_kst_dtm, avg(u) AS u, max(v) AS v FROM grid GROUP BY 1) SELECT forecast_kst_dtm, {r('kpx_group_1')} AS kpx_group_1, {r('u')} AS u, {r('v')} AS v FROM labels LEFT JOIN w ON kst_dtm = forecast_kst_dtm WHERE forecast_kst_dtm IS NOT NULL"
)
def _(s, d):
    w = fx.grid(s, d).groupBy(FORECAST).agg(F.avg("u").alias("u"), F.max("v").alias("v"))
    lab = fx.labels(s, d).select(F.col("kst_dtm").alias(FORECAST), "kpx_group_1").join(w.select(FORECAST), FORECAST, "left_semi")
    return baseline.model_matrix(lab, w)


@query(
    "temporal_split",
    LAB + " SELECT CASE WHEN kst_dtm < TIMESTAMP '2024-01-10 00:00:00' THEN 'train' ELSE 'holdout' END AS split, count(*) AS rows, count(kpx_group_3) AS answers FROM labels WHERE kst_dtm < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"
)
def _(s, d):
    a, b = baseline.split_by_time(fx.labels(s, d), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "kst_dtm")
    both = a.select(F.lit("train").alias("split"), "kpx_group_3").unionByName(b.select(F.lit("holdout").alias("split"), "kpx_group_3"))
    return both.groupBy("split").agg(F.count("*").alias("rows"), F.count("kpx_group_3").alias("answers"))


#: Three years of answers: the hours of the labels, stretched. Folds as the specification has them, fitted on what lies before.
_YEARS = LAB + ", n AS (SELECT count(*) AS n FROM labels), y AS (SELECT TIMESTAMP '2022-01-01 01:00:00' + to_hours(f * (26304 // n)) AS t, kpx_group_1, kpx_group_3 FROM labels, n)"


@query(
    "seasonal_folds",
    _YEARS + """, s(fold, target, a, b, c, d) AS (VALUES
      ('F0', 'kpx_group_1', '2022-01-01', '2024-01-01', '2024-01-01', '2025-01-01'), ('F0', 'kpx_group_3', '2023-01-01', '2024-01-01', '2024-01-01', '2025-01-01'),
      ('F1', 'kpx_group_1', '2022-01-01', '2024-01-01', '2024-01-01', '2024-06-01'), ('F1', 'kpx_group_3', '2023-01-01', '2024-01-01', '2024-01-01', '2024-06-01'),
      ('F2', 'kpx_group_1', '2022-01-01', '2024-06-01', '2024-06-01', '2024-11-01'), ('F2', 'kpx_group_3', '2023-01-01', '2024-06-01', '2024-06-01', '2024-11-01'),
      ('F3', 'kpx_group_3', '2023-01-01', '2024-01-01', '2024-01-01', '2025-01-01'),
      ('F4', 'kpx_group_1', '2023-01-01', '2024-07-01', '2024-07-01', '2025-01-01'), ('F4', 'kpx_group_3', '2023-01-01', '2024-07-01', '2024-07-01', '2025-01-01'))
    SELECT fold, target, count(*) FILTER (t >= CAST(a AS TIMESTAMP) AND t < CAST(b AS TIMESTAMP)) AS fit_rows, count(CASE WHEN target = 'kpx_group_1' THEN kpx_group_1 ELSE kpx_group_3 END) FILTER (t >= CAST(a AS TIMESTAMP) AND t < CAST(b AS TIMESTAMP)) AS fit_answers,
      count(*) FILTER (t >= CAST(c AS TIMESTAMP) AND t < CAST(d AS TIMESTAMP)) AS held_rows FROM s, y GROUP BY ALL""",
)
def _(s, d):
    lab = fx.labels(s, d)
    step = 26304 // lab.count()
    rows, made = lab.select(
        (F.lit("2022-01-01 01:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("f") * step).cast("int"))).alias(FORECAST),
        *TARGETS
    ), []
    for fold in baseline.seasonal_folds(2024):
        for t in (x for x in (TARGETS[0], TARGETS[2]) if x in fold.targets):
            fit, held = fold.of(rows, t)
            counts = fit.agg(
                F.count("*").alias("fit_rows"), F.count(t).alias("fit_answers")
            ).crossJoin(held.agg(F.count("*").alias("held_rows")))  # one row each
            made.append(counts.select(F.lit(fold.name).alias("fold"), F.lit(t).alias("target"), "*"))
    return reduce(DataFrame.unionByName, made)


# --- pooling ---

_KM = f"2 * 6371.0088e0 * asin(sqrt(least(1e0, greatest(0e0, pow(sin(radians(c.latitude - t.latitude) / 2), 2) + cos(radians(t.latitude)) * cos(radians(c.latitude)) * pow(sin(radians(c.longitude - t.longitude) / 2), 2)))))"
_DIST = f", cells AS (SELECT DISTINCT grid_id, latitude, longitude FROM grid), dist AS (SELECT turbine_id, group_id, capacity_mw, grid_id, {_KM} AS km FROM turbines t CROSS JOIN cells c)"
_W = (
    ", m AS (SELECT *, min(km) OVER (PARTITION BY turbine_id) AS least FROM dist), raw AS (SELECT *, 'nearest' AS method, CASE WHEN abs(km - least) <= 1e-12 + 1e-12 * abs(least) THEN 1e0 ELSE 0e0 END AS x FROM m UNION ALL "
    "SELECT *, 'idw' AS method, CASE WHEN least = 0 THEN CASE WHEN km = 0 THEN 1e0 ELSE 0e0 END ELSE pow(least / km, {p}e0) END AS x FROM m), tw AS (SELECT *, x / sum(x) OVER (PARTITION BY turbine_id, method) AS w FROM raw)"
)
_GW = ", gr AS (SELECT group_id, method, grid_id, sum(capacity_mw * w) / sum(capacity_mw) AS w FROM tw GROUP BY ALL), gw AS (SELECT group_id, method, grid_id, w / sum(w) OVER (PARTITION BY group_id, method) AS w FROM gr)"


def _dist(s, d):
    return pooling.distances(fx.turbines(s), pooling.grid_geometry(fx.grid(s, d), strict=False))


def _weights(s, d, p=2.0):
    return pooling.turbine_weights(_dist(s, d), ("nearest", "idw"), p)


@query("turbine_grid_distance", WGRID + _DIST + f" SELECT turbine_id, grid_id, {r('km')} AS km FROM dist")
def _(s, d):
    return _dist(s, d).select("turbine_id", GRID, "km")


@query("grid_geometry", G16 + f" SELECT DISTINCT grid_id, {r('latitude')} AS latitude, {r('longitude')} AS longitude FROM grid")
def _(s, d):
    return pooling.grid_geometry(fx.grid(s, d))


for _name, _method, _power in (("nearest_weights", "nearest", 2.0), ("idw_weights_p1", "idw", 1.0), ("idw_weights_p2", "idw", 2.0)):

    @query(_name, WGRID + _DIST + _W.format(p=_power) + f" SELECT turbine_id, grid_id, {r('w')} AS w FROM tw WHERE method = '{_method}'")
    def _(s, d, method=_method, power=_power):
        return _weights(s, d, power).filter(F.col("method") == method).select("turbine_id", GRID, "w")


@query("group_weights", WGRID + _DIST + _W.format(p=2.0) + _GW + f" SELECT group_id, method, grid_id, {r('w')} AS w FROM gw")
def _(s, d):
    return pooling.group_weights(_weights(s, d)).select("group_id", "method", GRID, "w")


@query(
    "effective_grids",
    WGRID + _DIST + _W.format(p=2.0) + _GW + f" SELECT group_id, method, {r('1e0 / sum(w * w)')} AS effective_cells, {r('max(w)')} AS largest_weight FROM gw GROUP BY ALL"
)
def _(s, d):
    return pooling.effective_cells(pooling.group_weights(_weights(s, d)))


@query(
    "nearest_gap",
    WGRID + _DIST + f", k AS (SELECT *, row_number() OVER w AS place, lead(km) OVER w - km AS gap FROM dist WINDOW w AS (PARTITION BY turbine_id ORDER BY km, grid_id)) SELECT turbine_id, grid_id, {r('km')} AS km, {r('gap')} AS gap_km FROM k WHERE place = 1"
)
def _(s, d):
    return pooling.nearest_gap(_dist(s, d))


def _pool_sql(method: str) -> str:
    # conditional means per variable and group, side by side
    cols = ", ".join(
        f"{r(f'CASE WHEN sum(CASE WHEN {c} IS NOT NULL AND group_id = \'{g}\' THEN w END) > 0 THEN sum(CASE WHEN group_id = \'{g}\' THEN w * {c} END) / sum(CASE WHEN {c} IS NOT NULL AND group_id = \'{g}\' THEN w END) END')} AS ldaps_pool_{c}_{g}_{method}"
        for c in "uvt" for g in ("group_1", "group_2", "group_3")
    )
    return WGRID + _DIST + _W.format(p=2.0) + _GW + f" SELECT forecast_kst_dtm, {cols} FROM grid JOIN gw USING (grid_id) WHERE method = '{method}' GROUP BY 1"


for _method in ("nearest", "idw"):

    @query(f"pooled_{_method}", _pool_sql(_method))
    def _(s, d, method=_method):
        g = fx.grid(s, d)
        return pooling.fit_pooler(g, fx.turbines(s), "ldaps", method).transform(g)


# --- imputation ---


@query(
    "median_fit",
    G16 + f" SELECT {r('median(u)')} AS u, {r('median(v)')} AS v, {r('median(t)')} AS t FROM grid WHERE forecast_kst_dtm < TIMESTAMP '2024-01-15 00:00:00'"
)
def _(s, d):
    g = fx.grid(s, d).filter(F.col(FORECAST) < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    m = impute.fit_median_imputer(g.select("u", "v", "t"))
    return s.createDataFrame([m.medians], "u double, v double, t double")


@query(
    "median_impute",
    G16 + f", m AS (SELECT median(u) AS mu FROM grid WHERE forecast_kst_dtm < TIMESTAMP '2024-01-15 00:00:00') SELECT forecast_kst_dtm, grid_id, {r('coalesce(u, mu)')} AS u FROM grid CROSS JOIN m"
)
def _(s, d):
    g = fx.grid(s, d)
    m = impute.fit_median_imputer(g.filter(F.col(FORECAST) < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("u"))
    return m.transform(g.select(FORECAST, GRID, "u"), keep=(FORECAST, GRID))


# --- scores ---

_ERR = ", e AS (SELECT *, abs(forecast - actual) / cap AS err FROM pairs WHERE actual >= cap * 0.1e0), p AS (SELECT *, CASE WHEN err <= 0.06e0 THEN 4e0 WHEN err <= 0.08e0 THEN 3e0 ELSE 0e0 END AS price FROM e)"
_TS = ", ts AS (SELECT target, CASE WHEN count(err) = count(*) THEN avg(err) END AS nmae, sum(actual * price) / sum(actual * 4e0) AS ficr, count(*) AS valid_rows FROM p GROUP BY 1)"


@query("metric_target", PAIRS + _ERR + _TS + f" SELECT target, {r('nmae')} AS nmae, {r('ficr')} AS ficr, valid_rows FROM ts")
def _(s, d):
    return scoring.target_scores(pairs(s, d))


@query(
    "metric_total",
    PAIRS + _ERR + _TS + f" SELECT {r('0.5e0 * (1e0 - avg(nmae)) + 0.5e0 * avg(ficr)')} AS total_score, {r('1e0 - avg(nmae)')} AS one_minus_nmae, {r('avg(ficr)')} AS ficr FROM ts"
)
def _(s, d):
    return scoring.total_score(pairs(s, d))


@query(
    "metric_null_pred",
    PAIRS.replace(
        fx.predictions_sql(), fx.predictions_sql().replace("FROM labels)", "FROM labels WHERE f % 50 <> 7)")
    ) + _ERR + _TS + f" SELECT target, {r('nmae')} AS nmae, {r('ficr')} AS ficr, valid_rows FROM ts"
)
def _(s, d):
    lab = fx.labels(s, d)
    some = lab.filter("f % 50 <> 7").select("kst_dtm")
    return scoring.target_scores(scoring.pair_up(lab, fx.predictions(s, d).join(some, "kst_dtm", "left_semi"), "kst_dtm"))


@query(
    "target_diagnostics",
    PAIRS + f", v AS (SELECT *, abs(forecast - actual) / cap AS err, actual >= cap * 0.1e0 AS ok FROM pairs) SELECT target, count(actual) AS answer_rows, count(*) FILTER (ok) AS valid_rows, {r('avg(abs(forecast - actual))')} AS mae, {r('avg(err) FILTER (ok)')} AS nmae, {r('avg(CASE WHEN err <= 0.06e0 THEN 1e0 ELSE 0e0 END) FILTER (ok)')} AS within_tight, {r('avg(CASE WHEN err <= 0.08e0 THEN 1e0 ELSE 0e0 END) FILTER (ok)')} AS within_wide, {r('min(forecast)')} AS forecast_min, {r('max(forecast)')} AS forecast_max FROM v GROUP BY 1"
)
def _(s, d):
    return scoring.diagnostics(pairs(s, d))


@query(
    "unit_price_share",
    PAIRS + _ERR + f", b AS (SELECT target, price, count(*) AS rows, sum(actual) AS energy FROM p GROUP BY ALL) SELECT target, {r('price')} AS price, rows, round(energy, 3) + 0e0 AS energy, {r('energy / sum(energy) OVER (PARTITION BY target)')} AS energy_share FROM b"
)
def _(s, d):
    return scoring.price_shares(pairs(s, d)).withColumn("energy", F.round("energy", 3) + F.lit(0.0))


@query(
    "error_landing",
    PAIRS + _ERR + " SELECT target, CASE WHEN err <= 0.06e0 THEN 'tight' WHEN err <= 0.08e0 THEN 'wide' ELSE 'out' END AS landing, count(*) AS rows FROM e GROUP BY ALL"
)
def _(s, d):
    e = scoring.with_errors(pairs(s, d))
    return e.groupBy(
        "target", F.when(F.col("error") <= 0.06, "tight").when(F.col("error") <= 0.08, "wide").otherwise("out").alias("landing")
    ).agg(F.count("*").alias("rows"))


def _settle(a: float, b: float) -> str:
    return f"sum(actual * CASE WHEN err <= {a}e0 THEN 4e0 WHEN err <= {b}e0 THEN 3e0 ELSE 0e0 END) / sum(actual * 4e0)"


@query(
    "settlement_scenarios",
    PAIRS + _ERR + f" SELECT '6/8' AS scenario, target, {r(_settle(0.06, 0.08))} AS ficr FROM e GROUP BY target UNION ALL SELECT '4/6', target, {r(_settle(0.04, 0.06))} FROM e GROUP BY target"
)
def _(s, d):
    return scoring.settlement(pairs(s, d), {"6/8": (0.06, 0.08), "4/6": (0.04, 0.06)})


@query("calibration_bias", PAIRS + f" SELECT target, {r('avg(forecast - actual)')} AS bias FROM pairs GROUP BY 1")
def _(s, d):
    return scoring.bias(pairs(s, d))


@query(
    "naive_climatology",
    PAIRS + f", s AS (SELECT target, cap, month(kst_dtm) AS m, hour(kst_dtm) AS h, avg(actual) AS y FROM pairs WHERE kst_dtm < TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL), o AS (SELECT target, cap, avg(actual) AS y FROM pairs WHERE kst_dtm < TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL) SELECT l.kst_dtm, o.target, {r('CASE WHEN coalesce(s.y, o.y) IS NOT NULL THEN greatest(0e0, least(coalesce(s.y, o.y), o.cap)) END')} AS forecast FROM labels l CROSS JOIN o LEFT JOIN s ON s.target = o.target AND s.m = month(l.kst_dtm) AND s.h = hour(l.kst_dtm)"
)
def _(s, d):
    lab = fx.labels(s, d)
    return scoring.climatology(lab.filter(F.col("kst_dtm") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")), "kst_dtm", lab, "kst_dtm")


_BOARD = ", a AS (SELECT target, avg(abs(forecast - actual) / cap) AS n0, avg(abs(forecast * 1.02e0 - actual) / cap) AS n1 FROM pairs WHERE actual >= cap * 0.1e0 GROUP BY 1)"


def _board(s, d):
    p = pairs(s, d)
    one = lambda name, f: scoring.target_scores(p.withColumn("forecast", F.col("forecast") * f)).select(
        F.lit(name).alias("feature_set"), "target", "nmae", "ficr"
    )
    return one("mean", 1.0).unionByName(one("scaled", 1.02))


_FICR = ", f AS (SELECT target, " + _settle(0.06, 0.08).replace("err", "abs(forecast - actual) / cap") + " AS f0, " + _settle(0.06, 0.08).replace(
    "err", "abs(forecast * 1.02e0 - actual) / cap"
) + " AS f1 FROM pairs WHERE actual >= cap * 0.1e0 GROUP BY 1)"


@query(
    "scoreboard_delta",
    PAIRS + _BOARD + _FICR + f" SELECT 'scaled' AS feature_set, target, {r('n1 - n0')} AS delta_nmae, {r('f1 - f0')} AS delta_ficr FROM a JOIN f USING (target)"
)
def _(s, d):
    return scoring.scoreboard_delta(_board(s, d), "mean")


@query(
    "decision_rule",
    PAIRS + _BOARD + _FICR + f", x AS (SELECT avg(n1 - n0) AS dn, avg(f1 - f0) AS df, count(*) FILTER (n1 < n0) AS better FROM a JOIN f USING (target)) SELECT 'scaled' AS feature_set, {r('0.5e0 * (df - dn)')} AS delta_total, better AS targets_better, CASE WHEN df - dn > 0 AND better >= 2 THEN 'adopt' WHEN df - dn > 0 THEN 'conditional' ELSE 'hold' END AS decision FROM x"
)
def _(s, d):
    return scoring.decide(scoring.scoreboard_delta(_board(s, d), "mean"))


# --- audits ---


def _union(body: str) -> str:
    """body for each target, with {t} and {cap}."""
    return " UNION ALL ".join(body.format(t=t, cap=f"{CAPACITY[t]}e0") for t in TARGETS)


@query(
    "label_profile",
    LAB + " " + _union(
        "SELECT '{t}' AS target, count(*) AS rows, count({t}) AS non_null, count(*) - count({t}) AS missing, count(*) FILTER ({t} < 0) AS negative, count(*) FILTER ({t} > {cap}) AS over_capacity, round(min({t}), 9) + 0e0 AS y_min, round(max({t}), 9) + 0e0 AS y_max, count(*) FILTER ({t} >= {cap} * 0.1e0) AS valid_rows, round(avg(CASE WHEN {t} >= {cap} * 0.1e0 THEN 1e0 WHEN {t} IS NOT NULL THEN 0e0 END), 9) + 0e0 AS valid_share, min(kst_dtm) FILTER ({t} IS NOT NULL) AS first_time, max(kst_dtm) FILTER ({t} IS NOT NULL) AS last_time, round(quantile_cont({t}, 0.25), 9) + 0e0 AS q25, round(quantile_cont({t}, 0.5), 9) + 0e0 AS q50, round(quantile_cont({t}, 0.75), 9) + 0e0 AS q75 FROM labels"
    )
)
def _(s, d):
    return audit.label_profile(fx.labels(s, d), "kst_dtm")


@query(
    "weather_profile",
    G16 + f", f AS (SELECT forecast_kst_dtm, count(*) AS n, count(DISTINCT grid_id) AS c FROM grid GROUP BY 1) SELECT (SELECT count(*) FROM grid) AS rows, count(*) AS forecast_rows, min(forecast_kst_dtm) AS forecast_start, max(forecast_kst_dtm) AS forecast_end, (SELECT min(data_available_kst_dtm) FROM grid) AS available_start, (SELECT max(data_available_kst_dtm) FROM grid) AS available_end, min(c) AS grid_count_min, max(c) AS grid_count_max, min(n) AS rows_per_forecast_min, max(n) AS rows_per_forecast_max, (SELECT round(min({LEAD_SQL}), 9) + 0e0 FROM grid) AS lead_hour_min, (SELECT round(max({LEAD_SQL}), 9) + 0e0 FROM grid) AS lead_hour_max, (SELECT count(DISTINCT {LEAD_SQL}) FROM grid) AS lead_hour_unique, (SELECT count(*) FILTER (u IS NULL) + count(*) FILTER (v IS NULL) + count(*) FILTER (t IS NULL) FROM grid) AS missing_cells FROM f"
)
def _(s, d):
    return audit.weather_profile(fx.grid(s, d))


@query(
    "matrix_missing",
    G16 + " SELECT count(*) FILTER (u IS NULL) + count(*) FILTER (v IS NULL) AS missing_cells, count(*) FILTER (u IS NULL OR v IS NULL) AS rows_with_missing, (CASE WHEN count(*) FILTER (u IS NULL) > 0 THEN CAST(1 AS BIGINT) ELSE 0 END) + (CASE WHEN count(*) FILTER (v IS NULL) > 0 THEN CAST(1 AS BIGINT) ELSE 0 END) AS columns_with_missing FROM grid"
)
def _(s, d):
    return audit.matrix_missing(fx.grid(s, d), ["u", "v"])


@query(
    "label_quantiles",
    LAB + " " + _union(
        "SELECT '{t}' AS target, " + ", ".join(
            f"round(quantile_cont({{t}}, {q}), 9) + 0e0 AS p{n}"
            for q, n in ((0.01, "01"), (0.5, "50"), (0.95, "95"), (0.99, "99"))
        ) + " FROM labels"
    )
)
def _(s, d):
    return audit.quantiles(scoring.long_targets(fx.labels(s, d), "kst_dtm", "y"), "y", ["target"])


@query(
    "corr_speed_target",
    PAIRS + f", {fx.grid_sql(16)}{_WIND}, h AS (SELECT forecast_kst_dtm, avg(speed) AS speed FROM w GROUP BY 1) SELECT target, {r('corr(speed, actual)')} AS corr, count(*) FILTER (speed IS NOT NULL AND actual IS NOT NULL) AS pairs FROM pairs JOIN h ON kst_dtm = forecast_kst_dtm GROUP BY 1"
)
def _(s, d):
    speed = wind.wind_vectors(
        fx.grid(s, d), "ldaps", PAIR, strict=False
    ).groupBy(F.col(FORECAST).alias("kst_dtm")).agg(F.avg(PAIR[0].outputs[0]).alias("speed"))
    return audit.correlation(scoring.long_targets(fx.labels(s, d), "kst_dtm", "y").join(speed, "kst_dtm"), "speed", "y", ["target"])


@query(
    "monthly_audit",
    PAIRS + f" SELECT target, strftime(kst_dtm, '%Y-%m') AS period, count(*) AS rows, count(*) - count(actual) AS missing, count(*) FILTER (actual >= cap * 0.1e0) AS valid, {r('avg(actual / cap)')} AS mean_rate FROM pairs GROUP BY ALL"
)
def _(s, d):
    cap = scalars.capacity_of(F.col("target"))
    rows = scoring.long_targets(fx.labels(s, d), "kst_dtm", "y")
    return rows.groupBy("target", scalars.period(F.col("kst_dtm")).alias("period")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("y") >= cap * 0.1).alias("valid"),
        F.avg(F.col("y") / cap).alias("mean_rate")
    )


@query(
    "hourly_valid_rate",
    PAIRS + f" SELECT target, hour(kst_dtm) AS hour, {r('avg(CASE WHEN actual >= cap * 0.1e0 THEN 1e0 WHEN actual IS NOT NULL THEN 0e0 END)')} AS valid_rate FROM pairs GROUP BY ALL"
)
def _(s, d):
    rows = scoring.long_targets(fx.labels(s, d), "kst_dtm", "y")
    ok = (F.col("y") >= scalars.capacity_of(F.col("target")) * 0.1).cast("double")
    return rows.groupBy("target", F.hour("kst_dtm").alias("hour")).agg(F.avg(ok).alias("valid_rate"))


@query(
    "daily_resample",
    LAB + ", x AS (SELECT * FROM labels WHERE day(kst_dtm) <> 6) , m AS (SELECT date_trunc('day', kst_dtm) AS bucket, avg(kpx_group_3) AS mean, count(*) AS n, avg(CASE WHEN kpx_group_3 IS NULL THEN 1e0 ELSE 0e0 END) AS q FROM x GROUP BY 1), axis AS (SELECT CAST(unnest(range(min(bucket), max(bucket) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS TIMESTAMP) AS bucket FROM m) SELECT CAST(axis.bucket AS TIMESTAMP) AS bucket, " + r("mean") + " AS mean, coalesce(n, 0) AS rows, " + r("q") + " AS missing_rate FROM axis LEFT JOIN m ON axis.bucket = m.bucket"
)
def _(s, d):
    return audit.resample(fx.labels(s, d).filter(F.dayofmonth("kst_dtm") != 6), "kst_dtm", "kpx_group_3")


@query(
    "time_continuity",
    LAB + ", x AS (SELECT kst_dtm FROM labels WHERE f % 11 <> 3 UNION ALL SELECT kst_dtm FROM labels WHERE f % 100 = 1) SELECT min(kst_dtm) AS start, max(kst_dtm) AS end, count(*) AS rows, count(DISTINCT kst_dtm) AS distinct_times, date_diff('hour', min(kst_dtm), max(kst_dtm)) + 1 AS expected, count(*) - count(DISTINCT kst_dtm) AS repeated, date_diff('hour', min(kst_dtm), max(kst_dtm)) + 1 - count(DISTINCT kst_dtm) AS missing FROM x".replace(" AS end,", ' AS "end",')
)
def _(s, d):
    lab = fx.labels(s, d)
    return audit.time_audit(lab.filter("f % 11 <> 3").select("kst_dtm").unionByName(lab.filter("f % 100 = 1").select("kst_dtm")), "kst_dtm")


@query(
    "missing_times",
    LAB + ", x AS (SELECT kst_dtm FROM labels WHERE f % 11 <> 3) SELECT kst_dtm FROM labels WHERE f % 11 = 3 AND kst_dtm < (SELECT max(kst_dtm) FROM x)"
)
def _(s, d):
    return audit.missing_times(fx.labels(s, d).filter("f % 11 <> 3"), "kst_dtm")


@query(
    "interval_mode",
    "WITH x AS (SELECT event_type, date_diff('second', lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts) AS seconds FROM events), c AS (SELECT event_type, seconds, count(*) AS n FROM x WHERE seconds IS NOT NULL GROUP BY ALL) SELECT event_type, arg_min(seconds, (-n, seconds)) AS seconds, max(n) AS n FROM c GROUP BY 1"
)
def _(s, d):
    return audit.dominant_interval(
        fx.table(s, d, "events").select("event_type", F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("ts")), "ts", ["event_type"]
    )


ORACLE["interval_mode"] = ORACLE["interval_mode"].replace(
    "lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts)",
    "lag(date_trunc('second', ts)) OVER (PARTITION BY event_type ORDER BY ts), date_trunc('second', ts))"
)


@query("melt_labels", LAB + " " + _union("SELECT kst_dtm, '{t}' AS target, round({t}, 9) + 0e0 AS y FROM labels"))
def _(s, d):
    return scoring.long_targets(fx.labels(s, d), "kst_dtm", "y")


@query(
    "pivot_missing",
    G16 + " SELECT hour(forecast_kst_dtm) AS hour, count(*) FILTER (u IS NULL AND grid_id % 2 = 0) AS even, count(*) FILTER (u IS NULL AND grid_id % 2 = 1) AS odd FROM grid GROUP BY 1"
)
def _(s, d):
    rows = fx.grid(s, d).select(
        F.hour(FORECAST).alias("hour"), F.when(F.col(GRID) % 2 == 0, "even").otherwise("odd").alias("side"),
        F.col("u").isNull().cast("long").alias("gap")
    )
    return rows.groupBy("hour").pivot("side", ["even", "odd"]).sum("gap").fillna(0)


@query(
    "missing_cells",
    G16 + " SELECT grid_id, 'u' AS variable, count(*) FILTER (u IS NULL) AS missing FROM grid GROUP BY 1 HAVING count(*) FILTER (u IS NULL) > 0"
)
def _(s, d):
    return audit.missing_cells(fx.grid(s, d), ["u", "v", "t"], GRID)


@query(
    "missing_rate_monthly",
    G16 + f" SELECT strftime(forecast_kst_dtm, '%Y-%m') AS period, {r('(avg(CASE WHEN u IS NULL THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END)) / 2')} AS missing_rate FROM grid GROUP BY 1"
)
def _(s, d):
    return audit.missing_rate(fx.grid(s, d), ["u", "v"], scalars.period(F.col(FORECAST)), "period")


@query(
    "dup_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1".replace(
        "l_linenumber, count", "CAST(l_linenumber AS BIGINT) AS l_linenumber, count"
    )
)
def _(s, d):
    return contracts.repeated_keys(fx.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "flag_copies",
    "SELECT is_copy, count(*) AS rows FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_copy FROM lineitem) GROUP BY 1"
)
def _(s, d):
    return audit.flag_copies(
        fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]
    ).groupBy("is_copy").agg(F.count("*").alias("rows"))


@query(
    "submission_violations",
    PAIRS + " " + _union(
        "SELECT '{t}' AS target, count(*) FILTER ({t} * 1.05e0 IS NULL) AS missing, count(*) FILTER ({t} * 1.05e0 < 0) AS negative, count(*) FILTER ({t} * 1.05e0 > {cap}) AS over_capacity FROM predictions"
    )
)
def _(s, d):
    return violations(fx.predictions(s, d).select(*[(F.col(t) * 1.05).alias(t) for t in TARGETS]))


@query(
    "clip_bounds",
    PAIRS + " " + _union(
        "SELECT kst_dtm, '{t}' AS target, round(CASE WHEN {t} IS NOT NULL THEN greatest(0e0, least({t} * 1.1e0 - 900e0, {cap})) END, 9) + 0e0 AS y FROM labels"
    )
)
def _(s, d):
    rows = scoring.long_targets(fx.labels(s, d), "kst_dtm", "y")
    return rows.select("kst_dtm", "target", clip(F.col("y") * 1.1 - 900.0, 0.0, scalars.capacity_of(F.col("target"))).alias("y"))


@query(
    "dms_parse",
    "SELECT turbine, round(CASE side WHEN 'S' THEN -1 WHEN 'W' THEN -1 ELSE 1 END * (deg + min / 60e0 + sec / 3600e0), 9) + 0e0 AS degrees FROM (SELECT s_suppkey AS turbine, s_suppkey % 90 AS deg, s_suppkey % 60 AS min, (s_suppkey * 7) % 60 AS sec, ['N', 'S', 'E', 'W'][s_suppkey % 4 + 1] AS side FROM supplier)"
)
def _(s, d):
    k = F.col("s_suppkey")
    side = F.element_at(F.array(*map(F.lit, "NSEW")), (k % 4 + 1).cast("int"))
    text = F.concat((k % 90).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("'"), ((k * 7) % 60).cast("string"), F.lit('"'), side)
    return fx.table(s, d, "supplier").select(k.alias("turbine"), scalars.dms(text).alias("degrees"))


@query("unit_ids", "SELECT s_suppkey, 'VESTAS-' || lpad(CAST(s_suppkey % 17 AS VARCHAR), 2, '0') AS unit FROM supplier")
def _(s, d):
    return fx.table(s, d, "supplier").select("s_suppkey", scalars.unit_id(F.lit(" vestas "), F.col("s_suppkey") % 17).alias("unit"))


@query("slugs", "SELECT DISTINCT p_type, trim(regexp_replace(trim(p_type), '[^A-Za-z0-9_.-]+', '-', 'g'), '-') AS slug, sha256(p_type) AS sha FROM part")
def _(s, d):
    return fx.table(s, d, "part").select("p_type", scalars.slug(F.col("p_type")).alias("slug"), F.sha2("p_type", 256).alias("sha")).distinct()


@query(
    "run_names",
    "SELECT o_orderkey, 'submission_' || strftime(o_orderdate, '%Y%m%d') || '_' || trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') || '_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 7) || '.csv' AS name FROM orders"
)
def _(s, d):
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return fx.table(s, d, "orders").select("o_orderkey", scalars.submission_name(F.col("o_orderpriority"), F.col("o_orderdate"), sha).alias("name"))


@query(
    "feature_union",
    f"WITH {fx.grid_sql(16, 'ga')}, {fx.grid_sql(9, 'gb')} SELECT 'ldaps' AS source, count(*) AS rows, count(DISTINCT forecast_kst_dtm) AS forecasts, string_agg(DISTINCT CAST(grid_id AS VARCHAR), ', ' ORDER BY CAST(grid_id AS VARCHAR)) AS cells FROM ga UNION ALL SELECT 'gfs', count(*), count(DISTINCT forecast_kst_dtm), string_agg(DISTINCT CAST(grid_id AS VARCHAR), ', ' ORDER BY CAST(grid_id AS VARCHAR)) FROM gb"
)
def _(s, d):
    both = fx.grid(s, d, 16).withColumn("source", F.lit("ldaps")).unionByName(fx.grid(s, d, 9).withColumn("source", F.lit("gfs")))
    return both.groupBy("source").agg(
        F.count("*").alias("rows"), F.countDistinct(FORECAST).alias("forecasts"),
        audit.distinct_text(F.col(GRID).cast("string")).alias("cells")
    )


@query(
    "group_summary",
    "WITH b AS (SELECT n_name, c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers, sum(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_name, c_mktsegment, orders, customers, round(t, 2) + 0e0 AS total, round(t / sum(t) OVER (PARTITION BY n_name), 9) + 0e0 AS share FROM b"
)
def _(s, d):
    from pyspark.sql import Window

    rows = fx.table(s, d, "orders").join(fx.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        fx.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    by = rows.groupBy("n_name", "c_mktsegment").agg(
        F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"), F.sum("o_totalprice").alias("t")
    )
    return by.select(
        "n_name", "c_mktsegment", "orders", "customers", (F.round("t", 2) + F.lit(0.0)).alias("total"),
        (F.col("t") / F.sum("t").over(Window.partitionBy("n_name"))).alias("share")
    )


@query(
    "forward_fill",
    G16 + f" SELECT forecast_kst_dtm, grid_id, {r('last_value(u IGNORE NULLS) OVER (PARTITION BY grid_id ORDER BY forecast_kst_dtm ROWS UNBOUNDED PRECEDING)')} AS u FROM grid"
)
def _(s, d):
    return audit.forward_fill(fx.grid(s, d).select(FORECAST, GRID, "u"), "u", FORECAST, [GRID])


@query(
    "every_nth",
    G16 + " SELECT forecast_kst_dtm, grid_id FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY forecast_kst_dtm) - 1 AS k FROM grid) WHERE k % 24 = 0"
)
def _(s, d):
    return audit.every_nth(fx.grid(s, d).select(FORECAST, GRID), FORECAST, 24, [GRID])


@query(
    "power_curve",
    G16 + _WIND + f" SELECT {r('floor(speed / 0.5e0) * 0.5e0')} AS speed_bin, {r('avg(t)')} AS power_mean, {r('stddev_pop(t)')} AS power_std, count(*) AS rows FROM w WHERE speed IS NOT NULL AND t IS NOT NULL GROUP BY 1"
)
def _(s, d):
    return audit.power_curve(wind.wind_vectors(fx.grid(s, d), "ldaps", PAIR, strict=False), PAIR[0].outputs[0], "t")


@query("null_out", "SELECT count(*) AS rows, round(sum(value), 3) + 0e0 AS total FROM events WHERE value BETWEEN 5 AND 60")
def _(s, d):
    return audit.null_out(fx.table(s, d, "events").select("value"), "value", 5.0, 60.0).agg(
        F.count("*").alias("rows"), (F.round(F.sum("value"), 3) + F.lit(0.0)).alias("total")
    )


@query("top_interval", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1")
def _(s, d):
    return fx.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(1)


@query(
    "columns_equal",
    G16 + " SELECT 'u' AS \"left\", 'v' AS \"right\", bool_and(u IS NOT DISTINCT FROM v) AS equal FROM grid UNION ALL SELECT 'u', 'u', true"
)
def _(s, d):
    return audit.columns_equal(fx.grid(s, d), [("u", "v"), ("u", "u")])


@query(
    "schema_audit",
    G16 + " SELECT 'u' AS \"column\", 'double' AS dtype, count(*) FILTER (u IS NULL) AS missing, 'value' AS role FROM grid UNION ALL SELECT 'grid_id', 'bigint', count(*) FILTER (grid_id IS NULL), 'key' FROM grid"
)
def _(s, d):
    return audit.schema_audit(fx.grid(s, d).select("u", GRID), {GRID: "key"})


@query("rf_predict")
def _(s, d):
    """The forests of the baseline, fitted on the first two thirds of the hours and predicting the rest."""
    lab = fx.labels(s, d)
    w = grid.aggregate_grid(fx.grid(s, d), "ldaps", ("mean", "max"), include_lead=True, strict=False)
    rows, features = baseline.training_features(lab, w)
    last = lab.agg(F.max("f")).first()[0]
    cut = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(last * 2 // 3))
    bundle = baseline.fit_forests(rows.filter(F.col(FORECAST) < cut), features)
    return baseline.predict(bundle, rows.filter(F.col(FORECAST) >= cut), [FORECAST])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and leads of a gridded forecast under its strict contract."""
    return QUERIES["grid_stats_lead"](spark, sf_dir)


assert math.isclose(sum(t[4] for t in fx.TURBINE_ROWS), 12 * 3.6 + 5 * 4.2)

"""Findings of the second review."""

import datetime as dt

import duckdb
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

import __spark_entry__ as entry
from zephyrlake.operators import baseline, grid, wind
from zephyrlake.plans import submission
from zephyrlake.schema import AVAILABLE, FORECAST, GRID, LAT, LON, SUBMISSION, TARGETS


def answers(spark, n: int):
    """n hours with three features and an answer that follows from two of them, in an order of the hash."""
    x = [(F.xxhash64("id", F.lit(k)) % 1000 / 1000.0).alias(f"x{k}") for k in range(3)]
    rows = spark.range(n).select(F.timestamp_add("HOUR", "id", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("at"), *x)
    return rows.withColumn(TARGETS[0], 100 * F.col("x0") + F.sin(7 * F.col("x1")) / 3).repartition(7, "x2")


def test_forest_of_parts(spark, tmp_path):
    """F1, rf_predict: a forest's parts have all its trees, each fitted in one task, and their union is kept and read as one forest."""
    rows, params = answers(spark, 4000), {"numTrees": 70, "maxDepth": 4}
    parts = baseline.forest_parts(4000, baseline.FOREST | params)
    assert [p["numTrees"] for p in parts] == [35, 35] and len({p["seed"] for p in parts}) == 2
    assert len(baseline.forest_parts(250_000, baseline.FOREST)) == baseline.PARTS and len(baseline.forest_parts(60, baseline.FOREST)) == 1
    features = ["x0", "x1", "x2"]
    bundle = baseline.fit_forests(rows, features, params, "at", TARGETS[:1])
    model = bundle.models[TARGETS[0]]
    assert model.getNumTrees == 70 and len(model.trees) == 70 and model.getOrDefault("numTrees") == 70 and model.numFeatures == 3
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > 60  # parts don't repeat each other's trees
    model.save(str(tmp_path / "model"))
    held = RandomForestRegressionModel.load(str(tmp_path / "model"))
    told = lambda m: baseline.predict(baseline.Bundle(bundle.imputer, {TARGETS[0]: m}, bundle.features), rows, ["at"]).orderBy("at").collect()
    assert told(model) == told(held)
    first = Vectors.dense(*rows.orderBy("at").select(*features).first())
    assert model.predict(first) == pytest.approx(sum(t.predict(first) for t in model.trees) / 70, rel=1e-12)


def test_speeds_on_bin_edges(spark, tmp_path):
    """F2, power_curve: speeds of 3 and 6 made of components that aren't exact, where hypot gives a number just below the edge."""
    on_edge = [(16.0, 16), (16.0, 34), (22.0, 13), (58.0, 13), (76.0, 1)]
    rows = [(100 + k, dt.datetime(2024, 1, 1), user, "view", value, "{}") for k, (value, user) in enumerate(on_edge * 2)]
    rows += [(k, dt.datetime(2024, 1, 1), k % 50, "view", k / 4, "{}") for k in [*range(100), *range(110, 160)]]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["power_curve"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.sql(entry.oracle_sql()["power_curve"])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_lengths_out_of_range(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3e200, 4e200), (3e-200, 4e-200), (None, 1.0), (float("inf"), 1.0), (-2.4, -1.7999999999999998)], "u double, v double")
    got = [r[0] for r in df.select(wind.length(F.col("u"), F.col("v"))).collect()]
    assert got == [0.0, pytest.approx(5e200), pytest.approx(5e-200), None, float("inf"), 3.0]


def test_ids_past_their_padding(spark):
    """F4, sinks: rows by id go on by number where a number has more digits than the others."""
    ids = ["a", "forecast_00009", "forecast_99999", "forecast_100000", "forecast_100001", "forecast_1000000", "x\n2", "x\n10"]
    rows = spark.createDataFrame([(i, "t", 1.0, 2.0, 3.0) for i in reversed(ids)], SUBMISSION)
    lines = submission.canonical_bytes(rows.repartition(3), "utf-8").decode().replace("x\n", "x").split("\n")[1:-1]
    assert [x.split(",")[0].strip('"') for x in lines] == [i.replace("\n", "") for i in ids]


def test_forests_repeat(spark):
    """F3, rf_checks: a second fit over rows in another layout predicts the same to the last bit."""
    rows, params = answers(spark, 8000), {"numTrees": 10, "maxDepth": 8}
    told = []
    for layout in (rows, rows, rows.repartition(3, "x0"), rows.orderBy(F.desc("x1"))):
        bundle = baseline.fit_forests(layout, ["x0", "x1", "x2"], params, "at", TARGETS[:1])
        told.append(baseline.predict(bundle, rows, ["at"]).orderBy("at").collect())
    assert told[0] == told[1] == told[2] == told[3] and len(told[0]) == 8000


def test_features_repeat(spark):
    """F3, rf_checks: cells' means and deviations are the same to the last bit in whatever order and tasks their rows lie."""
    at = F.timestamp_add("HOUR", F.expr("id div 16"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    value = [F.when(F.xxhash64("id", F.lit(k)) % 9 != 0, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(20_000)) / 100.0 - 4).alias(c) for k, c in enumerate("uv")]
    place = [F.lit(37.0).alias(LAT), F.lit(128.9).alias(LON)]
    rows = spark.range(16 * 500).select(at.alias(FORECAST), at.alias(AVAILABLE), (F.col("id") % 16).alias(GRID), *place, *value)
    told = []
    for layout in (rows.coalesce(1), rows.repartition(7, "u"), rows.repartition(5, "v").sortWithinPartitions(F.desc(GRID)), rows.orderBy("u")):
        made = grid.aggregate_grid(layout, "ldaps", ("mean", "std", "min", "max"), include_lead=True, strict=False)
        told.append(made.orderBy(FORECAST).collect())
    assert told[0] == told[1] == told[2] == told[3] and len(told[0]) == 500


def test_forests_in_one_task(spark, monkeypatch):
    """F3, rf_checks: where a session raises the counts of rows dealt by a key, a part's rows still lie in one task."""
    rows, params = answers(spark, 3000), {"numTrees": 10, "maxDepth": 6}
    told, dealt = [], type(rows).repartition
    for least in (1, 7):
        raised = lambda self, n, *by, least=least: dealt(self, max(n, least) if by and isinstance(n, int) else n, *by)
        monkeypatch.setattr(type(rows), "repartition", raised)
        bundle = baseline.fit_forests(rows, ["x0", "x1", "x2"], params, "at", TARGETS[:1])
        told.append(baseline.predict(bundle, rows, ["at"]).orderBy("at").collect())
    assert told[0] == told[1] and len(told[0]) == 3000

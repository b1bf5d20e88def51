"""Operators on hand-made frames: contracts, hand-computed values, missing values, lineage."""

import datetime as dt
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrlake import schema
from zephyrlake.functions import nulls, scalars
from zephyrlake.operators import audit, baseline, contracts, grid, impute, pooling, scoring, wind
from zephyrlake.operators.contracts import ContractError
from zephyrlake.plans import lineage, runs, submission
from zephyrlake.sources import files
from zephyrlake.streaming import blocks

START = dt.datetime(2024, 1, 1, 1)


def hours(n):
    return [START + dt.timedelta(hours=k) for k in range(n)]


def forecast(spark, n=3, cells=9, lead=12, value=None, drop=()):
    value = value or (lambda t, g: 100.0 * t + g)
    rows = [
        (h, h - dt.timedelta(hours=lead), g, 37.5 - 0.25 * ((g - 1) // 3), 128.75 + 0.25 * ((g - 1) % 3), value(t, g), 10.0 * (value(t, g) or 0.0))
        for t, h in enumerate(hours(n)) for g in range(1, cells + 1) if (t, g) not in drop
    ]
    return spark.createDataFrame(rows, schema.weather(["wind", "temperature"]))


TURBINES = [
    ("g1_a", "group_1", 37.50, 128.75, 1.0), ("g1_b", "group_1", 37.50, 129.00, 3.0), ("g2_a", "group_2", 37.25, 129.00, 2.0),
    ("g3_a", "group_3", 37.00, 129.25, 4.0)
]


def turbines(spark, rows=TURBINES):
    return spark.createDataFrame(rows, schema.TURBINES)


def test_statistics_names_order_and_missing_cells(spark):
    df = forecast(spark, value=lambda t, g: None if t == 1 or g == 2 else float(g))
    out = grid.aggregate_grid(df, "gfs", ("max", "mean", "std"), include_lead=True)
    assert out.columns == [schema.FORECAST, *[f"gfs_{c}_{s}" for c in ("wind", "temperature") for s in ("mean", "std", "max")], "gfs_lead_hour"]
    rows = {r[schema.FORECAST]: r for r in out.collect()}
    assert rows[hours(2)[1]]["gfs_wind_mean"] is None and rows[START]["gfs_wind_mean"] == pytest.approx((45 - 2) / 8) and rows[START]["gfs_lead_hour"] == 12.0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "k int, x double")
    assert [r.x for r in nulls.nan_to_null(df).orderBy("k").collect()] == [None, 3.0, None]
    r = nulls.nan_to_null(df).agg(
        F.avg("x").alias("a"), nulls.strict_avg(F.col("x")).alias("s"), nulls.std(F.col("x"), 1).alias("d"),
        nulls.std(F.col("x"), 0).alias("p")
    ).first()
    assert (r.a, r.s, r.d, r.p) == (3.0, None, None, 0.0)
    assert [r[0] for r in nulls.nan_to_null(df).orderBy("k").select(nulls.clip(F.col("x"), 0.0, 2.0)).collect()] == [None, 2.0, None]


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda d: d.drop("latitude"), "lacks"),
        (lambda d: d.filter("false"), "no rows"),
        (lambda d: d.withColumn(schema.LAT, F.when(F.col(schema.GRID) > 1, F.col(schema.LAT))), "missing"),
        (lambda d: d.withColumn(schema.AVAILABLE, F.col(schema.FORECAST) + F.expr("INTERVAL 1 HOUR")), "cutoff"),
        (lambda d: d.withColumn(schema.AVAILABLE, F.when(F.col(schema.GRID) == 1, F.col(schema.AVAILABLE) - F.expr("INTERVAL 1 HOUR")).otherwise(F.col(schema.AVAILABLE))), "several leads"),
        (lambda d: d.withColumn(schema.AVAILABLE, F.col(schema.FORECAST) - F.expr("INTERVAL 36 HOURS")), "outside"),
        (lambda d: d.filter(F.col(schema.GRID) != 4), "distinct cells"),
        (lambda d: d.withColumn(schema.GRID, F.when(F.col(schema.GRID) == 4, 5).otherwise(F.col(schema.GRID))), "distinct cells"),
        (lambda d: d.drop("wind", "temperature"), "no numeric"),
    ],
)
def test_grid_contract(spark, change, said):
    with pytest.raises(ContractError, match=said):
        contracts.check_grid(change(forecast(spark)), "gfs")


def test_small_contracts(spark):
    for bad in ((), ("mean", "mean"), ("sum",)):
        with pytest.raises(ContractError):
            contracts.check_statistics(bad, 0)
    for bad in (-1, True, 1.5):
        with pytest.raises(ContractError):
            contracts.check_statistics("mean", bad)
    with pytest.raises(ContractError):
        contracts.check_source("era5")
    with pytest.raises(ContractError):
        contracts.check_prefix("Bad")
    with pytest.raises(TypeError):
        contracts.check_columns([1], ["a"])
    with pytest.raises(ContractError, match="clash"):
        grid.merge_sources(
            spark.createDataFrame([(START, 1)], "forecast_kst_dtm timestamp_ntz, a int"),
            spark.createDataFrame([(START, 1)], "forecast_kst_dtm timestamp_ntz, a int")
        )
    day_late = forecast(spark, lead=2)
    with pytest.raises(ContractError):
        contracts.check_cutoff(day_late, day_ahead=True)


def test_feature_pair_locks_schema(spark):
    l16 = lambda: forecast(spark, cells=16)
    pair = grid.weather_feature_pair((l16(), l16()), (forecast(spark), forecast(spark)), statistics=("mean", "max"))
    assert pair.train.columns == pair.test.columns and pair.columns[0] == "ldaps_wind_mean" and pair.columns[4] == "gfs_wind_mean"
    with pytest.raises(ContractError, match="axes differ"):
        grid.weather_features(l16(), forecast(spark, n=2))
    with pytest.raises(ContractError, match="order differ"):
        grid.weather_feature_pair((l16(), l16().drop("wind")), (forecast(spark), forecast(spark)))


def test_wind_vectors(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, -1.0), (3, -1.0, 0.0), (4, 0.0, 0.0), (5, None, 1.0)], "k int, u double, v double")
    rows = wind.wind_vectors(df, "ldaps", (wind.WindPair("10m", "u", "v"),)).orderBy("k").collect()
    assert rows[0][3:] == (5.0, -0.6, -0.8) and rows[1][3:] == (1.0, 0.0, 1.0) and rows[2][3:] == (1.0, 1.0, 0.0)
    assert rows[3][3:] == (0.0, None, None) and rows[4][3:] == (None, None, None)
    for bad in (
        (), (wind.WindPair("a", "u", "u"),), (wind.WindPair("A-", "u", "v"),), (wind.WindPair("a", "u", "v"), wind.WindPair("a", "u", "v")),
        (wind.WindPair("a", "u", "w"),)
    ):
        with pytest.raises(ContractError):
            wind.wind_vectors(df, "ldaps", bad)
    with pytest.raises(ContractError, match="infinit"):
        wind.wind_vectors(spark.createDataFrame([(math.inf, 1.0)], "u double, v double"), "gfs", (wind.WindPair("a", "u", "v"),))
    for bad in (-1.0, True, math.nan):
        with pytest.raises(ContractError):
            wind.wind_vectors(df, "ldaps", (wind.WindPair("10m", "u", "v"),), calm=bad)


@pytest.mark.parametrize("method", ["nearest", "idw"])
def test_pooling_by_hand(spark, method):
    df = forecast(spark, n=2)
    p = pooling.fit_pooler(df, turbines(spark), "gfs", method)
    assert p.groups == ("group_1", "group_2", "group_3")
    r = p.transform(df.repartition(3)).orderBy(schema.FORECAST).first()
    assert (r[f"gfs_pool_wind_group_1_{method}"], r[f"gfs_pool_wind_group_2_{method}"], r[f"gfs_pool_wind_group_3_{method}"]) == pytest.approx((1.75, 5.0, 9.0))


def test_pooling_ties_gaps_and_drift(spark):
    df = forecast(spark, n=1)
    tie = pooling.fit_pooler(df, turbines(spark, [("a", "group_1", 37.50, 128.875, 1.0)]), "gfs", "nearest")
    assert tie.transform(df).first()["gfs_pool_wind_group_1_nearest"] == pytest.approx(1.5)
    p = pooling.fit_pooler(df, turbines(spark), "gfs")
    assert p.output_columns == [c for c in p.transform(df).columns if c != schema.FORECAST]
    gap = forecast(spark, n=1, value=lambda t, g: None if g == 1 else float(g))
    assert p.transform(gap).first()["gfs_pool_wind_group_1_nearest"] == pytest.approx(2.0)
    none = forecast(spark, n=1, value=lambda t, g: None)
    assert p.transform(none).first()["gfs_pool_wind_group_1_idw"] is None
    moved = df.withColumn(schema.LAT, F.when(F.col(schema.GRID) == 1, F.col(schema.LAT) + 1e-9).otherwise(F.col(schema.LAT)))
    for bad in (moved, df.filter(F.col(schema.GRID) < 9), df.drop("wind")):
        with pytest.raises(ContractError):
            p.transform(bad)
    for bad in (
        [("", "group_1", 1.0, 1.0, 1.0)], [("a", "g1", 1.0, 1.0, 1.0)], [("a", "group_1", 91.0, 1.0, 1.0)],
        [("a", "group_1", 1.0, 1.0, 0.0)], TURBINES[:1] * 2
    ):
        with pytest.raises(ContractError):
            pooling.fit_pooler(df, turbines(spark, bad), "gfs")
    for bad in ((), ("nearest", "nearest"), ("kriging",)):
        with pytest.raises(ContractError):
            pooling.fit_pooler(df, turbines(spark), "gfs", bad)
    with pytest.raises(ContractError):
        pooling.fit_pooler(df, turbines(spark), "gfs", power=0.0)


def test_imputer(spark):
    train = spark.createDataFrame([(1.0, 10.0), (3.0, None), (None, 30.0)], "a double, b double")
    m = impute.fit_median_imputer(train)
    assert m.medians == (2.0, 20.0)
    assert [
        tuple(r)
        for r in m.transform(spark.createDataFrame([(1000.0, None), (None, 3000.0)], "a double, b double")).collect()
    ] == [(1000.0, 20.0), (2.0, 3000.0)]
    with pytest.raises(ContractError):
        m.transform(train.select("b", "a"))
    for bad in (spark.createDataFrame([(None,)], "a double"), spark.createDataFrame([("x",)], "a string"), spark.createDataFrame([(math.inf,)], "a double")):
        with pytest.raises(ContractError):
            impute.fit_median_imputer(bad)


ANSWER = [(0, 2160.0, 2160.0, 2100.0), (1, 3000.0, 4000.0, 2500.0), (2, 1000.0, 8000.0, 22000.0), (3, None, 1200.0, None)]
FORECASTS = [(0, 2160.0, 3456.0, 3360.0), (1, 4296.0, 5728.0, 4180.0), (2, 1000.0, -100.0, 23000.0), (3, 500.0, 1200.0, 500.0)]


def _plain(answer, forecasts):
    """The score in plain Python."""
    n, f = [], []
    for k, t in enumerate(schema.TARGETS, 1):
        cap = schema.CAPACITY[t]
        rows = [(a[k], p[k]) for a, p in zip(answer, forecasts, strict=True) if a[k] is not None and a[k] >= cap * 0.1]
        if not rows:
            return None, None, None
        e = [None if p is None else abs(p - a) / cap for a, p in rows]
        n.append(None if None in e else sum(e) / len(e))
        f.append(
            sum(a * (0 if x is None else 4 if x <= 0.06 else 3 if x <= 0.08 else 0) for (a, _), x in zip(rows, e, strict=True)) / sum(4 * a for a, _ in rows)
        )
    one = None if None in n else 1 - sum(n) / 3
    return (None if one is None else 0.5 * one + 0.5 * sum(f) / 3), one, sum(f) / 3


@pytest.mark.parametrize("lost", [None, (1, 1), "all"])
def test_metric(spark, lost):
    answer = [(k, None, b, c) for k, _, b, c in ANSWER] if lost == "all" else ANSWER
    forecasts = [tuple(None if (i, j) == lost else v for j, v in enumerate(r)) for i, r in enumerate(FORECASTS)] if lost != "all" else FORECASTS
    kind = "k int, " + ", ".join(f"{t} double" for t in schema.TARGETS)
    got = scoring.metric(spark.createDataFrame(answer, kind), spark.createDataFrame(forecasts[::-1], kind), "k")
    want = _plain(answer, forecasts)
    assert [x if x is None else pytest.approx(x, abs=1e-12) for x in want] == list(got)


def _training(spark, n=60):
    labels = spark.createDataFrame([(h, 5000.0 + 100 * k, 6000.0 + 50 * k, None if k < 10 else 7000.0) for k, h in enumerate(hours(n))], schema.LABELS)
    return labels, forecast(spark, n=n, cells=2), forecast(spark, n=n, cells=2, lead=13)


def test_baseline_end_to_end(spark, tmp_path):
    labels, ldaps, gfs = _training(spark)
    sample = spark.createDataFrame([(f"forecast_{k:04d}", f"{h:%Y-%m-%d %H:%M:%S}", 0.0, 0.0, 0.0) for k, h in enumerate(hours(20), 1)], schema.SUBMISSION)
    small = {"numTrees": 5, "maxDepth": 3, "minInstancesPerNode": 2}
    made = baseline.train_and_infer(labels, ldaps, gfs, sample, ldaps, gfs, small)
    assert made["bundle"].train_rows == dict(zip(schema.TARGETS, (60, 60, 50), strict=True)) and made["bundle"].features[:9] == baseline.CALENDAR
    sub = made["submission"].orderBy("forecast_id")
    assert submission.validate(sub, sample, rows=20).ok
    again = baseline.train_and_infer(labels, ldaps, gfs, sample, ldaps, gfs, small)["submission"]
    assert submission.canonical_bytes(sub) == submission.canonical_bytes(again)
    with pytest.raises(ContractError):
        baseline.predict(made["bundle"], sample, ["forecast_id"])

    profile = runs.data_profile(labels, ldaps, gfs, made["train_features"], list(made["bundle"].features))
    model, meta, registry = (str(tmp_path / x) for x in ("model", "meta.json", "registry.csv"))
    config = lineage.RunConfig("first try", model_params=small)
    doc = lineage.save_artifact(
        made["bundle"], model, meta, config=config, profile=profile, commit="abcdef0123", manifest_sha="a" * 64, at="2024-05-01T10:00:00"
    )
    assert doc["run"]["id"].startswith("20240501T100000-first-try-")
    book = lineage.Registry(spark, registry)
    book.append(lineage.registry_entry(spark, doc, model, meta))
    with pytest.raises(ContractError, match="registered"):
        book.append(lineage.registry_entry(spark, doc, model, meta))
    with pytest.raises(ContractError, match="exists"):
        lineage.save_artifact(made["bundle"], model, meta, config=config, profile=profile, commit="abcdef0123", manifest_sha="a" * 64)
    bundle, _ = lineage.load_registered(spark, model, meta, registry)
    rows, _ = baseline.inference_features(sample, baseline.baseline_weather(ldaps, gfs))
    assert submission.canonical_bytes(baseline.build_submission(sample, baseline.predict(bundle, rows, ["forecast_id"]))) == submission.canonical_bytes(sub)

    out = str(tmp_path / "sub.csv")
    record = lambda sha: book.record_submission(doc["run"]["id"], "sub.csv", sha, 20, "utf-8-sig")
    sha = submission.write_validated(sub, sample, out, rows=20, after=record)
    assert sha == submission.sha256(open(out, "rb").read()) and sorted(os.listdir(tmp_path)) == ["meta.json", "model", "registry.csv", "sub.csv"]
    row = book.frame().first()
    assert (row.csv_hash, row.csv_rows, row.state, row.seed, row.chosen) == (sha, 20, "submission_validated", 42, False)
    with pytest.raises(ContractError, match="exists"):
        submission.write_validated(sub, sample, out, rows=20)
    other = str(tmp_path / "other.csv")
    with pytest.raises(ContractError):
        submission.write_validated(sub, sample, other, rows=20, after=record)
    assert not os.path.exists(other)

    tampered = json.loads(open(meta).read())
    tampered["config"]["seed"] = 1
    open(meta, "w").write(lineage.canonical_json(tampered) + "\n")
    with pytest.raises(ContractError, match="document's hash"):
        lineage.load_registered(spark, model, meta, registry)
    with pytest.raises(ContractError, match="hash of config"):
        lineage.load_artifact(spark, model, meta)
    open(f"{model}/bundle.json", "a").write(" ")
    with pytest.raises(ContractError, match="model's hash"):
        lineage.load_registered(spark, model, meta, registry)
    row = lineage.ledger_frame(spark, [lineage.ledger_entry(config, sub, "abcdef0123", "a" * 64, at="2024-05-01", board_score=0.5)]).first()
    assert (row.csv_rows, row.board_score, row.csv_hash, row.seed) == (20, 0.5, sha, 42)
    assert lineage.verify_repeats(lambda: sub)["is_reproducible"]


def test_merge_kinds(spark):
    a, b = forecast(spark, n=4, cells=2), forecast(spark, n=2, cells=2)
    assert baseline.baseline_weather(a, b).count() == 4 and baseline.baseline_weather(a, b, how="inner", lead=False).count() == 2


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda d: d.select("forecast_kst_dtm", "forecast_id", *schema.TARGETS), "columns"),
        (lambda d: d.filter("forecast_id <> 'f3'"), "rows"),
        (lambda d: d.withColumn("forecast_id", F.when(F.col("forecast_id") == "f2", "x").otherwise(F.col("forecast_id"))), "forecast_id: row 2"),
        (lambda d: d.withColumn("forecast_kst_dtm", F.lit("t")), "forecast_kst_dtm: row 0"),
        (lambda d: d.withColumn("kpx_group_1", F.lit(float("nan"))), "missing"),
        (lambda d: d.withColumn("kpx_group_2", F.lit(-1.0)), "negative"),
        (lambda d: d.withColumn("kpx_group_3", F.lit(21000.5)), "over capacity"),
    ],
)
def test_broken_submissions(spark, change, said):
    good = spark.createDataFrame([(f"f{k}", f"t{k}", 1.0, 2.0, 3.0) for k in range(5)], schema.SUBMISSION).coalesce(1)
    assert submission.validate(good, good, rows=5).ok
    report = submission.validate(change(good), good, rows=5)
    assert not report.ok and any(said in e for e in report.errors)


def test_lineage_texts():
    assert lineage.canonical_json({"b": {2, 1}, "a": "é", "d": dt.date(2024, 1, 2)}) == '{"a":"é","b":[1,2],"d":"2024-01-02"}'
    assert lineage.kst("2024-01-01T00:00:00+00:00") == "2024-01-01T09:00:00+09:00" and lineage.kst("2024-01-01") == "2024-01-01T00:00:00+09:00"
    assert lineage.submission_filename("a b!", "0123456789", "2024-03-04") == "submission_20240304_a-b_0123456.csv"
    for bad in ("soon", None.__class__, 3):
        with pytest.raises(ContractError):
            lineage.kst(bad)
    with pytest.raises(ContractError):
        lineage.slugify("!!")
    for bad in ({"total_score": 1.0}, {"total_score": 1.0, "one_minus_nmae": math.nan, "ficr": 1.0}):
        with pytest.raises(ContractError):
            lineage.check_validation(bad)


def test_sources(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text("﻿kst_dtm,kpx_group_1,kpx_group_2,kpx_group_3\n2022-01-01 01:00:00,1.5,,NaN\n", encoding="utf-8")
    r = files.read_csv(spark, str(p), schema.LABELS).first()
    assert (r.kst_dtm, r.kpx_group_1, r.kpx_group_2, r.kpx_group_3) == (dt.datetime(2022, 1, 1, 1), 1.5, None, None)
    p.write_text("kst_dtm,kpx_group_2,kpx_group_1,kpx_group_3\n2022-01-01 01:00:00,1.5,,3\n")
    with pytest.raises(Exception):  # noqa: B017  (Spark's own error)
        files.read_csv(spark, str(p), schema.LABELS).collect()
    made = files.fingerprints(spark, {"labels": str(p)}).first()
    assert made["bytes"] == p.stat().st_size and made["sha256"] == submission.sha256(p.read_bytes())
    with pytest.raises(FileNotFoundError):
        files.fingerprints(spark, {"x": str(tmp_path / "none")})
    m = tmp_path / "M.md"
    m.write_text(f"| path | bytes | sha |\n|-|-|-|\n| `{p}` | {p.stat().st_size:,} | `{made['sha256']}` |\n| `gone` | 1 | `{'0' * 64}` |\n")
    audited = {r.path: r.ok for r in files.manifest_audit(files.read_manifest(spark, str(m)), files.fingerprints(spark, {"labels": str(p)})).collect()}
    assert audited == {str(p): True, "gone": False}
    nb = tmp_path / "n.ipynb"
    nb.write_text(json.dumps({"cells": [{"cell_type": "code", "execution_count": 1, "outputs": [{"output_type": "stream"}]}, {"cell_type": "markdown"}]}))
    r = files.notebook_stats(spark, str(nb)).first()
    assert (r.cells, r.code_cells, r.markdown_cells, r.executed, r.with_output, r["errors"]) == (2, 1, 1, 1, 1, 0)


def test_scalars(spark):
    df = spark.createDataFrame([("37°15'30\"N",), ("128.5°W",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.dms(F.col("t"))).collect()] == [pytest.approx(37.2583333), -128.5, None, None]
    with pytest.raises(Exception, match="not a coordinate"):  # noqa: B017
        df.select(scalars.dms(F.col("t"), strict=True)).collect()
    km = spark.range(1).select(scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert km == pytest.approx(math.pi * 6371.0088)


def test_layout_does_not_matter(spark):
    df = forecast(spark, n=8)
    a = audit.content_hash(grid.aggregate_grid(df, "gfs", ("min", "max"))).first()
    b = audit.content_hash(grid.aggregate_grid(df.repartition(7).orderBy(F.desc(schema.GRID)), "gfs", ("min", "max"))).first()
    assert a == b
    assert audit.fixed_sample(df, [schema.GRID, schema.FORECAST], 5).collect() == audit.fixed_sample(
        df.repartition(5), [schema.GRID, schema.FORECAST], 5
    ).collect()


def test_command_line(spark, tmp_path, capsys):
    assert runs.main(["train"]) == 0 and "--run" in capsys.readouterr().out
    with pytest.raises(ContractError, match="missing"):
        runs.main(["infer", "--run"])
    labels, ldaps, gfs = _training(spark)
    files_ = {"labels": labels, "ldaps": ldaps, "gfs": gfs}
    for name, df in files_.items():
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False, encoding="utf-8-sig", date_format="%Y-%m-%d %H:%M:%S")
    pd.DataFrame(
        [(f"forecast_{k:04d}", f"{h:%Y-%m-%d %H:%M:%S}", 0.0, 0.0, 0.0) for k, h in enumerate(hours(20), 1)],
        columns=schema.SUBMISSION_COLUMNS
    ).to_csv(tmp_path / "sample.csv", index=False)
    (tmp_path / "MANIFEST.md").write_text("| path |\n")
    at = lambda n: str(tmp_path / n)
    weather = ["--ldaps", at("ldaps.csv"), "--gfs", at("gfs.csv"), "--model", at("model"), "--registry", at("runs.csv")]
    command = [
        "train", "--run", "--labels", at("labels.csv"), *weather, "--data-manifest", at("MANIFEST.md"), "--trees", "3", "--commit", "abc",
        "--created-at", "2024-05-01T10:00:00"
    ]
    with pytest.raises(ContractError, match="together"):
        runs.main([*command, "--total-score", "0.5"])
    with pytest.raises(ContractError, match="different paths"):
        runs.main([*command, "--metadata", at("runs.csv")])
    assert not os.path.exists(at("model"))
    assert runs.main(
        [*command, "--split", "2024", "--holdout-from", "2024-01-01 01:00:00", "--total-score", "0.5", "--one-minus-nmae", "0.8", "--ficr", "0.2"]
    ) == 0
    row = lineage.Registry(spark, at("runs.csv")).frame().first()
    raw = open(at("model.json"), "rb").read()
    assert (
        row.state, row.total_score, row.split, row.holdout_from, row.fit_from, row.created
    ) == ("trained", 0.5, "2024", "2024-01-01 01:00:00", None, "2024-05-01T10:00:00+09:00")
    assert row.document_hash == submission.sha256(raw) and row.manifest_hash == submission.sha256(b"| path |\n") and row.model_hash == json.loads(raw)["model"]["hash"]
    command = ["infer", "--run", "--sample", at("sample.csv"), *weather, "--rows", "20", "--out"]
    with pytest.raises(ContractError, match="different paths"):
        runs.main([*command, at("runs.csv")])
    assert runs.main([*command, at("sub.csv")]) == 0
    row = lineage.Registry(spark, at("runs.csv")).frame().first()
    assert (row.state, row.csv, row.csv_rows, row.csv_hash) == ("submission_validated", "sub.csv", 20, submission.sha256(open(at("sub.csv"), "rb").read()))
    with pytest.raises(ContractError, match="exists"):
        runs.main([*command, at("sub.csv")])


def test_stream_of_blocks(spark, tmp_path):
    for k in range(2):
        forecast(spark, n=3).withColumn(
            schema.FORECAST, (F.col(schema.FORECAST) + F.expr(f"INTERVAL {k * 3} HOURS"))
        ).withColumn(schema.AVAILABLE, F.col(schema.FORECAST) - F.expr("INTERVAL 12 HOURS")).write.parquet(str(tmp_path / f"in/b{k}"))
    s = blocks.grid_stream(spark, str(tmp_path / "in/*"), schema.weather(["wind", "temperature"]), "gfs", files=1)
    q = s.writeStream.outputMode("complete").format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("blocks").collect()
    assert len(rows) == 6 and all(r.complete and r["rows"] == 9 and r.late_rows == 0 for r in rows)


def test_exact_medians(spark):
    rng = np.random.default_rng(4)
    n = 3001
    frame = pd.DataFrame(
        {
            "a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float),
            "c": np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n)), "d": np.nan,
            "e": np.where(np.arange(n) < 2, [1.0, 4.0] + [0.0] * (n - 2), np.nan)
        }
    )
    df = nulls.nan_to_null(spark.createDataFrame(frame).repartition(5))
    for accuracy in (10_000, 20):  # with a coarse sketch many values lie between the bounds
        got = impute.exact_medians(df, list(frame.columns), accuracy)
        assert got["d"] is None and all(got[c] == pytest.approx(frame[c].median(), abs=1e-12) for c in "abce")


def test_upwind_pooling(spark):
    cells = spark.createDataFrame(
        [(START, START - dt.timedelta(hours=12), k, 37.0, 127.0 + k / 10, 10.0 * k, 1.0, 0.0) for k in (-1, 0, 1)],
        [*schema.META, "x", "s", "c"]
    )
    turbines = spark.createDataFrame([("t", "group_1", 37.0, 127.05, 2.0)], schema.TURBINES)
    pooler = pooling.fit_pooler(cells, turbines, "ldaps", "idw", power=1.0)
    r = pooling.pool_upwind(cells, pooler, turbines, "s", "c", "x", lean=0.5).first()
    w = {k: v for _, _, k, v in pooler.weights}
    upwind = {k: v * (1 + 0.5 * (1 if 0.1 * k > 0.05 else -1)) for k, v in w.items()}  # wind from the east
    assert r.plain == pytest.approx(sum(10 * k * v for k, v in w.items())) and r.pooled == pytest.approx(
        sum(10 * k * v for k, v in upwind.items()) / sum(upwind.values())
    ) and r.pooled > r.plain
    with pytest.raises(ContractError):
        pooling.pool_upwind(cells, pooler, turbines, "s", "c", "x", lean=1.0)


def test_feature_set_experiment(spark):
    labels, ldaps, gfs = _training(spark)
    rows, features = baseline.training_features(labels, baseline.baseline_weather(ldaps, gfs))
    fold = baseline.Fold(
        "half", ("2024-01-01 00:00:00", "2024-01-02 12:00:00"), ("2024-01-02 12:00:00", "2024-02-01 00:00:00"),
        later=((schema.TARGETS[1], "2024-01-01 11:00:00"),)
    )
    sets = {"all": dict.fromkeys(schema.TARGETS, features), "calendar": dict.fromkeys(schema.TARGETS, list(baseline.CALENDAR))}
    got = {(r.feature_set, r.target): r for r in baseline.run_feature_sets(rows, sets, fold, {"numTrees": 3, "maxDepth": 3}).collect()}
    assert set(got) == {(n, t) for n in sets for t in schema.TARGETS} and {r.features for r in got.values()} == {len(features), 9}
    held = {t: fold.of(rows, t)[1].filter(F.col(t).isNotNull()).count() for t in schema.TARGETS}
    assert all(r.valid_rows == held[t] and 0 <= r.nmae < 0.5 for (_, t), r in got.items())
    fit = {t: fold.of(rows, t)[0].filter(F.col(t).isNotNull()).count() for t in schema.TARGETS}
    assert all(r.fit_rows == fit[t] for (_, t), r in got.items()) and fit[schema.TARGETS[1]] < fit[schema.TARGETS[0]]


def test_blend_and_inventory(spark):
    a = spark.createDataFrame([(1, 2.0, 4.0, None), (2, 1.0, 1.0, 1.0)], "k int, kpx_group_1 double, kpx_group_2 double, kpx_group_3 double")
    b = spark.createDataFrame([(1, 4.0, 4.0, 1.0)], a.schema)
    rows = {r.k: r[1:] for r in baseline.blend([a, b], ["k"], [0.25, 0.75]).collect()}
    assert rows == {1: (3.5, 4.0, None), 2: (None, None, None)}
    with pytest.raises(ContractError):
        baseline.blend([a, b], ["k"], [0.5, 0.6])
    r = audit.file_inventory(forecast(spark, n=4, cells=2), "gfs", schema.FORECAST, [schema.FORECAST, schema.GRID]).first()
    assert (r.name, r["rows"], r["keys"], r.copies) == ("gfs", 8, 8, 0)

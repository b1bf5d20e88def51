"""Queries of contracts, sinks, files and column rules: each row says what came of a case, and SQL says what should."""

from __future__ import annotations

import io
import math
import re
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.functions import scalars
from zephyrlake.functions.nulls import finite
from zephyrlake.operators import audit, baseline, contracts, grid, impute, pooling, scoring, wind
from zephyrlake.operators.contracts import ContractError
from zephyrlake.plans import fixtures as fx
from zephyrlake.plans import lineage, submission
from zephyrlake.plans.catalog import query, r
from zephyrlake.plans.store import Store, sha256
from zephyrlake.schema import AVAILABLE, FORECAST, GRID, LABELS, LAT, LON, META, SUBMISSION, TARGETS
from zephyrlake.sources import files

REFUSED, ADMITTED = "refused", "admitted"


def outcome(run: Callable[[], object], count: bool = False) -> tuple[str, int | None]:
    """(refused or admitted, the first number that a refusal tells)."""
    try:
        run()
    except (ContractError, TypeError) as e:
        told = re.search(r"\d+", str(e)) if count else None
        return REFUSED, int(told[0]) if told else None
    return ADMITTED, None


class Cases:
    """Cases of one query: what is run, and the SQL of what should come of it."""

    def __init__(self, name: str, tables: str):
        self.cases: list[tuple[str, str, Callable, str]] = []
        self.name, self.tables = name, tables

    def add(self, item: str, what: str, said: str, run: Callable, n: str | None = None) -> None:
        """run(spark, sf_dir) is refused or admitted; n is SQL for the number that the refusal tells."""
        self.cases.append(
            (item, what, lambda s, d: outcome(lambda: run(s, d), n is not None), f"SELECT '{item}' AS item, '{what}' AS what, '{said}' AS said, CAST({n or 'NULL'} AS BIGINT) AS n")
        )

    def register(self) -> None:
        sql = f"WITH {self.tables} " + " UNION ALL ".join(c[3] for c in self.cases)

        @query(self.name, sql)
        def _(s, d):
            return s.createDataFrame([(item, what, *run(s, d)) for item, what, run, _ in self.cases], "item string, what string, said string, n long")


# --- contracts K1-K21 ---

K = Cases("contracts", f"{fx.grid_sql(16)}, {fx.turbines_sql()}")
H7_FORECASTS = "(SELECT count(DISTINCT forecast_kst_dtm) FROM grid WHERE extract('hour' FROM forecast_kst_dtm) = 7)"
FORECASTS = "(SELECT count(DISTINCT forecast_kst_dtm) FROM grid)"


def _where(c, then, other):
    return F.when(c, then).otherwise(other)


def _h7():
    return F.hour(FORECAST) == 7


def _lat(df: DataFrame, c, value) -> DataFrame:
    return df.withColumn(LAT, _where(c, F.lit(value).cast("double"), F.col(LAT)))


def _moved(df: DataFrame, c, hours: int) -> DataFrame:
    return df.withColumn(AVAILABLE, _where(c, F.col(AVAILABLE) + F.make_dt_interval(hours=F.lit(hours)), F.col(AVAILABLE)))


for _s, _ok in (("ecmwf", REFUSED), ("", REFUSED), ("gfs", ADMITTED)):
    K.add("K1", f"source {_s}", _ok, lambda s, d, x=_s: contracts.check_source(x))
for _what, _stats, _ddof, _ok in (
    ("none", (), 0, REFUSED), ("twice", ("mean", "mean"), 0, REFUSED), ("unknown", ("median",), 0, REFUSED), ("ddof under 0", "mean", -1, REFUSED),
    ("ddof a truth value", "mean", True, REFUSED), ("ddof a part", "mean", 0.5, REFUSED), ("one text", "mean", 1, ADMITTED),
):
    K.add("K2", _what, _ok, lambda s, d, x=_stats, n=_ddof: contracts.check_statistics(x, n))
K.add("K3", "no frame", REFUSED, lambda s, d: contracts.check_columns([1], ["a"]))
K.add("K3", "no rows", REFUSED, lambda s, d: contracts.check_grid(fx.grid(s, d).filter("false"), "ldaps"))
K.add("K3", "column twice", REFUSED, lambda s, d: contracts.check_grid(fx.grid(s, d).select("*", "u"), "ldaps"))
K.add("K3", "no latitude", REFUSED, lambda s, d: contracts.check_grid(fx.grid(s, d).drop(LAT), "ldaps"))
K.add("K3", "no value column", REFUSED, lambda s, d: contracts.check_grid(fx.grid(s, d).select(*META), "ldaps"))
K.add("K3", "whole", ADMITTED, lambda s, d: contracts.check_grid(fx.grid(s, d), "ldaps"))
K.add("K4", "places missing", REFUSED, lambda s, d: contracts.check_grid(_lat(fx.grid(s, d), (F.col(GRID) == 3) & _h7(), None), "ldaps"), H7_FORECASTS)
_LATE = "(SELECT count(*) FROM grid WHERE grid_id = 2 AND data_available_kst_dtm + INTERVAL 40 HOUR > forecast_kst_dtm)"
K.add("K5", "late", REFUSED, lambda s, d: contracts.check_grid(_moved(fx.grid(s, d), F.col(GRID) == 2, 40), "ldaps"), _LATE)
K.add("K5", "late, light path", REFUSED, lambda s, d: baseline.baseline_weather(_moved(fx.grid(s, d), F.col(GRID) == 2, 40), fx.grid(s, d, 9)), _LATE)
K.add("K5", "day ahead", REFUSED, lambda s, d: contracts.check_cutoff(_moved(fx.grid(s, d), F.col(GRID) == 2, 12), day_ahead=True),
      "(SELECT count(*) FROM grid WHERE data_available_kst_dtm + CASE WHEN grid_id = 2 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END > date_trunc('day', forecast_kst_dtm) - INTERVAL 10 HOUR)")
K.add("K6", "two leads", REFUSED, lambda s, d: contracts.check_grid(_moved(fx.grid(s, d), F.col(GRID) == 1, -1), "ldaps"), FORECASTS)
K.add("K7", "long lead", REFUSED, lambda s, d: contracts.check_grid(_moved(fx.grid(s, d), _h7(), -30), "ldaps"), H7_FORECASTS)
K.add("K8", "cell missing", REFUSED, lambda s, d: contracts.check_grid(fx.grid(s, d).filter(~((F.col(GRID) == 3) & _h7())), "ldaps"), H7_FORECASTS)
K.add("K8", "cells of another source", REFUSED, lambda s, d: contracts.check_grid(fx.grid(s, d), "gfs"), FORECASTS)
K.add(
    "K9", "cell twice", REFUSED, lambda s, d: contracts.check_grid(
        fx.grid(s, d).unionByName(fx.grid(s, d).filter((F.col(GRID) == 4) & _h7())), "ldaps"
    ), H7_FORECASTS
)
K.add(
    "K9", "key twice", REFUSED, lambda s, d: contracts.check_unique(
        fx.grid(s, d).unionByName(fx.grid(s, d).filter((F.col(GRID) == 4) & _h7())), [FORECAST, GRID], "grid"
    ), H7_FORECASTS
)
for _what, _prefixes in (("one", ("a",)), ("equal", ("a", "a")), ("capital", ("A", "b")), ("blank", ("", "b"))):
    K.add("K10", f"prefixes {_what}", REFUSED, lambda s, d, x=_prefixes: grid.weather_features(fx.grid(s, d), fx.grid(s, d, 9), prefixes=x, strict=False))
K.add(
    "K10", "names clash", REFUSED, lambda s, d: grid.merge_sources(
        grid.aggregate_grid(fx.grid(s, d), "ldaps", strict=False),
        grid.aggregate_grid(fx.grid(s, d, 9), "gfs", prefix="ldaps", strict=False)
    )
)
K.add("K10", "prefixes", ADMITTED, lambda s, d: grid.weather_features(fx.grid(s, d), fx.grid(s, d, 9), prefixes=("a", "b1_"), strict=False))
K.add(
    "K11", "times differ", REFUSED, lambda s, d: grid.merge_sources(
        grid.aggregate_grid(fx.grid(s, d), "ldaps", strict=False), grid.aggregate_grid(fx.grid(s, d).filter(~_h7()), "gfs", strict=False),
        check_axes=True
    ), H7_FORECASTS
)
K.add(
    "K11", "times agree", ADMITTED, lambda s, d: grid.merge_sources(
        grid.aggregate_grid(fx.grid(s, d), "ldaps", strict=False), grid.aggregate_grid(fx.grid(s, d), "gfs", strict=False), check_axes=True
    )
)
K.add(
    "K12", "test lacks a column", REFUSED, lambda s, d: grid.weather_feature_pair(
        (fx.grid(s, d), fx.grid(s, d).drop("t")), (fx.grid(s, d, 9), fx.grid(s, d, 9)), strict=False
    )
)
K.add(
    "K12", "other order", REFUSED, lambda s, d: grid.weather_feature_pair(
        (fx.grid(s, d), fx.grid(s, d).select(*META, "v", "u", "t")), (fx.grid(s, d, 9), fx.grid(s, d, 9)), strict=False
    )
)
K.add("K13", "no columns", REFUSED, lambda s, d: impute.fit_median_imputer(fx.grid(s, d).select()))
K.add("K13", "column twice", REFUSED, lambda s, d: impute.fit_median_imputer(fx.grid(s, d), ["u", "u"]))
K.add("K13", "text", REFUSED, lambda s, d: impute.fit_median_imputer(fx.grid(s, d).select("u", F.lit("x").alias("x"))))
K.add("K13", "no values", REFUSED, lambda s, d: impute.fit_median_imputer(fx.grid(s, d).select("u", F.lit(None).cast("double").alias("x"))))
K.add("K13", "infinite", REFUSED, lambda s, d: impute.fit_median_imputer(fx.grid(s, d).select("u", F.lit(math.inf).alias("x"))))
K.add("K13", "other order", REFUSED, lambda s, d: impute.fit_median_imputer(fx.grid(s, d).select("u", "v")).transform(fx.grid(s, d).select("v", "u")))
K.add(
    "K13", "nothing missing after", ADMITTED, lambda s, d: contracts.require(
        impute.fit_median_imputer(fx.grid(s, d).select("u", "v")).transform(fx.grid(s, d).select("u", "v")).filter("u is null or v is null").isEmpty(),
        "gaps"
    )
)
PAIR = wind.WindPair("10m", "u", "v")
for _what, _pairs in (
    ("none", ()), ("no column", (wind.WindPair("a", "u", "w"),)), ("one column", (wind.WindPair("a", "u", "u"),)),
    ("name", (wind.WindPair("A b", "u", "v"),)), ("equal names", (PAIR, PAIR))
):
    K.add("K14", f"pairs {_what}", REFUSED, lambda s, d, x=_pairs: wind.check_pairs(fx.grid(s, d), x))
K.add("K14", "output is there", REFUSED, lambda s, d: wind.check_pairs(fx.grid(s, d).withColumn(PAIR.outputs[0], F.lit(1.0)), (PAIR,)))
K.add(
    "K14", "infinite", REFUSED, lambda s, d: wind.check_pairs(
        fx.grid(s, d).withColumn("u", _where((F.col(GRID) == 3) & _h7(), F.lit(math.inf), F.col("u"))), (PAIR,)
    ), H7_FORECASTS
)
for _what, _calm in (("not a number", math.nan), ("under 0", -1.0), ("truth value", True)):
    K.add("K14", f"calm {_what}", REFUSED, lambda s, d, x=_calm: wind.wind_vectors(fx.grid(s, d), "ldaps", (PAIR,), calm=x))
K.add("K14", "pair", ADMITTED, lambda s, d: wind.check_pairs(fx.grid(s, d), (PAIR,)))
_T = lambda c, v: lambda s, d: contracts.check_turbines(fx.turbines(s).withColumn(c, v()))
_G3 = lambda then, c: _where(F.col("group_id") == "group_3", F.lit(then), F.col(c))
K.add("K15", "no capacity", REFUSED, lambda s, d: contracts.check_turbines(fx.turbines(s).drop("capacity_mw")))
K.add("K15", "no rows", REFUSED, lambda s, d: contracts.check_turbines(fx.turbines(s).limit(0)))
K.add("K15", "blank ids", REFUSED, _T("turbine_id", lambda: _G3(" ", "turbine_id")), "(SELECT count(*) FROM turbines WHERE group_id = 'group_3')")
K.add("K15", "id twice", REFUSED, _T("turbine_id", lambda: F.lit("a")))
K.add("K15", "group", REFUSED, _T("group_id", lambda: F.lit("g1")), "(SELECT count(*) FROM turbines)")
K.add("K15", "place", REFUSED, _T(LAT, lambda: _G3(95.0, LAT)), "(SELECT count(*) FROM turbines WHERE group_id = 'group_3')")
K.add("K15", "capacity", REFUSED, _T("capacity_mw", lambda: _G3(0.0, "capacity_mw")), "(SELECT count(*) FROM turbines WHERE group_id = 'group_3')")
K.add("K15", "capacity a text", REFUSED, _T("capacity_mw", lambda: F.lit("3")))
K.add("K15", "turbines", ADMITTED, lambda s, d: contracts.check_turbines(fx.turbines(s)))
for _what, _methods in (("none", ()), ("twice", ("idw", "idw")), ("unknown", ("spline",))):
    K.add("K16", f"methods {_what}", REFUSED, lambda s, d, x=_methods: pooling.check_methods(x))
for _what, _power in (("0", 0.0), ("not a number", math.nan), ("truth value", True), ("text", "2")):
    K.add("K16", f"power {_what}", REFUSED, lambda s, d, x=_power: pooling.fit_pooler(fx.grid(s, d), fx.turbines(s), "ldaps", power=x))
K.add(
    "K17", "out of range", REFUSED, lambda s, d: pooling.grid_geometry(
        _lat(fx.grid(s, d), F.col(GRID) == 3, 95.0)
    ), "(SELECT count(*) FROM grid WHERE grid_id = 3)"
)
K.add(
    "K17", "moving", REFUSED, lambda s, d: pooling.grid_geometry(
        fx.grid(s, d).withColumn(LAT, _where(_h7(), F.col(LAT) + 0.1, F.col(LAT)))
    ), "(SELECT count(DISTINCT grid_id) FROM grid)"
)
_P = lambda s, d: pooling.fit_pooler(fx.grid(s, d), fx.turbines(s), "ldaps")
K.add("K18", "other order", REFUSED, lambda s, d: _P(s, d).transform(fx.grid(s, d).select(*META, "v", "u", "t")))
K.add("K18", "other cells", REFUSED, lambda s, d: _P(s, d).transform(fx.grid(s, d).filter(F.col(GRID) != 3)))
K.add("K18", "other places", REFUSED, lambda s, d: _P(s, d).transform(fx.grid(s, d).withColumn(LON, F.col(LON) + 1e-9)))
K.add("K18", "as fitted", ADMITTED, lambda s, d: _P(s, d).transform(fx.grid(s, d)))


def _unchanged(s: SparkSession, d: str) -> None:
    df = fx.grid(s, d)
    before, names = audit.content_hash(df).first(), list(df.columns)
    grid.aggregate_grid(wind.wind_vectors(df, "ldaps", (PAIR,)), "ldaps", "mean")
    _P(s, d).transform(df)
    contracts.require(df.columns == names and audit.content_hash(df).first() == before, "an input changed")


K.add("K19", "inputs stay", ADMITTED, _unchanged)
SAMPLE = [(f"f{k}", f"2025-01-01 {k:02d}:00:00", 1.0, 2.0, 3.0) for k in range(5)]
_BROKEN = {
    "columns": lambda f: f.select(FORECAST, "forecast_id", *TARGETS),
    "rows": lambda f: f.filter("forecast_id <> 'f3'"),
    "ids": lambda f: f.withColumn("forecast_id", _where(F.col("forecast_id") == "f2", F.lit("x"), F.col("forecast_id"))),
    "times": lambda f: f.withColumn(FORECAST, F.lit("t")),
    "missing": lambda f: f.withColumn(TARGETS[0], _where(F.col("forecast_id") < "f2", F.lit(math.nan), F.lit(1.0))),
    "negative": lambda f: f.withColumn(TARGETS[1], F.lit(-1.0)),
    "over capacity": lambda f: f.withColumn(TARGETS[2], F.lit(21000.5)),
}


def _sample(s: SparkSession) -> DataFrame:
    return s.createDataFrame(SAMPLE, SUBMISSION).coalesce(1)


for _what, _n in (("columns", None), ("rows", "4"), ("ids", "2"), ("times", "0"), ("missing", None), ("negative", None), ("over capacity", None)):
    _tell = {"rows": r"got (\d+)", "ids": r"row (\d+)", "times": r"row (\d+)"}.get(_what)

    def _broken(s, d, what=_what):
        report = submission.validate(_BROKEN[what](_sample(s)), _sample(s), rows=5)
        told = [e for e in report.errors if re.search({"ids": "forecast_id", "times": FORECAST, "missing": "missing"}.get(what, what), e)]
        raise ContractError(re.sub(r"expected \d+, got|.*row ", "", told[0]) if told else "nothing was said") if not report.ok else AssertionError(what)

    K.add("K20", _what, REFUSED, _broken, _n)
K.add("K20", "whole", ADMITTED, lambda s, d: submission.require_valid(_sample(s), _sample(s), rows=5))
K.add(
    "K20", "all faults at once", REFUSED, lambda s, d: contracts.require(
        False,
        str(len(submission.validate(_BROKEN["negative"](_BROKEN["over capacity"](_BROKEN["times"](_sample(s)))), _sample(s), rows=5).errors))
    ), "3"
)
K.add("K21", "encoding", REFUSED, lambda s, d: submission.canonical_bytes(_sample(s), "latin-1"))
K.add("K21", "encodings", ADMITTED, lambda s, d: [submission.canonical_bytes(_sample(s), e) for e in ("utf-8", "utf-8-sig")])
K.register()


# --- sinks, artifacts and lineage ---


@contextmanager
def workplace(s: SparkSession):
    """A new folder on the warehouse's file system, for files that go again."""
    path, store = f"{s.conf.get('spark.sql.warehouse.dir')}/zephyrlake-{uuid.uuid4().hex}", Store(s)
    try:
        yield path, store
    finally:
        store.remove(path)


def _numbered(s: SparkSession, d: str) -> DataFrame:
    """The labels as a submission: ids by hour, whole cents, gaps as 500."""
    y = [F.coalesce(F.floor(F.col(t) * 100) / 100.0, F.lit(500.0)).alias(t) for t in TARGETS]
    return fx.labels(s, d).select(F.format_string("forecast_%05d", "f").alias("forecast_id"), F.col("kst_dtm").alias(FORECAST), *y)


_CSV = f"""{fx.labels_sql()},
lines AS (SELECT f, printf('forecast_%05d', f) || ',' || strftime(kst_dtm, '%Y-%m-%d %H:%M:%S') || ',' || {" || ',' || ".join(f"CAST(coalesce(floor({t} * 100) / 100e0, 500e0) AS VARCHAR)" for t in TARGETS)} AS line FROM labels),
csv AS (SELECT 'forecast_id,forecast_kst_dtm,{','.join(TARGETS)}' || chr(10) || string_agg(line || chr(10), '' ORDER BY f) AS body, count(*) AS n FROM lines)"""
SMALL = {"numTrees": 2, "maxDepth": 2}
CONFIG = '{"experiment_id":"first try","model_params":{"maxDepth":2,"numTrees":2,"seed":42},"notes":"","seed":42}'
COMMIT, MANIFEST, AT = "abcdef0123456", "a" * 64, "2024-05-01T10:00:00"
_FEATURES = ("ldaps_u_mean", "ldaps_v_mean", "ldaps_t_mean", "ldaps_lead_hour")
_SCHEMA = '{"columns":["month","ldaps_u_mean"],"dtypes":{"ldaps_u_mean":"double","month":"int"}}'
_SINKS = [
    ("S1", "canonical CSV", "(SELECT sha256(chr(65279) || body) FROM csv)"),
    ("S1", "without mark", "(SELECT sha256(body) FROM csv)"),
    ("F1", "rows in any order", "(SELECT sha256(body) FROM csv)"),
    ("S2", "written", "(SELECT sha256(chr(65279) || body) FROM csv)"),
    ("S2", "written again", "'refused'"),
    ("S2", "after a failed record", "'gone'"),
    ("S3", "whole, alone in its folder", "'one 1'"),
    ("S3", "replaced", "'two 1'"),
    ("S3", "created again", "'refused'"),
    ("S4", "document is there", "'refused, model gone'"),
    ("S5", "document", "'canonical'"),
    ("S6", "registered", "'trained'"),
    ("S6", "with submission", "'submission_validated ' || (SELECT n FROM csv)"),
    ("G5", "second run", "'2 rows'"),
    ("S7", "ledger", "(SELECT sha256(chr(65279) || body) || ' ' || n FROM csv)"),
    ("S8", "configuration", f"sha256('{CONFIG}')"),
    ("S9", "preparation", "'{\"calendar\":9,\"gfs\":0,\"ldaps\":4}'"),
    ("A7", "loaded", "'admitted'"),
    ("A8", "loaded by registry", "'admitted'"),
    ("A8", "not registered", "'refused'"),
    ("A9", "document changed", "'refused'"),
    ("A9", "document spaced", "'refused'"),
    ("K22", "hash", "'refused'"),
    ("K22", "two scores", "'refused'"),
    ("K22", "score not a number", "'refused'"),
    ("K22", "run twice", "'refused'"),
    ("K22", "other columns", "'refused'"),
    ("K22", "model is there", "'refused'"),
    ("K22", "equal paths", "'refused'"),
    ("K23", "profile of other order", "'refused'"),
    ("K23", "bundle changed", "'refused'"),
    ("I19", "run", f"'20240501T100000-first-try-' || substr(sha256('{CONFIG}'), 1, 8) || '-abcdef0'"),
    ("I25", "canonical JSON", "'{\"a\":\"é\",\"b\":[1,2],\"d\":\"2024-01-02\"}'"),
    ("I27", "time", "'2024-05-01T10:00:00+09:00'"),
    ("I28", "feature schema", f"sha256('{_SCHEMA}')"),
    ("J8", "repeats", "'1 hash'"),
    ("J6", "template with a gap", "'refused'"),
    ("J7", "rows predicted", "'' || (SELECT n FROM csv)"),
]


@query("sinks", f"WITH {_CSV} " + " UNION ALL ".join(f"SELECT '{i}' AS item, '{w}' AS what, {said} AS said" for i, w, said in _SINKS))
def _(s, d):
    import datetime as dt

    out: list[tuple[str, str, str]] = []
    tell = lambda item, what, said: out.append((item, what, str(said)))
    tries = lambda item, what, run, more="": tell(item, what, outcome(run)[0] + more)
    rows = _numbered(s, d).persist()
    n = rows.count()
    with workplace(s) as (at, store):
        whole = submission.canonical_bytes(rows)
        tell("S1", "canonical CSV", sha256(whole))
        tell("S1", "without mark", sha256(submission.canonical_bytes(rows, "utf-8")))
        tell("F1", "rows in any order", sha256(submission.canonical_bytes(rows.repartition(5, TARGETS[0]), "utf-8")))
        capped = rows.select(
            "forecast_id", F.date_format(FORECAST, "yyyy-MM-dd HH:mm:ss").alias(FORECAST),
            *[F.least(F.col(t), F.lit(21000.0)).alias(t) for t in TARGETS]
        )
        sample = capped.orderBy("forecast_id")
        submission.write_validated(sample, sample, f"{at}/sub.csv", rows=n)
        store.create(f"{at}/own/sub.csv", whole)
        tell(
            "S2", "written",
            sha256(store.read(f"{at}/own/sub.csv")) if sha256(store.read(f"{at}/sub.csv")) == sha256(submission.canonical_bytes(sample)) else "other bytes"
        )
        tries("S2", "written again", lambda: submission.write_validated(sample, sample, f"{at}/sub.csv", rows=n))

        def fails(sha):
            raise ContractError("no")

        outcome(lambda: submission.write_validated(sample, sample, f"{at}/late.csv", rows=n, after=fails))
        tell("S2", "after a failed record", "there" if store.exists(f"{at}/late.csv") else "gone")
        names = lambda: s.read.format("binaryFile").load(f"{at}/alone").count()
        store.create(f"{at}/alone/a", b"one")
        tell("S3", "whole, alone in its folder", f"{store.read(f'{at}/alone/a').decode()} {names()}")
        store.replace(f"{at}/alone/a", b"two")
        tell("S3", "replaced", f"{store.read(f'{at}/alone/a').decode()} {names()}")
        tries("S3", "created again", lambda: store.create(f"{at}/alone/a", b"three"))

        # a small model of the labels, its document, and a registry
        config = lineage.RunConfig("first try", model_params=SMALL)
        weather = grid.aggregate_grid(fx.grid(s, d), "ldaps", include_lead=True, strict=False)
        train, features = baseline.training_features(fx.labels(s, d).drop("f"), weather)
        bundle = baseline.fit_forests(train, features, SMALL)
        profile = {
            "feature_matrix": {"rows": n, "feature_columns": features, "feature_schema_sha256": lineage.feature_schema_sha(train, features)},
            "labels": {"rows": n}
        }
        save = lambda model, doc, p=profile: lineage.save_artifact(
            bundle, f"{at}/{model}", f"{at}/{doc}", config=config, profile=p, commit=COMMIT, manifest_sha=MANIFEST, at=AT
        )
        document = save("model", "model.json")
        tries("S4", "document is there", lambda: save("other", "model.json"), f", model {'there' if store.exists(f'{at}/other') else 'gone'}")
        raw = store.read(f"{at}/model.json")
        tell(
            "S5", "document",
            "canonical" if raw == (lineage.canonical_json(document) + "\n").encode() and document["model"]["features"] == features else "not canonical"
        )
        book = lineage.Registry(s, f"{at}/runs.csv")
        entry = lineage.registry_entry(s, document, f"{at}/model", f"{at}/model.json")
        book.append(entry)
        run = document["run"]["id"]
        tell("S6", "registered", book.find(run)["state"])
        book.record_submission(run, "sub.csv", sha256(whole), n, "utf-8-sig")
        tell("S6", "with submission", f"{book.find(run)['state']} {book.find(run)['csv_rows']}")
        book.append(entry | {"run": "another"})
        tell("G5", "second run", f"{book.frame().count()} rows")
        row = lineage.ledger_frame(s, [lineage.ledger_entry(config, rows, COMMIT, MANIFEST, AT)]).first()
        tell("S7", "ledger", f"{row.csv_hash} {row.csv_rows}")
        tell("S8", "configuration", config.sha())
        tell("S9", "preparation", lineage.canonical_json(document["preparation"]["features"]["by_family"]))
        tries("A7", "loaded", lambda: lineage.load_artifact(s, f"{at}/model", f"{at}/model.json"))
        tries("A8", "loaded by registry", lambda: lineage.load_registered(s, f"{at}/model", f"{at}/model.json", f"{at}/runs.csv"))
        tries("A8", "not registered", lambda: lineage.load_registered(s, f"{at}/model", f"{at}/model.json", f"{at}/none.csv"))
        store.create(f"{at}/changed.json", raw.replace(b'"seed":42', b'"seed":43'))
        tries("A9", "document changed", lambda: lineage.load_artifact(s, f"{at}/model", f"{at}/changed.json"))
        store.create(f"{at}/spaced.json", raw.replace(b'"seed":42', b'"seed": 42'))
        tries("A9", "document spaced", lambda: lineage.load_artifact(s, f"{at}/model", f"{at}/spaced.json"))
        tries("K22", "hash", lambda: lineage.require_sha("a" * 63, "x"))
        tries("K22", "two scores", lambda: lineage.check_validation({"total_score": 1.0, "ficr": 1.0}))
        tries("K22", "score not a number", lambda: lineage.check_validation({"total_score": 1.0, "ficr": 1.0, "one_minus_nmae": math.nan}))
        tries("K22", "run twice", lambda: book.append(entry))
        store.create(f"{at}/odd.csv", b"a,b\n1,2\n")
        tries("K22", "other columns", lambda: lineage.Registry(s, f"{at}/odd.csv").append(entry))
        tries("K22", "model is there", lambda: save("model", "new.json"))
        tries("K22", "equal paths", lambda: save("new", "new"))
        turned = {"feature_matrix": profile["feature_matrix"] | {"feature_columns": features[::-1]}}
        tries("K23", "profile of other order", lambda: save("new", "new.json", turned))
        held = store.read(f"{at}/model/bundle.json")
        store.replace(f"{at}/model/bundle.json", held.replace(b'"month"', b'"Month"'))
        tries("K23", "bundle changed", lambda: lineage.load_artifact(s, f"{at}/model", f"{at}/model.json"))
        tell("I19", "run", run)
        tell("I25", "canonical JSON", lineage.canonical_json({"b": {2, 1}, "a": "é", "d": dt.date(2024, 1, 2)}))
        tell("I27", "time", lineage.kst(AT))
        tell("I28", "feature schema", lineage.feature_schema_sha(train, ["month", "ldaps_u_mean"]))
        template = rows.select("forecast_id", FORECAST)
        told, _ = baseline.inference_features(template, weather)
        predict = lambda: baseline.build_submission(template, baseline.predict(bundle, told, ["forecast_id"]))
        repeats = lineage.verify_repeats(predict)
        tell("J8", "repeats", f"{len(set(repeats['hashes']))} hash")
        tries(
            "J6", "template with a gap", lambda: baseline.build_submission(
                template, baseline.predict(bundle, told.filter("forecast_id > 'forecast_00003'"), ["forecast_id"])
            )
        )
        tell("J7", "rows predicted", predict().filter(" and ".join(f"{t} >= 0" for t in TARGETS)).count())
    rows.unpersist()
    return s.createDataFrame(out, "item string, what string, said string")


# --- files ---


@query("csv_scan", f"WITH {fx.labels_sql()} SELECT kst_dtm, {', '.join(f'{r(t)} AS {t}' for t in TARGETS)} FROM labels")
def _(s, d):
    """Labels written as a CSV with a byte order mark, and read back under their schema."""
    with workplace(s) as (at, store):
        lines = fx.labels(s, d).orderBy("kst_dtm").select(F.date_format("kst_dtm", "yyyy-MM-dd HH:mm:ss"), *TARGETS).collect()  # an hour each
        cell = lambda v: "" if v is None else v if isinstance(v, str) else repr(v)
        store.create(f"{at}/labels.csv", "".join(",".join(map(cell, x)) + "\n" for x in [("kst_dtm", *TARGETS), *lines]).encode("utf-8-sig"))
        return s.createDataFrame(files.read_csv(s, f"{at}/labels.csv", LABELS).collect(), LABELS)


_BOOK = [("1", "VESTAS", "1", "37°15'30\"N", "3.6"), (None, "VESTAS", "2", "37°15'00\"N", "3.6"), ("3", "UNISON", "1", "36°00'00\"S", "4.2")]


def _workbook() -> bytes:
    """A workbook of three turbines under a title, with a merged group, a blank row and shared texts."""
    texts = ["group", "vendor", "unit", "latitude", "MW", "VESTAS"]
    shared = lambda x: f'<c r="{{}}" t="s"><v>{texts.index(x)}</v></c>'
    inline = lambda x: f'<c r="{{}}" t="inlineStr"><is><t>{x}</t></is></c>'
    number = lambda x: f'<c r="{{}}"><v>{x}</v></c>'
    cells = {"A1": inline("turbines"), **{f"{c}3": shared(x) for c, x in zip("BCDEF", texts, strict=False)}}
    for row, x in zip((4, 5, 7), _BOOK, strict=True):
        cells |= {
            f"{c}{row}": shared(v) if v in texts else number(v) if re.fullmatch(r"[\d.]+", v) else inline(v.replace('"', "&quot;"))
            for c, v in zip("BCDEF", x, strict=True) if v is not None
        }
    by_row: dict[int, str] = {}
    for place, c in cells.items():
        by_row[int(place[1:])] = by_row.get(int(place[1:]), "") + c.format(place)
    main, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="info" sheetId="1" r:id="rId7"/></sheets></workbook>'
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>'
        )
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f"<worksheet {main}><sheetData>{''.join(f'<row r="{k}">{c}</row>' for k, c in sorted(by_row.items()))}</sheetData></worksheet>"
        )
    return out.getvalue()


_NOTE = '{"cells": [{"cell_type": "code", "execution_count": 1, "outputs": [{"output_type": "error"}]}, {"cell_type": "code", "outputs": []}, {"cell_type": "markdown"}]}'
_FILES = [
    ("A2", "columns read", "'kst_dtm,kpx_group_1 ' || (SELECT count(kpx_group_1) FROM labels)"),
    ("B11", "times of another form", "'refused'"),
    ("A1", "header of another order", "'refused'"),
    ("A3", "rows", "'3'"),
    ("A3", "merged groups", "'1,1,3'"),
    ("A3", "places", "'37.258333,37.250000,-36.000000'"),
    ("A3", "no such sheet", "'refused'"),
    ("A5", "fingerprint", "(SELECT octet_length(encode('zephyr é')) || ' ' || sha256('zephyr é'))"),
    ("A5", "no file", "'refused'"),
    ("A4", "manifest rows", "'2'"),
    ("A6", "audit", "'a true, gone false'"),
    ("A11", "notebook", "'3 cells, 2 code, 1 run, 1 with errors'"),
]


@query("file_sources", f"WITH {fx.labels_sql()} " + " UNION ALL ".join(f"SELECT '{i}' AS item, '{w}' AS what, {said} AS said" for i, w, said in _FILES))
def _(s, d):
    out: list[tuple[str, str, str]] = []
    tell = lambda item, what, said: out.append((item, what, str(said)))

    def fails(run) -> str:
        try:
            run()
        except Exception:  # Spark's own errors have many classes
            return REFUSED
        return ADMITTED

    with workplace(s) as (at, store):
        fx.labels(s, d).select(F.date_format("kst_dtm", "yyyy-MM-dd HH:mm:ss").alias("kst_dtm"), *TARGETS).write.option("header", True).csv(f"{at}/labels")
        some = files.read_csv(s, f"{at}/labels", LABELS, ["kst_dtm", TARGETS[0]])
        tell("A2", "columns read", f"{','.join(some.columns)} {some.filter(f'{TARGETS[0]} is not null').count()}")
        store.create(f"{at}/times.csv", f"kst_dtm,{','.join(TARGETS)}\n01/02/2024,1,2,3\n".encode())
        tell("B11", "times of another form", fails(lambda: files.read_csv(s, f"{at}/times.csv", LABELS).collect()))
        store.create(f"{at}/order.csv", f"kst_dtm,{','.join(TARGETS[::-1])}\n2024-01-01 01:00:00,1,2,3\n".encode())
        tell("A1", "header of another order", fails(lambda: files.read_csv(s, f"{at}/order.csv", LABELS).collect()))
        store.create(f"{at}/info.xlsx", _workbook())
        book = files.read_workbook(s, f"{at}/info.xlsx", "info", 3, "B:F", ["group"]).orderBy("MW", F.desc("latitude"))
        rows = book.withColumn("lat", F.format_string("%.6f", scalars.dms(F.col("latitude"), strict=True))).collect()
        tell("A3", "rows", len(rows))
        tell("A3", "merged groups", ",".join(x["group"] for x in rows))
        tell("A3", "places", ",".join(x["lat"] for x in rows))
        tell("A3", "no such sheet", fails(lambda: files.read_workbook(s, f"{at}/info.xlsx", "none", 3, "B:F", [])))
        store.create(f"{at}/a.txt", "zephyr é".encode())
        print_ = files.fingerprints(s, {"a": f"{at}/a.txt"})
        one = print_.first()
        tell("A5", "fingerprint", f"{one['bytes']} {one['sha256']}")
        tell("A5", "no file", fails(lambda: files.fingerprints(s, {"a": f"{at}/none"})))
        store.create(
            f"{at}/M.md",
            f"# data\n| path | bytes | hash |\n|-|-|-|\n| `a` | {one['bytes']} B | `{one['sha256'].upper()}` |\n| gone | 1,000 | {'0' * 64} |\n".encode()
        )
        manifest = files.read_manifest(s, f"{at}/M.md")
        tell("A4", "manifest rows", manifest.count())
        audited = files.manifest_audit(manifest, print_.withColumn("path", F.lit("a"))).orderBy("path").collect()
        tell("A6", "audit", ", ".join(f"{x['path']} {str(x['ok']).lower()}" for x in audited))
        store.create(f"{at}/n.ipynb", _NOTE.encode())
        n = files.notebook_stats(s, f"{at}/n.ipynb").first()
        tell("A11", "notebook", f"{n['cells']} cells, {n['code_cells']} code, {n['executed']} run, {n['errors']} with errors")
    return s.createDataFrame(out, "item string, what string, said string")


# --- columns, orders and expressions ---


def official(s: SparkSession, d: str, source: str, n: int, cells: int) -> DataFrame:
    """A forecast with as many value columns as the official files have, the wind components among them under their names."""
    named = [c for p in wind.WIND_PAIRS[source] for c in p[1:]]
    values = [*named, *[f"value_{k:02d}" for k in range(n - len(named))]]
    made = [(F.col("u" if c.endswith("u") else "v") + k).alias(c) if c in named else (F.col("t") * (k + 1)).alias(c) for k, c in enumerate(values)]
    return fx.grid(s, d, cells).select(*META, *made)


_SETS = [
    ("mean", 74), ("expanded", 271), ("expanded_vector", 319), ("nearest_all", 550), ("nearest_own", 396), ("idw1_all", 550),
    ("idw2_all", 550), ("idw2_own", 396)
]


@query(
    "feature_sets",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature_set, '{t}' AS target, CAST({k} AS BIGINT) AS features, CAST({k} AS BIGINT) AS different, true AS found"
        for n, k in _SETS for t in TARGETS
    )
)
def _(s, d):
    """The experiment's eight sets over matrices of the official width: their columns by target, all of which the joined matrix has."""
    four, raw = ("mean", "std", "min", "max"), {"ldaps": official(s, d, "ldaps", 30, 16), "gfs": official(s, d, "gfs", 35, 9)}
    mean = [c for k, f in raw.items() for c in grid.aggregate_grid(f, k, strict=False).columns[1:]]
    expanded = [grid.aggregate_grid(f, k, four, include_lead=True, strict=False) for k, f in raw.items()]
    pairs = {k: tuple(wind.WindPair(*p) for p in wind.WIND_PAIRS[k]) for k in raw}
    vectors = [
        grid.aggregate_grid(wind.wind_vectors(f, k, strict=False).select(*META, *[o for p in pairs[k] for o in p.outputs]), k, four, strict=False)
        for k, f in raw.items()
    ]
    pooled = {}
    for name, method, power in (("nearest", "nearest", 2.0), ("idw1", "idw", 1.0), ("idw2", "idw", 2.0)):
        more = {k: wind.wind_vectors(f, k, strict=False) for k, f in raw.items()}
        pooled[name] = [pooling.fit_pooler(f, fx.turbines(s), k, method, power, f"{k}_{name}") for k, f in more.items()]
    columns = {n: [c for p in both for c in p.output_columns] for n, both in pooled.items()}
    sets = baseline.feature_sets(
        list(baseline.CALENDAR), mean, [c for e in expanded for c in e.columns[1:]], [c for v in vectors for c in v.columns[1:]], columns
    )
    known = {*baseline.CALENDAR, *mean, *(c for f in [*expanded, *vectors] for c in f.columns), *(c for cs in columns.values() for c in cs)}
    rows = [(n, t, len(cs), len(set(cs)), set(cs) <= known) for n, by in sets.items() if n in dict(_SETS) for t, cs in by.items()]
    return s.createDataFrame(rows, "feature_set string, target string, features long, different long, found boolean")


_RULES = [
    ("F2", "groups", "'group_2,group_9,group_10'"),
    ("F3", "cells", "'9,10,a2,a10'"),
    ("B17", "columns with _u_", "'ldaps_u_mean,ldaps_u_std'"),
    ("B18", "families", "'calendar 9,ldaps 7'"),
    ("B5", "projection", f"'forecast_id,{','.join(TARGETS)}'"),
    ("I22", "names", "'ldaps_u_mean,ldaps_u_std,ldaps_v_mean,ldaps_v_std,ldaps_t_mean,ldaps_t_std,ldaps_lead_hour'"),
    ("G3", "clash", "'refused'"),
    ("C14", "cell sets", "'refused'"),
    ("E9", "first mismatch", "'forecast_id: row 2 differs from the template'"),
    ("C10", "identity", "'true'"),
    ("J10", "own columns", "'p_u_group_2_idw,p_v_group_2_idw'"),
    ("X12", "pairs aloft", "'isobaric_850 isobaric_850_u isobaric_850_v'"),
]


@query("column_rules", " UNION ALL ".join(f"SELECT '{i}' AS item, '{w}' AS what, {said} AS said" for i, w, said in _RULES))
def _(s, d):
    out: list[tuple[str, str, str]] = []
    tell = lambda item, what, said: out.append((item, what, str(said)))
    made = grid.aggregate_grid(fx.grid(s, d), "ldaps", ("std", "mean"), include_lead=True, strict=False)
    many = fx.turbines(s).withColumn(
        "group_id",
        F.concat(F.lit("group_"), F.element_at(F.array(F.lit("9"), F.lit("10"), F.lit("2")), F.substring("group_id", 7, 1).cast("int")))
    )
    tell("F2", "groups", ",".join(pooling.fit_pooler(fx.grid(s, d), many, "ldaps", "nearest").groups))
    tell("F3", "cells", ",".join(map(str, pooling.in_order(["a10", 10, "a2", 9]))))
    tell("B17", "columns with _u_", ",".join(c for c in made.columns if "_u_" in c))
    rows, features = baseline.training_features(fx.labels(s, d), made)
    families = [baseline.feature_family(c) for c in features]
    tell("B18", "families", ",".join(f"{k} {families.count(k)}" for k in dict.fromkeys(families)))
    bundle = baseline.Bundle(impute.MedianImputer(("u",), (0.0,)), {}, ("u",))
    tell(
        "B5", "projection",
        ",".join(
            [*baseline.predict(bundle, s.createDataFrame([("a", 1.0, 2.0)], "forecast_id string, u double, more double"), ["forecast_id"]).columns, *TARGETS]
        )
    )
    tell("I22", "names", ",".join(made.columns[1:]))
    tell("G3", "clash", outcome(lambda: grid.merge_sources(made, made))[0])
    tell("C14", "cell sets", outcome(lambda: pooling.fit_pooler(fx.grid(s, d), fx.turbines(s), "ldaps").check(fx.grid(s, d).filter(F.col(GRID) > 0)))[0])
    tell("E9", "first mismatch", submission.validate(_BROKEN["ids"](_sample(s)), _sample(s), rows=5).errors[0])
    tell("C10", "identity", str(submission.validate(_sample(s), _sample(s), rows=5).ok).lower())
    pooled = {"p": [f"p_{c}_{g}_idw" for c in "uv" for g in ("group_1", "group_2", "group_3")]}
    tell("J10", "own columns", ",".join(baseline.feature_sets([], [], [], [], pooled)["p_own"][TARGETS[1]]))
    tell("X12", "pairs aloft", ",".join(f"{p.name} {p.u} {p.v}" for p in wind.find_pairs(["isobaric_850_u", "isobaric_850_v", "isobaric_850_t", "u", "10u"])))
    return s.createDataFrame(out, "item string, what string, said string")


@query("expressions", """SELECT event_id, isfinite(value) AND value < 50 AS is_finite, regexp_full_match(event_type, '[a-z][a-z0-9_]*') AS is_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text, strftime(ts, '%Y-%m') AS period,
  round(value * value, 6) + 0e0 AS v2, round(value * value * value, 6) + 0e0 AS v3, round(value - 3, 9) + 0e0 AS cut_in, round(value - 12.5, 9) + 0e0 AS rated, round(22 - value, 9) + 0e0 AS cut_out, value < 3 OR value >= 22 AS stands_still FROM events""")
def _(s, d):
    v = F.col("value")
    margins, powers = scalars.speed_margins(v, "group_3"), scalars.speed_powers(v)
    return fx.table(s, d, "events").select(
        "event_id", finite(
            F.when(v >= 50, F.lit(math.inf)).otherwise(v)
        ).alias("is_finite"), F.col("event_type").rlike("^[a-z][a-z0-9_]*$").alias("is_name"), scalars.stamp(F.col("ts")).alias("time_text"), scalars.period(F.col("ts")).alias("period"),
        F.round(powers["v2"], 6).alias("v2"), F.round(powers["v3"], 6).alias("v3"), margins["cut_in_margin"].alias("cut_in"), margins["rated_margin"].alias("rated"), margins["cut_out_margin"].alias("cut_out"), margins["stands_still"].alias("stands_still"),
    )


@query("head_n", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 25")
def _(s, d):
    return fx.table(s, d, "events").orderBy("ts", "event_id").select("event_id", "event_type").limit(25)


@query("fixed_sample", "SELECT CAST(least(count(*), 100) AS BIGINT) AS rows, true AS same_in_any_layout, true AS all_known FROM events")
def _(s, d):
    rows = fx.table(s, d, "events").select("event_id", "user_id")
    a, b = audit.fixed_sample(rows, ["event_id"], 100), audit.fixed_sample(rows.repartition(7, "user_id"), ["event_id"], 100)
    same = audit.content_hash(a).first() == audit.content_hash(b).first()
    known = a.join(rows.select("event_id"), "event_id", "left_anti").isEmpty()
    return s.createDataFrame([(a.count(), same, known)], "rows long, same_in_any_layout boolean, all_known boolean")


@query("bundle_medians", f"WITH {fx.grid_sql(16)}, {fx.labels_sql()}, w AS (SELECT forecast_kst_dtm, avg(u) AS u, avg(t) AS t FROM grid GROUP BY 1), m AS (SELECT l.*, w.u, w.t FROM labels l LEFT JOIN w ON w.forecast_kst_dtm = l.kst_dtm) "
       + f"SELECT {r('median(u)')} AS u, {r('median(t)')} AS t, " + ", ".join(f"count({t}) AS {t}" for t in TARGETS) + " FROM m")
def _(s, d):
    """Medians and rows by target of a fitted bundle: gaps take medians of all rows, targets keep their own rows."""
    rows, features = baseline.training_features(fx.labels(s, d), grid.aggregate_grid(fx.grid(s, d).drop("v"), "ldaps", strict=False))
    bundle = baseline.fit_forests(rows, features, SMALL)
    told = dict(zip(bundle.imputer.columns, bundle.imputer.medians, strict=True))
    return s.createDataFrame(
        [(told["ldaps_u_mean"], told["ldaps_t_mean"], *[bundle.train_rows[t] for t in TARGETS])],
        "u double, t double, " + ", ".join(f"{t} long" for t in TARGETS)
    )


_PAIRS = f"WITH {fx.labels_sql()}, {fx.predictions_sql()}, {fx.long_sql()}"
_SHIFTS = (-0.02, 0.0, 0.02)


@query("threshold_shift", _PAIRS + f", m AS (SELECT target, actual, cap, s AS shift, abs(least(greatest(forecast + s * cap, 0e0), cap) - actual) / cap AS e FROM pairs, (VALUES {', '.join(f'({x}e0)' for x in _SHIFTS)}) v(s) WHERE actual >= cap * 0.1e0) "
       + f"SELECT target, {r('shift')} AS shift, {r('sum(actual * CASE WHEN e <= 0.06e0 THEN 4 WHEN e <= 0.08e0 THEN 3 ELSE 0 END) / sum(actual * 4)')} AS ficr FROM m GROUP BY 1, 2")
def _(s, d):
    return scoring.threshold_shift(scoring.pair_up(fx.labels(s, d), fx.predictions(s, d), "kst_dtm"), _SHIFTS)


@query(
    "quantile_bands",
    _PAIRS + f" SELECT target, CAST(least(greatest(floor(forecast * 10 / cap), 0), 9) AS BIGINT) AS band, count(*) AS rows, {', '.join(f'{r(f"quantile_cont(actual, {q})")} AS q{round(100 * q):02d}' for q in (0.1, 0.5, 0.9))} FROM pairs WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY 1, 2"
)
def _(s, d):
    return scoring.quantile_bands(scoring.pair_up(fx.labels(s, d), fx.predictions(s, d), "kst_dtm"))


@query("isotonic", _PAIRS + f""", b AS (SELECT target, least(greatest(floor(forecast * 20 / cap), 0), 19) AS bin, cap / 20 AS width, sum(actual) AS total, count(*) AS n FROM pairs WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY ALL),
    m AS (SELECT a.target, a.bin AS lo, z.bin AS hi, sum(x.total) / sum(x.n) AS mean FROM b a JOIN b z ON a.target = z.target AND a.bin <= z.bin JOIN b x ON x.target = a.target AND x.bin BETWEEN a.bin AND z.bin GROUP BY ALL)
    SELECT b.target, {r('(b.bin + 0.5e0) * b.width')} AS forecast, {r('(SELECT max(least_) FROM (SELECT lo, min(mean) AS least_ FROM m WHERE m.target = b.target AND m.lo <= b.bin AND m.hi >= b.bin GROUP BY lo))')} AS fitted, b.n AS rows FROM b""")
def _(s, d):
    """The SQL takes the largest of the least means over all stretches of bins, which the rising fit equals."""
    return scoring.isotonic(scoring.pair_up(fx.labels(s, d), fx.predictions(s, d), "kst_dtm"), bins=20)


_W = f"WITH {fx.grid_sql(16)}, {fx.turbines_sql()}"


@query("pooled_knn", _W + f""", k AS (
      SELECT turbine_id, group_id, capacity_mw AS mw, c.grid_id, 2 * 6371.0088e0 * asin(sqrt(power(sin(radians(c.latitude - t.latitude) / 2), 2) + cos(radians(t.latitude)) * cos(radians(c.latitude)) * power(sin(radians(c.longitude - t.longitude) / 2), 2))) AS km
      FROM turbines t, (SELECT DISTINCT grid_id, latitude, longitude FROM grid) c),
    o AS (SELECT *, min(km) OVER (PARTITION BY turbine_id) AS least, row_number() OVER (PARTITION BY turbine_id ORDER BY km, grid_id) AS nth FROM k),
    i AS (SELECT *, CASE WHEN nth > 3 THEN 0 WHEN least = 0 THEN CASE WHEN km = 0 THEN 1 ELSE 0 END ELSE power(least / km, 2) END AS raw FROM o),
    w AS (SELECT turbine_id, group_id, mw, grid_id, raw / sum(raw) OVER (PARTITION BY turbine_id) AS w FROM i),
    g AS (SELECT group_id, grid_id, sum(mw * w) / sum(mw) AS w FROM w GROUP BY 1, 2)
    SELECT forecast_kst_dtm, {', '.join(f"{r(f'''sum(w * t) FILTER (group_id = '{x}' AND t IS NOT NULL) / sum(w) FILTER (group_id = '{x}' AND t IS NOT NULL)''')} AS ldaps_pool_t_{x}_knn" for x in ('group_1', 'group_2', 'group_3'))}
    FROM grid JOIN g USING (grid_id) GROUP BY 1""")
def _(s, d):
    f = fx.grid(s, d).select(*META, "t")
    return pooling.fit_pooler(f, fx.turbines(s), "ldaps", "knn", neighbours=3).transform(f)


@query(
    "inventory",
    f"WITH {fx.grid_sql(16)} SELECT column_name, dtype, missing, distinct_values FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values FROM grid"
        for c, k in ((FORECAST, "timestamp_ntz"), (GRID, "bigint"), ("u", "double"))
    ) + ")"
)
def _(s, d):
    return audit.column_inventory(fx.grid(s, d).select(FORECAST, GRID, "u"))


@query("boosted")
def _(s, d):
    """Boosted trees and their blend with forests, over the hours that they were fitted on."""
    rows, features = baseline.training_features(fx.labels(s, d), grid.aggregate_grid(fx.grid(s, d), "ldaps", ("mean", "max"), strict=False))
    told = [
        baseline.predict(baseline.fit_forests(rows, features, p, boosted=b), rows, [FORECAST])
        for p, b in (({"maxIter": 8}, True), ({"numTrees": 12, "maxDepth": 6}, False))
    ]
    return baseline.blend(told, [FORECAST])


_HELD = f"WITH {fx.labels_sql()}, h AS (SELECT *, f >= (SELECT max(f) FROM labels) * 2 // 3 AS held FROM labels) "


@query(
    "rf_checks",
    _HELD + " UNION ALL ".join(
        f"SELECT '{t}' AS target, count(*) FILTER (NOT held AND {t} IS NOT NULL) AS fit_rows, count(*) FILTER (held) AS rows, count(*) FILTER (held) AS within_capacity, true AS same_again, true AS varies FROM h"
        for t in TARGETS
    )
)
def _(s, d):
    """A forest for each target, fitted twice on the first two thirds of the hours: rows, predictions within capacity, equal ones after a second fit."""
    lab = fx.labels(s, d)
    rows, features = baseline.training_features(lab, grid.aggregate_grid(fx.grid(s, d), "ldaps", include_lead=True, strict=False))
    cut = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(lab.agg(F.max("f")).first()[0] * 2 // 3))
    fit, held = rows.filter(F.col(FORECAST) < cut), rows.filter(F.col(FORECAST) >= cut)
    small = {"numTrees": 10, "maxDepth": 6}
    bundle, again = (baseline.fit_forests(fit, features, small) for _ in range(2))
    told = scoring.long_targets(baseline.predict(bundle, held, [FORECAST]), FORECAST, "y")
    twice = told.join(scoring.long_targets(baseline.predict(again, held, [FORECAST]), FORECAST, "z"), [FORECAST, "target"])
    within = F.col("y").between(0.0, scalars.capacity_of(F.col("target")))
    by = twice.groupBy("target").agg(
        F.count("*").alias("rows"), F.count_if(within).alias("within_capacity"), F.bool_and(F.col("y") == F.col("z")).alias("same_again"),
        (F.min("y") < F.max("y")).alias("varies")
    )
    counts = s.createDataFrame(list(bundle.train_rows.items()), "target string, fit_rows long")
    return by.join(F.broadcast(counts), "target")

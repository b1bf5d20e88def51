"""Assembly of features and labels, one forest for each target, clipped predictions, and the submission."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions.nulls import clip, nan_to_null
from zephyrlake.functions.scalars import calendar
from zephyrlake.operators.contracts import check_columns, check_unique, require
from zephyrlake.operators.grid import mean_weather, merge_sources
from zephyrlake.operators.impute import MedianImputer, fit_median_imputer
from zephyrlake.operators.scoring import target_scores
from zephyrlake.schema import CAPACITY, FORECAST, LABEL_TIME, TARGETS

#: The forest's parameters.
FOREST = {"numTrees": 120, "maxDepth": 14, "minInstancesPerNode": 8, "featureSubsetStrategy": "sqrt", "seed": 42, "maxBins": 128, "bootstrap": True}
BOOSTED = {
    "maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 8, "featureSubsetStrategy": "onethird",
    "seed": 42, "maxBins": 128
}
#: Memory in MB for the sums of the nodes that a task splits at once; rows of a partition of boosted trees: with fewer, sending sums costs more than making them.
NODES_MB, PARTITION_ROWS = 64, 1_500
#: Forests are grown in parts of some trees each, a task to a part: at most so many parts, a part for so many rows times trees, and rows of a task.
PARTS, PART_WORK, TASK_ROWS = 16, 250_000, 500_000
CALENDAR = ("month", "day", "hour", "dayofweek", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos")


def add_calendar(df: DataFrame, time: str = FORECAST) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in calendar(F.col(time)).items()])


def baseline_weather(ldaps: DataFrame, gfs: DataFrame, how: str = "outer", lead: bool = True) -> DataFrame:
    """Both sources' means (and leads) by forecast time, under the availability rule only."""
    return merge_sources(mean_weather(ldaps, "ldaps", lead), mean_weather(gfs, "gfs", lead), how)


def ordered(frame: DataFrame, weather: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """keys, calendar columns, then weather columns in their order."""
    names = [c for c in weather.columns if c != FORECAST]
    features = [*CALENDAR, *names]
    return add_calendar(frame).select(*keys, *[F.col(f"`{c}`") for c in features]), features


def training_features(labels: DataFrame, weather: DataFrame) -> tuple[DataFrame, list[str]]:
    """Labels with the features of their hour (missing where there is no forecast), one row a label."""
    check_columns(labels, [LABEL_TIME, *TARGETS], "labels")
    rows = nan_to_null(labels).withColumnRenamed(LABEL_TIME, FORECAST).join(weather, FORECAST, "left")
    return ordered(rows, weather, [FORECAST, *TARGETS])


def inference_features(sample: DataFrame, weather: DataFrame) -> tuple[DataFrame, list[str]]:
    """The template's rows with the features of their hour."""
    check_columns(sample, ["forecast_id", FORECAST], "sample")
    rows = sample.select("forecast_id", F.col(FORECAST).cast("timestamp_ntz").alias(FORECAST)).join(weather, FORECAST, "left")
    return ordered(rows, weather, ["forecast_id", FORECAST])


def model_matrix(labels: DataFrame, features: DataFrame, key: str = FORECAST) -> DataFrame:
    """A left join of frames that both have the key once."""
    return check_unique(labels, [key], "labels").join(check_unique(features, [key], "features"), key, "left")


@dataclass
class Bundle:
    imputer: MedianImputer
    models: dict[str, RandomForestRegressionModel | GBTRegressionModel]
    features: tuple[str, ...]
    train_rows: dict[str, int] = field(default_factory=dict)


def fit_forests(
    rows: DataFrame, features: list[str], params: dict | None = None, key: str = FORECAST, targets: tuple[str, ...] = TARGETS,
    boosted: bool = False
) -> Bundle:
    """One forest (or a row of boosted trees) for each target on its rows with an answer. Gaps take medians of all training rows.

    A forest is grown in parts, side by side: each has some of its trees, a seed of its own and all rows in one task, up to TASK_ROWS. So the sums
    of a node's bins, which by far outweigh deep trees' rows, meet with no others, and come in one order. Rows are dealt by the key's hash
    and sorted: bagging depends on their layout, so equal input gives equal forests.
    """
    held = rows.select(key, *targets, *features).persist()  # medians take some passes
    try:
        imputer = fit_median_imputer(held, features)
    except BaseException:
        held.unpersist()
        raise
    filled = imputer.transform(held, keep=(key, *targets))
    tie = F.xxhash64(*targets, *[F.col(f"`{c}`") for c in features]).alias("_tie")
    matrix = VectorAssembler(inputCols=list(features), outputCol="x").transform(filled).select(key, *targets, "x", tie).persist()
    params = (BOOSTED if boosted else FOREST) | {"maxMemoryInMB": NODES_MB} | (params or {})

    def fit(t: str, n: int, more: dict) -> RandomForestRegressionModel | GBTRegressionModel:
        most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = min(most, -(-n // PARTITION_ROWS)) if boosted else -(-n // TASK_ROWS)
        answered = matrix.filter(F.col(t).isNotNull())
        dealt = answered.repartition(1) if tasks == 1 else answered.repartition(tasks, key)  # sessions may raise the tasks of a key, not a single one
        dealt = dealt.sortWithinPartitions(key, "_tie").select(t, "x")
        made = GBTRegressor if boosted else RandomForestRegressor
        return made(labelCol=t, **params | more).setFeaturesCol("x").setPredictionCol("p").fit(dealt)

    try:
        answers = matrix.agg(*[F.count(t).alias(t) for t in targets]).first().asDict()
        held.unpersist()
        for t in targets:
            require(answers[t] > 0, f"{t}: no rows with an answer")
        jobs = [(t, answers[t], more) for t in targets for more in ([{}] if boosted else forest_parts(answers[t], params))]
        with ThreadPoolExecutor(max(len(targets), rows.sparkSession.sparkContext.defaultParallelism)) as pool:
            fitted = list(pool.map(lambda job: fit(*job), jobs))
    finally:
        matrix.unpersist()
        held.unpersist()
    by = {t: [m for m, job in zip(fitted, jobs, strict=True) if job[0] == t] for t in targets}
    return Bundle(imputer, {t: one_forest(ms) for t, ms in by.items()}, tuple(features), answers)


def forest_parts(n: int, params: dict) -> list[dict]:
    """Trees and seed of each part of a forest over n rows; seeds are apart by more than the tasks of a part, whose places are added to them."""
    trees = params["numTrees"]
    parts = max(1, min(PARTS, trees, -(-n * trees // PART_WORK)))
    return [{"numTrees": trees // parts + (k < trees % parts), "seed": params["seed"] + 1_000_003 * k} for k in range(parts)]


def one_forest(parts: list[RandomForestRegressionModel | GBTRegressionModel]) -> RandomForestRegressionModel | GBTRegressionModel:
    """A forest of the trees of all parts, in their order."""
    if len(parts) == 1:
        return parts[0]
    gateway = SparkContext._active_spark_context._gateway
    ml, first = gateway.jvm.org.apache.spark.ml, parts[0]._java_obj
    trees = [t for p in parts for t in p._java_obj.trees()]
    held = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    for k, t in enumerate(trees):
        held[k] = t
    made = first.copyValues(ml.regression.RandomForestRegressionModel(first.uid(), held, first.numFeatures()), ml.param.ParamMap.empty())
    return parts[0]._copyValues(RandomForestRegressionModel(made.set("numTrees", len(trees))), {})._set(numTrees=len(trees))


def blend(predictions: list[DataFrame], keys: list[str], weights: list[float] | None = None) -> DataFrame:
    """Weighted means of several models' predictions by key; missing where a model has none."""
    require(bool(predictions), "no predictions")
    weights = [1.0 / len(predictions)] * len(predictions) if weights is None else weights
    require(
        len(weights) == len(predictions) and abs(sum(weights) - 1.0) < 1e-9 and min(weights) >= 0,
        f"weights must be one for each model and sum to 1, got {weights}"
    )
    tagged = [p.select(*keys, *[(F.col(t) * w).alias(t) for t in TARGETS]) for p, w in zip(predictions, weights, strict=True)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.when(F.count(t) == len(predictions), F.sum(t)).alias(t) for t in TARGETS])


def predict(bundle: Bundle, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the targets' predictions within [0, capacity]; extra columns are left out."""
    check_columns(rows, [*keys, *bundle.features], "inference rows")
    filled = bundle.imputer.transform(rows.select(*keys, *bundle.features), keep=tuple(keys))
    out = VectorAssembler(inputCols=list(bundle.features), outputCol="x").transform(filled).select(*keys, "x")
    for t in bundle.models:
        out = bundle.models[t].setPredictionCol(t).transform(out)
    return out.select(*keys, *[clip(F.col(t), 0.0, CAPACITY[t]).alias(t) for t in bundle.models])


def build_submission(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """The template's identity columns with the predicted targets; every row must have one prediction."""
    out = sample.select("forecast_id", FORECAST).join(predictions.select("forecast_id", *TARGETS), "forecast_id", "left")
    gap = F.greatest(*[F.col(t).isNull() for t in TARGETS])
    by_id = out.groupBy("forecast_id").agg(F.count("*").alias("n"), F.count_if(gap).alias("gaps"))
    r = by_id.agg(F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps")).first()
    require(not r["twice"] and not r["gaps"], f"predictions don't fit the template: {r['twice']} ids come twice, {r['gaps']} rows lack a prediction")
    return out


def train_and_infer(
    labels: DataFrame, ldaps: DataFrame, gfs: DataFrame, sample: DataFrame, ldaps_test: DataFrame, gfs_test: DataFrame,
    params: dict | None = None
) -> dict:
    """The whole baseline: features, forests, predictions and submission."""
    train, features = training_features(labels, baseline_weather(ldaps, gfs))
    bundle = fit_forests(train, features, params)
    rows, _ = inference_features(sample, baseline_weather(ldaps_test, gfs_test))
    predictions = predict(bundle, rows, ["forecast_id"])
    return {"bundle": bundle, "train_features": train, "predictions": predictions, "submission": build_submission(sample, predictions)}


def feature_family(name: str) -> str:
    return "ldaps" if name.startswith("ldaps_") else "gfs" if name.startswith("gfs_") else "calendar"


def run_feature_sets(rows: DataFrame, sets: dict[str, dict[str, list[str]]], fold: Fold, params: dict | None = None, time: str = FORECAST) -> DataFrame:
    """(feature_set, target, features, fit_rows, nmae, ficr, valid_rows): a forest for each set and target of the fold, scored on the fold's holdout."""
    made = []
    for name, by_target in sets.items():
        for t in fold.targets:
            fit, held = fold.of(rows, t, time)
            bundle = fit_forests(fit, by_target[t], params, time, (t,))
            told = predict(bundle, held.select(time, F.col(t).alias("actual"), *by_target[t]), [time, "actual"])
            scores = target_scores(told.select(F.lit(t).alias("target"), "actual", F.col(t).alias("forecast")))
            made.append(
                scores.select(
                    F.lit(name).alias("feature_set"), "target", F.lit(len(by_target[t])).alias("features"),
                    F.lit(bundle.train_rows[t]).alias("fit_rows"), "nmae", "ficr", "valid_rows"
                )
            )
    return reduce(DataFrame.unionByName, made)


def feature_sets(
    calendar_: list[str], mean: list[str], expanded: list[str], vector: list[str], pooled: dict[str, list[str]]
) -> dict[str, dict[str, list[str]]]:
    """Feature sets by name, each with its columns for every target; own-group sets take a target's own pooled columns."""
    def same(columns):
        return {t: list(columns) for t in TARGETS}

    def own(columns, t):
        g = t.rsplit("_", 1)[1]
        return [c for c in columns if f"_group_{g}_" in c]

    base = [*calendar_, *expanded, *vector]
    sets = {"mean": same([*calendar_, *mean]), "expanded": same([*calendar_, *expanded]), "expanded_vector": same(base)}
    for name, columns in pooled.items():
        sets[f"{name}_all"] = same([*base, *columns])
        sets[f"{name}_own"] = {t: [*base, *own(columns, t)] for t in TARGETS}
    return sets


@dataclass(frozen=True)
class Fold:
    """Times from which and to which (not included) rows are fitted on and held out. later: targets whose answers begin later."""

    name: str
    fit: tuple[str, str]
    holdout: tuple[str, str]
    targets: tuple[str, ...] = TARGETS
    later: tuple[tuple[str, str], ...] = ()

    def of(self, df: DataFrame, target: str, time: str = FORECAST) -> tuple[DataFrame, DataFrame]:
        """Rows to fit a target on, and its held-out rows, as range predicates that reach the scan."""
        require(target in self.targets, f"fold {self.name} has no {target}")
        start = dict(self.later).get(target, self.fit[0])
        span = lambda a, b: df.filter((F.col(time) >= F.lit(a).cast("timestamp_ntz")) & (F.col(time) < F.lit(b).cast("timestamp_ntz")))
        return span(start, self.fit[1]), span(*self.holdout)


def seasonal_folds(year: int = 2024) -> list[Fold]:
    """the whole year after the two before (the third target: after one); F1: its January to May; F2: June to October; F3: the third
    target alone; F4: the year's second half after the first. Rows to fit on lie before those held out."""
    at = lambda y, m: f"{y}-{m:02d}-01 00:00:00"
    third = ((TARGETS[2], at(year - 1, 1)),)
    return [
        Fold("F0", (at(year - 2, 1), at(year, 1)), (at(year, 1), at(year + 1, 1)), later=third),
        Fold("F1", (at(year - 2, 1), at(year, 1)), (at(year, 1), at(year, 6)), later=third),
        Fold("F2", (at(year - 2, 1), at(year, 6)), (at(year, 6), at(year, 11)), later=third),
        Fold("F3", (at(year - 1, 1), at(year, 1)), (at(year, 1), at(year + 1, 1)), targets=TARGETS[2:]),
        Fold("F4", (at(year - 1, 1), at(year, 7)), (at(year, 7), at(year + 1, 1))),
    ]


def split_by_time(df: DataFrame, start: str, end: str, time: str = FORECAST) -> tuple[DataFrame, DataFrame]:
    """(before start, from start to end), as range predicates that reach the scan."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.filter(F.col(time) < a), df.filter((F.col(time) >= a) & (F.col(time) < b))

"""Command lines: train and infer. Without --run they only say what they would do.

python -m zephyrlake.plans.runs train --run --labels L.csv --ldaps A.csv --gfs B.csv --model DIR --registry R.csv --data-manifest M.md
python -m zephyrlake.plans.runs infer --run --sample S.csv --ldaps A.csv --gfs B.csv --model DIR --registry R.csv --out SUB.csv

Paths may lie on any file system that Spark reads. The document about a model lies beside it, as DIR.json, unless --metadata names another place.
"""

from __future__ import annotations

import argparse
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.functions.nulls import nan_to_null
from zephyrlake.operators.audit import label_profile, matrix_missing, weather_profile
from zephyrlake.operators.baseline import baseline_weather, build_submission, fit_forests, inference_features, predict, training_features
from zephyrlake.operators.contracts import require
from zephyrlake.plans import lineage
from zephyrlake.plans.store import Store, sha256
from zephyrlake.plans.submission import write_validated
from zephyrlake.schema import AVAILABLE, FORECAST, LABEL_TIME, LABELS, META, SUBMISSION, SUBMISSION_ROWS
from zephyrlake.session import build_session
from zephyrlake.sources.files import fingerprints, read_csv


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """A forecast CSV: the header names the value columns, all of them numbers; times have no zone."""
    header = spark.read.text(path).first()[0].lstrip("\ufeff").split(",")
    kinds = {FORECAST: T.TimestampNTZType(), AVAILABLE: T.TimestampNTZType(), META[2]: T.StringType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in header])
    return read_csv(spark, path, schema)


def data_profile(labels: DataFrame, ldaps: DataFrame, gfs: DataFrame, rows: DataFrame, features: list[str]) -> dict:
    """The training data as a document."""
    text = lambda d: {k: v.isoformat(sep=" ") if hasattr(v, "isoformat") else v for k, v in d.items()}
    targets = {r["target"]: text({k: v for k, v in r.asDict().items() if k != "target"}) for r in label_profile(labels, LABEL_TIME).collect()}
    missing = matrix_missing(rows, features).first().asDict()
    return {
        "labels": {"rows": labels.count(), "columns": list(labels.columns), "targets": targets},
        "weather": {n: text(weather_profile(d).first().asDict()) for n, d in (("ldaps", ldaps), ("gfs", gfs))},
        "feature_matrix": {
            "rows": rows.count(), "columns": len(features), "feature_columns": list(features),
            "feature_schema_sha256": lineage.feature_schema_sha(rows, features), **missing
        },
    }


def commit_of(named: str | None) -> str:
    """The commit as named, else the working tree's."""
    if named and named.strip():
        return named.strip()
    said = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    require(said.returncode == 0 and bool(said.stdout.strip()), "the commit can't be told here; name it with --commit")
    return said.stdout.strip()


def document_path(a: argparse.Namespace) -> str:
    return a.metadata or f"{a.model.rstrip('/')}.json"


def check_apart(store: Store, written: dict[str, str], read: dict[str, str] | None = None) -> None:
    """What is written has places of its own: none twice, and none that is read."""
    places: dict[str, str] = {store.full(p): n for n, p in (read or {}).items()}
    for n, p in written.items():
        other = places.setdefault(store.full(p), n)
        require(other == n, f"{n} and {other} need different paths")


def validation_of(a: argparse.Namespace) -> dict:
    """The holdout's split and scores, as far as given; the scores all or none."""
    return lineage.check_validation({k: getattr(a, k) for k in (*lineage.SPLIT, *lineage.SCORES) if getattr(a, k) is not None})


def train(spark: SparkSession, a: argparse.Namespace) -> dict:
    store, paths, told = Store(spark), {"labels": a.labels, "ldaps": a.ldaps, "gfs": a.gfs}, document_path(a)
    check_apart(store, {"model": a.model, "metadata": told, "registry": a.registry}, paths)
    validation, commit = validation_of(a), commit_of(a.commit)
    manifest_sha = sha256(store.read(a.data_manifest)) if a.data_manifest else a.manifest_sha256
    labels, ldaps, gfs = read_csv(spark, a.labels, LABELS), read_weather(spark, a.ldaps), read_weather(spark, a.gfs)
    rows, features = training_features(labels, baseline_weather(ldaps, gfs))
    rows = rows.persist()
    try:
        config = lineage.RunConfig(a.experiment, a.seed, {"numTrees": a.trees} if a.trees else {}, a.remark)
        bundle = fit_forests(rows, features, config.params())
        inputs = {r["name"]: r.asDict() for r in fingerprints(spark, paths).collect()}
        profile = data_profile(labels, ldaps, gfs, rows, features)
        document = lineage.save_artifact(
            bundle, a.model, told, config=config, profile=profile, commit=commit, manifest_sha=manifest_sha, at=a.created_at, inputs=inputs,
            validation=validation
        )
    finally:
        rows.unpersist()
    try:
        lineage.Registry(spark, a.registry).append(lineage.registry_entry(spark, document, a.model, told))
    except BaseException:
        store.remove(a.model)
        store.remove(told)
        raise
    return document


def infer(spark: SparkSession, a: argparse.Namespace) -> str:
    store, told = Store(spark), document_path(a)
    check_apart(store, {"out": a.out}, {"sample": a.sample, "ldaps": a.ldaps, "gfs": a.gfs, "model": a.model, "metadata": told, "registry": a.registry})
    require(not store.exists(a.out), f"{a.out} exists")
    bundle, document = lineage.load_registered(spark, a.model, told, a.registry)
    sample = read_csv(spark, a.sample, SUBMISSION)
    rows, features = inference_features(sample, baseline_weather(read_weather(spark, a.ldaps), read_weather(spark, a.gfs)))
    require(list(features) == list(bundle.features), "the features differ from the model's")
    submission = build_submission(nan_to_null(sample), predict(bundle, rows, ["forecast_id"])).orderBy("forecast_id")
    submission = submission.withColumn(FORECAST, F.col(FORECAST).cast("string"))
    n = sample.count()
    registry = lineage.Registry(spark, a.registry)
    record = lambda sha: registry.record_submission(document["run"]["id"], a.out.rpartition("/")[2], sha, n, a.encoding)
    return write_validated(submission, sample.orderBy("forecast_id"), a.out, a.encoding, a.rows, after=record)


#: Options of a command: names, and what argparse is told of them.
PLACES = {
    "train": (("labels", "train-labels"), ("ldaps", "ldaps-train"), ("gfs", "gfs-train"), ("model", "model-output"), ("registry", "registry-output")),
    "infer": (
        ("sample", "sample-submission"), ("ldaps", "ldaps-test"), ("gfs", "gfs-test"), ("model", "model-input"),
        ("registry", "run-registry"), ("out", "submission-output")
    ),
}
MORE = {
    "train": (
        (("metadata", "metadata-output"), {}),
        (("data-manifest",), {"help": "the data's manifest; its hash goes into the registry"}),
        (("manifest-sha256",), {"help": "that hash, where the manifest isn't at hand"}),
        (("experiment", "experiment-id"), {"default": "forest"}),
        (("seed",), {"type": int, "default": 42}),
        (("trees", "n-estimators"), {"type": int}),
        (("commit", "git-commit"), {}),
        (("created-at", "created-at-kst"), {"help": "the run's time, else now"}),
        (("remark",), {"default": ""}),
        (("split", "split-name"), {}),
        (("fit-from", "train-start-kst"), {}),
        (("fit-to", "train-end-kst"), {}),
        (("holdout-from", "validation-start-kst"), {}),
        (("holdout-to", "validation-end-kst"), {}),
        *(((s.replace("_", "-"),), {"type": float}) for s in lineage.SCORES),
    ),
    "infer": ((("metadata", "model-metadata"), {}), (("encoding",), {"default": "utf-8-sig"}), (("rows",), {"type": int, "default": SUBMISSION_ROWS})),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for command, places in PLACES.items():
        c = sub.add_parser(command)
        c.add_argument("--run", action="store_true")
        for names, more in (*((names, {}) for names in places), *MORE[command]):
            c.add_argument(*[f"--{n}" for n in names], dest=names[0].replace("-", "_"), **more)
        c.set_defaults(needed=[names[0] for names in places])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not a.run:
        print(f"{a.command}: nothing is run without --run")
        return 0
    missing = [n for n in a.needed if not getattr(a, n)]
    if a.command == "train" and not (a.data_manifest or a.manifest_sha256):
        missing.append("data-manifest")
    require(not missing, f"missing arguments: {missing}")
    spark = build_session()
    print((train if a.command == "train" else infer)(spark, a))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

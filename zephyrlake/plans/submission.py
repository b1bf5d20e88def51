"""Submissions: checks against the template, canonical bytes, and the validated file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.operators.contracts import require
from zephyrlake.plans.store import Store, sha256
from zephyrlake.schema import CAPACITY, FORECAST, SUBMISSION_COLUMNS, SUBMISSION_ROWS, TARGETS

ENCODINGS = ("utf-8", "utf-8-sig")


@dataclass(frozen=True)
class Report:
    ok: bool
    errors: tuple[str, ...]
    rows: int
    columns: tuple[str, ...]


def violations(df: DataFrame) -> DataFrame:
    """(target, missing, negative, over_capacity) counts; texts that are no number count as missing."""
    values = [(t, F.col(t).try_cast("double")) for t in TARGETS]
    gone = lambda v: v.isNull() | F.isnan(v)
    r = df.agg(
        *[
            x.alias(f"{t}_{n}")
            for t, v in values for n, x in (
                ("missing", F.count_if(gone(v))), ("negative", F.count_if(~gone(v) & (v < 0))),
                ("over_capacity", F.count_if(~gone(v) & (v > CAPACITY[t])))
            )
        ]
    )
    rows = [F.struct(F.lit(t).alias("target"), *[F.col(f"{t}_{n}").alias(n) for n in ("missing", "negative", "over_capacity")]) for t in TARGETS]
    return r.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def with_place(df: DataFrame, place: str = "row_place") -> DataFrame:
    """Rows numbered from 0 in the frame's own order; for templates of a few thousand rows, which one task may order."""
    if place in df.columns:
        return df
    return df.withColumn("_m", F.monotonically_increasing_id()).withColumn(
        place, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_m")) - 1
    ).drop("_m")


def validate(submission: DataFrame, sample: DataFrame, rows: int = SUBMISSION_ROWS) -> Report:
    """All faults at once: columns, number of rows, identity of ids and times row by row, values."""
    place = "row_place"
    names = [c for c in submission.columns if c != place]
    sample_names = [c for c in sample.columns if c != place]
    errors, n, m = [], submission.count(), sample.count()
    for what, got in (("columns", names), ("template columns", sample_names)):
        if got != list(SUBMISSION_COLUMNS):
            errors.append(f"{what}: expected {list(SUBMISSION_COLUMNS)}, got {got}")
    for what, got in (("rows", n), ("template rows", m)):
        if got != rows:
            errors.append(f"{what}: expected {rows}, got {got}")
    keys = ("forecast_id", FORECAST)
    if n == m and all(k in names and k in sample_names for k in keys):
        a = with_place(submission).select(place, *[F.col(k).cast("string").alias(f"a_{k}") for k in keys])
        b = with_place(sample).select(place, *[F.col(k).cast("string").alias(f"b_{k}") for k in keys])
        first = a.join(b, place).agg(*[F.min(F.when(~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")), F.col(place))).alias(k) for k in keys]).first()
        errors += [f"{k}: row {first[k]} differs from the template" for k in keys if first[k] is not None]
    if all(t in names for t in TARGETS):
        for r in violations(submission).collect():
            if r["missing"]:
                errors.append(f"{r['target']}: {r['missing']} values are missing")
            else:
                errors += [f"{r['target']}: {r[k]} values are {k.replace('_', ' ')}" for k in ("negative", "over_capacity") if r[k]]
    return Report(not errors, tuple(errors), n, tuple(names))


def require_valid(submission: DataFrame, sample: DataFrame, rows: int = SUBMISSION_ROWS) -> Report:
    report = validate(submission, sample, rows)
    require(report.ok, "; ".join(report.errors))
    return report


def id_order(c: str = "forecast_id") -> list[Column]:
    """Ids by the text before their final number, then by that number: forecast_99999 comes before forecast_100000."""
    text = F.rtrim(c, F.lit("0123456789"))
    number = F.ltrim(F.substring(c, F.length(text) + 1, F.length(c)), F.lit("0"))
    return [text, F.length(number), number, F.col(c)]


def canonical_bytes(df: DataFrame, encoding: str = "utf-8-sig") -> bytes:
    """The CSV of a submission of template size: header, rows by id, line feeds, seconds in times, shortest decimals."""
    require(encoding in ENCODINGS, f"encoding must be one of {ENCODINGS}, got {encoding!r}")
    place = "row_place"
    columns = [c for c in df.columns if c != place]
    times = {f.name for f in df.schema if f.dataType.typeName().startswith("timestamp")}
    rows = df.orderBy(*([place] if place in df.columns else id_order())).select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in times else F.col(c) for c in columns]
    ).collect()
    cell = lambda v: "" if v is None else repr(v) if isinstance(v, float) else str(v)
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s
    return "".join(",".join(map(quote, line)) + "\n" for line in [columns, *[[cell(v) for v in r] for r in rows]]).encode(encoding)


def write_validated(submission: DataFrame, sample: DataFrame, path: str, encoding: str = "utf-8-sig", rows: int = SUBMISSION_ROWS, after=None) -> str:
    """Checks, writes and returns the file's hash; after(hash) may record it, and if that fails the file goes."""
    require_valid(submission, sample, rows)
    data, store = canonical_bytes(submission, encoding), Store(submission.sparkSession)
    store.create(path, data)
    try:
        if after is not None:
            after(sha256(data))
    except BaseException:
        store.remove(path)
        raise
    return sha256(data)

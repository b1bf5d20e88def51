"""The score: capacity-normalised error and stepwise settlement, over long rows (key, target, actual, forecast)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.functions.nulls import clip, nan_to_null, ratio, strict_avg
from zephyrlake.functions.scalars import capacity_of, unit_price
from zephyrlake.operators.contracts import check_columns
from zephyrlake.schema import TARGETS, TIGHT_ERROR, TIGHT_PRICE, VALID_SHARE, WIDE_ERROR


def long_targets(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """One row for each key and target."""
    keys = [key] if isinstance(key, str) else list(key)
    return nan_to_null(df.select(*keys, *[F.col(t).cast("double").alias(t) for t in TARGETS])).unpivot(keys, list(TARGETS), "target", value)


def pair_up(answer: DataFrame, prediction: DataFrame, on: str | list[str]) -> DataFrame:
    """Answers with the prediction of the same key; a row without one has a missing forecast."""
    keys = [on] if isinstance(on, str) else list(on)
    check_columns(answer, [*keys, *TARGETS], "answer")
    check_columns(prediction, [*keys, *TARGETS], "prediction")
    return long_targets(answer, keys, "actual").join(long_targets(prediction, keys, "forecast"), [*keys, "target"], "left")


def with_errors(pairs: DataFrame) -> DataFrame:
    """Valid rows only: actual of at least a tenth of capacity; with error and unit price."""
    cap = capacity_of(F.col("target"))
    rows = pairs.filter(F.col("actual") >= cap * F.lit(VALID_SHARE)).withColumn("error", F.abs(F.col("forecast") - F.col("actual")) / cap)
    return rows.withColumn("price", unit_price(F.col("error")))


def target_scores(pairs: DataFrame) -> DataFrame:
    """(target, nmae, ficr, valid_rows) of the targets with valid rows. A missing forecast on a valid row makes nmae missing and earns nothing."""
    by = with_errors(pairs).groupBy("target")
    return by.agg(
        strict_avg(F.col("error")).alias("nmae"),
        ratio(F.sum(F.col("actual") * F.col("price")), F.sum(F.col("actual") * TIGHT_PRICE)).alias("ficr"), F.count("*").alias("valid_rows")
    )


def total_score(pairs: DataFrame) -> DataFrame:
    """(total_score, one_minus_nmae, ficr): plain means over all targets; one target without a value makes the mean missing."""
    s = target_scores(pairs)
    every = lambda c: F.when(F.count(c) == len(TARGETS), F.avg(c))
    means = s.agg((1.0 - every("nmae")).alias("one_minus_nmae"), every("ficr").alias("ficr"))
    return means.select((0.5 * F.col("one_minus_nmae") + 0.5 * F.col("ficr")).alias("total_score"), "one_minus_nmae", "ficr")


def metric(answer: DataFrame, prediction: DataFrame, on: str | list[str]) -> tuple[float | None, float | None, float | None]:
    r = total_score(pair_up(answer, prediction, on)).first()
    return r["total_score"], r["one_minus_nmae"], r["ficr"]


def diagnostics(pairs: DataFrame) -> DataFrame:
    """By target: rows with an answer, valid rows, error over all answers, nmae, shares within the price steps, range of forecasts."""
    cap = capacity_of(F.col("target"))
    error = F.abs(F.col("forecast") - F.col("actual")) / cap
    valid = F.col("actual") >= cap * F.lit(VALID_SHARE)
    share = lambda at: F.avg(F.when(valid, (error <= at).cast("double")))
    return pairs.groupBy("target").agg(
        F.count("actual").alias("answer_rows"), F.count_if(valid).alias("valid_rows"), F.avg(
            F.abs(F.col("forecast") - F.col("actual"))
        ).alias("mae"), F.avg(F.when(valid, error)).alias("nmae"),
        share(TIGHT_ERROR).alias("within_tight"), share(WIDE_ERROR).alias("within_wide"), F.min("forecast").alias("forecast_min"), F.max("forecast").alias("forecast_max"),
    )


def price_shares(pairs: DataFrame) -> DataFrame:
    """Rows and energy by target and price, and each price's share of its target's energy."""
    from pyspark.sql import Window

    by = with_errors(pairs).groupBy("target", "price").agg(F.count("*").alias("rows"), F.sum("actual").alias("energy"))
    return by.withColumn("energy_share", F.col("energy") / F.sum("energy").over(Window.partitionBy("target")))


def settlement(pairs: DataFrame, scenarios: dict[str, tuple[float, float]]) -> DataFrame:
    """FICR by target under other price steps: scenario -> (tight, wide)."""
    cap = capacity_of(F.col("target"))
    rows = pairs.filter(F.col("actual") >= cap * F.lit(VALID_SHARE)).withColumn("error", F.abs(F.col("forecast") - F.col("actual")) / cap)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), unit_price(F.col("error"), a, b).alias("price")) for n, (a, b) in scenarios.items()]))
    rows = rows.select("target", "actual", each.alias("x"))
    return rows.groupBy(F.col("x.scenario").alias("scenario"), "target").agg(
        ratio(F.sum(F.col("actual") * F.col("x.price")), F.sum(F.col("actual") * TIGHT_PRICE)).alias("ficr")
    )


def climatology(labels: DataFrame, time: str, at: DataFrame, at_time: str) -> DataFrame:
    """(at_time, target, forecast): the (month, hour) mean of each target, or its overall mean, within capacity."""
    long = long_targets(labels, time, "actual")
    seasonal = long.groupBy("target", F.month(time).alias("m"), F.hour(time).alias("h")).agg(F.avg("actual").alias("seasonal"))
    overall = long.groupBy("target").agg(F.avg("actual").alias("overall"))
    # 3 x 12 x 24 and 3 rows
    rows = at.select(at_time, F.explode(F.array(*map(F.lit, TARGETS))).alias("target")).withColumns({"m": F.month(at_time), "h": F.hour(at_time)})
    rows = rows.join(F.broadcast(seasonal), ["target", "m", "h"], "left").join(F.broadcast(overall), "target", "left")
    return rows.select(at_time, "target", clip(F.coalesce("seasonal", "overall"), 0.0, capacity_of(F.col("target"))).alias("forecast"))


def scoreboard_delta(scores: DataFrame, control: str, name: str = "feature_set") -> DataFrame:
    """Each candidate's metrics less the control's by target."""
    base = scores.filter(F.col(name) == control).select("target", F.col("nmae").alias("c_nmae"), F.col("ficr").alias("c_ficr"))
    rows = scores.filter(F.col(name) != control).join(F.broadcast(base), "target")  # a row for each of three targets
    return rows.select(name, "target", (F.col("nmae") - F.col("c_nmae")).alias("delta_nmae"), (F.col("ficr") - F.col("c_ficr")).alias("delta_ficr"))


def decide(deltas: DataFrame, name: str = "feature_set", both: bool = False) -> DataFrame:
    """adopt, conditional or hold by candidate. both also asks that neither mean metric gets worse."""
    by = deltas.groupBy(name).agg(F.avg("delta_nmae").alias("d_nmae"), F.avg("delta_ficr").alias("d_ficr"), F.count_if(F.col("delta_nmae") < 0).alias("better"))
    total = 0.5 * (F.col("d_ficr") - F.col("d_nmae"))
    good = (total > 0) & (F.col("better") >= 2)
    if both:
        good &= (F.col("d_nmae") <= 0) & (F.col("d_ficr") >= 0)
    return by.select(
        name, total.alias("delta_total"), F.col("better").alias("targets_better"),
        F.when(good, "adopt").when(total > 0, "conditional").otherwise("hold").alias("decision")
    )


def bias(pairs: DataFrame) -> DataFrame:
    """Mean forecast error by target, to subtract in calibration."""
    return pairs.groupBy("target").agg(F.avg(F.col("forecast") - F.col("actual")).alias("bias"))


def isotonic(pairs: DataFrame, bins: int = 1000) -> DataFrame:
    """(target, forecast, fitted, rows): the rising step function that is closest to the actual values, at the middle of each bin of forecasts.

    Pairs are first summed into bins of a capacity's share, so pooling of adjacent violators sees at most `bins` rows a target.
    """
    rows = pairs.filter(F.col("forecast").isNotNull() & F.col("actual").isNotNull())
    width = capacity_of(F.col("target")) / bins
    bin_ = F.least(F.greatest(F.floor(F.col("forecast") / width), F.lit(0)), F.lit(bins - 1))
    sums = rows.groupBy("target", bin_.alias("bin"), width.alias("width")).agg(F.sum("actual").alias("total"), F.count("*").alias("n"))

    def pool(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bin")
        blocks: list[list[float]] = []  # total, rows, bins
        for total, n in zip(df.total, df.n, strict=True):
            blocks.append([total, n, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        fitted = [t / n for t, n, k in blocks for _ in range(int(k))]
        return pd.DataFrame({"target": df.target, "forecast": (df.bin + 0.5) * df.width, "fitted": fitted, "rows": df.n})

    return sums.groupBy("target").applyInPandas(pool, "target string, forecast double, fitted double, rows long")


def threshold_shift(pairs: DataFrame, shifts: tuple[float, ...] = (-0.04, -0.03, -0.02, -0.01, 0.0, 0.01, 0.02, 0.03, 0.04)) -> DataFrame:
    """(target, shift, ficr): the settled share of each target when its forecasts move by a share of capacity; the best shift calibrates
    forecasts near the tight and the wide price step. One pass: the shifts are columns."""
    cap, actual = capacity_of(F.col("target")), F.col("actual")
    price = lambda s: unit_price(F.abs(clip(F.col("forecast") + s * cap, 0.0, cap) - actual) / cap)
    valid = pairs.filter(actual >= cap * F.lit(VALID_SHARE))
    sums = valid.groupBy("target").agg(*[ratio(F.sum(actual * price(s)), F.sum(actual * TIGHT_PRICE)).alias(f"s{k}") for k, s in enumerate(shifts)])
    return sums.select(
        "target",
        F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.col(f"s{k}").alias("ficr")) for k, s in enumerate(shifts)])).alias("x")
    ).select("target", "x.*")


def quantile_bands(pairs: DataFrame, shares: tuple[float, ...] = (0.1, 0.5, 0.9), bins: int = 10) -> DataFrame:
    """(target, band, rows, q10, ...): exact quantiles of the actual values by band of forecasts, a share of capacity each."""
    rows = pairs.filter(F.col("forecast").isNotNull() & F.col("actual").isNotNull())
    band = F.least(F.greatest(F.floor(F.col("forecast") * bins / capacity_of(F.col("target"))), F.lit(0)), F.lit(bins - 1)).cast("int")
    made = [F.percentile(F.col("actual"), q).alias(f"q{round(100 * q):02d}") for q in shares]
    return rows.groupBy("target", band.alias("band")).agg(F.count("*").alias("rows"), *made)

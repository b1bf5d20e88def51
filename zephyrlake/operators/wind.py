"""Wind vectors from component columns: speed and the direction that the wind comes from, cell by cell."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.operators.contracts import check_columns, check_number, check_source, require
from zephyrlake.schema import CALM_SPEED, WIND_PAIRS


@dataclass(frozen=True)
class WindPair:
    name: str
    u: str
    v: str

    @property
    def outputs(self) -> tuple[str, str, str]:
        return tuple(f"windvec_{self.name}_{x}" for x in ("speed", "from_sin", "from_cos"))


def check_pairs(df: DataFrame, pairs: tuple[WindPair, ...]) -> None:
    require(bool(pairs), "no wind pairs")
    names = [p.name for p in pairs]
    require(all(re.fullmatch(r"[a-z0-9][a-z0-9_]*", n) for n in names), f"pair names {names} don't fit [a-z0-9][a-z0-9_]*")
    require(len(set(names)) == len(names), f"pair names repeat: {names}")
    require(all(p.u != p.v for p in pairs), "a pair's u and v are the same column")
    columns = sorted({c for p in pairs for c in (p.u, p.v)})
    check_columns(df, columns, "wind frame")
    require(all(isinstance(df.schema[c].dataType, T.NumericType) for c in columns), f"components must be numeric: {columns}")
    clash = [c for p in pairs for c in p.outputs if c in df.columns]
    require(not clash, f"output columns are there already: {clash}")
    infinite = df.agg(*[F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(c) for c in columns]).first().asDict()
    require(not any(infinite.values()), f"components hold infinities: { {c: n for c, n in infinite.items() if n} }")


def find_pairs(columns: list[str], known: tuple[WindPair, ...] = ()) -> tuple[WindPair, ...]:
    """Pairs by name, besides the known ones: columns that differ only in a final u and v, such as those of pressure levels aloft. A pair is
    named by what they share."""
    taken = {c for p in known for c in (p.u, p.v)}
    names = lambda c: re.sub(r"[^a-z0-9]+", "_", c[:-1].lower()).strip("_")
    return tuple(WindPair(names(c), c, f"{c[:-1]}v") for c in columns if c.endswith("u") and f"{c[:-1]}v" in columns and names(c) and c not in taken)


def wind_vectors(df: DataFrame, source: str, pairs: tuple[WindPair, ...] | None = None, calm: float = CALM_SPEED, strict: bool = True) -> DataFrame:
    """df with three columns for each pair after all others: speed, and sine and cosine of the direction it comes from.

    Direction is missing where the speed isn't over calm. strict runs the checks (one job).
    """
    check_source(source)
    calm = check_number(calm, "calm", least=0.0)
    pairs = tuple(WindPair(*p) for p in WIND_PAIRS[source]) if pairs is None else tuple(pairs)
    if strict:
        check_pairs(df, pairs)
    made = {}
    for p in pairs:
        u, v = F.col(p.u).cast("double"), F.col(p.v).cast("double")
        speed = length(u, v)
        made |= dict(zip(p.outputs, (speed, F.when(speed > calm, -u / speed), F.when(speed > calm, -v / speed)), strict=True))
    return df.select("*", *[c.alias(n) for n, c in made.items()])


def length(u: Column, v: Column) -> Column:
    """The square root of the sum of squares, both rounded correctly: hypot may be off by the last bit, which moves a speed on a bin's edge into another bin.
    Only where squares leave the normal range hypot takes over."""
    squares = u * u + v * v
    return F.when(squares.between(1e-290, 1e300), F.sqrt(squares)).otherwise(F.hypot(u, v))


def resultant_length(df: DataFrame, by: list[str], sin: str, cos: str, name: str = "resultant") -> DataFrame:
    """Length of the mean direction vector of each group: 1 where all agree, 0 where they cancel out."""
    return df.groupBy(*by).agg(F.hypot(F.avg(sin), F.avg(cos)).alias(name))


def unit_norm_error(df: DataFrame, sin: str, cos: str) -> DataFrame:
    return df.agg(F.max(F.abs(F.hypot(sin, cos) - 1.0)).alias("worst"))

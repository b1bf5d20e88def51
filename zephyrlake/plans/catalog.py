"""The named queries and the SQL that gives the same rows. Modules add theirs with query()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded (and never -0.0), integers as BIGINT."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 9) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r(x: str) -> str:
    return f"round({x}, 9) + 0e0"

"""Turbine-aware pooling of grid cells: capacity-weighted nearest and inverse-distance weights.

The weights are fitted once from two small dimensions (turbines and cells) and kept as a frame of at most
groups x methods x cells rows. Pooling is an aggregation by forecast time: rows get the broadcast weights of their
cell (one column for each group and method), and each value column has a weighted sum and the weights of its cells with a
value, so cells without take no part in their mean. Columns are taken some at a time, as many as generated code can hold; each such
part scans its own columns and shuffles one partial row for a time and task, and the parts meet on the time they are dealt by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.functions.nulls import finite, nan_to_null
from zephyrlake.functions.scalars import haversine_km
from zephyrlake.operators.contracts import check_columns, check_number, check_prefix, check_schema_match, check_source, check_turbines, require, value_columns
from zephyrlake.schema import FORECAST, GRID, LAT, LON, META

METHODS = ("nearest", "idw", "knn")
TOLERANCE = 1e-12
#: Dimensions are broadcast, and their pairs made on the driver's behalf; more of them are refused.
MOST_CELLS, MOST_TURBINES, MOST_PAIRS = 10_000, 10_000, 2_000_000
#: Sums in one aggregation.
SUMS = 64


def check_methods(methods: str | tuple[str, ...]) -> tuple[str, ...]:
    methods = (methods,) if isinstance(methods, str) else tuple(methods)
    require(bool(methods), "pooling methods are empty")
    require(len(set(methods)) == len(methods), f"pooling methods repeat: {methods}")
    require(set(methods) <= set(METHODS), f"pooling methods must be among {METHODS}, got {methods}")
    return methods


def grid_geometry(df: DataFrame, strict: bool = True) -> DataFrame:
    """(grid_id, latitude, longitude) of each cell; its place must not change over time."""
    check_columns(df, META, "grid")
    if strict:
        lat, lon = F.col(LAT).cast("double"), F.col(LON).cast("double")
        by_cell = df.groupBy(GRID).agg(
            (F.min(LAT) < F.max(LAT)).alias("lat"), (F.min(LON) < F.max(LON)).alias("lon"),
            F.count_if(~finite(lat) | ~finite(lon) | (F.abs(lat) > 90) | (F.abs(lon) > 180)).alias("bad"), F.count("*").alias("rows"),
        )
        r = by_cell.agg(
            F.count_if("lat").alias("lat"), F.count_if("lon").alias("lon"), F.sum("bad").alias("bad"), F.count("*").alias("cells"),
            F.count_if(F.col(GRID).isNull()).alias("nulls")
        ).first()
        require(r["cells"] > 0, "grid: no rows")
        require(not r["nulls"], "grid: cells without id")
        require(not r["bad"], f"grid: {r['bad']} coordinates are missing or out of range")
        require(not r["lat"] and not r["lon"], f"grid: coordinates change over time in {max(r['lat'], r['lon'])} cells")
    return df.groupBy(GRID).agg(F.min(LAT).cast("double").alias(LAT), F.min(LON).cast("double").alias(LON))


def distances(turbines: DataFrame, geometry: DataFrame) -> DataFrame:
    """Every turbine with every cell and their distance in km: two dimensions of bounded size."""
    cells = geometry.select(GRID, F.col(LAT).alias("cell_lat"), F.col(LON).alias("cell_lon"))
    km = haversine_km(F.col(LAT).cast("double"), F.col(LON).cast("double"), F.col("cell_lat"), F.col("cell_lon"))
    return turbines.crossJoin(F.broadcast(cells)).select(
        "turbine_id", "group_id", F.col("capacity_mw").cast("double").alias("capacity_mw"), GRID, km.alias("km")
    )


def turbine_weights(dist: DataFrame, methods: tuple[str, ...], power: float = 2.0, neighbours: int = 4) -> DataFrame:
    """(turbine, method, cell, w). nearest: shared by cells as near as the nearest to 1e-12. idw: cells at distance 0 take all, else (dmin / d) ** power.
    knn: as idw among the `neighbours` nearest cells (ties: the smaller id)."""
    all_cells = Window.partitionBy("turbine_id")
    d, least = F.col("km"), F.min("km").over(all_cells)
    near = (F.abs(d - F.col("least")) <= TOLERANCE + TOLERANCE * F.abs(F.col("least"))).cast("double")
    inverse = F.when(F.col("least") == 0, (d == 0).cast("double")).otherwise(F.when(d > 0, F.pow(F.col("least") / d, F.lit(power))).otherwise(0.0))
    raw = {"nearest": near, "idw": inverse, "knn": F.when(F.col("nth") <= neighbours, inverse).otherwise(0.0)}
    nth = F.row_number().over(all_cells.orderBy("km", GRID))
    rows = dist.withColumn("least", least).withColumn("nth", nth)
    long = rows.select(
        "turbine_id", "group_id", "capacity_mw", GRID, "km",
        F.explode(F.array(*[F.struct(F.lit(m).alias("method"), raw[m].alias("raw")) for m in methods])).alias("x")
    )
    long = long.select("turbine_id", "group_id", "capacity_mw", GRID, "km", "x.*")
    return long.withColumn("w", F.col("raw") / F.sum("raw").over(Window.partitionBy("turbine_id", "method"))).drop("raw")


def group_weights(weights: DataFrame) -> DataFrame:
    """(group, method, cell, w): capacity-weighted over the group's turbines, to a sum of 1."""
    by = weights.groupBy("group_id", "method", GRID).agg((F.sum(F.col("capacity_mw") * F.col("w")) / F.sum("capacity_mw")).alias("w"))
    return by.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("group_id", "method")))


def effective_cells(weights: DataFrame) -> DataFrame:
    """1 / sum of squared weights, and the largest weight, by group and method."""
    return weights.groupBy("group_id", "method").agg((1.0 / F.sum(F.col("w") * F.col("w"))).alias("effective_cells"), F.max("w").alias("largest_weight"))


def nearest_gap(dist: DataFrame) -> DataFrame:
    """The nearest cell of each turbine, its distance, and how much further the next one is."""
    w = Window.partitionBy("turbine_id").orderBy("km", GRID)
    return dist.select(
        "turbine_id", GRID, "km", F.row_number().over(w).alias("place"), (F.lead("km").over(w) - F.col("km")).alias("gap_km")
    ).filter("place = 1").drop("place")


def in_order(cells) -> list:
    """Ids in order: numbers by value before texts, whose digits count as numbers."""
    return sorted(
        cells, key=lambda c: (0, c, ()) if isinstance(c, (int, float)) else (
            1, 0, tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", str(c)) if x)
        )
    )


def _number(group: str) -> int:
    return int(re.search(r"(\d+)$", group)[1])


@dataclass(frozen=True)
class SpatialPooler:
    """Weights fitted on training weather, and the schema that transform() demands."""

    weights: tuple[tuple[str, str, object, float], ...]
    geometry: tuple[tuple[object, float, float], ...]
    grid_type: T.DataType
    columns: tuple[str, ...]
    groups: tuple[str, ...]
    methods: tuple[str, ...]
    source: str
    prefix: str

    @property
    def output_columns(self) -> list[str]:
        return [f"{self.prefix}_{c}_{g}_{m}" for c in self.columns for g in self.groups for m in self.methods]

    def check(self, df: DataFrame) -> None:
        check_columns(df, META, self.source)
        check_schema_match(self.columns, value_columns(df), f"{self.source} columns of fit and transform")
        seen = {r[GRID]: (r[LAT], r[LON]) for r in grid_geometry(df).limit(MOST_CELLS + 1).collect()}
        known = {g: (a, o) for g, a, o in self.geometry}
        require(set(seen) == set(known), f"{self.source}: cells differ from those of the fit: {in_order(set(seen) ^ set(known))}")
        moved = [g for g in known if seen[g] != known[g]]
        require(not moved, f"{self.source}: coordinates differ from those of the fit in cells {in_order(moved)}")

    def transform(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """{prefix}_{column}_{group}_{method} by forecast time."""
        df = nan_to_null(df)
        if strict:
            self.check(df)
        pairs = [(g, m) for g in self.groups for m in self.methods]
        by_cell: dict[object, dict] = {}
        for g, m, cell, w in self.weights:
            by_cell.setdefault(cell, {})[(g, m)] = w
        schema = T.StructType([T.StructField(GRID, self.grid_type), *[T.StructField(f"w{k}", T.DoubleType()) for k in range(len(pairs))]])
        wide = F.broadcast(df.sparkSession.createDataFrame([(cell, *[w.get(p, 0.0) for p in pairs]) for cell, w in by_cell.items()], schema))
        step, parts = max(1, SUMS // (2 * len(pairs))), []
        for at in range(0, len(self.columns), step):
            made = []
            for c in self.columns[at : at + step]:
                x = F.col(f"`{c}`").cast("double")
                for k, (g, m) in enumerate(pairs):
                    have = F.sum(F.when(x.isNotNull(), F.col(f"w{k}")))
                    made.append(F.when(have > 0, F.sum(F.col(f"w{k}") * x) / have).alias(f"{self.prefix}_{c}_{g}_{m}"))
            parts.append(df.join(wide, GRID).groupBy(FORECAST).agg(*made))
        return reduce(lambda a, b: a.join(b, FORECAST), parts).select(FORECAST, *[F.col(f"`{c}`") for c in self.output_columns])


def fit_pooler(
    train: DataFrame, turbines: DataFrame, source: str, methods: str | tuple[str, ...] = ("nearest", "idw"), power: float = 2.0,
    prefix: str | None = None, neighbours: int = 4
) -> SpatialPooler:
    """A pooler from training weather's geometry and the turbines."""
    check_source(source)
    methods = check_methods(methods)
    power = check_number(power, "idw_power", over=0.0)
    prefix = check_prefix(f"{source}_pool" if prefix is None else prefix)
    check_turbines(turbines)
    require(isinstance(neighbours, int) and not isinstance(neighbours, bool) and neighbours > 0, f"neighbours must be an integer over 0, got {neighbours!r}")
    n = turbines.count()
    require(n <= MOST_TURBINES, f"turbines: more than {MOST_TURBINES}")
    train = nan_to_null(train)
    columns = tuple(value_columns(train))
    geometry = grid_geometry(train)
    cells = geometry.limit(MOST_CELLS + 1).collect()
    require(len(cells) <= MOST_CELLS and len(cells) * n <= MOST_PAIRS, f"{source}: more than {MOST_CELLS} cells or {MOST_PAIRS} pairs of turbine and cell")
    fixed = train.sparkSession.createDataFrame([tuple(r) for r in cells], geometry.schema)
    weights = group_weights(turbine_weights(distances(turbines, fixed), methods, power, neighbours)).select("group_id", "method", GRID, "w").collect()
    groups = tuple(sorted({r["group_id"] for r in weights}, key=_number))
    return SpatialPooler(
        tuple(tuple(r) for r in weights), tuple(tuple(r) for r in cells), train.schema[GRID].dataType, columns, groups, methods, source,
        prefix
    )


def bearings(turbines: DataFrame, geometry: DataFrame) -> DataFrame:
    """(group, cell, east, north): the unit vector from a group's capacity-weighted centre to each cell; missing where they agree."""
    mw = F.col("capacity_mw").cast("double")
    centre = turbines.groupBy("group_id").agg((F.sum(mw * F.col(LAT)) / F.sum(mw)).alias("lat"), (F.sum(mw * F.col(LON)) / F.sum(mw)).alias("lon"))
    both = centre.crossJoin(F.broadcast(geometry))  # groups and cells: two dimensions of bounded size
    east, north = (F.col(LON) - F.col("lon")) * F.cos(F.radians("lat")), F.col(LAT) - F.col("lat")
    far = F.hypot(east, north)
    return both.select("group_id", GRID, F.when(far > 0, east / far).alias("east"), F.when(far > 0, north / far).alias("north"))


def pool_upwind(
    df: DataFrame, pooler: SpatialPooler, turbines: DataFrame, from_sin: str, from_cos: str, column: str, method: str = "idw",
    lean: float = 0.5
) -> DataFrame:
    """(time, group, pooled, plain): a column's mean with a method's weights times 1 + lean cos(angle between a cell's bearing and where the
    cell's wind comes from), so cells upwind count for more; without direction or bearing the factor is 1. plain: without it."""
    require(method in pooler.methods, f"the pooler has no method {method!r}")
    lean = check_number(lean, "lean", least=0.0)
    require(lean < 1, f"lean must be under 1, got {lean!r}")
    s = df.sparkSession
    weights = s.createDataFrame(
        [(g, cell, w) for g, m, cell, w in pooler.weights if m == method],
        T.StructType([T.StructField("group_id", T.StringType()), T.StructField(GRID, pooler.grid_type), T.StructField("w", T.DoubleType())])
    )
    places = s.createDataFrame(
        list(pooler.geometry),
        T.StructType([T.StructField(GRID, pooler.grid_type), T.StructField(LAT, T.DoubleType()), T.StructField(LON, T.DoubleType())])
    )
    lookup = weights.join(bearings(turbines, places), ["group_id", GRID])  # at most groups x cells rows
    x = F.col(f"`{column}`").cast("double")
    rows = nan_to_null(df).select(
        FORECAST, GRID, x.alias("x"), F.col(from_sin).alias("s"), F.col(from_cos).alias("c")
    ).filter("x is not null").join(F.broadcast(lookup), GRID)
    w = F.col("w") * F.coalesce(1.0 + lean * (F.col("s") * F.col("east") + F.col("c") * F.col("north")), F.lit(1.0))
    return rows.groupBy(FORECAST, "group_id").agg(
        (F.sum(w * F.col("x")) / F.sum(w)).alias("pooled"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("plain")
    )

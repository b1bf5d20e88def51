"""A PySpark engine for gridded forecasts and the wind-power features, scores and lineage built on them."""

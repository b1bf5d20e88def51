"""Sharding by sampled splitters.

A sample of keys, each drawn with a chance in proportion to its size, gives quantile
boundaries; keys are dealt to the ranges between them. The exact bytes and rows of each
range are then summed, and ranges that hold more than twice their share, their largest key apart, are subdivided by a
sample of their own, with a rate that doubles each round, until none is overfull. Places of ranges
in the whole follow from those sums (a table as long as the list of ranges), places inside a
range from a running sum over that range alone. Shard s takes the rows whose middle byte lies in
the s-th of n equal parts, so sizes differ by about a row's size.

The key is (hash of the text, id): equal texts lie together unless a boundary between shards falls into
their group. Rows with one key are counted, not listed, while ranges are made, and are numbered in parts of bounded size,
so a group of identical rows of any size is no task of its own. What comes to the driver is bounded by
`most_ranges`: samples and sums of ranges, as arrays.

Defined results: a null text has no bytes (and size 1); null ids have a key of their own, before others; repeated
rows follow one another; an empty table gives no rows; n shards are always numbered 0 to n-1, and some
stay empty where rows are few or one row holds more than a part; a very long text is one row of its size. All columns stay, whatever
their names, but for columns named shard and slot, which the results replace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, read


@dataclass(frozen=True)
class Sharding:
    """shards; rows to a range and to a part of a key's rows (about); ranges at least and at most; sampled keys to a range."""

    shards: int = 16
    rows_per_range: int = 200_000
    least_ranges: int = 64
    most_ranges: int = 50_000
    oversample: int = 16
    seed: int = 6


class Splitters:
    """Range numbers of (hash, id) keys: how many boundaries are at or under the key."""

    def __init__(self, h: np.ndarray, i: np.ndarray):
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1])])[: len(h)]
        self.h, self.i = h[new], i[new]

    def find(self, h: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.h, h, "left")
        end = np.searchsorted(self.h, h, "right")
        same = np.flatnonzero(end > at)
        if len(same):
            order = same[np.argsort(h[same], kind="stable")]
            cuts = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] - 1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):  # one step for each boundary hash that occurs
                rows = order[a:b]
                lo, hi = at[rows[0]], end[rows[0]]
                at[rows] = lo + np.searchsorted(self.i[lo:hi], i[rows], "right")
        return at

    def with_more(self, more: Splitters) -> Splitters:
        return Splitters(np.concatenate([self.h, more.h]), np.concatenate([self.i, more.i]))


def _deal(keys: DataFrame, cuts: Splitters) -> DataFrame:
    """keys with their range."""

    @F.pandas_udf("int")
    def run(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(cuts.find(h.to_numpy(np.int64), i.to_numpy(np.int64)).astype(np.int32))

    return keys.withColumn("range", run("h", "i"))


def _draw(keys: DataFrame, per_byte: float, cfg: Sharding, salt: int) -> Splitters:
    """Keys drawn by hash with a chance in proportion to their bytes, about per_byte times the bytes of all, as arrays."""
    chance = F.least(F.lit(1.0), F.col("bytes") * F.lit(per_byte))
    luck = F.pmod(F.xxhash64("h", "i", F.lit(cfg.seed + salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = keys.filter(luck < chance).select("h", "i").toArrow()
    return Splitters(drawn["h"].to_numpy(), drawn["i"].to_numpy())


def _sums(dealt: DataFrame) -> dict[str, np.ndarray]:
    """Bytes, rows and the largest key of each range, by range."""
    sums = dealt.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("largest")).toArrow().sort_by("range")
    return {c: sums[c].to_numpy() for c in sums.column_names}


def _placed(keys: DataFrame, cfg: Sharding, scratch: Scratch, total: int, count: int) -> DataFrame:
    """keys with start (bytes before a key's first row) and place (rows before it) in the order of the keys."""
    spark = keys.sparkSession
    ranges = int(min(cfg.most_ranges, max(cfg.least_ranges, count // cfg.rows_per_range)))
    share = total / ranges
    sample = _draw(keys, cfg.oversample * ranges / max(total, 1), cfg, 0)
    every = slice(cfg.oversample // 2, None, cfg.oversample)
    cuts, rate = Splitters(sample.h[every], sample.i[every]), 4
    name = "dealt-0"
    dealt = scratch.write(_deal(keys, cuts), name)
    sums = _sums(dealt)
    while len(over := sums["range"][sums["bytes"] - sums["largest"] > 2 * share]):
        overfull = F.broadcast(spark.createDataFrame(pa.table({"range": over})))  # at most most_ranges / 2 numbers
        more = _draw(dealt.join(overfull, "range", "left_semi"), rate / share, cfg, rate)
        cuts, rate = cuts.with_more(more), 2 * rate
        scratch.drop(name)
        name = f"dealt-{rate}"
        dealt = scratch.write(_deal(keys, cuts), name)
        sums = _sums(dealt)
    before = lambda x: np.cumsum(x) - x
    # as many rows as there are ranges
    places = spark.createDataFrame(pa.table({"range": sums["range"], "bytes_before": before(sums["bytes"]), "rows_before": before(sums["n"])}))
    w = Window.partitionBy("range").orderBy("h", "i", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    placed = dealt.withColumn("bytes_in", upto("bytes")).withColumn("rows_in", upto("n")).join(F.broadcast(places), "range")
    return placed.select(
        "h", "i", "size", "n", (F.col("bytes_before") + F.col("bytes_in")).cast("long").alias("start"),
        (F.col("rows_before") + F.col("rows_in")).cast("long").alias("place")
    )


def assign(rows: DataFrame, hash_col: str, id_col: str, size_col: str, cfg: Sharding | None = None) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard).

    hash_col (long, not null) and id_col (long) are the key, size_col (long, over 0) the weight.
    """
    cfg = cfg or Sharding()
    scratch = Scratch(rows.sparkSession, "shards")
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    # own names are apart from the rows' columns, which are one
    rows = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(hash_col).alias("h"),
        F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("i"), F.col(size_col).alias("size")
    )
    keys = rows.groupBy("h", "i", "size").agg(F.count("*").alias("n"))
    keys = scratch.write(keys.withColumn("bytes", F.col("size") * F.col("n")), "keys")
    total, count = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long"), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = scratch.write(_placed(keys, cfg, scratch, total, count), "placed")

    def shard_of(copy: str):
        """Of a row by the middle of its bytes, in whole numbers."""
        return F.expr(f"cast(least({cfg.shards - 1}, (start + size div 2 + cast({copy} as decimal(38, 0)) * size) * {cfg.shards} div {max(total, 1)}) as int)")

    # the first place of each shard: of a key whose rows lie in several shards, the first copy in each
    some = placed.withColumn("s", F.explode(F.sequence(shard_of("0"), shard_of("n - 1"))))
    least = F.ceil((F.col("s") * F.lit(total).cast("decimal(38,0)") / cfg.shards - F.col("start") - F.expr("size div 2")) / F.col("size")).cast("long")
    some = some.withColumn("copy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.greatest(F.lit(0), F.least(F.col("n") - 1, least + d)))))
    first = some.filter(shard_of("copy") == F.col("s")).groupBy(F.col("s").alias("shard")).agg(F.min(F.col("place") + F.col("copy")).alias("first"))

    key = ["h", "i", "size"]
    several = placed.filter("n > 1")
    once = rows.join(placed.filter("n = 1").hint("merge"), key).withColumn("copy", F.lit(0).cast("long"))
    # rows of one key are numbered in parts, which are drawn once and written
    parts = F.ceil(F.col("n") / cfg.rows_per_range)
    again = rows.join(several.hint("merge"), key).withColumn("part", F.floor(F.rand(cfg.seed) * parts)).withColumn("draw", F.rand(cfg.seed + 1))
    again = scratch.write(again, "again")
    by_part = again.groupBy(*key, "part").agg(F.count("*").alias("of"))
    by_part = by_part.withColumn("ahead", F.sum("of").over(Window.partitionBy(*key).orderBy("part")) - F.col("of")).drop("of")
    number = F.row_number().over(Window.partitionBy(*key, "part").orderBy("draw")) - 1
    again = again.withColumn("number", number).join(by_part, [*key, "part"]).withColumn("copy", (F.col("ahead") + F.col("number")).cast("long"))
    told = once.select("row", "size", "start", "place", "copy").unionByName(
        again.select("row", "size", "start", "place", "copy")
    ).withColumn("shard", shard_of("copy"))
    told = told.join(F.broadcast(first), "shard")  # a row for each shard
    return told.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", (F.col("place") + F.col("copy") - F.col("first")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to 16 shards of near equal bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("text_hash")
    )
    rows = rows.fillna(1, ["size"])
    made = assign(rows, "text_hash", "doc_id", "size")
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "text_hash")


#: The law over all rows in the order of the key; CRC-32 by its table, which a rule makes.
OP6_SQL = """
WITH t AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256)))),
b AS (
  SELECT doc_id, coalesce(text, '') AS text, [CAST(4294967295 AS BIGINT)] || [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes FROM documents),
d AS (
  SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS text_hash,
    xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
o AS (SELECT *, sum(size) OVER (ORDER BY text_hash, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(least(15, (start + size // 2) * 16 // total) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY text_hash, doc_id NULLS FIRST) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, text_hash
FROM s
"""

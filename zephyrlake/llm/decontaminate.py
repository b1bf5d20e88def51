"""Benchmark decontamination: short items found inside long texts, with DataFrame functions only.

Containment MinHash: of an item's shingles, each of the `perms` hash orders picks its smallest. An
item contained to a share t in a text has each pick there with chance t, however long the text
is, so picks are looked up among the text's shingles instead of comparing two signatures.
Items are partitioned by size: each size has its own number of distinct picks, and the least number of them that must be
found, set so that a contained item is missed with a chance under `miss`. Items with no more shingles than orders
can lose picks only through shingles that are really missing. A partition is joined only with texts that have as many
shingles as a contained item of its size needs.

1. Candidates: texts' shingles are joined with the picks alone, and the picks found are counted by text and item.
2. Exact containment: the full shingles of candidate texts and of their items are joined, and the distinct shared ones
   counted over the item's. Other texts are not read again.

Picks and items' shingles are broadcast if all items have at most `broadcast_rows` shingles together; beyond that,
texts' shingles are first held against residues of the picks' hashes (a bounded table), and the rest is merge joins, where a
shingle of very many texts can be split.

Words are runs of letters and digits, lower case; a shingle is five words. An item with fewer words has its whole
sequence as its one shingle, which is looked for as such; `shortest` asks for a least number of words.

Defined results: null and empty texts, and texts without letters and digits, have no shingle and are found nowhere; of items
with equal id the shingles are put together; repeated rows of documents count once; a null id stays null; of rows with equal id
and different texts each is searched, and the best counts; a very long text is searched whole; empty tables give no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, read, slot_of, split_by_slots
from zephyrlake.llm.line_dedup import let


@dataclass(frozen=True)
class Decontamination:
    """Words to a shingle, containment as num/den, hash orders, chance of a miss, least words of an item; broadcast_rows: items' shingles that are broadcast, at most."""

    words: int = 5
    num: int = 80
    den: int = 100
    perms: int = 24
    miss: float = 1e-6
    shortest: int = 1
    broadcast_rows: int = 1_000_000

    def needed(self, picks: int, size: int) -> int:
        """The most distinct picks that may be asked for: a contained item has as many but for a chance of miss.

        size shingles of which size - ceil(t size) may be missing; picks of them are drawn without return. Sizes over EXACT
        take a bound that holds for all sizes.
        """
        if size > EXACT:
            return self._any_size(picks)
        lost, total = size - math.ceil(self.num * size / self.den), math.comb(size, picks)
        chance, found = 0.0, max(0, picks - lost)
        while found < picks:
            chance += math.comb(lost, picks - found) * math.comb(size - lost, found) / total
            if chance > self.miss:
                break
            found += 1
        return max(1, found)

    def _any_size(self, picks: int) -> int:
        """By Chernoff's bound, which holds for draws without return too: at most x of the picks are found with a chance under exp(-picks KL(x / picks, t))."""
        t, needed = self.num / self.den, 1
        for x in range(1, picks):
            a = x / picks
            if a >= t or math.exp(-picks * (a * math.log(a / t) + (1 - a) * math.log((1 - a) / (1 - t)))) > self.miss:
                break
            needed = x + 1
        return needed


#: Up to this size the chance of a miss is computed for the very size.
EXACT = 512


def word_hashes(text: Column) -> Column:
    """array<long>: hashes of the text's words; of one empty word where it has none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.split(plain, " ", -1), lambda w: F.xxhash64(w))


def _joined(hashes: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; none where there are fewer words."""
    at = F.sequence(F.lit(0), F.size(hashes) - k)
    return F.when(
        F.size(hashes) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    ).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(text: Column, lengths: tuple[int, ...]) -> Column:
    """array<long>: distinct hashes of the text's shingles of these numbers of words."""
    return let(word_hashes(text), lambda h: F.array_distinct(F.concat(*[_joined(h, k) for k in lengths])))


def item_hashes(text: Column, cfg: Decontamination) -> Column:
    """array<struct<h, words>>: an item's shingles, or its whole sequence where it has fewer words than one."""

    def told(h: Column) -> Column:
        hashes, words = _joined(h, cfg.words), F.size(h)
        for k in range(1, cfg.words):
            hashes = F.when(words == k, _joined(h, k)).otherwise(hashes)
        return F.transform(hashes, lambda x: F.struct(x.alias("h"), F.least(words, F.lit(cfg.words)).alias("words")))

    some = F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")
    return F.when(some, let(word_hashes(text), lambda h: F.filter(told(h), lambda x: F.size(h) >= cfg.shortest)))


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    cfg: Decontamination | None = None
) -> DataFrame:
    """(id, item, n_item_shingles, n_shared, containment) of each item contained in a text to the threshold."""
    cfg = cfg or Decontamination()
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    item = items.select(F.col(item_col).alias("item"), F.explode(item_hashes(F.col(text_col), cfg)).alias("x"))
    item = scratch.write(item.select("item", "x.h", "x.words").distinct(), "items")
    lengths = tuple(sorted({cfg.words, *(r["words"] for r in item.select("words").distinct().collect())}))  # at most cfg.words numbers
    item = item.select("item", "h").distinct()
    small = item.count() <= cfg.broadcast_rows
    hint = F.broadcast if small else (lambda x: x.hint("merge"))

    # picks: an item's smallest shingle in each order, with the item's size and how many of its picks are needed
    orders = [F.min_by("h", F.xxhash64("h", F.lit(k))).alias(f"p{k}") for k in range(cfg.perms)]
    picks = item.groupBy("item").agg(F.count("*").alias("size"), F.array_distinct(F.array(*orders)).alias("picks"))
    sizes = picks.select(F.size("picks").alias("n"), F.least("size", F.lit(EXACT + 1)).alias("of")).distinct().collect()  # at most perms x (EXACT + 1) rows
    rule = spark.createDataFrame([(r["n"], r["of"], cfg.needed(r["n"], r["of"])) for r in sizes], "n int, of long, needed int")
    picks = picks.withColumn("n", F.size("picks")).withColumn("of", F.least("size", F.lit(EXACT + 1))).join(F.broadcast(rule), ["n", "of"])
    picks = scratch.write(picks.select("item", "size", "needed", F.explode("picks").alias("h")), "picks")

    row = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), shingle_hashes(F.col(text_col), lengths).alias("hs"))
    each = row.select("id", "version", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    if not small:
        each, _ = split_by_slots(each, slot_of("h"), picks.select(slot_of("h")))
    met = each.join(hint(picks), "h").filter(cfg.den * F.col("n") >= cfg.num * F.col("size"))
    found = met.groupBy("id", "version", "item", "size", "needed").agg(F.count_distinct("h").alias("found"))
    candidates = scratch.write(found.filter("found >= needed").select("id", "version", "item", "size"), "candidates")

    # full shingles, of candidates alone
    may, _ = split_by_slots(docs, slot_of(id_col, F.xxhash64(text_col)), candidates.select(slot_of("id", "version")))
    full = may.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("v"), F.explode(shingle_hashes(F.col(text_col), lengths)).alias("h"))
    if small:
        full = full.join(F.broadcast(item.select("h").distinct()), "h", "left_semi")
    wanted = candidates.alias("c").join(
        hint(item.alias("t")), F.col("c.item").eqNullSafe(F.col("t.item"))
    ).select("id", "version", "c.item", "size", F.col("t.h").alias("g"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")) & (F.col("g") == F.col("h"))
    shared = wanted.join(full.hint("merge"), same).groupBy("id", "version", "item", "size").agg(F.count_distinct("h").alias("shared"))
    contained = shared.filter(cfg.den * F.col("shared") >= cfg.num * F.col("size")).groupBy("id", "item", "size").agg(F.max("shared").alias("shared"))
    share = (F.col("shared") / F.col("size")).alias("containment")
    return contained.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("size").alias("n_item_shingles"), F.col("shared").alias("n_shared"),
        share
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items against all documents."""
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
  FROM d, (SELECT DISTINCT least(len(w), 5) AS k FROM b)),
bs AS (
  SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS s
  FROM (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE w[1] <> '')),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item_shingles
"""

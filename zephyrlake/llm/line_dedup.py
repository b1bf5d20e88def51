"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Lines are hashed; a rolling hash over the hashes of `window` lines (itself a hash of theirs)
closes a chunk after a line where it is 0 modulo `every`. A line of `alone_words` words or more stands
alone, with a boundary before and after it. All boundaries thus follow from nearby content
and stay in place when lines are added or removed elsewhere.

A chunk that occurs more than once in the corpus is a repeat wherever it isn't the first (by id, then place in the text).
Adjacent repeats of a text are a run. A run of two lines or more and `least_words` words, or of `long_words` words, is
taken out, chunk by chunk, after each chunk's bytes have been compared with the first's. So a
passage is found whether its lines are long or short, many or few; of short lines those before the first
boundary inside the passage, and after the last, have neighbours in their chunks and stay.

Only hashes and places are shuffled to find runs. Texts of their chunks, and of documents that lose some, are
shuffled where a bounded table of hash residues, broadcast, says that they may be meant. These joins
are merge joins at every size, so a hash with very many rows can be split.

Defined results: a null text stays null and an empty one empty; a text all of whose chunks go
becomes empty; a chunk of the same hash but other bytes than the first stays; empty lines are lines of no words; rows of equal id
and text count as one document, so each keeps what the first occurrence keeps; a null id is a value
that sorts first; a very long text counts whole; an empty table gives no rows. Other columns pass through unchanged, whatever their names;
the count of chunks replaces a column of the name that it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, free_name, read, slot_of, split_by_slots


@dataclass(frozen=True)
class LineDedup:
    """Lines under the rolling hash, its modulus, words of lines that stand alone; words of a run of two lines, and of any run."""

    window: int = 2
    every: int = 2
    alone_words: int = 12
    least_words: int = 20
    long_words: int = 50


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, also where f uses it inside lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def line_chunks(text: Column, cfg: LineDedup) -> Column:
    """array<struct<pos, text, words, lines>> of the chunks of a text; their texts joined by line feeds are the text."""

    def closes(hashes: Column, i: Column) -> Column:
        near = F.array_join(F.slice(hashes, F.greatest(i - (cfg.window - 2), F.lit(1)), F.least(i + 1, F.lit(cfg.window))), "")
        return F.conv(F.substring(F.md5(near), 1, 4), 16, 10).cast("int") % cfg.every == 0

    def starts(hashes: Column, sizes: Column) -> Column:
        alone = lambda i: F.get(sizes, i) >= cfg.alone_words
        return F.filter(F.sequence(F.lit(0), F.size(sizes) - 1), lambda i: (i == 0) | alone(i) | alone(i - 1) | closes(hashes, i - 1))

    def cut(lines: Column, sizes: Column, at: Column) -> Column:
        def chunk(k: Column) -> Column:
            begin = F.get(at, k)
            n = F.coalesce(F.get(at, k + 1), F.size(lines)) - begin
            count = F.aggregate(F.slice(sizes, begin + 1, n), F.lit(0), lambda a, x: a + x)
            return F.struct(k.alias("pos"), F.array_join(F.slice(lines, begin + 1, n), "\n").alias("text"), count.alias("words"), n.alias("lines"))

        return F.transform(F.sequence(F.lit(0), F.size(at) - 1), chunk)

    def whole(lines: Column) -> Column:
        hashes, sizes = F.transform(lines, F.md5), F.transform(lines, words)
        return let(sizes, lambda s: let(hashes, lambda h: let(starts(h, s), lambda at: cut(lines, s, at))))

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), whole)


def _runs(rows: DataFrame, repeated: DataFrame, cfg: LineDedup) -> DataFrame:
    """(id, version, pos, h) of the chunks in runs that go; repeated has h and the place of its first chunk."""
    may, _ = split_by_slots(rows, slot_of("h"), repeated.select(slot_of("h")))
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("version") == F.col("first.version")) & (F.col("pos") == F.col("first.pos"))
    copies = may.join(repeated.hint("merge"), "h").filter(~is_first)
    copies = copies.groupBy("id", "version", "pos").agg(*[F.first(c).alias(c) for c in ("h", "words", "lines")])  # rows of equal id and text are one
    run = F.col("pos") - F.row_number().over(Window.partitionBy("id", "version").orderBy("pos"))
    of = copies.withColumn("run", run).groupBy("id", "version", "run").agg(
        F.sum("words").alias("words"), F.sum("lines").alias("lines"), F.collect_list(F.struct("pos", "h")).alias("c")
    )
    gone = (F.col("words") >= cfg.long_words) | ((F.col("lines") >= 2) & (F.col("words") >= cfg.least_words))
    return of.filter(gone).select("id", "version", F.explode("c").alias("c")).select("id", "version", "c.*")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: LineDedup | None = None, count_col: str = "removed_chunks"
) -> DataFrame:
    """docs with runs of repeated chunks taken out of text_col, and count_col (long): how many chunks went."""
    cfg = cfg or LineDedup()
    scratch = Scratch(docs.sparkSession, "line-dedup")
    told = F.transform(
        line_chunks(F.col(text_col), cfg), lambda c: F.struct(
            c["pos"].alias("pos"), F.xxhash64(c["text"]).alias("h"), c["words"].alias("words"), c["lines"].alias("lines")
        )
    )
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.explode(told).alias("c"))
    rows = scratch.write(rows.select("id", "version", "c.*"), "rows")

    repeated = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "version", "pos")).alias("first"))
    repeated = scratch.write(repeated.filter("n > 1").select("h", "first"), "repeated")
    copies = scratch.write(_runs(rows, repeated, cfg), "copies")
    scratch.drop("rows")

    # texts of those chunks and of the first ones, for the comparison of bytes
    firsts = repeated.join(copies.select("h").distinct().hint("merge"), "h").select("first.*", "h")
    wanted = copies.withColumn("is_first", F.lit(False)).unionByName(firsts.withColumn("is_first", F.lit(True)))
    wanted = scratch.write(wanted.groupBy("id", "version").agg(F.collect_list(F.struct("pos", "h", "is_first")).alias("c")), "wanted")
    v, g, i = (free_name(docs, x) for x in ("text_version", "gone_chunks", "gone_id"))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(v))
    named = lambda df, c: df.select(F.col("id").alias(i), F.col("version").alias(v), F.col(c).alias(g))
    held, _ = split_by_slots(docs, slot_of(id_col, F.xxhash64(text_col)), wanted.select(slot_of("id", "version")))
    held = held.join(named(wanted, "c").hint("merge"), same)
    text_of = let(
        line_chunks(F.col(text_col), cfg), lambda c: F.transform(
            F.col(g), lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), x["is_first"].alias("is_first"), F.get(c, x["pos"])["text"].alias("text"))
        )
    )
    texts = held.select(F.col(i).alias("id"), F.col(v).alias("version"), F.explode(text_of).alias("c"))
    texts = scratch.write(texts.select("id", "version", "c.*"), "texts")
    first = texts.filter("is_first").select("h", F.col("text").alias("first_text")).dropDuplicates(["h"])
    gone = texts.filter("not is_first").join(first.hint("merge"), "h").filter(F.col("text") == F.col("first_text"))
    gone = scratch.write(gone.groupBy("id", "version").agg(F.collect_set("pos").alias("gone")), "gone")
    for name in ("repeated", "copies", "wanted", "texts"):
        scratch.drop(name)

    touched, clear = split_by_slots(docs, slot_of(id_col, F.xxhash64(text_col)), gone.select(slot_of("id", "version")))
    joined = touched.join(named(gone, "gone").hint("merge"), same, "left")
    stay = lambda c: F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col(g))
    left = let(line_chunks(F.col(text_col), cfg), lambda c: F.array_join(F.transform(stay(c), lambda k: F.get(c, k)["text"]), "\n"))
    rest = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(left)
    names = [c for c in docs.columns if c != count_col]
    columns = [rest.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    joined = joined.select(*columns, F.coalesce(F.size(g), F.lit(0)).cast("long").alias(count_col))
    return clear.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias(count_col)).unionByName(joined)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs)


OP8_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
s AS (
  SELECT doc_id, text, lines, [md5(x) for x in lines] AS hs,
    [CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, ' ', '')) + 1 END for x in lines] AS ws FROM l),
u AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, unnest(ws) AS w, hs, ws FROM s),
b AS (
  SELECT doc_id, i, line, w,
    CASE WHEN i = 1 OR w >= 12 OR ws[i - 1] >= 12
      OR CAST('0x' || substr(md5(CASE WHEN i = 2 THEN hs[1] ELSE hs[i - 2] || hs[i - 1] END), 1, 4) AS INTEGER) % 2 = 0
    THEN 1 ELSE 0 END AS cut FROM u),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM b),
c AS (
  SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, sum(w) AS w, count(*) AS n FROM k GROUP BY doc_id, pos),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS again FROM c),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, again ORDER BY pos) AS run FROM r),
t AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, again, run) AS run_words, sum(n) OVER (PARTITION BY doc_id, again, run) AS run_lines FROM g),
z AS (SELECT *, again AND (run_words >= 50 OR (run_lines >= 2 AND run_words >= 20)) AS gone FROM t),
o AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS removed_chunks FROM z GROUP BY doc_id)
SELECT o.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE o.text END AS text, CAST(o.removed_chunks AS BIGINT) AS removed_chunks
FROM o JOIN documents d USING (doc_id)
"""

"""The corpus pipeline: documents in, token ids of the documents that stay out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last
return the columns of documents, whatever their names.

Defined results: rows that share a doc_id are one document for near_dedup and decontaminate, and stay or go
together (near_dedup asks whether any of their texts is another document's); toxicity and line_dedup judge each row's text; a row
without doc_id can't be named by a decision of those two and stays; null and empty texts stay; very long texts are worked on
whole; empty tables give no rows, and without labels or benchmark items nothing is taken out by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, free_name, read, without
from zephyrlake.llm.decontaminate import find_items
from zephyrlake.llm.line_dedup import remove_repeats
from zephyrlake.llm.near_dedup import NearDup, near_duplicates
from zephyrlake.llm.pieces import encode
from zephyrlake.llm.toxicity import fit, held_out, score_column


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model is fitted on labelled documents of the stage's input."""
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    return docs.filter(score_column(F.col("text").cast("string"), model) < model.config.threshold)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; those go that had text and are left with none."""
    n = free_name(docs, "removed_chunks")
    left = remove_repeats(docs, count_col=n).filter((F.col(n) == 0) | (F.trim("text") != ""))
    changed = F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return left.select(*[changed if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near-duplicates (five words, similarity 0.8)."""
    gone = near_duplicates(docs, cfg=NearDup()).filter("doc_id <> component_id").select("doc_id")
    return without(docs, gone, "doc_id")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    gone = find_items(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, gone, "doc_id")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids, with merge-dropout."""
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the learned lexicon nor the merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two the rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs

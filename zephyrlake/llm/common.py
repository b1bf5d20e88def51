"""What the operators share: reading tables, cutting lineage, and naming scratch columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z as bytes; other letters stay as they are.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[[^-]|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder, to cut lineage and to use a result twice.

    They outlive a lost executor. drop() deletes a table that nothing reads any more; the
    rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


#: Rows that a Python worker gets at once, at most.
BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends at most BATCH_ROWS rows at once to Python workers from now on: ten thousand long texts, Spark's default, are
    held several times over outside an executor's heap."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def releasing(run: Callable) -> Callable:
    """run, a function over a partition's batches, that gives freed memory back to the system at the partition's end: Python workers live on,
    and what one stage took would else be missing to the next."""

    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return over


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() would change other letters, and with them their bytes."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: Residues of a hash, for tables that are broadcast as bits: their size is bounded whatever they are made from.
SLOTS, BITS = 1 << 22, 64


def slot_of(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def split_by_slots(rows: DataFrame, slot: Column, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose slot is among slots, the others): at most SLOTS / BITS numbers of 64 bits are broadcast, and only the first part needs a shuffle."""
    word, bits = free_name(rows, "slot_word"), free_name(rows, "slot_bits")
    each = slots.toDF("slot").select(F.expr(f"slot div {BITS}").alias(word), F.expr(f"shiftleft(1L, slot % {BITS})").alias("bit"))
    some = F.broadcast(each.groupBy(word).agg(F.bit_or("bit").alias(bits)))
    there = (F.floor(slot / BITS) == F.col(word)) & (F.getbit(F.col(bits), slot % BITS) == 1)
    return rows.join(some, there, "left_semi"), rows.join(some, there, "left_anti")


def without(rows: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """rows whose id isn't among gone's; rows without id stay. Merge joins at every size, so that a large id can be split."""
    may, clear = split_by_slots(rows, slot_of(id_col), gone.select(slot_of(id_col)))
    return clear.unionByName(may.join(gone.hint("merge"), id_col, "left_anti").select(*[f"`{c}`" for c in rows.columns]))

"""File sources: CSV under a schema, manifests, fingerprints, workbooks, notebooks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrlake.functions.nulls import nan_to_null
from zephyrlake.operators.contracts import require
from zephyrlake.plans.store import Store


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV with header (a byte order mark is no part of it) under a schema; a header of other names or order fails, and so do texts of another type.

    Only the given columns are read where `columns` says so.
    """
    reader = spark.read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    df = reader.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST", nullValue="", encoding="UTF-8")
    return nan_to_null(df if columns is None else df.select(*columns))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of a Markdown table whose rows hold `path`, a size and a hash."""
    row = r"^\|\s*`?([^|`]+?)`?\s*\|\s*([\d,]+)[^|]*\|\s*`?([0-9a-fA-F]{64})`?\s*\|"
    lines = spark.read.text(path).filter(F.col("value").rlike(row))
    part = lambda g: F.regexp_extract("value", row, g)
    return lines.select(part(1).alias("path"), F.regexp_replace(part(2), ",", "").cast("long").alias("bytes"), F.lower(part(3)).alias("sha256"))


def fingerprints(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, bytes, sha256) of files that Spark can read; a file that isn't there fails."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    for name, path in paths.items():
        p = fs(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(f"{name}: {path}")
    made = None
    for name, path in paths.items():
        one = spark.read.format("binaryFile").load(path).select(
            F.lit(name).alias("name"), F.lit(path).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
        )
        made = one if made is None else made.unionByName(one)
    require(made is not None, "no files")
    return made


def manifest_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """By expected path: is it there, do size and hash agree, and all of it."""
    a = actual.select("path", F.col("bytes").alias("a_bytes"), F.lower("sha256").alias("a_sha"))
    rows = expected.join(a, "path", "left").select(
        "path", F.col("a_bytes").isNotNull().alias("exists"), F.coalesce(F.col("bytes") == F.col("a_bytes"), F.lit(False)).alias("size_ok"),
        F.coalesce(F.lower("sha256") == F.col("a_sha"), F.lit(False)).alias("hash_ok")
    )
    return rows.withColumn("ok", F.col("exists") & F.col("size_ok") & F.col("hash_ok"))


_XML = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/package/2006/relationships"}
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def workbook_cells(data: bytes, sheet: str | None = None) -> dict[int, dict[int, str]]:
    """The texts of a sheet's cells by row and column, from 1; the first sheet where none is named."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        book, links = ElementTree.fromstring(z.read("xl/workbook.xml")), ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        sheets = {x.get("name"): x.get(_ID) for x in book.iterfind("m:sheets/m:sheet", _XML)}
        require(bool(sheets) and (sheet is None or sheet in sheets), f"no sheet {sheet!r} among {list(sheets)}")
        target = next(
            x.get("Target")
            for x in links.iterfind("r:Relationship", _XML) if x.get("Id") == (sheets[sheet] if sheet else next(iter(sheets.values())))
        )
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{{{_XML['m']}}}t"))
        shared = [text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _XML)] if "xl/sharedStrings.xml" in names else []
        page = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    cells: dict[int, dict[int, str]] = {}
    for c in page.iterfind("m:sheetData/m:row/m:c", _XML):
        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
        v = c.find("m:v", _XML)
        value = text(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        if value:
            cells.setdefault(int(row), {})[_column_number(letters)] = value
    return cells


def read_workbook(spark: SparkSession, path: str, sheet: str | None, header_row: int, columns: str, merged: list[str]) -> DataFrame:
    """A small sheet as texts: header in header_row (from 1), columns such as B:L; rows without any value are left out, and gaps of merged cells
    take the value above. The file is read whole by the driver: a workbook of facts about turbines, not of measurements."""
    cells = workbook_cells(Store(spark).read(path), sheet)
    first, last = map(_column_number, columns.split(":"))
    head = cells.get(header_row, {})
    names = [(k, head[k].strip()) for k in range(first, last + 1) if k in head]
    require(bool(names), f"{path}: no header in row {header_row}")
    above: dict[str, str] = {}
    out = []
    for r in sorted(k for k in cells if k > header_row):
        row = {n: cells[r].get(k) for k, n in names}
        if any(v is not None for v in row.values()):
            for n in merged:
                above[n] = row[n] = above.get(n) if row[n] is None else row[n]
            out.append(tuple(row.values()))
    return spark.createDataFrame(out, T.StructType([T.StructField(n, T.StringType()) for _, n in names]))


def notebook_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, cells, code_cells, markdown_cells, executed, with_output, errors) of notebook files."""
    cell = "struct<cell_type:string,execution_count:bigint,outputs:array<struct<output_type:string>>>"
    books = spark.read.schema(f"cells array<{cell}>").json(path, multiLine=True).select(
        F.col("_metadata.file_path").alias("path"), F.explode_outer("cells").alias("c")
    )
    code = F.col("c.cell_type") == "code"
    return books.groupBy("path").agg(
        F.count("c").alias("cells"), F.count_if(code).alias("code_cells"), F.count_if(F.col("c.cell_type") == "markdown").alias("markdown_cells"), F.count_if(
            code & F.col("c.execution_count").isNotNull()
        ).alias("executed"),
        F.count_if(code & (F.size("c.outputs") > 0)).alias("with_output"), F.count_if(
            F.exists("c.outputs", lambda o: o["output_type"] == "error")
        ).alias("errors"),
    )

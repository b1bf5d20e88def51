"""Small files of the driver, on whatever file system their path names."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from zephyrlake.operators.contracts import require


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


class Store:
    """Whole files by path, through Hadoop's file systems: models, documents and tables of one run lie in one place."""

    def __init__(self, spark: SparkSession):
        self.spark, self._hadoop = spark, spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._hadoop.Path(path)
        return p, p.getFileSystem(self._conf)

    def full(self, path: str) -> str:
        """The path with its file system: equal for equal places."""
        p, fs = self._at(path)
        return str(fs.makeQualified(p))

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> bytes:
        p, fs = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """A file that wasn't there, whole or not at all."""
        require(not self.exists(path), f"{path} exists")
        self._put(path, data, "NONE")

    def replace(self, path: str, data: bytes) -> None:
        """A file, whole, in place of the one that is there."""
        self._put(path, data, "OVERWRITE")

    def _put(self, path: str, data: bytes, rename: str) -> None:
        p, fs = self._at(path)
        part = self._hadoop.Path(p.getParent() or self._hadoop.Path("."), f".{p.getName()}.{uuid.uuid4().hex}")
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = getattr(kind, rename)
        fs.setWriteChecksum(False)  # of a local file system, whose sums would lie beside the file
        try:
            out = fs.create(part, False)
            try:
                out.write(bytearray(data))
                out.hsync()
            finally:
                out.close()
            self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(part), fs.makeQualified(p), options)
        finally:
            fs.setWriteChecksum(True)
            if fs.exists(part):
                fs.delete(part, False)

    def tree(self, path: str) -> tuple[str, int]:
        """Hash and bytes of a folder: its files by name with their own hashes, which executors take."""
        root = self.full(path).rstrip("/") + "/"
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = files.select(F.col("path"), "length", F.sha2("content", 256).alias("sha")).collect()  # a row for each file of a model
        place = root.partition(":")[2].lstrip("/")
        lines = sorted(f"{r['path'].partition(':')[2].lstrip('/').removeprefix(place)} {r['sha']}\n" for r in rows)
        return sha256("".join(lines)), sum(r["length"] for r in rows)

"""What fixpoints write between their rounds: tables in the shared folder, dropped when no later one reads them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; sets a folder of our own only where none is set (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, folder: str, names: set[str]) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        _delete(spark, folder)


class Tables:
    """Parquet tables of one computation in the folder of spark.checkpoint.dir; what is left goes with this object.

    A write cuts lineage, is computed once, and Spark deletes its shuffle files when it ends. ``kept()`` writes a table that stays.
    """

    WRITING = dict.fromkeys(("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"), "true") | {"spark.sql.parquet.compression.codec": "zstd"}

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder, self.n = spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/weft-{uuid.uuid4().hex}", 0
        self.paths: dict[str, list[str]] = {}
        self.dealt_out: set[str] = set()
        weakref.finalize(self, _forget, spark, self.folder, self.dealt_out)

    def _write(self, writer) -> None:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in self.WRITING}
        for k, v in self.WRITING.items():
            conf.set(k, v)
        try:
            writer()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def _path(self, name: str) -> str:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        self.paths.setdefault(name, []).append(path)
        return path

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table."""
        path = self._path(name)
        self._write(lambda: df.write.parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def all_of(self, name: str) -> DataFrame:
        """The rows of every table of this name that stands."""
        paths = self.paths[name]
        return self.spark.read.schema(self.spark.read.parquet(paths[-1]).schema).parquet(*paths)

    def dealt(self, name: str, df: DataFrame, *by: str, slices: int = 1) -> DataFrame:
        """df as a table dealt out by columns: joins on them shuffle only their other side, however many rounds read it.

        It is written slice by slice, and each slice's shuffle files go before the next one's come.
        """
        parts, path = parts_of(self.spark), self._path(name)
        table = f"weft_{uuid.uuid4().hex}"
        self.dealt_out.add(table)
        for k in range(slices):
            part = df.where(F.pmod(F.xxhash64(*by), F.lit(slices)) == k) if slices > 1 else df
            self._write(lambda part=part: part.repartition(parts, *by).write.mode("append").option("path", path).bucketBy(parts, *by).sortBy(*by).saveAsTable(table))
        return self.spark.table(table)

    def slices(self, name: str) -> int:
        """In how many slices to deal out what is read from a table, so that a slice is of about a quarter GB."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[name][-1])
        return 1 + (at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() >> 28)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, ()):
                _delete(self.spark, path)

    def kept(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """df as a table that stays: one that a result reads."""
        self.n += 1
        path = f"{self.folder}-stays/{self.n:03d}-{name}"
        self.paths.setdefault(name, []).append(path)
        self._write(lambda: df.write.parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    return Tables(df.sparkSession).kept(df)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def beside(df: DataFrame, *by: str) -> DataFrame:
    """A round's rows for a join with a table dealt out by ``by``: they alone are shuffled, and hashed, so that the table needs no sort."""
    return df.repartition(parts_of(df.sparkSession), *by).hint("shuffle_hash")

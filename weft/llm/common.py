"""What several operators share: tables, the shared folder, cutting lineage, hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; bounds a Python worker's memory on tables of whole texts.
BATCH_ROWS = 128
#: A word is a run of anything but ASCII white space.
SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows; texts may be long, so fewer rows than Spark's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset in local mode (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """One operator run's tables in the shared folder: each cuts lineage and survives lost executors.

    A table is dropped as soon as no later one reads it. While a table is written, the session's Arrow batches
    have ``arrow_rows`` rows, and Spark deletes the shuffle files of that write when it ends.
    """

    CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, fresh_path(spark, name), 0
        self.paths: dict[str, list[str]] = {}

    def put(self, name: str, df: DataFrame, arrow_rows: int = BATCH_ROWS) -> DataFrame:
        """df as a Parquet table."""
        conf, self.n = self.spark.conf, self.n + 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        set_now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(arrow_rows), **dict.fromkeys(self.CLEANUP, "true")}
        before = {k: conf.get(k, None) for k in set_now}
        for k, v in set_now.items():
            conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes all tables of these names."""
        for name in names:
            for path in self.paths.pop(name, ()):
                self._delete(path)

    def clear(self) -> None:
        """Deletes all tables."""
        self._delete(self.folder)
        self.paths.clear()

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, arrow_rows: int = BATCH_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder that stays: the last one that a result reads."""
    return Scratch(df.sparkSession, name).put(name, df, arrow_rows)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on unsigned 64-bit arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of byte words, remembered; call trim() between batches to bound memory."""

    def __init__(self, most: int = 40_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def runs_hash(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of every window of ``length`` hashed words, order counting."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix64(out)


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Connected components of links between longs: rows (node, label), label the smallest node reached.

    Each round points every node at its smallest neighbour, or itself, follows the pointers to their ends, and contracts the links
    to those ends, which at least halves the nodes that have links; rounds end when no link is left. A node's label is
    where the rounds' pointers lead one after another. Nodes without links have no row, nulls and self links are ignored.
    Everything stays distributed and is written at each step; joins are merge joins of written tables at every size,
    which lets Spark split a hub's rows, two longs each, and minima are taken before the shuffle.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    pairs = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a) != F.col(b))
    edges = scratch.put("links", pairs.distinct())
    labels = None
    while labels is None or edges.limit(1).count():
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
        up = scratch.put("pointers", ends.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
        moved = True
        while moved:
            on = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            after = scratch.put("pointers", up.select("node", "label").join(on.hint("merge"), "label").select("node", F.col("next").alias("label"), (F.col("label") != F.col("next")).alias("moved")))
            moved = after.where("moved").limit(1).count() > 0
            up = after.select("node", "label")
        if labels is None:
            labels = scratch.put("labels", up)
        else:
            on = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = scratch.put("labels", labels.join(on.hint("merge"), "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        of = lambda end: up.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        there = edges.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v").select(F.least("u_label", "v_label").alias("u"), F.greatest("u_label", "v_label").alias("v"))
        edges = scratch.put("links", there.where("u <> v").distinct())
        scratch.drop("pointers")
    scratch.drop("links")
    return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels of components after more links (a, b): only the links between different components are followed."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    named = links.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left")
    named = scratch.put("named", named.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")))
    on = components(named, "x", "y", scratch=scratch).select(F.col("node").alias("label"), F.col("label").alias("next"))
    every = labels.unionByName(named.select(F.col("a").alias("node"), F.col("x").alias("label"))).unionByName(named.select(F.col("b").alias("node"), F.col("y").alias("label"))).distinct()
    found = scratch.put("labels", every.join(on.hint("merge"), "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    scratch.drop("named")
    return found

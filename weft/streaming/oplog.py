"""A graph kept up to date by a stream of operations.

Each micro-batch of (seq long, operation string) rows, one JSON operation a row, is applied in order
of seq as one atomic batch, and the result is written as the next version of the graph's tables. A batch that fails
leaves the last version as it was and stops the query with its issue. A version that is already written is
not applied again, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import Graph
from ..operators.edit import apply
from ..functions.jsontext import parse
from ..sources.document import read_tables, write_tables

#: Operations of a micro-batch that the driver gathers; a longer one is refused.
MAX_OPERATIONS = 10_000


class GraphLog:
    """Versions of a graph under one folder: v0 is the first, v{n + 1} follows from micro-batch n."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version}"

    def _written(self, version: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self._path(version)}/hyperedges/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def start(self, graph: Graph) -> None:
        if not self._written(0):
            write_tables(graph, self._path(0))

    def version(self, number: int) -> Graph:
        return read_tables(self.spark, self._path(number))

    def advance(self, batch: DataFrame, number: int) -> None:
        """Applies one micro-batch; the function of foreachBatch."""
        if self._written(number + 1):
            return
        rows = batch.orderBy("seq").limit(MAX_OPERATIONS + 1).collect()
        if len(rows) > MAX_OPERATIONS:
            raise ValueError(f"more than {MAX_OPERATIONS} operations in a micro-batch")
        done = apply(self.version(number), [parse(r["operation"]) for r in rows])
        done.points.write.mode("overwrite").parquet(f"{self._path(number + 1)}/points")
        done.hyperedges.write.mode("overwrite").parquet(f"{self._path(number + 1)}/hyperedges")

    def follow(self, operations: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the query over a stream of (seq, operation)."""
        writer = operations.writeStream.foreachBatch(self.advance).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

"""The data model: a graph is two DataFrames, points and hyperedges.

A hyperedge fires once every point of its tail set is available; it then makes its one head available at
its weight. An empty tail set fires at once. Weights are whole tenths ("units"); costs are
saturating sums whose largest value, INFINITY, means "not reachable".
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the document format.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
MAX_WEIGHT_UNITS = 2**53 - 1
INFINITY = 2**64 - 1
GRAPH_SCHEMA = "weft.graph/v1"

COST = T.DecimalType(38, 0)


def infinite():
    """INFINITY as a column of costs."""
    return F.lit(str(INFINITY)).cast(COST)


POINTS = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("id", T.StringType(), False), T.StructField("data", T.StringType())])
HYPEREDGES = T.StructType(
    [
        T.StructField("pos", T.LongType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("weight_units", T.LongType(), False),
        T.StructField("tails", T.ArrayType(T.StringType()), False),
        T.StructField("head", T.StringType(), False),
        T.StructField("data", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Issue:
    code: str
    path: str
    message: str = ""

    def json(self) -> dict:
        return {"code": self.code, "path": self.path, "message": self.message}


#: Exit status by top-level code (fixed values).
EXIT_STATUS = {"invalid_arguments": 64, "file_not_found": 66, "file_unreadable": 66, "internal": 70, "io": 74}


class GraphError(Exception):
    """A structured error: code, message, issues and details."""

    def __init__(self, code: str, message: str = "", issues: list[Issue] | tuple = (), **details):
        super().__init__(f"{code}: {message}" + "".join(f"\n  {i.code} at {i.path or '/'}" for i in issues))
        self.code, self.message, self.issues, self.details = code, message, list(issues), details
        #: The argument that a failed edit's check was about, as a path within an operation.
        self.field: str | None = None

    def on(self, field: str) -> GraphError:
        self.field = field
        return self

    @property
    def exit_status(self) -> int:
        return EXIT_STATUS.get(self.code, 65)

    def json(self) -> dict:
        error = {"code": self.code, "message": self.message}
        if self.issues:
            error["issues"] = [i.json() for i in self.issues]
        if self.details:
            error["details"] = self.details
        return {"error": error}


@dataclass(frozen=True)
class Graph:
    """points (pos, id, data) and hyperedges (pos, id, weight_units, tails, head, data); pos is the document's order."""

    points: DataFrame
    hyperedges: DataFrame
    schema_tag: str | None = None
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def with_frames(self, points: DataFrame | None = None, hyperedges: DataFrame | None = None) -> Graph:
        return replace(self, points=self.points if points is None else points, hyperedges=self.hyperedges if hyperedges is None else hyperedges, cache={})

    def edges(self) -> DataFrame:
        """(edge, pos, weight, n_tails, head) without payload; tail sets count distinct points."""
        return self.hyperedges.select(F.col("id").alias("edge"), "pos", F.col("weight_units").alias("weight"), F.size(F.array_distinct("tails")).alias("n_tails"), "head")

    def incidence(self) -> DataFrame:
        """(edge, point): one row for each distinct tail point; empty tail sets have none."""
        return self.hyperedges.select(F.col("id").alias("edge"), F.explode(F.array_distinct("tails")).alias("point"))

    # lookups and measures

    def point(self, point_id: str) -> DataFrame:
        return self.points.where(F.col("id") == point_id)

    def hyperedge(self, edge_id: str) -> DataFrame:
        return self.hyperedges.where(F.col("id") == edge_id)

    def incoming(self, point_id: str) -> DataFrame:
        return self.hyperedges.where(F.col("head") == point_id)

    def outgoing(self, point_id: str) -> DataFrame:
        return self.hyperedges.where(F.array_contains("tails", point_id))

    def in_degrees(self) -> DataFrame:
        return self.points.select(F.col("id").alias("point")).join(self.hyperedges.groupBy(F.col("head").alias("point")).agg(F.count(F.lit(1)).alias("n")), "point", "left").select("point", F.coalesce("n", F.lit(0)).alias("n_incoming"))

    def out_degrees(self) -> DataFrame:
        return self.points.select(F.col("id").alias("point")).join(self.incidence().groupBy("point").agg(F.count(F.lit(1)).alias("n")), "point", "left").select("point", F.coalesce("n", F.lit(0)).alias("n_outgoing"))

    def sizes(self) -> DataFrame:
        """One row: n_points, n_hyperedges and size, the sum of tails + 1 over hyperedges."""
        both = self.points.select(F.lit(1).alias("p"), F.lit(0).alias("e"), F.lit(0).alias("s")).unionByName(
            self.hyperedges.select(F.lit(0).alias("p"), F.lit(1).alias("e"), (F.size(F.array_distinct("tails")) + 1).alias("s"))
        )
        total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("p", "n_points"), ("e", "n_hyperedges"), ("s", "size"))]
        return both.agg(*total)


def starts_frame(spark: SparkSession, queries: dict[str, list[str]]) -> DataFrame:
    """(query_id, point) of a few queries given on the driver."""
    return spark.createDataFrame([(q, p) for q, points in queries.items() for p in points], "query_id string, point string")

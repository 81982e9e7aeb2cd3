"""Induced, reachable and route subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .reach import closure


def induced(graph: Graph, points: DataFrame) -> Graph:
    """The points (point) and the edges whose head and every tail are among them; an empty-tail edge needs its head only."""
    chosen = points.select(F.col("point").alias("id")).distinct()
    tails = graph.incidence().join(chosen.withColumnRenamed("id", "point"), "point", "left_semi").groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    edges = graph.hyperedges.join(chosen.withColumnRenamed("id", "head"), "head", "left_semi").withColumnRenamed("id", "edge").join(tails, "edge", "left")
    edges = edges.where(F.coalesce("n", F.lit(0)) == F.size(F.array_distinct("tails"))).withColumnRenamed("edge", "id")
    return graph.with_frames(graph.points.join(chosen, "id", "left_semi"), edges.select(*graph.hyperedges.columns))


def reachable(graph: Graph, starts: DataFrame) -> Graph:
    """The subgraph induced by the closure of one query's starts."""
    return induced(graph, closure(graph, starts).select("point"))


def of_route(graph: Graph, edges: DataFrame, points: DataFrame) -> Graph:
    """Exactly the edges (edge) of a route, their points, and the starts and targets (point)."""
    kept = graph.hyperedges.join(edges.select(F.col("edge").alias("id")).distinct(), "id", "left_semi").select(*graph.hyperedges.columns)
    named = kept.select(F.explode(F.array_union("tails", F.array("head"))).alias("id")).unionByName(points.select(F.col("point").alias("id"))).distinct()
    return graph.with_frames(graph.points.join(named, "id", "left_semi").select(*graph.points.columns), kept)

"""A graph's edges as a fixpoint's rounds read them: dealt out once by tail point, without names that no round needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.fixpoint import Tables, beside, is_empty


@dataclass(frozen=True)
class Layout:
    """Edges with tails: arcs (point, head) has those with one; of the others, tails has (point, key) and joint (key, head, n_tails).

    arcs and joint carry further columns; where edges belong to queries, joins on points go by query_id too.
    """

    arcs: DataFrame
    tails: DataFrame
    joint: DataFrame
    on: tuple[str, ...]

    def along(self, new: DataFrame) -> DataFrame:
        """The arcs from new points (query_id, point, ...)."""
        return beside(new, *self.on).join(self.arcs, list(self.on))

    def meets(self, new: DataFrame) -> bool:
        """Whether any joint edge has a tail among new points."""
        return not is_empty(beside(new.select(*self.on), *self.on).join(self.tails, list(self.on)))

    def into_joint(self, new: DataFrame) -> DataFrame:
        """The joint edges' tails among new points."""
        return beside(new, *self.on).join(self.tails, list(self.on))


def shape(graph: Graph) -> tuple[Tables, DataFrame]:
    """(key, tails, head, weight) of all edges, written once for a graph; it goes with the graph."""
    if "shape" not in graph.cache:
        tables = Tables(graph.spark)
        columns = [F.array_distinct("tails").alias("tails"), "head", F.col("weight_units").alias("weight"), F.monotonically_increasing_id().alias("key")]
        graph.cache["shape"] = tables, tables.put("edges", graph.hyperedges.select(*columns))
    return graph.cache["shape"]


def stand(tables: Tables, edges: DataFrame) -> tuple[Tables, DataFrame]:
    """edges (tails without repeats, head, more columns) written with a key."""
    return tables, tables.put("edges", edges.withColumn("key", F.monotonically_increasing_id()))


def lay_out(tables: Tables, stood: tuple[Tables, DataFrame], *more: str) -> Layout:
    """stood: what shape() or stand() return; edges with query_id belong to queries."""
    where, edges = stood
    own = [c for c in edges.columns if c == "query_id"]
    slices, n, on = where.slices("edges"), F.size("tails"), (*own, "point")
    arcs = tables.dealt("arcs", edges.where(n == 1).select(*own, F.get("tails", F.lit(0)).alias("point"), "head", *more), *on, slices=slices)
    many = edges.where(n > 1)
    tails = tables.dealt("tails", many.select(*own, F.explode("tails").alias("point"), "key"), *on, slices=slices)
    joint = tables.dealt("joint", many.select("key", "head", n.alias("n_tails"), *more), "key", slices=slices)
    return Layout(arcs, tails, joint, on)


def layout(graph: Graph) -> Layout:
    """All edges with their weights laid out, once for a graph; the tables go with the graph."""
    if "layout" not in graph.cache:
        tables = Tables(graph.spark)
        graph.cache["layout"] = tables, lay_out(tables, shape(graph), "weight")
    return graph.cache["layout"][1]


def stored(graph: Graph) -> Graph:
    """The graph with its hyperedges written once; they go with the graph."""
    tables = Tables(graph.spark)
    found = graph.with_frames(hyperedges=tables.put("hyperedges", graph.hyperedges))
    found.cache["hyperedges"] = tables
    return found


def needed(graph: Graph, targets: DataFrame) -> Graph:
    """The graph with only those hyperedges that some target (point) can need: what the targets' walk back meets."""
    tables = Tables(graph.spark)
    new = tables.put("seen", targets.select("point").distinct())
    while not is_empty(new):
        used = graph.hyperedges.join(new.withColumnRenamed("point", "head"), "head", "left_semi")
        ahead = used.select(F.explode("tails").alias("point")).distinct()
        new = tables.put("seen", ahead.join(tables.all_of("seen"), "point", "left_anti"))
    heads = tables.all_of("seen").withColumnRenamed("point", "head")
    kept = graph.hyperedges.join(heads, "head", "left_semi").select(*graph.hyperedges.columns)
    return graph.with_frames(hyperedges=tables.kept(kept))

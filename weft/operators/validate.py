"""Validation as relations: issues of point and hyperedge tables of any size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ID_PATTERN, MAX_WEIGHT_UNITS, Graph, GraphError, Issue

_ID = re.compile(ID_PATTERN.replace(r"\z", r"\Z"))


def is_id(text: str) -> bool:
    return bool(_ID.match(text))


def _issues(df: DataFrame, code: str, section: int, path) -> DataFrame:
    return df.select(F.lit(section).alias("section"), "pos", F.lit(code).alias("code"), path.alias("path"), F.col("id"))


def issues(graph: Graph) -> DataFrame:
    """(section, pos, code, path, id): what is wrong with a graph's tables. Paths name rows by pos.

    duplicate_id (points and hyperedges share one namespace; the first of a name by section and pos is
    fine), invalid_id, invalid_weight, duplicate_tail, unknown_point.
    """
    points, edges = graph.points, graph.hyperedges
    at = F.col("pos").cast("string")
    p_path, e_path = F.concat(F.lit("/points/"), at), F.concat(F.lit("/hyperedges/"), at)
    names = points.select(F.lit(0).alias("section"), "pos", "id").unionByName(edges.select(F.lit(1).alias("section"), "pos", "id"))
    repeated = names.groupBy("id").agg(F.min(F.struct("section", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = names.join(repeated, "id").where(F.struct("section", "pos") != F.col("first"))
    section_path = F.concat(F.when(F.col("section") == 0, F.lit("/points/")).otherwise(F.lit("/hyperedges/")), at, F.lit("/id"))
    duplicates = again.select("section", "pos", F.lit("duplicate_id").alias("code"), section_path.alias("path"), "id")
    bad = ~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False))
    known = points.select("id").distinct()
    tails = edges.select("pos", "id", F.posexplode("tails").alias("k", "tail"))
    tail_path = F.concat(e_path, F.lit("/tails/"), F.col("k").cast("string"))
    twice = edges.where(F.size("tails") != F.size(F.array_distinct("tails"))).select("pos", "id", F.posexplode("tails").alias("k", "tail"), "tails").where(F.array_position("tails", F.col("tail")) <= F.col("k"))
    parts = [
        duplicates,
        _issues(points.where(bad), "invalid_id", 0, F.concat(p_path, F.lit("/id"))),
        _issues(edges.where(bad), "invalid_id", 1, F.concat(e_path, F.lit("/id"))),
        _issues(edges.where(~F.coalesce(F.col("weight_units").between(0, MAX_WEIGHT_UNITS), F.lit(False))), "invalid_weight", 1, F.concat(e_path, F.lit("/weight"))),
        _issues(twice, "duplicate_tail", 1, tail_path),
        _issues(tails.join(known.withColumnRenamed("id", "tail"), "tail", "left_anti"), "unknown_point", 2, tail_path),
        _issues(edges.join(known.withColumnRenamed("id", "head"), "head", "left_anti"), "unknown_point", 2, F.concat(e_path, F.lit("/head"))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def validate(graph: Graph) -> Graph:
    """The graph itself, or GraphError with all issues by section, pos, path and code; ``issues`` leaves them distributed."""
    found = issues(graph).orderBy("section", "pos", "path", "code").collect()
    if found:
        raise GraphError("invalid_graph", "graph validation failed", [Issue(r["code"], r["path"], r["id"] or "") for r in found])
    return graph

"""Why a target can't be reached: the blocking frontier and the cycles inside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.fixpoint import Tables, beside, cut, is_empty
from .layout import shape
from .reach import closure

KEY = ["query_id", "target"]


def blocking_frontier(graph: Graph, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target, point): unreached points met walking back from each unreached target.

    targets: (query_id, target). The walk goes through all incoming edges of an unreached point and
    their unreached premises; the target itself is included. A reached target has no rows.
    """
    tables = Tables(graph.spark)
    known = closure(graph, starts, queries=targets).select("query_id", "point")
    where, edges = shape(graph)
    premises = tables.dealt("premises", edges.select("head", F.explode("tails").alias("premise")), "head", slices=where.slices("edges"))
    asked = targets.select(*KEY, F.col("target").alias("point")).distinct()
    new = tables.put("found", asked.join(known, ["query_id", "point"], "left_anti").select(*KEY, "point"))
    while not is_empty(new):
        ahead = beside(new.withColumnRenamed("point", "head"), "head").join(premises, "head").select(*KEY, F.col("premise").alias("point")).distinct()
        ahead = ahead.join(known, ["query_id", "point"], "left_anti").join(tables.all_of("found"), [*KEY, "point"], "left_anti")
        new = tables.put("found", ahead.select(*KEY, "point"))
    tables.drop("premises")
    return tables.kept(tables.all_of("found"))


def components(arcs: DataFrame, key: list[str]) -> DataFrame:
    """Strongly connected components of arcs (key..., a, b): rows (key..., node, component) of cyclic ones.

    Nodes without an arc in or out are trimmed; the rest takes the least node that reaches it as its
    colour, and what reaches that node back inside the colour is its component. This repeats on what is left.
    A single node counts only with an arc to itself.
    """
    arcs = cut(arcs.select(*key, "a", "b").distinct())
    loops = arcs.where("a = b").select(*key, F.col("a").alias("node"))
    arcs = cut(arcs.where("a <> b"))
    found = loops.select(*key, "node", F.col("node").alias("component")).limit(0)
    while not is_empty(arcs):
        while True:  # trim
            inner = arcs.join(arcs.select(*key, F.col("b").alias("a")).distinct(), [*key, "a"], "left_semi")
            inner = cut(inner.join(arcs.select(*key, F.col("a").alias("b")).distinct(), [*key, "b"], "left_semi").select(*key, "a", "b"))
            done = inner.count() == arcs.count()
            arcs = inner
            if done:
                break
        if is_empty(arcs):
            break
        nodes = arcs.select(*key, F.col("a").alias("node")).unionByName(arcs.select(*key, F.col("b").alias("node"))).distinct()
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            offers = arcs.join(colour.withColumnRenamed("node", "a"), [*key, "a"]).groupBy(*key, F.col("b").alias("node")).agg(F.min("colour").alias("offer"))
            merged = cut(colour.join(offers, [*key, "node"], "left").withColumn("now", F.least("colour", "offer")))
            colour = merged.select(*key, "node", F.col("now").alias("colour"))
            if is_empty(merged.where("now < colour")):
                break
        inside = arcs.join(colour.select(*key, F.col("node").alias("a"), F.col("colour").alias("ca")), [*key, "a"]).join(colour.select(*key, F.col("node").alias("b"), F.col("colour").alias("cb")), [*key, "b"])
        inside = cut(inside.where("ca = cb").select(*key, "a", "b", "ca"))
        part = cut(colour.where("node = colour").select(*key, "node", "colour"))
        new = part
        while not is_empty(new):
            back = inside.join(new.select(*key, F.col("node").alias("b"), F.col("colour").alias("ca")), [*key, "b", "ca"]).select(*key, F.col("a").alias("node"), F.col("ca").alias("colour")).distinct()
            new = cut(back.join(part, [*key, "node"], "left_anti"))
            part = part.unionByName(new)
        part = cut(part)
        found = found.unionByName(part.join(part.groupBy(*key, "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), [*key, "colour"]).select(*key, "node", F.col("colour").alias("component")))
        gone = part.select(*key, F.col("node").alias("a"))
        arcs = arcs.join(gone, [*key, "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), [*key, "b"], "left_anti")
        arcs = cut(arcs.select(*key, "a", "b"))
    alone = loops.join(found.select(*key, "node"), [*key, "node"], "left_anti")
    return cut(found.unionByName(alone.select(*key, "node", F.col("node").alias("component"))))


def cycle_members(graph: Graph, frontier: DataFrame) -> DataFrame:
    """(query_id, target, node, component): the members of each cyclic component of a blocking_frontier()'s dependencies.

    A target leads to its whole frontier, so what leads back to it is its own component. The components of the rest,
    which no arc leaves both into and out of that one, are found apart.
    """
    tables = Tables(graph.spark)
    where, edges = shape(graph)
    slices, on = where.slices("edges"), [*KEY, "point"]
    heads = tables.dealt("heads", edges.select("head", F.explode("tails").alias("point")), "point", slices=slices)
    new = tables.put("back", frontier.where("point = target").select(*on))
    while not is_empty(new):
        ahead = beside(new, "point").join(heads, "point").select(*KEY, F.col("head").alias("point")).distinct()
        ahead = ahead.join(frontier.select(*on), on, "left_semi").join(tables.all_of("back"), on, "left_anti")
        new = tables.put("back", ahead.select(*on))
    back = tables.all_of("back")
    several = back.where("point <> target").select(*KEY).distinct()
    own = tables.put("own", back.join(several, KEY, "left_semi"))
    rest = tables.put("rest", frontier.select(*on).join(own, on, "left_anti"))
    tables.drop("back")
    ours = own.select(*KEY, F.col("point").alias("node"), F.col("target").alias("component"))
    if is_empty(rest):
        return tables.kept(ours)
    # arcs (a, b) from a head to a tail of it, both in the rest
    arcs = beside(rest, "point").join(heads, "point").select(*KEY, F.col("head").alias("a"), F.col("point").alias("b"))
    arcs = tables.put("arcs", arcs.join(rest.withColumnRenamed("point", "a"), [*KEY, "a"], "left_semi").select(*KEY, "a", "b").distinct())
    tables.drop("heads", "rest")
    return tables.kept(ours.unionByName(components(arcs, KEY)))


def blocking_cycles(graph: Graph, frontier: DataFrame) -> DataFrame:
    """(query_id, target, cycle): each cyclic component of a blocking_frontier()'s dependencies, members and cycles in ASCII order."""
    return cycle_members(graph, frontier).groupBy(*KEY, "component").agg(F.array_sort(F.collect_list("node")).alias("cycle")).select(*KEY, "cycle")


def diagnose(graph: Graph, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: (query_id, target, blocking array<string>, cycles array<array<string>>, reachable of the whole query)."""
    frontier = blocking_frontier(graph, starts, targets)
    cycles = blocking_cycles(graph, frontier).groupBy(*KEY).agg(F.array_sort(F.collect_list("cycle")).alias("cycles"))
    blocking = frontier.groupBy(*KEY).agg(F.array_sort(F.collect_set("point")).alias("blocking"))
    rows = targets.select(*KEY).distinct().join(blocking, KEY, "left").join(cycles, KEY, "left")
    whole = rows.groupBy("query_id").agg(F.bool_and(F.col("blocking").isNull()).alias("reachable"))
    none = F.array().cast("array<string>")
    return rows.join(whole, "query_id").select(*KEY, F.coalesce("blocking", none).alias("blocking"), F.coalesce("cycles", F.array().cast("array<array<string>>")).alias("cycles"), "reachable")

"""Cost measures and their fixpoints: depth (a lower bound), tree (an upper bound), witnesses."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COST, Graph, GraphError, infinite
from ..plans.fixpoint import Tables, cut, is_empty, parts_of
from .layout import lay_out, layout, shape, stand


class CostMeasure(Protocol):
    """A local recurrence of costs along an edge.

    role is "lower", "upper" or "neither": which bound of the set cost the fixpoint is. superior says
    that a result is never below any premise, which the fixpoint needs. gathered aggregates the
    premises of an edge (never empty); combined adds the weight.
    """

    role: str
    superior: bool

    def gathered(self, premise: Column) -> Column: ...

    def combined(self, weight: Column, gathered: Column) -> Column: ...


def saturated(cost: Column) -> Column:
    return F.least(cost.cast(COST), infinite())


class DepthCost:
    """Weight plus the dearest premise."""

    role, superior = "lower", True

    def gathered(self, premise: Column) -> Column:
        return F.max(premise)

    def combined(self, weight: Column, gathered: Column) -> Column:
        return weight + gathered


class TreeCost:
    """Weight plus all premises, each paid again wherever it is used."""

    role, superior = "upper", True

    def gathered(self, premise: Column) -> Column:
        return F.sum(premise)

    def combined(self, weight: Column, gathered: Column) -> Column:
        return weight + gathered


def bounds(graph: Graph, starts: DataFrame, measure: CostMeasure, prepaid: DataFrame | None = None, edges: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The least costs under a measure: rows (query_id, point, cost) of reachable points.

    Start points cost 0 and are never lowered further; prepaid (edge) edges weigh 0. A round looks
    only at edges with a tail whose cost has just fallen. The rest of a graph's points cost INFINITY.
    """
    if not measure.superior:
        raise GraphError("invalid_arguments", "the measure isn't superior")
    if measure.role not in ("lower", "upper", "neither"):
        raise GraphError("invalid_arguments", "unknown role")
    tables = Tables(graph.spark)
    if edges is None and prepaid is None:
        stood, laid = shape(graph), layout(graph)
    else:
        table = graph.hyperedges.select(F.col("id").alias("edge"), F.array_distinct("tails").alias("tails"), "head", F.col("weight_units").alias("weight"))
        if edges is not None:
            table = table.join(edges.select("edge").distinct(), "edge", "left_semi")
        if prepaid is not None:
            paid = prepaid.select("edge").distinct().withColumn("_paid", F.lit(True))
            table = table.join(paid, "edge", "left").withColumn("weight", F.when(F.col("_paid"), 0).otherwise(F.col("weight")))
        stood = stand(tables, table.select("tails", "head", "weight"))
        laid = lay_out(tables, stood, "weight")
    asked = (starts if queries is None else queries).select("query_id").distinct()
    zero, weight = F.lit(0).cast(COST), F.col("weight").cast(COST)
    free = stood[1].where(F.size("tails") == 0).groupBy(F.col("head").alias("point")).agg(F.min(weight).alias("cost"))
    entries = asked.withColumn("_one", F.lit(1)).join(free.withColumn("_one", F.lit(1)), "_one").select("query_id", "point", "cost")
    first = starts.select("query_id", "point", zero.alias("cost")).unionByName(entries).groupBy("query_id", "point").agg(F.min("cost").alias("cost"))
    number, fallen = 0, tables.put("costs", first.withColumn("round", F.lit(0)))
    while not is_empty(fallen):
        # each round's table has the costs that fell in it, so the least of all tables is the cost now
        now = tables.all_of("costs").groupBy("query_id", "point").agg(F.min("cost").alias("cost"), F.max("round").alias("round"))
        lone = fallen.repartition(parts_of(graph.spark), "point").groupBy("query_id", "point").agg(measure.gathered(F.col("cost")).alias("g"))
        offers = laid.along(lone).select("query_id", F.col("head").alias("point"), saturated(measure.combined(weight, F.col("g"))).alias("offer"))
        if laid.meets(fallen):
            premises = laid.into_joint(now).select("query_id", "key", "cost", (F.col("round") == number).alias("new"))
            gathered = premises.repartition(parts_of(graph.spark), "key").groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new"), measure.gathered(F.col("cost")).alias("g"))
            ready = gathered.where("new").join(laid.joint, "key").where("n = n_tails")
            offers = offers.unionByName(ready.select("query_id", F.col("head").alias("point"), saturated(measure.combined(weight, F.col("g"))).alias("offer")))
        least = offers.groupBy("query_id", "point").agg(F.min("offer").alias("offer"))
        number += 1
        lower = least.join(now, ["query_id", "point"], "left").where("cost is null or offer < cost")
        fallen = tables.put("costs", lower.select("query_id", "point", F.col("offer").alias("cost"), F.lit(number).alias("round")))
    now = tables.all_of("costs").groupBy("query_id", "point").agg(F.min("cost").alias("cost"))
    return tables.kept(now.where(F.col("cost") < infinite()))


def choices(graph: Graph, starts: DataFrame, costs: DataFrame, measure: CostMeasure) -> DataFrame:
    """(query_id, point, edge): for each reached point that is no start, one tight edge, without cycles.

    Tight edges alone are closed from the starts, round by round; a point takes the least (weight,
    pos) of the tight edges that are ready when it is first reached. So even with zero weights an
    edge's tails are reached before its head.
    """
    table = graph.edges().withColumn("weight", F.col("weight").cast(COST))
    premises = graph.incidence().join(costs, "point").groupBy("query_id", "edge").agg(F.count(F.lit(1)).alias("n"), measure.gathered(F.col("cost")).alias("g"))
    fed = premises.join(table, "edge").where("n = n_tails").withColumn("made", saturated(measure.combined(F.col("weight"), F.col("g"))))
    asked = costs.select("query_id").distinct()
    free = asked.withColumn("_one", F.lit(1)).join(table.where("n_tails = 0").withColumn("_one", F.lit(1)), "_one").withColumn("made", F.col("weight"))
    columns = ["query_id", "edge", "head", "weight", "pos", "n_tails", "made"]
    both = fed.select(*columns).unionByName(free.select(*columns))
    tight = both.join(costs.select("query_id", F.col("point").alias("head"), "cost"), ["query_id", "head"]).where("made = cost")
    tight = cut(tight.join(starts.select("query_id", F.col("point").alias("head")).distinct(), ["query_id", "head"], "left_anti").select("query_id", "edge", "head", "weight", "pos", "n_tails"))
    tails = cut(tight.join(graph.incidence(), "edge").select("query_id", "edge", "point"))
    known = cut(starts.select("query_id", "point").distinct())
    new, counts, chosen, first = known, None, None, True
    while first or not is_empty(new):
        fed_now = new.join(tails, ["query_id", "point"]).groupBy("query_id", "edge").agg(F.count(F.lit(1)).alias("n"))
        if counts is not None:
            fed_now = fed_now.unionByName(counts).groupBy("query_id", "edge").agg(F.sum("n").alias("n"))
        state = cut(fed_now.join(tight, ["query_id", "edge"]))
        counts = state.where("n < n_tails").select("query_id", "edge", "n")
        ready = state.where("n = n_tails").select(*tight.columns)
        if first:
            ready = ready.unionByName(tight.where("n_tails = 0"))
        taken = ready.groupBy("query_id", F.col("head").alias("point")).agg(F.min_by("edge", F.struct("weight", "pos", "edge")).alias("edge"))
        new_choice = cut(taken.join(known, ["query_id", "point"], "left_anti"))
        chosen = new_choice if chosen is None else chosen.unionByName(new_choice)
        new = new_choice.select("query_id", "point")
        known = known.unionByName(new)
        first = False
    return cut(chosen)


def witness(graph: Graph, chosen: DataFrame, targets: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(query_id, edge): the distinct edges that the choices use to derive the targets (query_id, point).

    members: (query_id, like), where the choices of a query are those of the query ``like``.
    """
    if members is not None:
        chosen = chosen.withColumnRenamed("query_id", "like")
    need = cut(targets.select("query_id", "point").distinct())
    seen, found = need, None
    while not is_empty(need):
        used = need.join(chosen, ["query_id", "point"]) if members is None else need.join(members, "query_id").join(chosen, ["like", "point"])
        used = cut(used.select("query_id", "edge"))
        found = used if found is None else found.unionByName(used)
        need = cut(used.distinct().join(graph.incidence(), "edge").select("query_id", "point").distinct().join(seen, ["query_id", "point"], "left_anti"))
        seen = seen.unionByName(need)
    if found is None:
        return targets.select("query_id", F.lit(None).cast("string").alias("edge")).limit(0)
    return cut(found.distinct())


def tree_derivation(graph: Graph, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, edge) of the tree witness of each query all of whose targets are reachable."""
    costs = bounds(graph, starts, TreeCost(), queries=targets)
    missing = targets.join(costs, ["query_id", "point"], "left_anti").select("query_id").distinct()
    wanted = targets.join(missing, "query_id", "left_anti")
    return witness(graph, choices(graph, starts, costs, TreeCost()), wanted)

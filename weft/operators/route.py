"""Minimum-set-cost routes for batches of queries: bounds, pinning, arborescences or exact search, assembly; costs alone by trunks."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COST, Graph, GraphError, infinite
from ..plans.fixpoint import Tables, cut, is_empty, parts_of
from .arborescence import Arcs, solved_sets
from .bounds import CostMeasure, DepthCost, TreeCost, bounds, choices, witness
from .layout import needed
from .reach import closure, executable_order
from .search import cheapest
from .trunk import MAX_TERMINALS, ROOT, least_costs, numbered

MAX_NODES, MAX_MILLIS = 200_000, 10_000
SOLUTION = "query_id string, cost decimal(38,0), lower decimal(38,0), upper decimal(38,0), proven_optimal boolean, derivation array<string>, nodes long, pruned long, millis long"


#: Open queries of one task group, which share a copy of the edges that they can need.
TOGETHER = 1000


def _searched(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The residual queries, a group of them at a time: (SOLUTION columns).

    edges: (batch, edge, pos, weight, tails, head, least); asked: (batch, query_id, lower, upper, held, targets, starts, max_nodes, max_millis).
    Queries that only arcs lead to are solved as arborescences, all at once; each of the others is searched on the edges whose least
    cost its own upper bound allows.
    """
    from decimal import Decimal

    def typed(table: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["pos", "edge"])
        names, least = table["edge"].tolist(), table["least"].tolist()
        number = {name: i for i, name in enumerate(names)}
        known = [(int(w), tuple(t), h) for w, t, h in zip(table["weight"], table["tails"], table["head"])]
        out, targets = [], [list(t) for t in queries["targets"]]
        began = time.monotonic()
        found = solved_sets(Arcs(known, queries["starts"].iloc[0]), targets, int(queries["max_nodes"].iloc[0])) if len(queries) else []
        each = int((time.monotonic() - began) * 1000 / max(1, len(queries)))
        for q, wanted, got in zip(queries.itertuples(index=False), targets, found):
            if got is not None:
                cost, lower, proven, used, nodes, pruned, millis = got[0], got[0], True, got[1], got[2], 0, each
            else:
                own = needed_by(wanted, known, {number[e] for e in q.held}, [x <= q.upper for x in least])
                place = {e: i for i, e in enumerate(own)}
                f = cheapest(list(q.starts), [known[e] for e in own], wanted, [place[number[e]] for e in q.held], int(q.lower), int(q.max_nodes), int(q.max_millis))
                cost, lower, proven, used, nodes, pruned, millis = f.cost, f.lower, f.proven, [own[e] for e in f.edges], f.nodes, f.pruned, f.millis
            out.append((q.query_id, Decimal(cost), Decimal(lower), Decimal(cost), proven, [names[e] for e in used], nodes, pruned, millis))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SOLUTION.split(", ")])

    return edges.groupBy("batch").cogroup(asked.groupBy("batch")).applyInPandas(typed, SOLUTION)


def needed_by(targets: list, edges: list, held: set, usable: list[bool]) -> list[int]:
    """The numbers of the usable or held edges that a walk back from the targets meets, in order."""
    into: dict = {}
    for e, (_, _, head) in enumerate(edges):
        into.setdefault(head, []).append(e)
    todo, seen, found = list(targets), set(targets), set()
    while todo:
        for e in into.get(todo.pop(), ()):
            if usable[e] or e in held:
                found.add(e)
                new = set(edges[e][1]) - seen
                seen |= new
                todo += new
    return sorted(found)


def alike(starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, like): of the queries with one set of starts, like is the first; bounds and closure hold for all of them."""
    sets = starts.groupBy("query_id").agg(F.array_sort(F.collect_set("point")).alias("set"))
    asked = targets.select("query_id").distinct().join(sets, "query_id", "left").withColumn("set", F.to_json("set"))
    first = asked.groupBy("set").agg(F.min("query_id").alias("like"))
    return asked.join(first, asked["set"].eqNullSafe(first["set"])).select("query_id", "like")


def relevant(graph: Graph, starts: DataFrame, targets: DataFrame, depth: DataFrame, limit: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, edge, pos, weight, tails, head, least): edges that a cheapest set can hold, once each; least is the depth bound behind them.

    Dropped are edges into starts, edges with an unreached tail, edges whose depth bound already
    passes limit (query_id, upper), and edges that no target can need. starts and depth are those of
    the queries ``like`` in members (query_id, like); the walk back from the targets is each query's own.
    """
    table = graph.hyperedges.select(F.col("id").alias("edge"), "pos", F.col("weight_units").alias("weight"), F.array_distinct("tails").alias("tails"), "head")
    tails = graph.incidence().join(depth, "point").groupBy("query_id", "edge").agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("d"))
    fed = tails.join(table, "edge").where(F.col("n") == F.size("tails")).withColumn("least", F.col("d") + F.col("weight"))
    likes = members.select(F.col("like").alias("query_id")).distinct()
    free = likes.withColumn("_one", F.lit(1)).join(table.where(F.size("tails") == 0).withColumn("_one", F.lit(1)), "_one").withColumn("least", F.col("weight").cast(COST))
    columns = ["edge", "pos", "weight", "tails", "head"]
    usable = fed.select("query_id", *columns, "least").unionByName(free.select("query_id", *columns, "least"))
    usable = usable.join(starts.select("query_id", F.col("point").alias("head")).distinct(), ["query_id", "head"], "left_anti")
    usable = cut(usable.select(F.col("query_id").alias("like"), *columns, "least"))
    bound = cut(limit.join(members, "query_id").select("query_id", "like", "upper"))
    need = cut(targets.join(limit, "query_id", "left_semi").select("query_id", "point").distinct())
    seen, kept = need, None
    while not is_empty(need):
        used = need.withColumnRenamed("point", "head").join(bound, "query_id").join(usable, ["like", "head"]).where("least <= upper")
        used = cut(used.select("query_id", *columns, "least"))
        kept = used if kept is None else kept.unionByName(used)
        need = cut(used.select("query_id", F.explode("tails").alias("point")).distinct().join(seen, ["query_id", "point"], "left_anti"))
        seen = seen.unionByName(need)
    if kept is None:
        return targets.select("query_id").join(usable.select(*columns, "least"), F.lit(False))
    return kept  # a point is walked back from once, so no edge comes twice


def solve(graph: Graph, starts: DataFrame, targets: DataFrame, max_nodes: int = MAX_NODES, max_millis: int = MAX_MILLIS, lower: CostMeasure | None = None, upper: CostMeasure | None = None) -> DataFrame:
    """One row a query (SOLUTION columns); starts and targets are (query_id, point).

    A query with an unreachable target costs INFINITY, proven, with no edges. A query is pinned without a search when
    the depth bound meets the cost of the tree witness, whose edges are paid once each. Other
    queries are searched exactly, within max_nodes states and max_millis milliseconds; when those run out,
    lower and upper enclose the true cost and proven_optimal is false. A target set without points can't be a row here:
    its cost is 0. Queries with equal starts share one computation of the bounds.
    """
    lower, upper = lower or DepthCost(), upper or TreeCost()
    if not (lower.superior and upper.superior) or lower.role != "lower" or upper.role != "upper":
        raise GraphError("invalid_arguments", "a lower and an upper bound measure are needed")
    starts, targets = cut(starts.select("query_id", "point").distinct()), cut(targets.select("query_id", "point").distinct())
    members = cut(alike(starts, targets))
    likes = members.select(F.col("like").alias("query_id")).distinct()
    given = cut(starts.join(likes, "query_id", "left_semi").select("query_id", "point"))
    depth, tree = bounds(graph, given, lower, queries=likes), bounds(graph, given, upper, queries=likes)

    def own(df: DataFrame) -> DataFrame:
        return wanted.join(df.withColumnRenamed("query_id", "like"), ["like", "point"], "left")

    wanted = cut(targets.join(members, "query_id"))
    low = own(depth).groupBy("query_id").agg(F.max(F.coalesce("cost", infinite())).alias("lower"))
    high = own(tree).groupBy("query_id").agg(F.max(F.coalesce("cost", infinite())).alias("tree"))
    reached = own(closure(graph, given, queries=likes)).groupBy("query_id").agg(F.bool_and(F.col("round").isNotNull()).alias("reached"))
    state = cut(low.join(high, "query_id").join(reached, "query_id"))
    over = state.where(F.col("reached") & ((F.col("lower") == infinite()) | (F.col("tree") == infinite()))).limit(1).collect()
    if over:
        raise GraphError("invalid_weight", "a reachable cost overflows", query=over[0]["query_id"])
    open_ = state.where("reached")
    held = witness(graph, choices(graph, given, tree, upper), targets.join(open_, "query_id", "left_semi"), members)
    paid = held.join(graph.edges(), "edge").groupBy("query_id").agg(F.sum(F.col("weight").cast(COST)).cast(COST).alias("upper"), F.array_sort(F.collect_list("edge")).alias("edges"))
    known = cut(open_.join(paid, "query_id", "left").select("query_id", "lower", F.coalesce("upper", F.lit(0).cast(COST)).alias("upper"), F.coalesce("edges", F.array().cast("array<string>")).alias("edges")))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    lost = state.where("not reached").select("query_id", infinite().alias("cost"), infinite().alias("lower"), infinite().alias("upper"), F.lit(True).alias("proven_optimal"), none.alias("derivation"), zero.alias("nodes"), zero.alias("pruned"), zero.alias("millis"))
    pinned = known.where("lower = upper").select("query_id", F.col("upper").alias("cost"), "lower", "upper", F.lit(True).alias("proven_optimal"), F.col("edges").alias("derivation"), zero.alias("nodes"), zero.alias("pruned"), zero.alias("millis"))
    left = cut(known.where("lower < upper"))
    done = lost.unionByName(pinned)
    if is_empty(left):
        return done
    # open queries with equal starts go in batches: a batch walks back once, as far as its highest upper bound allows
    batches = max(1, -(-left.count() // TOGETHER))
    batch = F.concat(F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("string"), F.lit(":"), F.col("like"))
    dealt = cut(left.join(members, "query_id").select("query_id", "like", batch.alias("batch"), "lower", "upper", F.col("edges").alias("held")))
    limit = dealt.groupBy(F.col("batch").alias("query_id"), "like").agg(F.max("upper").alias("upper"))
    ends = targets.join(dealt.select("query_id", "batch"), "query_id").select(F.col("batch").alias("query_id"), "point").distinct()
    edges = relevant(graph, given, ends, depth, limit.select("query_id", "upper"), limit.select("query_id", "like")).withColumnRenamed("query_id", "batch")
    asked = dealt.drop("like").join(targets.groupBy("query_id").agg(F.collect_set("point").alias("targets")), "query_id").join(starts.groupBy("query_id").agg(F.collect_set("point").alias("starts")), "query_id", "left")
    asked = asked.withColumns({"starts": F.coalesce("starts", none), "max_nodes": F.lit(max_nodes), "max_millis": F.lit(max_millis)})
    return done.unionByName(cut(_searched(edges, asked)))


#: A trunk of more points isn't held by every task, nor are so many arcs into one terminal; their queries go through solve().
MAX_TRUNK, MAX_WAYS = 1 << 19, 1 << 17
#: Queries of a task, which share a copy of their terminals' arcs.
BATCH = 200_000


def _trunk(ways: DataFrame, arcs: DataFrame) -> dict | None:
    """The points that lead to terminals, round by round up to what is free: (parent, weight) by point, or None where there is more than one arc.

    arcs: (head, tail, weight) of terminals, tail null at what is free. None: more points than MAX_TRUNK.
    """
    spark, found, asked = ways.sparkSession, {}, set()
    new = arcs.where("tail is not null").select(F.col("tail").alias("head")).distinct()
    while True:
        rows = new.join(ways, "head").select("head", F.get("tails", F.lit(0)).alias("parent"), "weight", ((F.col("n") > 1) | (F.col("widest") > 1)).alias("other"))
        got = rows.limit(MAX_TRUNK + 1 - len(found)).toArrow().to_pydict()
        found.update((p, None if other else (up, w)) for p, up, w, other in zip(*(got[c] for c in rows.columns)))
        if len(found) > MAX_TRUNK:
            return None
        ahead = {way[0] for way in found.values() if way is not None and way[0] is not None} - found.keys() - asked
        if not ahead:
            return found
        asked |= ahead
        new = spark.createDataFrame(pd.DataFrame({"head": sorted(ahead)}), "head string")


def _batches(spark: SparkSession, queries: int) -> list[int]:
    """Keys of batches, each in a partition of its own as long as there are enough of them."""
    parts = parts_of(spark)
    n = max(-(-queries // BATCH), min(parts, 2 * spark.sparkContext.defaultParallelism, -(-queries // TOGETHER)), 1)
    places = spark.range(64 * parts).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("place")).agg(F.min("key").alias("key"))
    keys = [r["key"] for r in places.orderBy("place").collect()]
    return keys[:n] + list(range(64 * parts, 64 * parts + n - len(keys)))


def costs(graph: Graph, starts: DataFrame, targets: DataFrame, max_nodes: int = MAX_NODES, max_millis: int = MAX_MILLIS) -> DataFrame:
    """(query_id, cost, lower, proven_optimal) as solve() has them, without routes; starts and targets are (query_id, point).

    Queries with equal starts to whose terminals a trunk leads (see trunk.py) need neither bounds nor witnesses: a batch of
    them comes with the arcs into its terminals, once each. What is of another form goes through solve(), on the edges that it can need.
    """
    spark, tables = graph.spark, Tables(graph.spark)
    columns = ["query_id", "cost", "lower", "proven_optimal"]
    starts, targets = tables.kept(starts.select("query_id", "point").distinct()), targets.select("query_id", "point").distinct()

    def all_searched() -> DataFrame:
        return solve(graph, starts, targets, max_nodes, max_millis).select(*columns)

    if not is_empty(starts) and alike(starts, targets).select("like").distinct().count() > 1:
        return all_searched()
    given = starts.select(F.col("point").alias("head")).distinct()
    rows = graph.hyperedges.select("head", F.array_distinct("tails").alias("tails"), F.col("weight_units").alias("weight"))
    rows = rows.where(~F.array_contains("tails", F.col("head"))).join(F.broadcast(given) if is_empty(given) else given, "head", "left_anti")
    rows = rows.unionByName(given.select("head", F.array().cast("array<string>").alias("tails"), F.lit(0).cast("long").alias("weight")))
    edges = tables.dealt("edges", rows, "head")
    n_tails = F.size("tails")
    ways = tables.put("ways", edges.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.max(n_tails).alias("widest"), F.any_value("tails").alias("tails"), F.any_value("weight").alias("weight")))
    forced = (F.col("n") == 1) & (F.col("widest") > 0)
    met = targets.withColumnRenamed("point", "head").join(ways, "head", "left").withColumn("forced", F.coalesce(forced, F.lit(False)))
    of_target = (F.col("n").isNull().alias("lost"), F.when(F.col("forced"), F.col("head")).alias("forced"), F.when(F.col("forced"), F.col("tails")).otherwise(F.array("head")).alias("ends"), F.when(F.col("forced"), F.col("weight")).otherwise(F.lit(0)).cast(COST).alias("base"))
    asked = met.select("query_id", *of_target).groupBy("query_id").agg(F.max("lost").alias("lost"), F.sum("base").cast(COST).alias("base"), F.collect_list("forced").alias("forced"), F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"))
    asked = tables.put("asked", asked)
    heads = asked.select(F.explode("forced").alias("head")).distinct()
    ends = tables.put("ends", asked.where("not lost").select(F.explode("ends").alias("head")).distinct())
    usable = ends.join(ways.where((F.col("widest") < 2) & (F.col("n") <= MAX_WAYS)).select("head"), "head", "left_semi").join(heads, "head", "left_anti")
    arcs = tables.put("arcs", edges.join(usable, "head", "left_semi").select("head", F.get("tails", F.lit(0)).alias("tail"), "weight"))
    tables.drop("edges")
    found = _trunk(ways, arcs)
    dearest = arcs.agg(F.max("weight")).first()[0] or 0
    if found is None or MAX_TERMINALS * (dearest + sum(way[1] for way in found.values() if way is not None)) >= 1 << 60:
        return all_searched()
    trunk, number, other = numbered(found)
    # a point that is in the trunk and is itself asked for would be paid twice
    inside = tables.put("inside", spark.createDataFrame(pd.DataFrame({"head": sorted(found)}, dtype=object), "head string"))
    nodes = pd.DataFrame({"tail": [*number, *sorted(other)], "node": [*number.values(), *[-1] * len(other)]})
    nodes = tables.put("nodes", spark.createDataFrame(nodes.astype({"tail": object}), "tail string, node int"))
    node = F.when(F.col("tail").isNull(), F.lit(ROOT)).otherwise(F.col("node"))
    table = arcs.join(inside, "head", "left_anti").join(nodes, "tail", "left").select("head", node.alias("node"), F.col("weight").cast("int" if dearest < 1 << 31 else "long").alias("weight"))
    table = table.where("node is not null").groupBy("head").agg(F.min("node").alias("least"), F.collect_list(F.struct("node", "weight")).alias("arcs"))
    table = tables.put("table", table.where("least >= 0").select("head", F.col("arcs.node").alias("nodes"), F.col("arcs.weight").alias("weights")))
    tables.drop("ways", "arcs")
    most = min(MAX_TERMINALS, (max_nodes + 1).bit_length() - 1)
    fit = asked.where(~F.col("lost") & (F.size("ends") <= most))
    if table.count() < ends.count():
        short = fit.select("query_id", F.explode("ends").alias("head")).join(table.select("head"), "head", "left_anti")
        fit = fit.join(short.select("query_id").distinct(), "query_id", "left_anti")
    if not is_empty(through := heads.join(inside, "head", "left_semi")):
        passed = asked.select("query_id", F.explode("forced").alias("head")).join(through, "head", "left_semi")
        fit = fit.join(passed.select("query_id").distinct(), "query_id", "left_anti")
    fit = tables.put("fit", fit.select("query_id", "base", "ends"))
    lost = tables.kept(asked.where("lost").select("query_id"))
    solving, n_lost, n_asked = fit.count(), lost.count(), asked.count()
    tables.drop("ends")
    keys = _batches(spark, solving)
    batch = F.element_at(F.array(*map(F.lit, keys)), (F.pmod(F.xxhash64("query_id"), F.lit(len(keys))) + 1).cast("int"))
    dealt = fit.withColumn("batch", batch)
    known = dealt.select("batch", F.explode("ends").alias("head")).groupBy("head").agg(F.collect_set("batch").alias("of")).join(table, "head")
    known = known.select(F.explode("of").alias("of"), "head", "nodes", "weights")

    def typed(known: pa.Table, queries: pa.Table) -> pa.Table:
        least = np.zeros(0, np.int64)
        if queries.num_rows:
            into, ends = known["nodes"].combine_chunks(), queries["ends"].combine_chunks()
            at = pc.index_in(ends.flatten(), value_set=known["head"].combine_chunks()).to_numpy(zero_copy_only=False)
            first, last = (np.append(0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))) for x in (into, ends))
            node, weight = (x.flatten().to_numpy().astype(np.int64) for x in (into, known["weights"].combine_chunks()))
            least = least_costs(trunk, first, node, weight, at, last)
        return pa.table({"query_id": queries["query_id"], "base": queries["base"], "least": least})

    solved = known.groupBy("of").cogroup(dealt.groupBy("batch")).applyInArrow(typed, "query_id string, base decimal(38,0), least long")
    cost = (F.col("base") + F.col("least")).cast(COST)
    solved = tables.kept(solved.select("query_id", cost.alias("cost")))
    done = solved.select("query_id", "cost", F.col("cost").alias("lower"), F.lit(True).alias("proven_optimal"))
    done = done.unionByName(lost.select("query_id", infinite().alias("cost"), infinite().alias("lower"), F.lit(True).alias("proven_optimal")))
    if solving + n_lost == n_asked:
        return done
    rest = tables.kept(targets.join(done.select("query_id"), "query_id", "left_anti"))
    searched = solve(needed(graph, rest), starts.join(rest.select("query_id").distinct(), "query_id", "left_semi"), rest, max_nodes, max_millis)
    return done.unionByName(searched.select(*columns))


def routes(graph: Graph, starts: DataFrame, targets: DataFrame, max_nodes: int = MAX_NODES, max_millis: int = MAX_MILLIS) -> DataFrame:
    """solve() with the route: reachable, hyperedgeIds and pointIds in ASCII order, executableOrder by firing round."""
    solved = cut(solve(graph, starts, targets, max_nodes, max_millis))
    used = solved.select("query_id", F.explode("derivation").alias("edge"))
    order = executable_order(graph, starts, used)[0].groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("step", "edge"))).getField("edge").alias("executableOrder"))
    named = used.join(graph.hyperedges.select(F.col("id").alias("edge"), "tails", "head"), "edge").select("query_id", F.explode(F.array_union("tails", F.array("head"))).alias("point"))
    ends = starts.select("query_id", "point").unionByName(targets.select("query_id", "point")).join(solved.where(F.col("cost") < infinite()), "query_id", "left_semi")
    points = named.unionByName(ends).groupBy("query_id").agg(F.array_sort(F.collect_set("point")).alias("pointIds"))
    none = F.array().cast("array<string>")
    return solved.join(order, "query_id", "left").join(points, "query_id", "left").select(
        *solved.columns,
        (F.col("cost") < infinite()).alias("reachable"),
        F.col("derivation").alias("hyperedgeIds"),
        F.coalesce("executableOrder", none).alias("executableOrder"),
        F.coalesce("pointIds", none).alias("pointIds"),
    )

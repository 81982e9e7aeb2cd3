"""Reachability: closures, firing rounds, executable order, dangling points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, GraphError
from ..plans.fixpoint import Tables, is_empty, parts_of
from .layout import Layout, lay_out, layout, shape, stand


def _spread(tables: Tables, laid: Layout, fires: bool = False) -> None:
    """Adds to the table "known" (query_id, point, round), round by round, what its points make available.

    A round joins only what the last one added and adds to each joint edge's count of known tails; an edge fires when the
    count is its number of tails. fires: the table "fired" gets (query_id, edge, pos, round, head) of every edge that fires.
    """
    spark, number = tables.spark, 1
    new, waiting = tables.all_of("known"), None
    while not is_empty(new):
        number += 1
        columns = ["query_id", "edge", "pos", (F.col("last") + 1).alias("round"), "head"] if fires else ["query_id", "head"]
        made = [laid.along(new.withColumnRenamed("round", "last")).select(*columns)]
        if laid.meets(new):
            met = laid.into_joint(new).select("query_id", "key", F.lit(1).cast("long").alias("n"), F.col("round").alias("last"))
            if waiting is not None:
                met = met.unionByName(waiting)
            counts = met.repartition(parts_of(spark), "key").groupBy("query_id", "key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
            state = tables.put(f"state-{number}", counts.join(laid.joint, "key"))
            tables.drop(f"state-{number - 1}")
            waiting = tables.put(f"waiting-{number}", state.where("n < n_tails").select("query_id", "key", "n", "last"))
            made.append(state.where("n = n_tails").select(*columns))
            tables.drop(*[x for x in list(tables.paths) if x.startswith("waiting-") and x != f"waiting-{number}"])
        if fires:
            made = [tables.kept(m, "fired") for m in made]
        heads = made[0] if len(made) == 1 else made[0].unionByName(made[1])
        heads = heads.select("query_id", F.col("head").alias("point")).distinct()
        new = tables.put("known", heads.join(tables.all_of("known").select("query_id", "point"), ["query_id", "point"], "left_anti").withColumn("round", F.lit(number)))


def _for_all(asked: DataFrame, rows: DataFrame) -> DataFrame:
    return asked.withColumn("_one", F.lit(1)).join(rows.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _first(tables: Tables, starts: DataFrame, free: DataFrame) -> DataFrame:
    """The table "known" of start points and of the heads (query_id, point) of edges without tails."""
    both = starts.select("query_id", "point", F.lit(0).alias("round")).unionByName(free.select("query_id", "point", F.lit(1).alias("round")))
    return tables.put("known", both.groupBy("query_id", "point").agg(F.min("round").alias("round")))


def closure(graph: Graph, starts: DataFrame, edges: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The least fixed point for every query: rows (query_id, point, round).

    starts: (query_id, point); queries: (query_id), needed only where a query may have no start point.
    edges: only these (edge) may fire. Start points have round 0, heads of empty-tail edges round 1 unless they are starts.
    """
    tables = Tables(graph.spark)
    if edges is None:
        stood = shape(graph)
    else:
        table = graph.hyperedges.select(F.col("id").alias("edge"), F.array_distinct("tails").alias("tails"), "head")
        stood = stand(tables, table.join(edges.select("edge").distinct(), "edge", "left_semi").select("tails", "head"))
    asked = starts.select("query_id").distinct() if queries is None else queries.select("query_id").distinct()
    free = stood[1].where(F.size("tails") == 0).select(F.col("head").alias("point")).distinct()
    # a query set against the free entries: rows are in proportion to what every query reaches anyway
    if not is_empty(_first(tables, starts, _for_all(asked, free))):
        _spread(tables, layout(graph) if edges is None else lay_out(tables, stood))
    return tables.kept(tables.all_of("known"))


def closure_sets(graph: Graph, starts: DataFrame) -> DataFrame:
    """One row a query: (query_id, startPointIds, pointIds), both in ASCII order."""
    reached = closure(graph, starts).groupBy("query_id").agg(F.array_sort(F.collect_set("point")).alias("pointIds"))
    return starts.groupBy("query_id").agg(F.array_sort(F.collect_set("point")).alias("startPointIds")).join(reached, "query_id")


def firing_rounds(graph: Graph, known: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, edge, pos, round): the round after the last of an edge's tails is known; edges that never fire are absent.

    known: a closure's rows; edges: (query_id, edge) asked for.
    """
    picked = edges.select("query_id", "edge").distinct().join(graph.edges(), "edge")
    rounds = picked.join(graph.incidence(), "edge").join(known, ["query_id", "point"]).groupBy("query_id", "edge").agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("last"))
    both = picked.join(rounds, ["query_id", "edge"], "left")
    return both.where("n_tails = 0 or n = n_tails").select("query_id", "edge", "pos", (F.coalesce("last", F.lit(0)) + 1).alias("round"))


def executable_order(graph: Graph, starts: DataFrame, edges: DataFrame | None = None, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(order, blocked): order is (query_id, edge, step) in which every edge finds its tails available.

    edges: (query_id, edge); only a query's own edges fire. Every edge asked for is in the order or in
    blocked (query_id, edge), also where its head was known before. Duplicates collapse. Without edges, each of the
    queries (query_id; else those with starts) asks for all edges of the graph.
    """
    tables = Tables(graph.spark)
    rows = graph.hyperedges.select(F.col("id").alias("edge"), "pos", F.array_distinct("tails").alias("tails"), "head")
    if edges is not None:
        asked = edges.select("query_id", "edge").distinct()
        stood = stand(tables, asked.join(rows, "edge"))
        free = stood[1].where(F.size("tails") == 0)
    else:
        who = (starts if queries is None else queries).select("query_id").distinct()
        starts = starts.join(who, "query_id", "left_semi")
        asked = _for_all(who, rows.select("edge"))
        stood = stand(tables, rows)
        free = _for_all(who, stood[1].where(F.size("tails") == 0))
    free = tables.kept(free.select("query_id", "edge", "pos", F.lit(1).alias("round"), "head"), "fired")
    known = _first(tables, starts, free.withColumn("point", F.col("head")))
    if not is_empty(known):
        laid = lay_out(tables, stood, "edge", "pos")
        tables.drop("edges")
        _spread(tables, laid, fires=True)
    fired = tables.all_of("fired")
    order = fired.withColumn("step", F.row_number().over(Window.partitionBy("query_id").orderBy("round", "pos", "edge"))).select("query_id", "edge", "step", "round")
    return order, asked.join(fired.select("query_id", "edge"), ["query_id", "edge"], "left_anti")


def require_executable(graph: Graph, starts: DataFrame, edges: DataFrame) -> DataFrame:
    order, blocked = executable_order(graph, starts, edges)
    left = blocked.limit(20).collect()
    if left:
        raise GraphError("internal", "edges are blocked", blocked=[r["edge"] for r in left])
    return order


def natural_entries(graph: Graph) -> DataFrame:
    """(point): points that are no edge's head."""
    return graph.points.select(F.col("id").alias("point")).join(graph.hyperedges.select(F.col("head").alias("point")), "point", "left_anti")


def dangling_points(graph: Graph) -> DataFrame:
    """(point): points that can't be derived from the natural entries and the empty-tail edges."""
    spark = graph.spark
    starts = natural_entries(graph).select(F.lit("natural").alias("query_id"), "point")
    known = closure(graph, starts, queries=spark.createDataFrame([("natural",)], "query_id string"))
    return graph.points.select(F.col("id").alias("point")).join(known.select("point"), "point", "left_anti")

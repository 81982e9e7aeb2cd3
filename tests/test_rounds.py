"""What fixpoints leave in the shared folder, and results of whole graphs without a list of their edges."""

import os

from pyspark.sql import functions as F

from tests.helpers import graph_of, starts
from weft.operators import bounds as B
from weft.operators import diagnose as D
from weft.operators import reach as R
from weft.operators.layout import needed
from weft.plans.fixpoint import ensure_checkpoint_dir

RING = [f"e{i}: p{i}->p{(i + 1) % 12} (1)" for i in range(12)] + ["pair: p3,p5->x (1)", "on: x->y (1)"]


def left_after(spark, run):
    """Tables that a run leaves in the shared folder."""
    ensure_checkpoint_dir(spark)
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    tables = lambda: {d for d, _, names in os.walk(at) if any(n.startswith("part-") for n in names)}
    before = tables()
    run()
    return len(tables() - before)


def test_bounds_leave_their_result_only(spark):
    g = graph_of(spark, RING)
    for measure in (B.DepthCost(), B.TreeCost()):
        assert left_after(spark, lambda m=measure: B.bounds(g, starts(spark, "p0"), m, prepaid=spark.createDataFrame([("e1",)], "edge string")).collect()) <= 1


def test_frontier_leaves_its_result_only(spark):
    targets = spark.createDataFrame([("q", "y")], "query_id string, target string")
    # closure, frontier, and the edges that stay with the graph
    assert left_after(spark, lambda: D.blocking_frontier(graph_of(spark, RING), starts(spark, "nowhere"), targets).collect()) <= 3


def test_order_of_all_edges(spark):
    g = graph_of(spark, [*RING, "free: ->z (1)", "lost: w->v (1)"])
    every = g.hyperedges.select(F.lit("q").alias("query_id"), F.col("id").alias("edge"))
    found = [R.executable_order(g, starts(spark, "p0"), edges) for edges in (None, every)]
    assert [sorted(tuple(r) for r in order.collect()) for order, _ in found][0] == sorted(tuple(r) for r in found[1][0].collect())
    assert [[tuple(r) for r in blocked.collect()] for _, blocked in found] == [[("q", "lost")]] * 2


def test_cycle_members_with_several_components(spark):
    # y waits for x; two rings, and a loop that the target's own component does not hold
    g = graph_of(spark, ["a: a->b (1)", "b: b->a (1)", "c: c->d (1)", "d: d->c (1)", "l: l->l (1)", "m: a,c,l->t (1)", "back: t,u->u (1)"])
    targets = spark.createDataFrame([("q", "t"), ("q", "a"), ("r", "u")], "query_id string, target string")
    nowhere = starts(spark, "nowhere").unionByName(starts(spark, "nowhere", query="r"))
    cycles = D.blocking_cycles(g, D.blocking_frontier(g, nowhere, targets))
    got = {}
    for r in cycles.collect():
        got.setdefault((r["query_id"], r["target"]), []).append(r["cycle"])
    three = [["a", "b"], ["c", "d"], ["l"]]
    assert {k: sorted(v) for k, v in got.items()} == {("q", "t"): three, ("q", "a"): [["a", "b"]], ("r", "u"): [*three, ["u"]]}


def test_needed_is_the_walk_back(spark):
    g = graph_of(spark, ["free: ->a (1)", "ab: a->b (2)", "abc: a,b->c (1)", "cb: c->b (1)", "cd: c->d (1)", "dx: d->x (1)"])
    assert {r["id"] for r in needed(g, starts(spark, "c")).hyperedges.collect()} == {"free", "ab", "abc", "cb"}
    assert {r["id"] for r in needed(g, starts(spark, "nowhere")).hyperedges.collect()} == set()

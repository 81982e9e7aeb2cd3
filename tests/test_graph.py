"""Reachability, bounds, routes, subgraphs and diagnosis on small graphs with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from tests import oracle
from tests.helpers import graph_of, starts
from weft.model import INFINITY, GraphError, infinite
from weft.operators import bounds as B
from weft.operators import diagnose as D
from weft.operators import reach as R
from weft.operators import route as Q
from weft.operators import subgraph as S
from weft.plans import queries as engine

F1 = ["ab: a->b (3)", "bd: b->d (1)", "be: b->e (1)", "dez: d,e->z (1)"]
CYCLES = ["t: Taylor->eix (1)", "es: eix->sincos (1)", "se: sincos->eix (1)", "g: geotrig->sincos (1)", "ls: lin->sup (1)", "sl: sup->lin (1)"]


def costs(df):
    return {r["point"]: int(r["cost"]) for r in df.collect()}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_closure_and_rounds(spark):
    g = graph_of(spark, ["entry: ->a (2)", "next: a->b (1)"])
    ask = spark.createDataFrame([("q",)], "query_id string")
    found = {r["point"]: r["round"] for r in R.closure(g, starts(spark), queries=ask).collect()}
    assert found == {"a": 1, "b": 2}


def test_restricted_closure_and_order(spark):
    g = graph_of(spark, ["ab: a->b (1)", "bc: b->c (1)"])
    only = spark.createDataFrame([("bc",)], "edge string")
    assert {r["point"] for r in R.closure(g, starts(spark, "a"), edges=only).collect()} == {"a"}
    both = spark.createDataFrame([("q", "bc"), ("q", "ab"), ("q", "ab")], "query_id string, edge string")
    order = R.require_executable(g, starts(spark, "a"), both)
    assert [r["edge"] for r in order.orderBy("step").collect()] == ["ab", "bc"]
    with pytest.raises(GraphError):
        R.require_executable(g, starts(spark, "a"), both.where("edge = 'bc'"))


def test_cycles(spark):
    g = graph_of(spark, CYCLES)
    assert {r["point"] for r in R.dangling_points(g).collect()} == {"lin", "sup"}
    sets = one(R.closure_sets(g, starts(spark, "Taylor")))
    assert sets["pointIds"] == ["Taylor", "eix", "sincos"]
    row = one(D.diagnose(g, starts(spark, "Taylor"), spark.createDataFrame([("q", "lin")], "query_id string, target string")))
    assert row["cycles"] == [["lin", "sup"]] and row["blocking"] == ["lin", "sup"] and not row["reachable"]


def test_bounds_and_route(spark):
    g = graph_of(spark, F1)
    s = starts(spark, "a")
    assert costs(B.bounds(g, s, B.DepthCost()))["z"] == 5
    assert costs(B.bounds(g, s, B.TreeCost()))["z"] == 9
    row = one(Q.routes(g, s, starts(spark, "z")))
    assert (int(row["cost"]), int(row["lower"]), row["proven_optimal"]) == (6, 6, True)
    assert row["executableOrder"] == ["ab", "bd", "be", "dez"] and row["pointIds"] == ["a", "b", "d", "e", "z"]
    row = one(Q.solve(g, s, starts(spark, "d", "e")))
    assert int(row["cost"]) == 5 and len(row["derivation"]) == 3
    row = one(Q.solve(g, s, starts(spark, "z"), max_nodes=0))
    assert not row["proven_optimal"] and row["lower"] <= 6 <= row["upper"] == row["cost"]


def test_many_queries_at_once(spark):
    f3 = ["sa: s->a (2)", "sd: s->d (0)", "de: d->e (2)", "ea: e->a (1)", "aeh: a,e->h (0)", "ehi: e,h->i (0)", "it: i->t (0)", "xy: x->y (1)", "yx: y->x (1)"]
    g = graph_of(spark, f3)
    s = starts(spark, "s", query="reach").unionByName(starts(spark, "s", query="lost"))
    t = starts(spark, "t", query="reach").unionByName(starts(spark, "t", "x", query="lost")).unionByName(starts(spark, "x", query="none"))
    rows = {r["query_id"]: r for r in Q.solve(g, s, t).collect()}
    assert int(rows["reach"]["cost"]) == 3 and rows["reach"]["proven_optimal"]
    for name in ("lost", "none"):
        assert int(rows[name]["cost"]) == INFINITY and rows[name]["proven_optimal"] and rows[name]["derivation"] == []


def test_target_among_starts_costs_nothing(spark):
    g = graph_of(spark, F1)
    row = one(Q.solve(g, starts(spark, "a"), starts(spark, "a")))
    assert int(row["cost"]) == 0 and row["derivation"] == [] and row["proven_optimal"]


def test_overflow_is_no_unreachability(spark):
    g = graph_of(spark, ["ab: a->b (9007199254740991)", "bc: b->c (1)"])
    g = g.with_frames(hyperedges=g.hyperedges.withColumn("weight_units", F.lit(2**62)))
    big = graph_of(spark, ["ab: a->b (1)", "ac: a->c (1)", "bcd: b,c->d (1)", "de: d->e (1)"])
    huge = big.with_frames(hyperedges=big.hyperedges.withColumn("weight_units", F.lit(2**63 - 1)))
    with pytest.raises(GraphError) as e:
        Q.solve(huge, starts(spark, "a"), starts(spark, "e")).collect()
    assert e.value.code == "invalid_weight"
    assert B.bounds(huge, starts(spark, "a"), B.TreeCost()).where(F.col("cost") >= infinite()).count() == 0


def test_zero_weight_cycle_witness(spark):
    g = graph_of(spark, ["ba: b->a (0)", "ab: a->b (0)", "sa: s->a (0)", "bt: b->t (0)"])
    edges = B.tree_derivation(g, starts(spark, "s"), starts(spark, "t"))
    assert {r["edge"] for r in edges.collect()} == {"sa", "ab", "bt"}


def test_random_graphs(spark):
    """Sixty graphs as one batch: each graph's names carry its number, so one job serves all."""
    r, edges, s_rows, t_rows, want = random.Random(7), [], [], [], {}
    for n in range(60):
        names, raw = oracle.random_graph(r)
        own = [(w, tuple(f"{n}.{t}" for t in tails), f"{n}.{head}") for w, tails, head in raw]
        s, t = {f"{n}.{p}" for p in r.sample(names, r.randint(1, 2))}, f"{n}.{r.choice(names)}"
        edges += [f"e{n}.{i}: {','.join(tails)}->{head} ({w})" for i, (w, tails, head) in enumerate(own)]
        s_rows += [(str(n), p) for p in s]
        t_rows.append((str(n), t))
        want[str(n)] = (own, s, t)
    g = graph_of(spark, edges)
    # an empty tail of one graph is an entry of all, which harms no other graph's names
    s_df, t_df = spark.createDataFrame(s_rows, "query_id string, point string"), spark.createDataFrame(t_rows, "query_id string, point string")
    depth = {(x["query_id"], x["point"]): int(x["cost"]) for x in B.bounds(g, s_df, B.DepthCost()).collect()}
    tree = {(x["query_id"], x["point"]): int(x["cost"]) for x in B.bounds(g, s_df, B.TreeCost()).collect()}
    solved = {x["query_id"]: x for x in Q.solve(g, s_df, t_df).collect()}
    for n, (own, s, t) in want.items():
        assert {p: c for (q, p), c in depth.items() if q == n and p.startswith(f"{n}.")} == oracle.depth(s, own)
        assert {p: c for (q, p), c in tree.items() if q == n and p.startswith(f"{n}.")} == oracle.tree(s, own)
        best = oracle.set_cost(s, own, {t})
        assert int(solved[n]["cost"]) == (INFINITY if best == oracle.INF else best) and solved[n]["proven_optimal"]


def test_subgraphs(spark):
    g = graph_of(spark, ["ab: a->b (1)", "free: ->c (1)", "abc: a,b->c (1)"], ["x"])
    p = spark.createDataFrame([("a",), ("b",)], "point string")
    assert [r["id"] for r in S.induced(g, p).hyperedges.collect()] == ["ab"]
    assert {r["id"] for r in S.reachable(g, starts(spark, "a")).hyperedges.collect()} == {"ab", "free", "abc"}
    route = S.of_route(g, spark.createDataFrame([("ab",)], "edge string"), spark.createDataFrame([("x",)], "point string"))
    assert {r["id"] for r in route.points.collect()} == {"a", "b", "x"}


def test_measures(spark):
    g = graph_of(spark, ["pq: p,q->r (1)", "e: ->p (3)", "f: ->q (4)"])
    ask = spark.createDataFrame([("q",)], "query_id string")
    assert costs(B.bounds(g, starts(spark), B.TreeCost(), queries=ask))["r"] == 8
    assert costs(B.bounds(g, starts(spark), B.DepthCost(), queries=ask))["r"] == 5

    class Bad(B.DepthCost):
        superior = False

    with pytest.raises(GraphError):
        B.bounds(g, starts(spark), Bad())


def star_tables(spark, at):
    """Small star tables in which orders of up to five parts share suppliers, nations and regions."""
    r = random.Random(11)
    made = {
        "region": ("r_regionkey long", [(i,) for i in range(2)]),
        "nation": ("n_nationkey long, n_regionkey long", [(i, i % 2) for i in range(4)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(i, i % 4) for i in range(6)]),
        "part": ("p_partkey long", [(i,) for i in range(12)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i % 3) for i in range(25)]),
        "customer": ("c_custkey long, c_nationkey long", [(i, i) for i in range(3)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(o, p, r.randrange(6)) for o in range(24) for p in r.sample(range(12), r.randint(1, 5))]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return {name: rows for name, (_, rows) in made.items()}


def brute_order(tables, order):
    """The least cost of an order over all choices of one supplier a part."""
    nation, region = dict(tables["supplier"]), dict(tables["nation"])
    parts = sorted({p for o, p, _ in tables["lineitem"] if o == order})
    ways = [sorted({s for _, q, s in tables["lineitem"] if q == p}) for p in parts]
    best = None
    for taken in itertools.product(*ways):
        nations = {nation[s] for s in taken}
        cost = len(parts) + sum(1 + (7 * p + 3 * s) % 13 for p, s in zip(parts, taken)) + sum(5 + s % 11 for s in set(taken))
        cost += sum(10 + n % 5 for n in nations) + 10 * len({region[n] for n in nations})
        best = cost if best is None else min(best, cost)
    return best if parts else None


def test_all_orders_are_routed(spark, tmp_path):
    tables = star_tables(spark, tmp_path)
    got = {g["query_id"]: g for g in engine.route_all_orders(spark, str(tmp_path)).collect()}
    assert set(got) == {f"O-{i}" for i in range(25)} and all(g["proven_optimal"] for g in got.values())
    assert [got[f"O-{i}"]["cost"] for i in range(25)] == [brute_order(tables, i) for i in range(25)]
    assert all(g["lower"] == g["cost"] for g in got.values())


@pytest.mark.parametrize("name", ["executable_order_all", "induced_all_kinds"])
def test_every_kind_of_edge(spark, name):
    """On the whole graph: all seven kinds of edges, orders with several parts among them, as the SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for table in ("region", "nation", "supplier", "part", "orders", "customer", "lineitem"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    got = sorted(tuple(x) for x in engine.QUERIES[name](spark, SMOKE_DIR).collect())
    assert got == sorted(base.execute(engine.ORACLE_SQL[name]).fetchall())
    assert {x[0].split("-")[0] for x in got} == {"r", "n", "s", "ps", "o", "c", "cn"}

"""The JSON forms of query and subgraph results, for documents that fit the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.jsontext import Number, weight_text
from .model import INFINITY, Graph, GraphError, starts_frame
from .operators import diagnose as D
from .operators import reach as R
from .operators import route as Q
from .operators import subgraph as S
from .sources.document import value_of


def _checked(graph: Graph, names: list[str], what: str) -> None:
    if len(set(names)) != len(names):
        raise GraphError("invalid_arguments", f"a {what} stands twice")
    found = {r["id"] for r in graph.points.where(F.col("id").isin(names)).select("id").collect()} if names else set()
    for name in names:
        if name not in found:
            raise GraphError("unknown_point", name, id=name)


def _asked(graph: Graph) -> DataFrame:
    return graph.spark.createDataFrame([("q",)], "query_id string")


def _points(graph: Graph, names: list[str]) -> DataFrame:
    return starts_frame(graph.spark, {"q": names})


def _number(cost) -> Number | None:
    return None if int(cost) >= INFINITY else Number(weight_text(int(cost)))


def closure(graph: Graph, starts: list[str]) -> dict:
    _checked(graph, starts, "start")
    reached = R.closure(graph, _points(graph, starts), queries=_asked(graph)).select("point").collect()
    return {"startPointIds": sorted(starts), "pointIds": sorted(r["point"] for r in reached)}


def diagnose(graph: Graph, starts: list[str], targets: list[str]) -> dict:
    _checked(graph, starts, "start")
    _checked(graph, targets, "target")
    if not targets:
        raise GraphError("invalid_arguments", "a target is needed")
    asked = graph.spark.createDataFrame([("q", t) for t in targets], "query_id string, target string")
    rows = {r["target"]: r for r in D.diagnose(graph, _points(graph, starts), asked).collect()}
    found = [{"targetPointId": t, "blockingPointIds": list(rows[t]["blocking"]), "cycles": [list(c) for c in rows[t]["cycles"]]} for t in sorted(targets)]
    return {"reachable": rows[targets[0]]["reachable"], "startPointIds": sorted(starts), "targetPointIds": sorted(targets), "targetDiagnoses": found}


def route(graph: Graph, starts: list[str], targets: list[str], max_nodes: int = Q.MAX_NODES, max_millis: int = Q.MAX_MILLIS) -> dict:
    """The cheapest route, or the diagnosis of every target where one can't be reached."""
    _checked(graph, starts, "start")
    _checked(graph, targets, "target")
    if not targets:
        raise GraphError("invalid_arguments", "a target is needed")
    row = Q.routes(graph, _points(graph, starts), _points(graph, targets), max_nodes, max_millis).first()
    if not row["reachable"]:
        return diagnose(graph, starts, targets)
    return {
        "reachable": True,
        "startPointIds": sorted(starts),
        "targetPointIds": sorted(targets),
        "pointIds": list(row["pointIds"]),
        "hyperedgeIds": sorted(row["hyperedgeIds"]),
        "executableOrder": list(row["executableOrder"]),
        "cost": _number(row["cost"]),
        "lower": _number(row["lower"]),
        "upper": _number(row["upper"]),
        "provenOptimal": row["proven_optimal"],
        "nodes": row["nodes"],
        "pruned": row["pruned"],
        "millis": row["millis"],
    }


def _point_rows(graph: Graph, names: list[str]) -> DataFrame:
    return graph.spark.createDataFrame([(p,) for p in names], "point string")


def induced(graph: Graph, points: list[str]) -> dict:
    _checked(graph, points, "point")
    return {"graph": value_of(S.induced(graph, _point_rows(graph, points))), "selection": {"kind": "induced", "pointIds": sorted(points)}}


def reachable(graph: Graph, starts: list[str]) -> dict:
    found = closure(graph, starts)
    return {"graph": value_of(S.induced(graph, _point_rows(graph, found["pointIds"]))), "selection": {"kind": "reachable", **found}}


def route_subgraph(graph: Graph, starts: list[str], targets: list[str], max_nodes: int = Q.MAX_NODES, max_millis: int = Q.MAX_MILLIS) -> dict:
    found = route(graph, starts, targets, max_nodes, max_millis)
    kept = None
    if found["reachable"]:
        edges = graph.spark.createDataFrame([(e,) for e in found["hyperedgeIds"]], "edge string")
        kept = value_of(S.of_route(graph, edges, _point_rows(graph, [*starts, *targets])))
    return {"graph": kept, "selection": {"kind": "route", **found}}

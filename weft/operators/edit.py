"""Point and hyperedge editing, and atomic batches of operations.

Every function returns a new graph; the old one stays as it was, so a batch that fails has changed
nothing. Checks look up only the names an operation mentions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..model import HYPEREDGES, POINTS, Graph, GraphError, Issue
from ..plans.fixpoint import cut, is_empty
from .validate import is_id, issues

# --- checks --------------------------------------------------------------------------------------


def _has_point(graph: Graph, name: str) -> bool:
    return not is_empty(graph.point(name))


def _has_edge(graph: Graph, name: str) -> bool:
    return not is_empty(graph.hyperedge(name))


def _need_point(graph: Graph, name: str) -> None:
    if not _has_point(graph, name):
        raise GraphError("unknown_point", name, id=name).on("id")


def _need_edge(graph: Graph, name: str) -> None:
    if not _has_edge(graph, name):
        raise GraphError("unknown_hyperedge", name, id=name).on("id")


def _need_new(graph: Graph, name: str, field: str = "id") -> None:
    if not is_id(name):
        raise GraphError("invalid_id", name, id=name).on(field)
    taken = graph.points.select("id").unionByName(graph.hyperedges.select("id")).where(F.col("id") == name)
    if not is_empty(taken):
        raise GraphError("id_conflict", name, id=name).on(field)


def _need_ends(graph: Graph, tails: list[str] | None = None, head: str | None = None) -> None:
    """Every tail and the head are points, then no tail stands twice; one lookup for all."""
    ends = [(f"tails/{i}", t) for i, t in enumerate(tails or ())] + ([] if head is None else [("head", head)])
    wanted = sorted({name for _, name in ends})
    found = {r["id"] for r in graph.points.where(F.col("id").isin(wanted)).select("id").collect()} if wanted else set()
    for field, name in ends:
        if name not in found:
            raise GraphError("unknown_point", name, id=name).on(field)
    first: dict[str, int] = {}
    for i, tail in enumerate(tails or ()):
        if first.setdefault(tail, i) != i:
            raise GraphError("duplicate_tail", tail, id=tail, index=i).on(f"tails/{i}")


def _units(weight: str) -> int:
    try:
        return J.weight_units(J.Number(weight))
    except GraphError as e:
        raise e.on("weight") from None


def _after(df: DataFrame) -> int:
    last = df.agg(F.max("pos")).first()[0]
    return 0 if last is None else last + 1


def _payload(data) -> str | None:
    """The text of a payload; the default is an empty object."""
    return "{}" if data is J.MISSING else J.dump(data)


# --- points --------------------------------------------------------------------------------------


def point_list(graph: Graph) -> DataFrame:
    return graph.points.orderBy("pos")


def point_get(graph: Graph, name: str) -> DataFrame:
    _need_point(graph, name)
    return graph.point(name)


def point_add(graph: Graph, name: str, data=J.MISSING) -> Graph:
    _need_new(graph, name)
    row = graph.spark.createDataFrame([(_after(graph.points), name, _payload(data))], POINTS)
    return graph.with_frames(points=graph.points.unionByName(row))


def point_remove(graph: Graph, name: str, cascade: bool = False, ignore_missing: bool = False) -> Graph:
    """Without the point; cascade takes the edges that hold it along, else a point in use is point_referenced."""
    if not _has_point(graph, name):
        if ignore_missing:
            return graph
        raise GraphError("unknown_point", name, id=name).on("id")
    used = (F.col("head") == name) | F.array_contains("tails", name)
    if not cascade and not is_empty(graph.hyperedges.where(used)):
        raise GraphError("point_referenced", name, id=name).on("id")
    return graph.with_frames(graph.points.where(F.col("id") != name), graph.hyperedges.where(~used))


def point_rename(graph: Graph, name: str, new: str) -> Graph:
    """The point in its place under a new name, and so in every edge."""
    _need_point(graph, name)
    _need_new(graph, new, "newId")

    def swapped(column):
        return F.when(column == name, F.lit(new)).otherwise(column)

    edges = graph.hyperedges.withColumn("tails", F.transform("tails", swapped)).withColumn("head", swapped(F.col("head")))
    return graph.with_frames(graph.points.withColumn("id", swapped(F.col("id"))), edges)


# --- hyperedges ----------------------------------------------------------------------------------


def hyperedge_list(graph: Graph) -> DataFrame:
    return graph.hyperedges.orderBy("pos")


def hyperedge_get(graph: Graph, name: str) -> DataFrame:
    _need_edge(graph, name)
    return graph.hyperedge(name)


def hyperedge_add(graph: Graph, name: str, tails: list[str], head: str, weight: str, data=J.MISSING) -> Graph:
    """weight is a number's text. Checks come in the order id, points, tails, weight."""
    _need_new(graph, name)
    _need_ends(graph, tails, head)
    row = (_after(graph.hyperedges), name, _units(weight), list(tails), head, _payload(data))
    return graph.with_frames(hyperedges=graph.hyperedges.unionByName(graph.spark.createDataFrame([row], HYPEREDGES)))


def hyperedge_remove(graph: Graph, name: str, ignore_missing: bool = False) -> Graph:
    if not _has_edge(graph, name):
        if ignore_missing:
            return graph
        raise GraphError("unknown_hyperedge", name, id=name).on("id")
    return graph.with_frames(hyperedges=graph.hyperedges.where(F.col("id") != name))


def _replaced(graph: Graph, name: str, column: str, value) -> Graph:
    return graph.with_frames(hyperedges=graph.hyperedges.withColumn(column, F.when(F.col("id") == name, value).otherwise(F.col(column))))


def hyperedge_rename(graph: Graph, name: str, new: str) -> Graph:
    _need_edge(graph, name)
    _need_new(graph, new, "newId")
    return _replaced(graph, name, "id", F.lit(new))


def hyperedge_set_tails(graph: Graph, name: str, tails: list[str]) -> Graph:
    _need_edge(graph, name)
    _need_ends(graph, tails)
    return _replaced(graph, name, "tails", F.array(*map(F.lit, tails)).cast("array<string>"))


def hyperedge_set_head(graph: Graph, name: str, head: str) -> Graph:
    _need_edge(graph, name)
    _need_ends(graph, head=head)
    return _replaced(graph, name, "head", F.lit(head))


def hyperedge_set_weight(graph: Graph, name: str, weight: str) -> Graph:
    _need_edge(graph, name)
    return _replaced(graph, name, "weight_units", F.lit(_units(weight)).cast("bigint"))


# --- payloads ------------------------------------------------------------------------------------


def _frame(graph: Graph, kind: str, name: str) -> DataFrame:
    (_need_point if kind == "point" else _need_edge)(graph, name)
    return graph.points if kind == "point" else graph.hyperedges


def data_get(graph: Graph, kind: str, name: str, pointer: str = ""):
    row = _frame(graph, kind, name).where(F.col("id") == name).select("data").first()
    return J.pointer_get(J.from_column(row["data"]), pointer)


def _with_data(graph: Graph, kind: str, name: str, change) -> Graph:
    df = _frame(graph, kind, name)
    old = J.from_column(df.where(F.col("id") == name).select("data").first()["data"])
    try:
        text = J.to_column(change(old))
    except GraphError as e:
        raise e.on("pointer") from None
    return graph.with_frames(**{"points" if kind == "point" else "hyperedges": df.withColumn("data", F.when(F.col("id") == name, F.lit(text)).otherwise(F.col("data")))})


def data_set(graph: Graph, kind: str, name: str, value, pointer: str = "") -> Graph:
    return _with_data(graph, kind, name, lambda old: J.pointer_set(old, pointer, value))


def data_remove(graph: Graph, kind: str, name: str, pointer: str = "", ignore_missing: bool = False) -> Graph:
    return _with_data(graph, kind, name, lambda old: J.pointer_remove(old, pointer, ignore_missing))


# --- batches -------------------------------------------------------------------------------------

#: Fields of each operation in checking order (fixed by the document format): name, type, needed.
TEXT, TEXTS, FLAG, ANY, NUMBER = "string", "array of strings", "boolean", "value", "number"
FIELDS = {
    "point.add": (("id", TEXT, True), ("data", ANY, False)),
    "point.remove": (("id", TEXT, True), ("cascade", FLAG, False), ("ignoreMissing", FLAG, False)),
    "point.rename": (("id", TEXT, True), ("newId", TEXT, True)),
    "point.data.set": (("id", TEXT, True), ("pointer", TEXT, False), ("value", ANY, True)),
    "point.data.remove": (("id", TEXT, True), ("pointer", TEXT, False), ("ignoreMissing", FLAG, False)),
    "hyperedge.add": (("id", TEXT, True), ("tails", TEXTS, False), ("head", TEXT, True), ("weight", NUMBER, True), ("data", ANY, False)),
    "hyperedge.remove": (("id", TEXT, True), ("ignoreMissing", FLAG, False)),
    "hyperedge.rename": (("id", TEXT, True), ("newId", TEXT, True)),
    "hyperedge.set.tails": (("id", TEXT, True), ("tails", TEXTS, True)),
    "hyperedge.set.head": (("id", TEXT, True), ("head", TEXT, True)),
    "hyperedge.set.weight": (("id", TEXT, True), ("weight", NUMBER, True)),
    "hyperedge.data.set": (("id", TEXT, True), ("pointer", TEXT, False), ("value", ANY, True)),
    "hyperedge.data.remove": (("id", TEXT, True), ("pointer", TEXT, False), ("ignoreMissing", FLAG, False)),
}
#: Operations between two cuts of the growing plan.
CUT_EVERY = 8


class _Bad(Exception):
    def __init__(self, code: str, path: str, message: str = ""):
        self.issue = (code, path, message)


def _checked(op) -> tuple[str, dict]:
    """(operation name, fields) of one item, typed; _Bad with its path otherwise."""
    if not isinstance(op, dict):
        raise _Bad("invalid_type", "", "an object is needed")
    if "op" not in op:
        raise _Bad("missing_field", "/op")
    if type(op["op"]) is not str:
        raise _Bad("invalid_type", "/op")
    if op["op"] not in FIELDS:
        raise _Bad("unknown_field", "/op", op["op"])
    fields = FIELDS[op["op"]]
    for key in sorted(op, key=str.encode):
        if key != "op" and key not in {f[0] for f in fields}:
            raise _Bad("unknown_field", f"/{J.escape(key)}")
    out = {}
    for name, kind, needed in fields:
        if name not in op:
            if needed:
                raise _Bad("missing_field", f"/{name}")
            continue
        v = op[name]
        if kind == TEXT and type(v) is not str or kind == FLAG and type(v) is not bool or kind == TEXTS and not isinstance(v, list):
            raise _Bad("invalid_type", f"/{name}", f"a {kind} is needed")
        if kind == TEXTS:
            for i, x in enumerate(v):
                if type(x) is not str:
                    raise _Bad("invalid_type", f"/{name}/{i}", "a string is needed")
        if kind == NUMBER and not isinstance(v, J.Number):
            raise _Bad("invalid_weight", f"/{name}", "a number is needed")
        out[name] = v
    return op["op"], out


def _one(graph: Graph, name: str, f: dict) -> Graph:
    kind, _, action = name.partition(".")
    if name == "point.add":
        return point_add(graph, f["id"], f.get("data", J.MISSING))
    if name == "point.remove":
        return point_remove(graph, f["id"], f.get("cascade", False), f.get("ignoreMissing", False))
    if name == "point.rename":
        return point_rename(graph, f["id"], f["newId"])
    if action == "data.set":
        return data_set(graph, kind, f["id"], f["value"], f.get("pointer", ""))
    if action == "data.remove":
        return data_remove(graph, kind, f["id"], f.get("pointer", ""), f.get("ignoreMissing", False))
    if name == "hyperedge.add":
        return hyperedge_add(graph, f["id"], f.get("tails", []), f["head"], f["weight"], f.get("data", J.MISSING))
    if name == "hyperedge.remove":
        return hyperedge_remove(graph, f["id"], f.get("ignoreMissing", False))
    if name == "hyperedge.rename":
        return hyperedge_rename(graph, f["id"], f["newId"])
    if name == "hyperedge.set.tails":
        return hyperedge_set_tails(graph, f["id"], f["tails"])
    if name == "hyperedge.set.head":
        return hyperedge_set_head(graph, f["id"], f["head"])
    return hyperedge_set_weight(graph, f["id"], f["weight"])


def apply(graph: Graph, operations: str | bytes | list) -> Graph:
    """All operations in order, or GraphError invalid_operations with the first one's issue and no change."""
    if not isinstance(operations, list):
        try:
            operations = J.parse(operations)
        except GraphError as e:
            raise GraphError("invalid_operations", e.message, [Issue(e.code if e.code == "duplicate_key" else "invalid_type", "/operations", e.message)]) from e
    if not isinstance(operations, list):
        raise GraphError("invalid_operations", "an array is needed", [Issue("invalid_type", "/operations")])
    for i, op in enumerate(operations):
        try:
            graph = _one(graph, *_checked(op))
        except _Bad as bad:
            code, path, message = bad.issue
            raise GraphError("invalid_operations", message, [Issue(code, f"/operations/{i}{path}", message)]) from None
        except GraphError as e:
            path = f"/operations/{i}/{e.field}" if e.field else f"/operations/{i}"
            raise GraphError("invalid_operations", e.message, [Issue(e.code, path, e.message)]) from e
        if (i + 1) % CUT_EVERY == 0:
            graph = graph.with_frames(cut(graph.points), cut(graph.hyperedges))
    if operations and not is_empty(issues(graph)):
        raise GraphError("internal", "the batch left an invalid graph")
    return graph

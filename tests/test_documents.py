"""JSON documents, pointers, weights, editing and batches."""

import pytest

from weft.functions import jsontext as J
from weft.model import GraphError
from weft.operators import edit as E
from weft.operators import validate as V
from weft.sources import document as X

DOC = '{"points":[{"id":"A"},{"id":"B","data":{"n":123456789012345678901234567890,"a~/b":[1,2]}},{"id":"C","data":null}],"hyperedges":[{"id":"ab","weight":2.5,"tails":["A"],"head":"B"}]}'


def code(call, *args, **kw):
    with pytest.raises(GraphError) as e:
        call(*args, **kw)
    return e.value


def test_round_trip(spark):
    g = X.from_json(spark, DOC)
    assert X.to_json(g) == '{"hyperedges":[{"head":"B","id":"ab","tails":["A"],"weight":2.5}],"points":[{"id":"A"},{"data":{"a~/b":[1,2],"n":123456789012345678901234567890},"id":"B"},{"data":null,"id":"C"}]}\n'
    assert X.to_json(X.from_json(spark, '{"points":[],"hyperedges":[]}')) == '{"hyperedges":[],"points":[]}\n'


def test_parser():
    e = code(J.parse, '{"data":{"a/b":1,"a/b":2}}')
    assert e.code == "duplicate_key" and e.issues[0].path == "/data/a~1b"
    assert J.parse("[" * 128 + "]" * 128) is not None
    assert code(J.parse, "[" * 129 + "1" + "]" * 129).code == "nesting_limit_exceeded"
    assert code(J.parse, "[" * 100_000).code in ("invalid_json", "nesting_limit_exceeded")
    for bad in ("NaN", "1 2", "{", '"\ud800"', b"\xff", "[1,]"):
        assert code(J.parse, bad).code == "invalid_json"


# depth, weight bounds and precision below are fixed by the document format
def test_weights():
    for text, units in (("1e1", 100), ("-0.0", 0), ("900719925474099.1", 2**53 - 1), ("0.1000", 1), ("0e-99999999", 0), ("1e-1", 1)):
        assert J.weight_units(J.Number(text)) == units
    for text in ("-0.1", "1.25", "900719925474099.2", "1e999999", "1e-2", "0." + "0" * 40 + "1"):
        assert code(J.weight_units, J.Number(text)).code == "invalid_weight"
    assert code(J.weight_units, "1").code == code(J.weight_units, None).code == "invalid_weight"
    assert J.weight_text(15) == "1.5" and J.weight_text(10) == "1"


def test_pointers():
    data = J.parse('{"items":[1,2],"a/b":{"~":0}}')
    assert J.dump(J.pointer_get(data, "/a~1b/~0")) == "0"
    assert J.dump(J.pointer_set(data, "/items/-", J.parse("3"))["items"]) == "[1,2,3]"
    for pointer, want in (("items/0", "invalid_pointer"), ("/items/01", "invalid_pointer"), ("/items/-", "invalid_pointer"), ("/missing", "pointer_not_found"), ("/~2", "invalid_pointer")):
        assert code(J.pointer_remove, data, pointer).code == want
    assert J.pointer_remove(data, "/missing", True) == data
    assert code(J.pointer_remove, data, "/items/-", True).code == "invalid_pointer"
    assert code(J.pointer_set, data, "/items/2", 1).code == "pointer_not_found"
    assert code(J.pointer_set, None, "/a", 1).code == "pointer_type_mismatch"
    assert J.pointer_remove(data, "") is J.MISSING and J.pointer_get(J.MISSING, "") is None
    assert J.dump(J.pointer_remove(data, "/items/0")["items"]) == "[2]"


def test_document_issues(spark):
    text = '{"x":1,"points":[{"id":"A"},{"id":"A"},{"id":"-"},7,{}],"hyperedges":[{"id":"e","weight":"1","tails":[],"head":"A"},{"id":"A","weight":1,"tails":["A","A"],"head":"Z"},{"id":"f","weight":1,"tails":[1],"head":"A"}]}'
    e = code(X.from_json, spark, text)
    assert [(i.code, i.path) for i in e.issues] == [
        ("unknown_field", "/x"), ("duplicate_id", "/points/1/id"), ("invalid_id", "/points/2/id"), ("invalid_type", "/points/3"), ("missing_field", "/points/4/id"), ("invalid_weight", "/hyperedges/0/weight"),
        ("duplicate_id", "/hyperedges/1/id"), ("duplicate_tail", "/hyperedges/1/tails/1"), ("invalid_type", "/hyperedges/2/tails/0"), ("unknown_point", "/hyperedges/0/head"),
    ]
    assert code(X.from_json, spark, '{"schema":"other/v9"}').code == "unsupported_schema"
    assert code(X.from_json, spark, "[]").code == "invalid_graph"
    assert code(X.from_json, spark, DOC, limit=10).code == "input_limit_exceeded"


def test_files(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text(DOC)
    assert X.from_file(spark, str(path)).sizes().first().asDict() == {"n_points": 3, "n_hyperedges": 1, "size": 2}
    assert code(X.from_file, spark, str(tmp_path / "none.json")).code == "file_not_found"
    g = X.from_json(spark, DOC)
    X.write_tables(g, str(tmp_path / "tables"))
    assert X.to_json(X.read_tables(spark, str(tmp_path / "tables"))) == X.to_json(g)


def test_relational_validation(spark):
    points = spark.createDataFrame([(0, "A"), (1, "A"), (2, "bad/id"), (3, "line\n")], "pos long, id string")
    edges = spark.createDataFrame([(0, "e", 1, ["A", "A"], "Z"), (1, "A", -1, ["Y"], "A")], "pos long, id string, weight_units long, tails array<string>, head string")
    found = {(r["code"], r["path"]) for r in V.issues(X.from_tables(points, edges)).collect()}
    assert found == {
        ("duplicate_id", "/points/1/id"), ("duplicate_id", "/hyperedges/1/id"), ("invalid_id", "/points/2/id"), ("invalid_id", "/points/3/id"), ("invalid_weight", "/hyperedges/1/weight"),
        ("duplicate_tail", "/hyperedges/0/tails/1"), ("unknown_point", "/hyperedges/0/head"), ("unknown_point", "/hyperedges/1/tails/0"),
    }


def test_editing(spark):
    g = X.from_json(spark, DOC)
    assert code(E.point_remove, g, "A").code == "point_referenced"
    assert E.point_remove(g, "A", cascade=True).hyperedges.count() == 0
    assert code(E.point_rename, g, "A", "A").code == "id_conflict" and code(E.point_add, g, "ab").code == "id_conflict"
    renamed = E.point_rename(g, "A", "D")
    assert renamed.hyperedges.first()["tails"] == ["D"] and [r["id"] for r in E.point_list(renamed).collect()] == ["D", "B", "C"]
    assert code(E.hyperedge_add, g, "e", ["A", "A"], "B", "1").code == "duplicate_tail"
    assert code(E.hyperedge_add, g, "e", [], "missing", "1").code == "unknown_point"
    assert code(E.hyperedge_set_weight, g, "ab", "1.25").code == "invalid_weight"
    assert E.hyperedge_set_tails(g, "ab", []).hyperedges.first()["tails"] == []
    assert E.point_remove(g, "none", ignore_missing=True) is g
    assert J.dump(E.data_get(E.data_set(g, "point", "B", J.parse("9"), "/a~0~1b/0"), "point", "B", "/a~0~1b")) == "[9,2]"


def small(spark):
    """Two points, one edge between them that has a payload."""
    return X.from_json(spark, '{"points":[{"id":"in"},{"id":"out","data":{"n":[1]}}],"hyperedges":[{"id":"way","weight":3,"tails":["in"],"head":"out","data":{"by":"rail"}}]}')


#: A value that fits and one that doesn't, by type of field.
FITS = {E.TEXT: '"x1"', E.TEXTS: '["in"]', E.FLAG: "true", E.ANY: "[0]", E.NUMBER: "1.5"}
MISFITS = {E.TEXT: ("7", "null"), E.TEXTS: ('"in"', "{}"), E.FLAG: ("0", '"true"'), E.NUMBER: ('"1"', "null")}


def failed(graph, *ops):
    e = code(E.apply, graph, "[" + ",".join(ops) + "]")
    assert e.code == "invalid_operations" and len(e.issues) == 1
    return e.issues[0].code, e.issues[0].path


def spelled_op(name, fields):
    return "{" + ",".join([f'"op":"{name}"', *(f'"{k}":{v}' for k, v in fields.items())]) + "}"


@pytest.mark.parametrize("name", sorted(E.FIELDS))
def test_fields_of_an_operation(spark, name):
    """Each field left out, mistyped or unknown, one at a time, is the one issue of the batch."""
    graph, whole = small(spark), {f: FITS[kind] for f, kind, _ in E.FIELDS[name]}
    for f, kind, needed in E.FIELDS[name]:
        if needed:
            assert failed(graph, spelled_op(name, {k: v for k, v in whole.items() if k != f})) == ("missing_field", f"/operations/0/{f}")
        for bad in MISFITS.get(kind, ()):
            assert failed(graph, spelled_op(name, whole | {f: bad})) == ("invalid_weight" if kind == E.NUMBER else "invalid_type", f"/operations/0/{f}")
        if kind == E.TEXTS:
            assert failed(graph, spelled_op(name, whole | {f: '["in", [], "out"]'})) == ("invalid_type", f"/operations/0/{f}/1")
    assert failed(graph, spelled_op(name, whole | {"zz": "1"})) == ("unknown_field", "/operations/0/zz")
    assert failed(graph, spelled_op(name, whole)[:-1] + ',"b/c":1}') == ("unknown_field", "/operations/0/b~1c")
    for wrong in (f'["{name}"]', f'"{name}"', "null"):
        assert failed(graph, '{"op":"point.add","id":"first"}', wrong) == ("invalid_type", "/operations/1")


def test_each_check_names_its_own_field(spark):
    graph = small(spark)
    for op, want in {
        '{"op":"point.rename","id":"gone","newId":"x"}': ("unknown_point", "id"),
        '{"op":"point.rename","id":"in","newId":"way"}': ("id_conflict", "newId"),
        '{"op":"point.rename","id":"in","newId":"-"}': ("invalid_id", "newId"),
        '{"op":"point.add","id":"way"}': ("id_conflict", "id"),
        '{"op":"point.remove","id":"out"}': ("point_referenced", "id"),
        '{"op":"point.data.set","id":"out","pointer":"/n/4","value":0}': ("pointer_not_found", "pointer"),
        '{"op":"point.data.remove","id":"gone","ignoreMissing":true}': ("unknown_point", "id"),
        '{"op":"hyperedge.data.remove","id":"way","pointer":"by"}': ("invalid_pointer", "pointer"),
        '{"op":"hyperedge.data.set","id":"way","pointer":"/by/x","value":0}': ("pointer_type_mismatch", "pointer"),
        '{"op":"hyperedge.remove","id":"gone"}': ("unknown_hyperedge", "id"),
        '{"op":"hyperedge.rename","id":"way","newId":"in"}': ("id_conflict", "newId"),
        '{"op":"hyperedge.set.tails","id":"way","tails":["out","in","out"]}': ("duplicate_tail", "tails/2"),
        '{"op":"hyperedge.set.tails","id":"way","tails":["out","way"]}': ("unknown_point", "tails/1"),
        '{"op":"hyperedge.set.head","id":"way","head":"gone"}': ("unknown_point", "head"),
        '{"op":"hyperedge.set.weight","id":"way","weight":0.25}': ("invalid_weight", "weight"),
    }.items():
        assert failed(graph, '{"op":"point.add","id":"first"}', op) == (want[0], f"/operations/1/{want[1]}")


def test_batch(spark):
    """Every kind of operation, payloads among them, in one batch; a failed batch changes nothing."""
    graph = small(spark)
    steps = [
        spelled_op("hyperedge.data.set", {"id": '"way"', "pointer": '"/speed"', "value": "80"}),
        spelled_op("hyperedge.rename", {"id": '"way"', "newId": '"line"'}),
        spelled_op("point.add", {"id": '"mid"', "data": '{"stop":null}'}),
        spelled_op("hyperedge.set.head", {"id": '"line"', "head": '"mid"'}),
        spelled_op("point.data.remove", {"id": '"out"', "pointer": '"/n/0"'}),
        spelled_op("hyperedge.add", {"id": '"free"', "head": '"in"', "weight": "0"}),
        spelled_op("hyperedge.add", {"id": '"last"', "tails": '["mid","in"]', "head": '"out"', "weight": "1e1", "data": "5"}),
        spelled_op("hyperedge.data.remove", {"id": '"last"'}),
        spelled_op("point.rename", {"id": '"in"', "newId": '"start"'}),
        spelled_op("hyperedge.set.weight", {"id": '"line"', "weight": "2.5"}),
        spelled_op("hyperedge.set.tails", {"id": '"line"', "tails": "[]"}),
        spelled_op("point.data.set", {"id": '"mid"', "pointer": '"/stop"', "value": "[true]"}),
        spelled_op("hyperedge.remove", {"id": '"free"'}),
        spelled_op("point.remove", {"id": '"nowhere"', "ignoreMissing": "true"}),
    ]
    done = E.apply(graph, "[" + ",".join(steps) + "]")
    assert X.to_json(done) == (
        '{"hyperedges":[{"data":{"by":"rail","speed":80},"head":"mid","id":"line","tails":[],"weight":2.5},{"head":"out","id":"last","tails":["mid","start"],"weight":10}],'
        '"points":[{"data":{},"id":"start"},{"data":{"n":[]},"id":"out"},{"data":{"stop":[true]},"id":"mid"}]}\n'
    ).replace('{"data":{},"id":"start"}', '{"id":"start"}')
    assert failed(graph, *steps, spelled_op("point.remove", {"id": '"mid"'})) == ("point_referenced", "/operations/14/id")
    assert X.to_json(E.apply(graph, "[]")) == X.to_json(graph) == X.to_json(small(spark))


def test_pointer_columns(spark):
    df = spark.createDataFrame([(1, '{"k": 87}'), (2, None), (3, "[1]")], "i int, data string")
    found = {r["i"]: (r["x"]["value"], r["x"]["error"]) for r in df.select("i", J.json_get(df["data"], "/k").alias("x")).collect()}
    assert found == {1: ("87", None), 2: (None, "pointer_type_mismatch"), 3: (None, "pointer_not_found")}
    w = spark.createDataFrame([("1e2",), ("2.5",), ("1.25",), ("x",), ("-1",)], "w string")
    assert [r[0] for r in w.select(J.weight_units_column(w["w"])).collect()] == [1000, 25, None, None, None]

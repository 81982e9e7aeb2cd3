"""The command line on documents."""

import json

from weft.__main__ import run

DOC = b'{"schema":"weft.graph/v1","points":[{"id":"A"},{"id":"B"},{"id":"C"}],"hyperedges":[{"id":"ab","weight":1,"tails":["A"],"head":"B"}]}'


def call(spark, *argv, text=DOC):
    status, out, err = run(list(argv), spark, text)
    return status, json.loads(out or err)


def test_queries(spark):
    assert call(spark, "query", "closure", "--start", "A") == (0, {"startPointIds": ["A"], "pointIds": ["A", "B"]})
    status, found = call(spark, "query", "diagnose", "--start", "A", "--target", "B", "--target", "C")
    assert status == 0 and not found["reachable"] and [d["blockingPointIds"] for d in found["targetDiagnoses"]] == [[], ["C"]]
    status, found = call(spark, "query", "route", "--start", "A", "--target", "B")
    assert found["cost"] == 1 and found["executableOrder"] == ["ab"] and found["provenOptimal"]
    status, found = call(spark, "query", "route", "--start", "A", "--target", "C")
    assert status == 0 and not found["reachable"] and "cost" not in found


def test_subgraphs(spark):
    status, found = call(spark, "subgraph", "reachable", "--start", "A")
    assert [p["id"] for p in found["graph"]["points"]] == ["A", "B"] and found["graph"]["schema"] == "weft.graph/v1" and found["selection"]["kind"] == "reachable"
    assert call(spark, "subgraph", "route", "--start", "A", "--target", "C")[1]["graph"] is None
    assert call(spark, "subgraph", "induced")[1]["graph"] == {"schema": "weft.graph/v1", "points": [], "hyperedges": []}


def test_edits_and_errors(spark, tmp_path):
    assert call(spark, "validate")[0] == 0
    status, found = call(spark, "hyperedge", "add", "bc", "--tail", "B", "--head", "C", "--weight", "2.5")
    assert found["hyperedges"][1] == {"id": "bc", "weight": 2.5, "tails": ["B"], "head": "C", "data": {}}
    assert call(spark, "point", "data", "get", "A")[1] is None
    assert call(spark, "point", "get", "Z")[1]["error"]["code"] == "unknown_point"
    assert call(spark, "query", "closure", "--start", "A", "--start", "A")[0] == 64
    assert call(spark, "nonsense")[0] == 64
    assert call(spark, "validate", text=b'{"x":1}')[0] == 65
    assert call(spark, "apply", str(tmp_path / "none.json"))[0] == 66
    ops = tmp_path / "ops.json"
    ops.write_text('[{"op":"hyperedge.set.weight","id":"ab","weight":9}]')
    assert call(spark, "apply", str(ops))[1]["hyperedges"][0]["weight"] == 9

from tests.helpers import graph_of
from weft.streaming.oplog import GraphLog


def test_stream_of_operations(spark, tmp_path):
    log = GraphLog(spark, f"file://{tmp_path}/graph")
    log.start(graph_of(spark, ["ab: a->b (1)"]))
    rows = [(2, '{"op":"point.rename","id":"c","newId":"d"}'), (1, '{"op":"point.add","id":"c"}')]
    spark.createDataFrame(rows, "seq long, operation string").coalesce(1).write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema("seq long, operation string").parquet(str(tmp_path / "ops"))
    for _ in range(2):  # a second run has nothing left to do
        query = log.follow(stream, f"file://{tmp_path}/state")
        query.awaitTermination(120)
    assert {r["id"] for r in log.version(1).points.collect()} == {"a", "b", "d"}

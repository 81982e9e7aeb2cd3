from weft.model import HYPEREDGES, POINTS, Graph


def graph_of(spark, edges, points=()):
    """A graph of "name: a,b->c (w)" lines; points are the named ones and those of the edges."""
    rows, names = [], list(points)
    for i, text in enumerate(edges):
        name, rest = text.split(":")
        sides, weight = rest.rsplit("(", 1)
        left, head = (x.strip() for x in sides.split("->"))
        tails = [t.strip() for t in left.split(",") if t.strip()]
        rows.append((i, name.strip(), int(weight.strip(" )")), tails, head, None))
        names += [p for p in [*tails, head] if p not in names]
    return Graph(spark.createDataFrame([(i, n, None) for i, n in enumerate(dict.fromkeys(names))], POINTS), spark.createDataFrame(rows, HYPEREDGES))


def starts(spark, *points, query="q"):
    return spark.createDataFrame([(query, p) for p in points], "query_id string, point string")

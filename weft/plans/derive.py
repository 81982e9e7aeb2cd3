"""A hypergraph view of the star-schema tables: regions, nations, suppliers, parts, orders, customers.

Regions are free entries; a nation needs its region, a supplier its nation, a part any of its
suppliers, an order all of its parts, a customer any of its orders, and a nation any of its customers,
which closes cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def star_graph(spark: SparkSession, sf_dir: str, orders: bool = True) -> Graph:
    """The derived graph; orders=False leaves orders, customers and the edges back to nations out."""
    region, nation, supplier = (_read(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    items = _read(spark, sf_dir, "lineitem")
    none = F.array().cast("array<string>")

    def edge(df, name, weight, tails, head):
        return df.select(F.lit(0).cast("long").alias("pos"), name.alias("id"), weight.cast("long").alias("weight_units"), tails.alias("tails"), head.alias("head"), F.lit(None).cast("string").alias("data"))

    c = F.col
    supplied = items.select("l_partkey", "l_suppkey").distinct()
    parts = [
        edge(region, _named("r-", c("r_regionkey")), F.lit(10), none, _named("R-", c("r_regionkey"))),
        edge(nation, _named("n-", c("n_nationkey")), 10 + c("n_nationkey") % 5, F.array(_named("R-", c("n_regionkey"))), _named("N-", c("n_nationkey"))),
        edge(supplier, _named("s-", c("s_suppkey")), 5 + c("s_suppkey") % 11, F.array(_named("N-", c("s_nationkey"))), _named("S-", c("s_suppkey"))),
        edge(supplied, F.concat(_named("ps-", c("l_partkey")), _named("-", c("l_suppkey"))), 1 + (7 * c("l_partkey") + 3 * c("l_suppkey")) % 13, F.array(_named("S-", c("l_suppkey"))), _named("P-", c("l_partkey"))),
    ]
    points = [region.select(_named("R-", c("r_regionkey")).alias("id")), nation.select(_named("N-", c("n_nationkey")).alias("id")), supplier.select(_named("S-", c("s_suppkey")).alias("id")), _read(spark, sf_dir, "part").select(_named("P-", c("p_partkey")).alias("id"))]
    if orders:
        placed, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
        # an order's line items are few, so its tail set is small
        baskets = items.groupBy("l_orderkey").agg(F.array_sort(F.transform(F.collect_set("l_partkey"), lambda k: _named("P-", k))).alias("tails"))
        parts += [
            edge(baskets, _named("o-", c("l_orderkey")), F.size("tails"), c("tails"), _named("O-", c("l_orderkey"))),
            edge(placed, _named("c-", c("o_orderkey")), 1 + c("o_orderkey") % 9, F.array(_named("O-", c("o_orderkey"))), _named("C-", c("o_custkey"))),
            edge(customer, _named("cn-", c("c_custkey")), F.lit(2), F.array(_named("C-", c("c_custkey"))), _named("N-", c("c_nationkey"))),
        ]
        points += [placed.select(_named("O-", c("o_orderkey")).alias("id")), customer.select(_named("C-", c("c_custkey")).alias("id"))]

    def union(frames):
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    all_points = union(points).select(F.lit(0).cast("long").alias("pos"), "id", F.lit(None).cast("string").alias("data"))
    # names are unique, so any order is a document order; a hash needs no global numbering
    return Graph(all_points.withColumn("pos", F.xxhash64("id")), union(parts).withColumn("pos", F.xxhash64("id")))

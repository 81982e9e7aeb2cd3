"""Operator 9: nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` tables turns a unit vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest signed axis as its bucket; with ``hashes`` rotations a table, a bucket is
a tuple of axes, for more rows than fit the buckets of one. A query probes its ``PROBES`` nearest buckets
of every table; all candidates met there are ranked by exact double-precision distance on the
original vectors. Where a query meets fewer than k candidates in its buckets, all rows are searched
for it, in blocks, so nothing is lost.

Equal vectors are folded into one class beforehand: of a class only its k + 1 smallest ids can ever
be among k nearest. Vectors travel once for each table, in their own precision. Buckets are cut into blocks of ``BLOCK`` vectors;
a bucket's blocks are dealt to parts of ``PART`` blocks, and a query block meets each part in a row of its own, so no task gathers a whole bucket.

Vectors that are null, zero or hold a null or non-finite component take no part, neither as query nor
as candidate, nor do rows without an id; vectors of another length are never compared. Ties go to the smaller id. An id that
occurs twice counts as its rows do: each of them is a candidate, and different vectors of one id are different queries with ranks of their own.
Equal queries are one. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, shuffle_parts, table, written

TABLES, PROBES, BLOCK, PART, QUERY_BLOCK, SALT, SEED = 4, 24, 2048, 8, 256, 64, 20240901
#: Rows of an Arrow batch: of single vectors, and of pairs of blocks.
VECTORS, BLOCKS = 1024, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix (length a power of two), by butterflies; scaled to keep norms."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-rotation ``number`` of unit rows, padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng([SEED, number, size]).choice((-1.0, 1.0), (3, size))
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(x: np.ndarray, number: int, probes: int, hashes: int = 1) -> np.ndarray:
    """The ``probes`` nearest buckets of each unit row in a table, nearest first.

    A rotation's axes are 2 * axis + (1 if negative), nearest first by the row's part along them; a bucket of several
    rotations ranks by the sum of their parts.
    """
    total, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for h in range(hashes):
        y = rotated(x, number * hashes + h)
        both = np.stack((y, -y), axis=2).reshape(len(y), -1)
        own = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        total = (total[:, :, None] + np.take_along_axis(both, own, 1)[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * both.shape[1] + own[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        total, codes = np.take_along_axis(total, best, 1), np.take_along_axis(codes, best, 1)
    return codes


def _coded(df: DataFrame, tables: int, probes: int, hashes: int) -> DataFrame:
    """Rows (place table and length, code bucket, id, vector bytes) of rows (id, v): one for each table and probe."""
    kind = "<f4" if isinstance(df.schema["v"].dataType.elementType, T.FloatType) else "<f8"

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            ends = v.offsets.to_numpy()
            flat, sizes = v.values.to_numpy(), np.diff(ends)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = flat[ends[at][:, None] + np.arange(size)]
                ids, u = batch.column(0).take(pa.array(at)), unit(x.astype(np.float64))
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                for t in range(tables):
                    place = pa.array(np.full(len(at), (int(size) << 8) | t, np.int64))
                    for code in axes(u, t, probes, hashes).T:
                        yield pa.RecordBatch.from_arrays([place, pa.array(code), ids, raw], ["place", "code", "id", "vector"])

    return df.select("id", "v").mapInArrow(run, "place long, code long, id long, vector binary")


def _packed(rows: DataFrame, block: int, name: str, salts: int = 1) -> DataFrame:
    """Rows (place, code, ids bytes, vectors bytes, salt, number) of at most ``block`` vectors; a bucket is dealt to ``salts`` tasks, which number its blocks."""
    schema = f"place long, code long, {name}_ids binary, {name}_vectors binary, salt int, number long"

    def run(batches):
        key, ids, vectors, number = None, [], [], 0

        def out():
            columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary()), pa.array([key[2]], pa.int32()), pa.array([number], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["place", "code", f"{name}_ids", f"{name}_vectors", "salt", "number"])

        for batch in batches:
            place, code, salt, own, raw = (batch.column(k).to_pylist() for k in range(5))
            for this, i, v in zip(zip(place, code, salt), own, raw):
                if ids and (this != key or len(ids) == block):
                    yield out()
                    number = number + 1 if this == key else 0
                    ids, vectors = [], []
                key = this
                ids.append(i)
                vectors.append(v)
        if ids:
            yield out()

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return salted.repartition("place", "code", "salt").sortWithinPartitions("place", "code", "salt", "id").select("place", "code", "salt", "id", "vector").mapInArrow(run, schema)


def nearest_in_block(q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of each query's k nearest rows of a block, ties to the smaller id."""
    rough = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (q @ b.T)
    take = min(k, len(b))
    edge = np.partition(rough, take - 1, axis=1)[:, take - 1]
    slack = 1e-9 * (np.abs(edge) + (q * q).sum(1) + (b * b).sum(1).max())
    rows, places = np.nonzero(rough <= (edge + slack)[:, None])
    exact = np.sqrt(((q[rows] - b[places]) ** 2).sum(axis=1))
    order = np.lexsort((ids[places], exact, rows))
    rows, places, exact = rows[order], places[order], exact[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = rank < take
    return rows[keep], ids[places[keep]], exact[keep]


def _met(pairs: DataFrame, k: int) -> DataFrame:
    """Rows (query, class_id, score): each query's k nearest of the blocks that its own block meets one after another."""

    def matrix(vectors, ids, size):
        kind = "<f4" if len(vectors) == 4 * size * len(ids) else "<f8"
        return np.frombuffer(vectors, kind).reshape(len(ids), -1).astype(np.float64)

    def run(batches):
        asked, q, best = None, None, None  # the queries at hand and their nearest so far

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, "<i8")[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "class_id", "score"])

        for batch in batches:
            for place, qi, qv, bi, bv in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if qi != asked:
                    if best is not None:
                        yield out()
                    asked, q, best = qi, matrix(qv, np.frombuffer(qi, "<i8"), place >> 8), None
                bi = np.frombuffer(bi, "<i8")
                found = nearest_in_block(q, matrix(bv, bi, place >> 8), bi, k)
                if best is not None:
                    rows, ids, score = (np.concatenate(x) for x in zip(best, found))
                    order = np.lexsort((ids, score, rows))
                    rows = rows[order]
                    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                    found = rows[keep], ids[order][keep], score[order][keep]
                best = found
        if best is not None:
            yield out()

    return pairs.select("place", "q_ids", "q_vectors", "b_ids", "b_vectors").mapInArrow(run, "query long, class_id long, score double")


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v: the vector in its own precision, without negative zeros) that take part."""
    v = F.col(vector).cast("array<double>")
    kind = "float" if df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull) else "double"
    fine = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x + 0.0).cast(f"array<{kind}>").alias("v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors folded: (class_id smallest id, v, ids: the k + 1 smallest). Salted, as a class may hold a third of all rows."""
    part = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("_salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    whole = part.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    return whole.select(F.element_at("ids", 1).alias("class_id"), "v", "ids")


def search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES, hashes: int = 1) -> DataFrame:
    """Each query's k nearest rows of df but the one with its own id: (query_id, rank, vec_id, score)."""
    scratch, parts = Scratch(df.sparkSession, "ann"), shuffle_parts(df.sparkSession)
    base = scratch.put("classes", classes(valid(df, key, vector), k))
    asked = scratch.put("queries", valid(queries, key, vector).dropDuplicates(["id", "v"]).withColumn("query", F.xxhash64("id", "v")))
    both = asked.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if both:
        raise RuntimeError("two queries' 64-bit names clash")
    salts = max(4, parts // 16)
    blocks = scratch.put("blocks", _packed(_coded(base.select(F.col("class_id").alias("id"), "v"), tables, 1, hashes), BLOCK, "b", salts), VECTORS)
    blocks = blocks.withColumn("part", F.floor((F.col("number") * salts + F.col("salt")) / PART))
    there = blocks.select("place", "code", "part").distinct()  # a row for each PART blocks

    def ranked(pairs: DataFrame, name: str) -> DataFrame:
        met = scratch.put("met", _met(pairs, k + 1), BLOCKS)
        near = met.distinct().join(base.select("class_id", "ids"), "class_id").select("query", "score", F.explode("ids").alias("vec_id"))
        near = near.join(asked.select("query", F.col("id").alias("query_id")), "query").where("vec_id <> query_id")
        best = lambda hits: F.slice(F.array_sort(hits), 1, k)
        part = near.groupBy("query", "query_id", F.pmod("vec_id", F.lit(SALT)).alias("salt")).agg(best(F.collect_list(F.struct("score", "vec_id"))).alias("top"))
        found = scratch.put(name, part.groupBy("query", "query_id").agg(best(F.flatten(F.collect_list("top"))).alias("top")))
        scratch.drop("met")
        return found

    def of(rows: DataFrame, tables: int, probes: int, name: str) -> DataFrame:
        return scratch.put(name, _packed(_coded(rows.select(F.col("query").alias("id"), "v"), tables, probes, hashes), QUERY_BLOCK, "q"), VECTORS).drop("salt", "number")

    probing = of(asked, tables, probes, "probes").join(there, ["place", "code"])
    top = ranked(probing.join(blocks.hint("merge"), ["place", "code", "part"]), "top")
    short = asked.join(top.where(F.size("top") >= k).select("query"), "query", "left_anti")
    if short.limit(1).count():
        # every class lies in one block of table 0: those of the query's length are all searched, each part of them with its own copy of the queries
        left = of(short, 1, 1, "short").drop("code")
        every = ranked(left.join(there.hint("merge"), "place").join(blocks.hint("merge"), ["place", "code", "part"]), "every")
        top = top.where(F.size("top") >= k).unionByName(every)
    found = top.select("query_id", F.posexplode("top").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    result = written(found, "ann-nearest")
    scratch.clear()
    return result


def op9_ann(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op9_ann": op9_ann}

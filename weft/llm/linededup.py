"""Operator 6: later copies of repeated line runs, by a distributed suffix array over line ids.

A document is the sequence of its \\n-split lines. Suffixes are ranked by prefix doubling: rank 0
names lines in order of their 128-bit hashes, and rank k + 1 names pairs of ranks 2**k lines apart,
in order, so equal ranks at k are equal runs of 2**k lines. A suffix leaves the array as soon as its
rank is unique, which at the first round drops all lines that occur once; doubling ends when
no suffix is left or no run needs a longer prefix.

A run is compared by the longest-common-prefix interval at exactly its length: its two ranks of 2**k
lines that together span it. Within an interval the first run in order of (doc_id, line) stays; the
lines of all others are deleted. Compared are, from each line, the shortest run of at least
``min_words`` words and, with ``maximal``, the shortest such run that ends at each line. A line of a
maximal repeated run lies in the run's first shortest one or ends a shortest one inside it, so the union
is the maximal repeated runs; without ``maximal`` the last lines of one can stay. A document has at most
twice as many such runs as lines. Runs that lie in one line, or overlap their own copy, count too.

A null text stays null and an empty one empty. A document of which every line with a word is deleted gets an
empty text. Rows equal in id and text (null ids are equal) are one document:
each gets its result, and they are no copies of each other. Texts of any length are read whole. Other columns, of any names, pass
through; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, shuffle_parts, small_batches, table, written

MIN_WORDS = 50
AT = ["d", "h", "line"]


def with_key(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with d (the id, nulls first) and h (hash of the text): what tells documents apart."""
    return df.withColumn("d", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))).withColumn("h", F.xxhash64(F.col(text)))


def line_rows(keyed: DataFrame, text: str, min_words: int, maximal: bool = False) -> DataFrame:
    """Rows (d, h, line, a, b, need, most): 128-bit line hash, lines of the shortest run with min_words words (null: none).

    Runs of need to most lines are compared: most is need, or with maximal the longest that no later line could begin.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            ds, hs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = {n: [] for n in ("d", "h", "line", "a", "b", "need", "most")}
            for d, h, t in zip(ds, hs, batch.column(2).to_pylist()):
                if not t:
                    continue
                lines = t.encode("utf-8", "replace").split(b"\n")
                ends = np.cumsum([len(x.split()) for x in lines])
                starts = np.concatenate(([0], ends[:-1]))
                last = np.searchsorted(ends, starts + min_words)
                need = np.where(last < len(lines), last - np.arange(len(lines)) + 1, 0)
                # a run from here is the shortest one that ends at its last line, up to where the next line's shortest one ends
                until = np.maximum(last + 1, np.append(last[1:], len(lines))) if maximal else last + 1
                most = np.where(need > 0, until - np.arange(len(lines)), 0)
                hashes = [xxhash.xxh3_128_intdigest(x) for x in lines]
                out["d"] += [d] * len(lines)
                out["h"] += [h] * len(lines)
                out["line"] += range(len(lines))
                out["a"] += [(x >> 64) - (1 << 63) for x in hashes]
                out["b"] += [(x & (1 << 64) - 1) - (1 << 63) for x in hashes]
                out["need"] += [int(x) or None for x in need]
                out["most"] += [int(x) or None for x in most]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n in ("line", "need", "most") else pa.int64()) for n, v in out.items()], list(out))

    schema = "d long, h long, line int, a long, b long, need int, most int"
    return keyed.select("d", "h", text).mapInArrow(run, schema)


def _named(rows: DataFrame, keys: list[str], out: str, scratch: Scratch) -> DataFrame:
    """(keys..., out) of the keys that occur at least twice; ranks ascend with the keys, over all tasks."""
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ordered = repeated.repartitionByRange(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return scratch.put("names", ordered.withColumn(out, F.monotonically_increasing_id()))


def suffix_ranks(lines: DataFrame, scratch: Scratch):
    """For each k, yields rows (d, h, line, need, most, rank) of the suffixes whose first 2**k lines occur elsewhere too.

    A level is dropped when the next one is asked for. Rows equal in id and text wrote equal lines; each stays once.
    Joins are of two written tables, which lets Spark split a key that many lines share.
    """
    now = scratch.put("suffixes-0", lines.join(_named(lines, ["a", "b"], "rank", scratch).hint("merge"), ["a", "b"]).select(*AT, "need", "most", "rank").dropDuplicates(AT))
    scratch.drop("names")
    longest = now.agg(F.max("most")).first()[0] or 0
    k = 0
    while True:
        yield now
        if 2 ** (k + 1) > longest:
            return
        ahead = now.select("d", "h", (F.col("line") - 2**k).alias("line"), F.col("rank").alias("rank2"))
        pairs = scratch.put("pairs", now.join(ahead.hint("merge"), AT))
        names = _named(pairs, ["rank", "rank2"], "next", scratch)
        now = scratch.put(f"suffixes-{k + 1}", pairs.join(names.hint("merge"), ["rank", "rank2"]).select(*AT, "need", "most", F.col("next").alias("rank")))
        scratch.drop("pairs", "names", f"suffixes-{k}")
        k += 1
        if not now.limit(1).count():
            return


def later_runs(levels, scratch: Scratch) -> DataFrame:
    """Rows (d, h, line, need): runs of ``need`` lines that occur earlier, in order of (d, h, line)."""
    found = None
    for k, level in enumerate(levels):
        own = level.where((F.col("most") >= 2**k) & (F.col("need") < 2 ** (k + 1)))
        lengths = F.sequence(F.greatest("need", F.lit(2**k)), F.least("most", F.lit(2 ** (k + 1) - 1)))
        own = own.withColumn("need", F.explode(lengths))
        far = level.select("d", "h", F.col("line").alias("end"), F.col("rank").alias("rank2"))
        runs = own.withColumn("end", F.col("line") + F.col("need") - 2**k)
        runs = runs.withColumn("rank2", F.col("rank")) if k == 0 else runs.join(far.hint("merge"), ["d", "h", "end"])
        runs = scratch.put("runs", runs.select(*AT, "need", "rank", "rank2"))
        first = runs.groupBy("rank", "rank2", "need").agg(F.min(F.struct(*AT)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        first = scratch.put("first", first)
        later = runs.join(first.hint("merge"), ["rank", "rank2", "need"]).where(F.struct(*AT) != F.col("first")).select(*AT, "need")
        later = scratch.put("later", later)
        scratch.drop("runs", "first")
        found = later if found is None else found.unionByName(later)
    return found


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, maximal: bool = False) -> DataFrame:
    """df with the lines of later copies deleted from ``text``; n_lines and n_deleted (int) are added, or replaced.

    The registered query and the pipeline delete ``maximal`` runs.
    """
    df = df.drop("n_lines", "n_deleted")
    others = [c for c in df.columns if c not in (key, text)]
    packed = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(F.lit(0).alias("_0"), *others).alias("_row"))
    keyed = with_key(packed, "_key", "_text")
    scratch = Scratch(df.sparkSession, "lines")
    lines = scratch.put("lines", line_rows(keyed, "_text", min_words, maximal))
    runs = later_runs(suffix_ranks(lines, scratch), scratch)
    # a document's runs are bounded by its own lines
    marks = written(runs.groupBy("d", "h").agg(F.collect_set(F.struct("line", "need")).alias("_runs")), "line-marks")
    scratch.clear()
    # a merge join at every size: how many marks there are follows the corpus
    joined = keyed.join(marks.hint("merge"), ["d", "h"], "left").select("_key", "_text", "_row", "_runs")

    def run(batches):
        for batch in batches:
            texts, n_lines, n_deleted = [], [], []
            for t, runs_ in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                parts = t.split("\n") if t else []
                gone = 0
                if runs_:
                    edge = np.zeros(len(parts) + 1, np.int64)
                    for r in runs_:
                        edge[r["line"]] += 1
                        edge[r["line"] + r["need"]] -= 1
                    stays = np.cumsum(edge)[:-1] == 0
                    gone = int((~stays).sum())
                    left = [x for x, keep in zip(parts, stays) if keep]
                    t = "\n".join(left) if any(x.encode("utf-8", "replace").split() for x in left) else ""
                texts.append(t)
                n_lines.append(len(parts))
                n_deleted.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(n_lines, pa.int32()), pa.array(n_deleted, pa.int32())], ["_key", "_text", "_row", "n_lines", "n_deleted"])

    small_batches(df.sparkSession)
    fields = [*[f for f in joined.schema.fields if f.name != "_runs"], T.StructField("n_lines", T.IntegerType()), T.StructField("n_deleted", T.IntegerType())]
    done = joined.mapInArrow(run, T.StructType(fields))
    place = {key: "_key", text: "_text"}
    return done.select(*[F.col(place[c]).alias(c) if c in place else F.col("_row").getField(c).alias(c) for c in df.columns], "n_lines", "n_deleted")


def op6_linededup(spark, sf_dir):
    done = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), maximal=True)
    return done.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op6_linededup": op6_linededup}

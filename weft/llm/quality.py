"""Operator 2: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row keeps the measurements and one bit per
failed rule; policies are versioned masks over those bits, applied later without reading a text
again, and ablations are bitwise aggregates over the ledger.

Words are runs of anything but ASCII white space. A null text has no words and fails ``few_words``;
so does an empty one. Repeated documents get equal rows, an empty table gives an empty ledger. Texts of any length are measured
whole. Columns to keep must not be named as the ledger's own (ValueError); all others are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, WordHashes, runs_hash, small_batches, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_shout_words", "top_word", "n_stutter")

#: (name, test over a row of MEASURES); a rule's bit is its place here, so new rules go to the end.
RULES = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    ("upper_case", lambda m: 2 * m["n_upper_words"] > m["n_words"]),
    ("shouting", lambda m: 10 * m["n_shout_words"] > 3 * m["n_words"]),
    ("one_word", lambda m: m["n_words"] >= 20 and 100 * m["top_word"] > 25 * m["n_words"]),
    ("repeated_lines", lambda m: m["n_lines"] >= 4 and 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    ("stutter", lambda m: m["n_words"] >= 20 and 100 * m["n_stutter"] > 30 * m["n_words"]),
    ("word_length", lambda m: m["n_words"] > 0 and not 2 * m["n_words"] <= m["word_chars"] <= 25 * m["n_words"]),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


#: Versions of the policy: the rules that reject a document.
POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask(*BITS),
}


def measure(text: str | None, hashes: WordHashes) -> dict[str, int]:
    """The MEASURES of one whole text."""
    if not text:
        return dict.fromkeys(MEASURES, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    found = {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": 0,
        "n_lines": len(lines),
        "n_upper_words": sum(map(bytes.isupper, words)),
        "n_shout_words": sum(w.endswith(b"!!") for w in words) if "!!" in text else 0,
        "top_word": max(Counter(words).values(), default=0),
        "n_stutter": 0,
    }
    if len(words) > WINDOW:
        hashed = hashes.of(words)
        found["n_stutter"] = int((hashed[1:] == hashed[:-1]).sum())
        windows = runs_hash(hashed, WINDOW)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            again = np.zeros(len(windows), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            edge[at] += 1
            edge[at + WINDOW] -= 1
            found["n_repeat_words"] = int((np.cumsum(edge)[:-1] > 0).sum())
    return found


def failed_bits(m: dict[str, int]) -> int:
    return sum(BITS[name] for name, test in RULES if test(m))


_HASHES = WordHashes()


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, measurements, fail_bits long), plus the columns ``keep`` of df."""
    kept = [key, *keep]
    if clash := {*kept} & {*MEASURES, "fail_bits"}:
        raise ValueError(f"columns named as the ledger's own: {sorted(clash)}")

    def run(batches):
        for batch in batches:
            rows = [measure(t, _HASHES) for t in batch.column(len(kept)).to_pylist()]
            _HASHES.trim()
            columns = [pa.array([r[n] for r in rows], pa.int64()) for n in MEASURES]
            bits = pa.array(map(failed_bits, rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns, bits], [*kept, *MEASURES, "fail_bits"])

    small_batches(df.sparkSession)
    fields = [*[df.schema[k] for k in kept], *[T.StructField(n, T.LongType()) for n in (*MEASURES, "fail_bits")]]
    return df.select(*kept, F.col(text).alias("_text")).mapInArrow(run, T.StructType(fields))


def with_policy(rows: DataFrame, version: str = "v1", out: str = "kept") -> DataFrame:
    """Ledger rows with ``out``: no bit of the version's mask is set."""
    return rows.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a version: documents that fail it, that fail it alone, and all kept without it."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]))
    rules = [(n, b) for n, b in BITS.items() if b & POLICIES[version]]
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(bits.bitwiseAND(F.lit(b)) != 0).alias(f"f_{n}") for n, b in rules],
        *[F.count_if(bits == b).alias(f"o_{n}") for n, b in rules],
        *[F.count_if(bits.bitwiseAND(F.lit(~b)) == 0).alias(f"k_{n}") for n, b in rules],
    )
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_failed_alone"), F.col(f"k_{n}").alias("n_kept_without"), "n_docs") for n, _ in rules])))


def op2_quality(spark, sf_dir):
    rows = with_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "fail_bits")


QUERIES = {"op2_quality": op2_quality}

#: Windows are numbered by their first word, from 1.
ORACLE_SQL = {
    "op2_quality": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n
  FROM (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM docs))
), repeated AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM windows WHERE n > 1) GROUP BY rid
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper, len(list_filter(words, lambda x: x LIKE '%!!')) AS n_shout,
    coalesce(list_max(map_values(list_aggregate(words, 'histogram'))), 0) AS top_word, len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter
  FROM docs LEFT JOIN repeated USING (rid)
), judged AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (2 * n_upper > n_words)::BIGINT + 16 * (10 * n_shout > 3 * n_words)::BIGINT + 32 * (n_words >= 20 AND 100 * top_word > 25 * n_words)::BIGINT
    + 64 * (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 128 * (n_words >= 20 AND 100 * n_stutter > 30 * n_words)::BIGINT
    + 256 * (n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 25 * n_words)::BIGINT AS fail_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM judged
""",
}

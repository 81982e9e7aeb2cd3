"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``; where a
stage changes texts, n_chars is counted anew.

Every stage reads whole texts. Other columns, of any names, pass through all stages but the last. An empty table gives an
empty one. A null text has no words, so the first stage rejects it; a null doc_id stands before all others. Rows equal in
doc_id and text are one document: quality and line dedup give each the same result, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.llm import jaccard, linededup, packing, pii, quality, tokenfile
from weft.llm.common import Scratch, table, written


def _packed(docs):
    """Id, text and the whole row, so that no column clashes with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def _unpacked(done, columns):
    """The rows with the texts as they are now."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the current policy; rejected ones go."""
    rows = quality.ledger(_packed(docs), keep=("row",))
    return quality.with_policy(rows).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(spark, docs, sf_dir):
    """Later copies of line runs of 50 words or more are deleted; a document with no word left through that goes."""
    done = linededup.dedup(_packed(docs), maximal=True)
    return _unpacked(done.where((F.col("n_deleted") == 0) | (F.col("text") != "")), docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document stays of each group linked by 5-word shingles at similarity 0.8 or more: the smallest doc_id."""
    return jaccard.without_near_copies(docs, 5, 80, 100)


def personal_data(spark, docs, sf_dir):
    """Personal data is replaced by <EMAIL>, <IP>, <CARD> and <PHONE>."""
    return _unpacked(pii.find(_packed(docs), pii.trained(), mask=True), docs.columns)


def length_buckets(spark, docs, sf_dir):
    """Every document's bucket and batch: (doc_id, n_tokens, bucket, padded_to, batch_id, place)."""
    return packing.pack(written(packing.token_lengths(docs.select("doc_id", "text")), "packing-lengths", tokenfile.ENCODED_ROWS))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("length_buckets", length_buckets),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch, docs = Scratch(spark, "stages"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(f"{k}", stage(spark, docs, sf_dir))
        scratch.drop(f"{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

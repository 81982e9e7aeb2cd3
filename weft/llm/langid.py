"""Operator 5: language identification with a blended-spectrum string kernel.

Two texts' kernel is the number of character n-grams (all lengths of ``SPECTRUM``, hashed) that both
hold, divided by the root of the product of their numbers of n-grams. Nyström landmarks drawn from
the training sample give each text a vector; one-versus-rest kernel ridge regression is fitted on
those vectors. As the kernel is linear in the presence vector, landmarks, whitening and regression
fold into one matrix (n-gram bins x languages), and a block of texts is scored by the product of its presence
matrix with that matrix. With more languages than
landmarks the matrix stays two factors, (bins x landmarks) and (landmarks x languages).

The classifier is fitted on every label value, on a bounded sample of its rows (``SAMPLE`` per language and ``SAMPLE_ALL`` in
all, but two of each language at least, by hash order of the id, so it doesn't depend on partitions); prediction reads whole texts. A text that is
null or has no letter is ``und`` with score 0. Repeated rows get equal predictions, an empty table gives an empty one; equal scores
go to the first label in order. Texts of any length are read whole. With no labelled
row at all, every text is ``und``. Columns to keep must not be named ``lang_pred`` or ``score`` (ValueError).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

SPECTRUM = (1, 2, 3, 4)
BINS = 1 << 16
#: Bounds of the fitted sample: rows per language, rows in all, landmarks. Sampled texts are whole.
SAMPLE, SAMPLE_ALL, LANDMARKS = 150, 1200, 256
RIDGE = 1e-2


def bins_of(text: str) -> np.ndarray:
    """The distinct hashed n-gram bins present in a whole text, letters in lower case, ASCII spaces merged."""
    codes = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    present = np.zeros(BINS, bool)
    gram = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SPECTRUM) + 1):
            if n > len(codes):
                break
            gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in SPECTRUM:
                h = (gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                present[(h >> np.uint64(48)).astype(np.int64)] = True
    return np.flatnonzero(present)


class Model:
    """Languages and the folded matrix (BINS x languages), or with ``right`` its factors (BINS x landmarks, landmarks x languages)."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, right: np.ndarray | None = None):
        self.languages, self.weights, self.bias, self.right = languages, weights, bias, right

    def scores(self, texts: list[str], block: int = 64) -> np.ndarray:
        """Rows of decision values: products of the presence matrices of ``block`` texts with the model's."""
        out = np.zeros((len(texts), self.weights.shape[1]), np.float32)
        present = np.zeros((min(block, len(texts)), BINS), np.float32)
        for at in range(0, len(texts), block):
            bins = [bins_of(t) for t in texts[at : at + block]]
            where = np.repeat(np.arange(len(bins)), [len(b) for b in bins]), np.concatenate(bins)
            present[where] = 1
            out[at : at + block] = present[: len(bins)] @ self.weights
            present[where] = 0
            out[at : at + block] /= np.sqrt([[max(1, len(b))] for b in bins])
        return (out if self.right is None else out @ self.right) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, values = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            scores = self.scores([texts[i] for i in known])
            best = scores.argmax(axis=1)
            # decision values of one-versus-rest regression on 0/1 targets
            for i, k, s in zip(known, best, scores[np.arange(len(known)), best]):
                names[i], values[i] = self.languages[k], float(min(1.0, max(0.0, s)))
        return names, values


def fit(texts: list[str], langs: list[str]) -> Model:
    """Nyström features and one-versus-rest kernel ridge regression on a bounded sample."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros(0, np.float32))
    bins = [bins_of(t) for t in texts]

    def dense(chosen) -> np.ndarray:
        rows = np.zeros((len(chosen), BINS), np.float32)
        for i, k in enumerate(chosen):
            if len(bins[k]):
                rows[i, bins[k]] = 1 / np.sqrt(len(bins[k]))
        return rows

    # landmarks: an equal share of every language, in the sample's order
    place, seen = [], {}
    for i, lang in enumerate(langs):
        seen[lang] = seen.get(lang, 0) + 1
        place.append((seen[lang], i))
    chosen = [i for _, i in sorted(place)[:LANDMARKS]]
    marks = dense(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    blocks = [range(i, min(i + SAMPLE_ALL, len(texts))) for i in range(0, len(texts), SAMPLE_ALL)]
    features = np.concatenate([(dense(b) @ marks.T).astype(np.float64) @ whiten for b in blocks])
    number = {name: k for k, name in enumerate(languages)}
    label = np.array([number[x] for x in langs])
    weight = len(langs) / (np.bincount(label) * len(languages))[label]  # languages count equally
    mean = np.bincount(label, weight) / weight.sum()
    centre = (weight[:, None] * features).sum(axis=0) / weight.sum()
    x = features - centre
    weighted = weight[:, None] * x
    sums = np.zeros((len(languages), x.shape[1]))
    np.add.at(sums, label, weighted)  # the product with the 0/1 targets
    solved = np.linalg.solve(x.T @ weighted + RIDGE * np.eye(x.shape[1]), sums.T - np.outer(weighted.sum(axis=0), mean))
    right, bias = whiten @ solved, (mean - centre @ solved).astype(np.float32)
    if len(languages) > LANDMARKS:
        return Model(languages, np.ascontiguousarray(marks.T), bias, right.astype(np.float32))
    return Model(languages, (marks.T @ right).astype(np.float32), bias)


def sample(df: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], list[str]]:
    """A bounded number of labelled rows of each language, by hash order of their ids."""
    counts = df.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    languages = counts.count()
    most = min(SAMPLE, max(2, SAMPLE_ALL // max(1, languages)))
    rows = df.where(F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(key).alias("_key"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    # a hash threshold thins a language to about four times the need before the sort
    share = F.when(F.col("_n") > 8 * most, F.floor(F.lit((1 << 20) * 4 * most) / F.col("_n"))).otherwise(1 << 20)
    # the model holds every label too, so the counts fit where it fits
    thinned = rows.join(F.broadcast(counts), "_lang").where(F.pmod("h", F.lit(1 << 20)) < share)
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("h", "_key", "t"))
    found = sorted((r["_lang"], r["place"], r["t"]) for r in thinned.withColumn("place", place).where(F.col("place") <= most).select("_lang", "place", "t").collect())
    return [t for _, _, t in found], [x for x, _, _ in found]


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep..., lang_pred string, score double) for every row of df."""
    spark = df.sparkSession
    if clash := {*keep} & {"lang_pred", "score"}:
        raise ValueError(f"columns named as the prediction's own: {sorted(clash)}")
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.bias, model.right))  # BINS x 256 at most, and 256 floats a language

    def run(batches):
        scorer = Model(*shared.value)
        for batch in batches:
            names, values = scorer.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(values, pa.float64())], [*keep, "lang_pred", "score"])

    small_batches(spark)
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def op5_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    texts, langs = sample(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return predict(docs, fit(texts, langs), keep=("doc_id", "held_out"))


QUERIES = {"op5_langid": op5_langid}

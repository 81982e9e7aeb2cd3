"""Operator 8: optimal length buckets and token-budget batches.

The global histogram of lengths is gathered, a row per distinct length: n distinct lengths take at least
n * n / 2 tokens in all, so 10 billion tokens have 141,000 at most. Dynamic programming over it chooses
at most ``buckets`` boundaries with the least padding. A bucket's
documents are numbered in order of their key across all tasks and cut into batches whose padded size
stays within the token budget; a document longer than the budget is a batch of its own.

Every row gets a bucket and a batch: nothing is cut or dropped. Null and empty texts have length 0
and go to the first bucket; equal keys are ordered by length, and equal rows are interchangeable. An
empty table gives an empty result.

Lengths are counted by column: texts are split and their distinct words cut into letters and the marks after them
by Arrow, and the library sees only letters, marks and other words whose numbers of ids are not remembered.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_parts, small_batches, table, written
from .tokenfile import ENCODED_ROWS, vocabulary_path, word_encoder

BUCKETS, BUDGET = 16, 1 << 15
#: Letters in the forms of words. Arrow trims by bytes: all of these but ASCII are C3 and one more in UTF-8, so letters stay whole.
LETTERS = "abcdefghijklmnopqrstuvwxyzÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: What may end a word; an apostrophe may not, as it joins the letters after it.
MARKS = ".,;:!?%$#*&|<>()[]{}\"-_/+=~^@\\`"
FORM = re.compile(f"[A-Z{LETTERS}]*[{re.escape(MARKS)}]*")
#: A vocabulary of these steps takes letters in lower case as they are, so only its last step and its model are needed for them.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class LengthCounter:
    """Numbers of ids of whole texts, as operator 3 writes them, for vocabularies that drop white space.

    If the vocabulary lowers A to Z and parts letters from marks after them, a word of letters and marks counts as
    its letters in lower case and its marks, all others as they are. At most 2 * ``most`` numbers are remembered for
    such pieces, between batches: when the younger half is full, the elder one goes.
    """

    def __init__(self, path: str, most: int = 500_000):
        import tokenizers

        self.encoder, self.most = word_encoder(path), most
        self.known: dict[str, int] = {}
        self.elder: dict[str, int] = {}
        library = self.encoder.library
        added = [t.content for t in library.get_added_tokens_decoder().values()]
        words = ["the", "élan", "straße", "ñandú", "ÿþøæ"]
        forms = [(w, m) for w in words for m in (*MARKS, MARKS, "!!", ".%%%", "?,***", "<|>")]
        apart = self._learnt([*words, *MARKS, *{m for _, m in forms}])
        whole = self._learnt([w.capitalize() + m for w, m in forms])
        self.by_form = self.encoder.by_form and not any(map(FORM.fullmatch, added)) and all(whole[w.capitalize() + m] == apart[w] + apart[m] for w, m in forms)
        said = json.loads(library.to_str())
        model, suffix = said["model"], said["model"].get("end_of_word_suffix")
        vocabulary = model.get("vocab") or {}
        alphabet = tokenizers.pre_tokenizers.ByteLevel.alphabet()
        known_steps = {k: said[k] for k in STEPS} == STEPS and not said["post_processor"] and model["type"] == "BPE" and suffix
        self.letters = self.ends = None
        if self.by_form and known_steps and not model["dropout"] and not model["continuing_subword_prefix"] and all(c in vocabulary and c + suffix in vocabulary for c in alphabet):
            self.letters = tokenizers.Tokenizer.from_str(library.to_str())
            self.letters.normalizer = tokenizers.normalizers.Sequence([])
            split = tokenizers.pre_tokenizers
            self.letters.pre_tokenizer = split.Sequence([split.WhitespaceSplit(), split.ByteLevel(add_prefix_space=False, use_regex=False)])
            # a piece's last id, and no other, is that of a token with the suffix
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    def _learnt(self, new: list[str]) -> dict[str, int]:
        """Numbers of ids by the whole library."""
        words = {w: w.encode() for w in new}
        self.encoder._learn([*words.values()])
        return {w: len(self.encoder.known.pop(b)) // 4 for w, b in words.items()}

    def _learn(self, new: list[str], group: int = 1024) -> None:
        if self.letters is not None:
            plain = [w for w in new if w.isalpha() and w.islower() and FORM.fullmatch(w)]
            groups = [plain[i : i + group] for i in range(0, len(plain), group)]
            for g, e in zip(groups, self.letters.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ends = np.flatnonzero(self.ends[e.ids])
                self.known.update(zip(g, np.diff(ends, prepend=-1).tolist(), strict=True))
            new = [w for w in new if w not in self.known]
        self.known.update(self._learnt(new))

    def _of(self, pieces: list[str]) -> np.ndarray:
        """Numbers of ids of distinct pieces."""
        known, elder = self.known, self.elder
        found = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = []
            for w in map(pieces.__getitem__, missing):
                n = elder.get(w)
                if n is None:
                    new.append(w)
                else:
                    known[w] = n
            self._learn(new)
            found[missing] = [known[pieces[i]] for i in missing]
        return found

    def _of_each(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        return self._of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text; a null text has none."""
        if len(self.known) > self.most:
            self.known, self.elder = {}, self.known
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        if self.by_form:
            low = pc.ascii_lower(words)
            letters, marks = pc.ascii_rtrim(low, MARKS), pc.ascii_ltrim(low, LETTERS)
            parted = pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(low))
            each = self._of_each(pc.if_else(parted, letters, words)) + self._of_each(pc.if_else(parted, marks, ""))
        else:
            each = self._of_each(words)
        upto = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()])))
        at = split.offsets.to_numpy()
        return np.diff(upto[at - at[0]])


_COUNTERS: dict[str, LengthCounter] = {}


def length_counter(path: str) -> LengthCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = LengthCounter(path)
    return _COUNTERS[path]


def token_lengths(df: DataFrame, path: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df without its text column and with the number of ids that operator 3 writes for the text, end id aside."""
    path = path or vocabulary_path()
    kept = [f for f in df.schema.fields if f.name not in (text, out)]

    def run(batches):
        counter = length_counter(path)
        for batch in batches:
            counts = counter.count(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64())], [*[f.name for f in kept], out])

    small_batches(df.sparkSession)
    return df.select(*[f.name for f in kept], F.col(text).alias("_text")).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType())]))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Boundaries (ascending, each a length that occurs) of at most ``buckets`` buckets with the least padding, and that padding.

    best[k][j], the least padding of the first j lengths in k buckets, is found by divide and conquer:
    the cost of a bucket satisfies the quadrangle inequality, so the best cuts never cross.
    """
    n = len(lengths)
    if not n:
        return [], 0
    order = np.argsort(lengths)
    x, c = np.asarray(lengths)[order].astype(np.float64), np.asarray(counts)[order].astype(np.float64)
    docs, tokens = np.concatenate(([0.0], np.cumsum(c))), np.concatenate(([0.0], np.cumsum(c * x)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        after, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        after[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            cost = best[i] + x[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])
            k = int(cost.argmin())
            after[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, left, int(i[k])), (j + 1, hi, int(i[k]), right)]
        best = after
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        if j:
            found.append(int(x[j - 1]))
            j = int(cut[j])
    return found[::-1], int(best[n])


def pack(df: DataFrame, length: str = "n_tokens", key: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """df with bucket int, padded_to long, batch_id long and place int; batches are numbered through all buckets."""
    spark = df.sparkSession
    df = df.drop("bucket", "padded_to", "batch_id", "place")
    histogram = df.groupBy(F.coalesce(F.col(length), F.lit(0).cast("long")).alias("length")).count().collect()
    bounds, _ = boundaries(np.array([r["length"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets)
    if not bounds:
        bounds = [0]
    size = F.coalesce(F.col(length), F.lit(0).cast("long"))
    bucket = sum((F.when(size > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    rows = df.withColumn("bucket", bucket.cast("int"))
    # ordered by range over all tasks, so a bucket that holds a third of the rows lies in many of them
    ranged = rows.repartitionByRange(shuffle_parts(spark), "bucket", key, length).sortWithinPartitions("bucket", key, length)
    placed = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "packing-rows").withColumn("_task", F.shiftright("_row", 33))
    before = Window.partitionBy("bucket").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("bucket", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row per task and bucket
    per = F.element_at(F.array(*[F.lit(max(1, budget // max(1, b))).cast("long") for b in bounds]), F.col("bucket") + 1)
    counts = {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("_n").alias("n")).collect()}
    first, at = [], 0
    for i, b in enumerate(bounds):
        first.append(at)
        at += -(-counts.get(i, 0) // max(1, budget // max(1, b)))
    start = F.element_at(F.array(*[F.lit(f).cast("long") for f in first]), F.col("bucket") + 1)
    padded = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1)
    number = F.col("_row") - F.col("_first") + F.col("_before")
    return (
        placed.join(parts.drop("_n"), ["bucket", "_task"])
        .withColumn("padded_to", padded)
        .withColumn("batch_id", start + F.floor(number / per).cast("long"))
        .withColumn("place", (number % per).cast("int"))
        .select(*df.columns, "bucket", "padded_to", "batch_id", "place")
    )


def op8_packing(spark, sf_dir):
    lengths = written(token_lengths(table(spark, sf_dir, "documents").select("doc_id", "text")), "packing-lengths", ENCODED_ROWS)
    return pack(lengths)


QUERIES = {"op8_packing": op8_packing}

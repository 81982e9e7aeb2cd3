"""Operator 3: token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order. Its frames are independent zstandard frames of
little-endian unsigned 32-bit ids; then comes one skippable frame (any zstandard reader passes over
it) with, per frame, compressed and raw size and crc32 of the raw bytes, and per document the number
of ids; last, a fixed footer with counts and the index's own crc32. A reader takes the
footer, the index and then only the frames that hold the documents asked for.

Documents are dealt to files by ranges of (doc_id, text hash, text), so equal ids are ordered by text and a
file never holds all of them; a null text is an empty one, a null doc_id comes first. Each task
writes a file of its own name, and only files that a finished task reported are listed in the
manifest, so a lost executor or a second attempt leaves no wrong document behind. A text of any length is encoded whole and may
span frames; an empty table writes no file. Columns but key and text are not read; the key must not be named as a column
of the results (ValueError).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, shuffle_parts, table, written

MAGIC = b"WFTSEEK1"
SKIPPABLE = 0x184D2A50
FRAME_IDS = 1 << 17
FOOTER = struct.Struct("<QQQI8s")  # frames, documents, index bytes, crc32 of the index, magic
END_ID = 1
#: Texts of an Arrow batch: a word is looked for once in each.
ENCODED_ROWS = 1024
#: A word of Latin letters whose lower case is one letter each, and the marks at its end.
FORM = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$#*]*)")


# --- files ---------------------------------------------------------------------------------------


def open_store(path: str):
    """(pyarrow file system, path in it) of a path with any scheme that pyarrow has a file system for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes documents' ids to an open binary file; holds one frame in memory."""

    def __init__(self, sink, level: int = 1, frame_ids: int = FRAME_IDS):
        import zstandard

        self.sink, self.frame_ids = sink, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        if self.n_waiting:
            raw = np.concatenate(self.waiting).astype("<u4").tobytes()
            for at in range(0, len(raw), 4 * self.frame_ids):  # a very long document spans frames
                part = raw[at : at + 4 * self.frame_ids]
                packed = self.packer.compress(part)
                self.sink.write(packed)
                self.frames.append((len(packed), len(part), zlib.crc32(part)))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        self._flush()
        index = np.array(self.frames, "<u8").reshape(-1, 3).tobytes() + np.array(self.lengths, "<u8").tobytes()
        footer = FOOTER.pack(len(self.frames), len(self.lengths), len(index), zlib.crc32(index), MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(index) + len(footer)) + index + footer)


class FrameReader:
    """Reads documents of one file by their place in it; unpacks only the frames they touch."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(end - FOOTER.size)
        n_frames, n_docs, n_index, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no seek table")
        source.seek(end - FOOTER.size - n_index)
        index = source.read(n_index)
        if zlib.crc32(index) != crc:
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(index, "<u8", 3 * n_frames).reshape(-1, 3).astype(np.int64)
        self.ends = np.cumsum(np.frombuffer(index, "<u8", n_docs, 24 * n_frames).astype(np.int64))
        self.packed_at = np.concatenate(([0], np.cumsum(self.frames[:, 0])))
        self.ids_at = np.concatenate(([0], np.cumsum(self.frames[:, 1] // 4)))
        self.kept = (-1, np.empty(0, "<u4"))

    def __len__(self) -> int:
        return len(self.ends)

    def _frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            size, raw_size, crc = map(int, self.frames[k])
            self.source.seek(int(self.packed_at[k]))
            raw = self.unpacker.decompress(self.source.read(size), max_output_size=raw_size)
            if zlib.crc32(raw) != crc:
                raise ValueError(f"damaged frame {k}")
            self.kept = (k, np.frombuffer(raw, "<u4"))
        return self.kept[1]

    def document(self, place: int) -> np.ndarray:
        first, last = (int(self.ends[place - 1]) if place else 0), int(self.ends[place])
        if first == last:
            return np.empty(0, "<u4")
        k = int(np.searchsorted(self.ids_at, first, "right")) - 1
        parts = []
        while first < last:
            upto = min(last, int(self.ids_at[k + 1]))
            parts.append(self._frame(k)[first - int(self.ids_at[k]) : upto - int(self.ids_at[k])])
            first, k = upto, k + 1
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


# --- encoding ------------------------------------------------------------------------------------


class WordEncoder:
    """The tokenizers library over whole texts, for vocabularies that drop white space.

    There, ids of a text are those of its pieces between ASCII white space one after the other, so
    each piece is encoded by the library and remembered. New pieces go to it many at a time,
    parted by a special token, which it takes as the end of one text and the beginning of the next.
    If the vocabulary lowers A to Z and parts a last mark from letters, forms of a word share what is learnt for it.
    At most 2 * ``most`` pieces are remembered: when the younger half is full, the elder one goes.
    """

    def __init__(self, path: str, most: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        sample = [w for w in self.library.get_vocab(with_added_tokens=False) if w.isalpha()][:50]
        blanks = "".join(f" {a}\t{b}\n\n {a}" for a, b in zip(sample, sample[1:]))
        pieces = [i for w in blanks.split() for i in self.library.encode(w, add_special_tokens=False).ids]
        if self.library.encode(blanks, add_special_tokens=False).ids != pieces:
            raise ValueError("this vocabulary doesn't drop white space")
        parting = [(i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.special = tuple(content.encode() for _, content in parting)
        self.may_be_special = re.compile(b"|".join({re.escape(s[:1]) for s in self.special}) or b"(?!)").search
        self.parting = max(parting, default=None)
        self.known: dict[bytes, bytes] = {}
        self.elder: dict[bytes, bytes] = {}
        self.most = most
        marks = {m: self._one(m.encode()) for m in (*".,;:!?%$#*", ".%%%", "!!", "?,***")}
        plain = [w for w in (*sample, "élan", "straße", "ñandú") if FORM.fullmatch(w)]
        self.by_form = all(self._one((w.capitalize() + m).encode()) == self._one(w.lower().encode()) + ids for w in plain for m, ids in marks.items())

    def _one(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _by_form(self, new: list[bytes]) -> None:
        """Learns a word with capitals or marks at its end from its letters in lower case and the marks."""
        forms, rest = [], set()
        for w in new:
            if w.isalpha() and w.islower():
                rest.add(w)
                continue
            found = FORM.fullmatch(w.decode())
            lower = found[1].lower().encode() if found else w
            if lower == w:
                rest.add(w)
            else:
                marks = found[2].encode()
                forms.append((w, lower, marks))
                rest.add(lower)
                rest.add(marks)
        rest.discard(b"")
        known, elder, new = self.known, self.elder, []
        for w in rest.difference(known):
            ids = elder.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        self._learn(new)
        for w, lower, marks in forms:
            known[w] = known[lower] + known[marks] if marks else known[lower]

    def _learn(self, new: list[bytes], group: int = 256) -> None:
        if self.parting is None:
            self.known.update((w, self._one(w)) for w in new)
            return
        # a piece that holds a special token itself goes alone
        alone = [w for w in new if self.may_be_special(w) and any(s in w for s in self.special)]
        if alone:
            self.known.update((w, self._one(w)) for w in alone)
            new = [w for w in new if w not in self.known]
        number, content = self.parting
        groups = [new[i : i + group] for i in range(0, len(new), group)]
        texts = [content.encode().join(g).decode() for g in groups]
        for g, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == number).tolist()
            raw, at = ids.tobytes(), 0
            for word, end in zip(g, [*ends, len(ids)]):
                self.known[word] = raw[4 * at : 4 * end]
                at = end + 1

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        if len(self.known) > self.most:
            self.known, self.elder = {}, self.known
        known, elder = self.known, self.elder
        new = []
        for word in {w for words in split for w in words}.difference(known):
            ids = elder.get(word)
            if ids is None:
                new.append(word)
            else:
                known[word] = ids
        (self._by_form if self.by_form else self._learn)(new)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- operators -----------------------------------------------------------------------------------


def write_files(df: DataFrame, folder: str, path: str | None = None, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Writes df's ids to files in ``folder`` in ascending order of ``key``.

    Returns the manifest: (file_no int, place long, key, file string), one row per document, as a
    written table. ``files`` is the number of files (default: Spark's shuffle partitions).
    """
    path = path or vocabulary_path()
    spark = df.sparkSession
    if key in ("file_no", "place", "file", "n_tokens", "ids_crc32", "start", "ids"):
        raise ValueError(f"a key named as a column of the manifest or of what is read back: {key}")
    files = files or shuffle_parts(spark)
    schema = T.StructType([T.StructField("file_no", T.IntegerType()), T.StructField("place", T.LongType()), df.schema[key], T.StructField("file", T.StringType())])

    def run(batches):
        from pyspark import TaskContext

        encoder, number = word_encoder(path), TaskContext.get().partitionId()
        name = f"{folder}/ids-{number:06d}-{uuid.uuid4().hex}.zst"
        store = sink = writer = None
        place = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if writer is None:
                store, at = open_store(name)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                sink = store.open_output_stream(at, compression=None)
                writer = FrameWriter(sink)
            for ids in encoder.encode_batch(batch.column(1).to_pylist()):
                writer.add(np.append(ids, np.uint32(END_ID)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), batch.column(0), pa.array([name] * n)], schema.names)
            place += n
        if writer is not None:
            writer.close()
            sink.close()

    ranged = df.select(key, text).repartitionByRange(files, F.col(key), F.xxhash64(F.coalesce(text, F.lit("")))).sortWithinPartitions(F.col(key), F.xxhash64(F.coalesce(text, F.lit(""))), F.col(text))
    return written(ranged.mapInArrow(run, schema), "token-manifest", ENCODED_ROWS)


def read_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (file_no, place, key, n_tokens, ids_crc32) read back from the files that a manifest lists.

    A manifest cut down to some documents reads only those documents' frames.
    """

    def run(frames):
        reader, opened = None, None
        for frame in frames:
            counts, sums = [], []
            for name, place in zip(frame.column(3).to_pylist(), frame.column(1).to_pylist()):
                if name != opened:
                    store, at = open_store(name)
                    reader, opened = FrameReader(store.open_input_file(at)), name
                ids = reader.document(place)
                counts.append(len(ids))
                sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["file_no", "place", key, "n_tokens", "ids_crc32"])

    schema = T.StructType([*[manifest.schema[c] for c in ("file_no", "place", key)], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return manifest.select("file_no", "place", key, "file").mapInArrow(run, schema)


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, ids array<long>) of the documents that a manifest lists."""

    def run(frames):
        reader, opened = None, None
        for frame in frames:
            found = []
            for name, place in zip(frame.column(1).to_pylist(), frame.column(2).to_pylist()):
                if name != opened:
                    store, at = open_store(name)
                    reader, opened = FrameReader(store.open_input_file(at)), name
                found.append(reader.document(place).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(found, pa.list_(pa.int64()))], [key, "ids"])

    schema = T.StructType([manifest.schema[key], T.StructField("ids", T.ArrayType(T.LongType()))])
    return manifest.select(key, "file", "place").mapInArrow(run, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before each one, over all files in order.

    Totals are summed per file first, so one task sees a row per file only; within a file the sum
    runs over that file's rows. Files hold ranges of the key, so neither is a hot group.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("_total")).select("file_no", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals, "file_no").withColumn("start", F.col("_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("_base")


def op3_tokenfile(spark, sf_dir):
    manifest = write_files(table(spark, sf_dir, "documents"), fresh_path(spark, "token-files"))
    rows = with_starts(written(read_files(manifest), "token-rows"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op3_tokenfile": op3_tokenfile}

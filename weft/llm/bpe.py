"""Operator 1: byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pretoken exactly one vocabulary token can end its encoding. An automaton of the
vocabulary reads the pretoken once; its state is the longest suffix of the prefix that begins a token, and
its suffix links lead to all tokens that end there. Of these the one that is compatible with the
last token of the prefix before it is stored. Following the stored tokens back from the end emits
the ids, in time linear in the text, however long a pretoken is.

Two neighbouring tokens are compatible if no merge joins a part on the left token's right edge to a
part on the right token's left edge before the merges that swallow those parts.

Nulls and empty texts have no ids, and decode to an empty text. Texts of any length are encoded whole. Rows are
independent: equal rows get equal results, an empty table gives an empty one. Other columns of any name pass through
``encode`` and ``decode``, which replace a column of the name they write; ``digests`` returns the key and its own columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

#: The split of text before the merges (fixed by the vocabulary file's pre-tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 62
#: White space before a space: there a run of white space may go on, elsewhere a pretoken begins at each space.
RUN = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Automaton:
    """Reads letters one by one; the state stands for the longest suffix read that begins a piece.

    ``ends[state]`` lists (length, value) of the pieces that end here, longest first: its own and those of its suffix link.
    """

    def __init__(self, pieces: dict[str, int]):
        self.after: list[dict[str, int]] = [{}]
        own: list[int | None] = [None]
        depth = [0]
        for piece, value in pieces.items():
            node = 0
            for c in piece:
                if c not in self.after[node]:
                    self.after[node][c] = len(self.after)
                    self.after.append({})
                    own.append(None)
                    depth.append(depth[node] + 1)
                node = self.after[node][c]
            own[node] = value
        self.suffix = [0] * len(self.after)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.after)
        queue = list(self.after[0].values())
        for node in queue:
            self.ends[node] = (() if own[node] is None else ((depth[node], own[node]),)) + self.ends[self.suffix[node]]
            for c, child in self.after[node].items():
                at = self.suffix[node]
                while at and c not in self.after[at]:
                    at = self.suffix[at]
                self.suffix[child] = self.after[at].get(c, 0)
                queue.append(child)
        self.known = [dict(x) for x in self.after]  # and the steps by suffix links that were taken

    def step(self, node: int, c: str) -> int:
        found = self.known[node].get(c)
        if found is None:
            at = node
            while at and c not in self.after[at]:
                at = self.suffix[at]
            found = self.known[node][c] = self.after[at].get(c, 0)
        return found


class Codec:
    """Encoder and decoder of one vocabulary file. Remembers pretokens, at most ``most`` of them."""

    def __init__(self, path: str, most: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.pieces: dict[int, bytes] = {i: raw[token] for token, i in spec["model"]["vocab"].items()}
        ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        self.merges: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = ids[raw[left]], ids[raw[right]]
            self.merges[a, b] = rank
            parts.setdefault(ids[raw[left] + raw[right]], (a, b, rank))
        # edges[side][token]: the parts on that edge from the single byte up, each with the rank that swallows it
        self.edges = ({}, {})
        for token in self.pieces:
            for side in (0, 1):
                chain_up, at, gone = [], token, NEVER
                while True:
                    chain_up.append((at, gone))
                    if at not in parts:
                        break
                    gone, at = parts[at][2], parts[at][side]
                self.edges[side][token] = chain_up[::-1]
        # a token that the merges can't make of its own bytes never ends a prefix
        self.automaton = Automaton({piece.decode("latin-1"): i for piece, i in ids.items() if len(piece) == 1 or i in parts})
        self.pattern = regex.compile(PATTERN)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces.update({i: content.encode() for content, i in added.items()})
        self.added = added
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}  # of pieces between spaces
        self.words: dict[str, tuple[int, ...]] = {}  # of short pretokens
        self.most = most

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        key = left << 20 | right
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= 4 * self.most:
                self.compatible.clear()
            found = self.compatible[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        a_side, b_side, i, j = self.edges[1][left], self.edges[0][right], 0, 0
        while True:
            (a, a_gone), (b, b_gone) = a_side[i], b_side[j]
            rank = self.merges.get((a, b), NEVER)
            # of equal ranks the leftmost merge comes first
            if rank < a_gone and rank <= b_gone and rank != NEVER:
                return False
            if a_gone == NEVER and b_gone == NEVER:
                return True
            if a_gone <= b_gone:
                i += 1
            else:
                j += 1

    def pretoken(self, data: str) -> tuple[int, ...]:
        """Ids of one pretoken of any length, a letter for each byte: the last token of every prefix, then the pointers back."""
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        step, ends, compatible = self.automaton.step, self.automaton.ends, self.compatible
        state = 0
        for end, c in enumerate(data, 1):
            state = step(state, c)
            for length, token in ends[state]:
                before = last[end - length]
                if length != end:
                    fits = compatible.get(before << 20 | token)
                    if not (self.fits(before, token) if fits is None else fits):
                        continue
                last[end], size[end] = token, length
                break
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        return tuple(ids[::-1])

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        # letters after at most one space are one pretoken, and so is a stop or comma behind them
        word = chunk[:-1] if chunk[-1:] in (".", ",") else chunk
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            ids = self._remembered(word)
            if word is not chunk:
                ids += self._remembered(chunk[-1])
        else:
            ids = tuple(chain.from_iterable(map(self._remembered, self.pattern.findall(chunk))))
        if len(chunk) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def _remembered(self, piece: str) -> tuple[int, ...]:
        ids = self.words.get(piece)
        if ids is None:
            ids = self.pretoken(piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1"))
            if len(piece) <= 64:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[piece] = ids
        return ids

    def _ordinary(self, text: str, ids: list[int]) -> None:
        known = self.known
        if RUN.search(text):
            pieces = BEFORE_SPACE.split(text)
        else:
            pieces = text.split(" ")
            pieces[1:] = [" " + x for x in pieces[1:]]
        for piece in pieces:
            found = known.get(piece)
            ids.extend(self._chunk(piece) if found is None else found)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        if self.at_added is None or not any(x in text for x in self.added):
            self._ordinary(text, ids)
            return ids
        for part in self.at_added.split(text):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                self._ordinary(part, ids)
        return ids

    def decode(self, ids) -> str:
        """The ids' bytes as UTF-8; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once per Python process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _appended(df: DataFrame, column: str, out: str, kind: T.DataType, one) -> DataFrame:
    """df with column ``out`` = one(path's codec)(value of ``column``), other columns passed through."""
    schema = T.StructType([*[x for x in df.schema.fields if x.name != out], T.StructField(out, kind)])
    arrow = {T.StringType(): pa.string(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}[kind]

    def run(batches):
        apply = one()
        for batch in batches:
            values = batch.column(batch.schema.names.index(column)).to_pylist()
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != out]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array([apply(v) for v in values], arrow)], [*[n for n, _ in kept], out])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of every whole text; an existing column ``ids`` is replaced."""
    path = path or vocabulary_path()
    return _appended(df, text, ids, T.ArrayType(T.IntegerType()), lambda: codec(path).encode)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of every list of ids (null: empty)."""
    path = path or vocabulary_path()
    return _appended(df, ids, text, T.StringType(), lambda: lambda v: codec(path).decode(v or ()))


def digests(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass; returns the key and digests of ids and decoded text."""
    path = path or vocabulary_path()

    def run(batches):
        made = codec(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1).to_pylist():
                ids = made.encode(value)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(made.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], *[T.StructField(n, k) for n, k in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]])
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op1_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}

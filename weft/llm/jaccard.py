"""Operator 7: Jaccard join of shingle sets by universe partitioning and the pigeonhole principle.

A document's set holds its distinct hashed shingles. Sets fall into size bands; two sets that link lie
in the same band or in neighbouring ones, and the band of the smaller one bounds their symmetric
difference. That band's scheme hashes all shingles into segments. A plain segment is broken by one
differing shingle, a segment with its one-deletion neighbourhood only by two, so of segments that weigh
more than the bound (1 for plain, 2 with deletions) at least one is matched. How many of either kind
a band gets is the cheapest by a cost model of index rows and chance meetings. Each set writes only
as many segments as its own size needs.

Segments weigh ``slack`` more than the bound needs. So a set whose empty segments and crowded index
buckets weigh no more than that skips them without losing a link; only sets with more of them (copies
of each other, as a rule) meet there. Equal sets are one class throughout, so exact copies cost
nothing.

Index rows are sorted by range of (signature, class): a signature held by a third of all classes lies in
many tasks, and rows of signatures that only one class holds end there. Members of a bucket are dealt
to blocks of about ``BLOCK`` classes. A first round compares members of a block with pivots by 512-bit parity sketches
(whose distance never exceeds the symmetric difference, so no link is missed), and survivors are verified
exactly and connected. As long as that connects something, buckets of more than one block do the same with one
class for each component in them. The last round writes the surviving pairs between different components, block
against block: the rows of a bucket's largest component never meet each other there. Sets are fetched once, for
classes that have a survivor in some bucket or lie in a bucket of many blocks; pairs are verified in tiles of about ``TILE`` sets a
side, whatever share of a tile's pairs survives, in as many slices as bound what is copied at once. Pairs are compared only within a bucket, but a bucket
of many blocks whose classes are no copies of each other compares all their sketches. ``links="all"`` writes
every surviving pair instead, for the whole join.

Shingles are compared as 64-bit hashes. Classes are told apart by 128 bits, and a clash of their 64-bit
names is found and repaired by another seed. Null texts, and texts without words, have empty sets, linked with nothing;
a text with fewer words than a shingle is one shingle. Ids may repeat; a null id never is the smallest. Texts of any
length are read whole; an empty table gives an empty result; other columns of df are not read, so none can clash.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, components, merged, mix64, runs_hash, table, written

CROWDED = 64
BLOCK = 512
#: Sets on either side of a tile of pairs that are verified beside each other, and the bytes of its left side.
TILE, TILE_BYTES = 64, 1 << 24
#: Bytes of sets that may be copied to tiles at once, if sets has no more itself.
SLICE_BYTES = 1 << 30
SKETCH_BITS = 512
#: Rows of an Arrow batch where rows are short.
SHORT_ROWS = 4096
#: Cost of a chance meeting of two sets in a segment, in index rows.
MEETING = 10.0

_HASHES = WordHashes()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a whole text, A-Z in lower case."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = _HASHES.of(found)
    if len(found) < words:
        return runs_hash(hashed, len(found)) ^ np.uint64(0x5851F42D4C957F2D * (len(found) + 1) & (1 << 64) - 1)
    return np.unique(runs_hash(hashed, words))


# --- bands and schemes ---------------------------------------------------------------------------


class Scheme:
    """One band's segments: ``plain`` of weight 1, then ``double`` of weight 2; sizes low to high."""

    def __init__(self, number: int, low: int, high: int, num: int, den: int):
        self.number, self.low, self.high = number, low, high
        bound = differing(high, num, den)
        middle = (low + high) / 2
        chance = (bound + 1) * math.exp(-min(50.0, low / (bound + 1)))
        self.slack = min(1 << 17, math.ceil(chance + 2 * math.sqrt(chance)) + 1) if bound else 0
        weight = bound + 1 + self.slack
        best = None
        for double in {*range(0, min(weight // 2, 24) + 1), weight // 2}:
            n = weight - double
            held = middle / n
            empty = math.exp(-min(50.0, held))
            plain = weight - 2 * double
            cost = plain + double * (1 + held) + MEETING * empty * (plain + double * (1 + held))
            if best is None or cost < best[0]:
                best = (cost, plain, double)
        _, self.plain, self.double = best
        self.n = self.plain + self.double
        self.salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def first(self, weight: int) -> int:
        """How many segments weigh at least ``weight``."""
        return min(self.n, weight if weight <= self.plain else self.plain + (weight - self.plain + 1) // 2)


def differing(size: int, num: int, den: int) -> int:
    """The most shingles that may differ between a set of this size and a linked set no smaller."""
    return (den - num) * (size + size * den // num) // (den + num)


@lru_cache(maxsize=None)
def scheme(number: int, num: int, den: int) -> Scheme:
    low = 1
    for _ in range(number):
        low = low * den * den // (num * num) + 1
    return Scheme(number, low, low * den * den // (num * num), num, den)


@lru_cache(maxsize=100_000)
def bands(size: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """(scheme, segments to write) of a set: its own band's, and the band's below if a partner can be there."""
    number = 0
    while scheme(number, num, den).high < size:
        number += 1
    own = scheme(number, num, den)
    found = [(number, own.first(differing(size, num, den) + 1 + own.slack))]
    if number and -(-num * size // den) < own.low:
        found.append((number - 1, scheme(number - 1, num, den).n))
    return tuple(found)


def index_rows(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, infos) of a set. info: scheme, slack left after empty segments, weight."""
    signatures, infos = [], []
    for number, n_written in bands(len(tokens), num, den):
        s = scheme(number, num, den)
        if s.plain + s.double == 1 and s.plain == 1:
            continue  # nothing may differ: such links are equal sets
        mixed = mix64(tokens ^ s.salt)
        segment = (mixed % np.uint64(s.n)).astype(np.int64)
        low = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64)
        high = (mixed >> np.uint64(32)).astype(np.float64)
        # sums of 32-bit halves are exact in doubles up to 2**21 shingles, and wrap harmlessly beyond
        held = np.bincount(segment, minlength=s.n)
        sum_low, sum_high = np.bincount(segment, low, s.n), np.bincount(segment, high, s.n)
        weights = np.where(np.arange(s.n) < s.plain, 1, 2)
        weak = int((weights * (held <= (weights - 1)))[:n_written].sum())
        left = s.slack - weak
        info = (number << 20) | (max(0, left) << 2)

        def signed(lo, hi, seg):
            with np.errstate(over="ignore"):
                return mix64(mix64(lo.astype(np.uint64) + s.salt * (seg.astype(np.uint64) + np.uint64(1))) ^ (hi.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

        at = np.arange(n_written)
        if left >= 0:
            at = at[held[:n_written] > 0]
        signatures.append(signed(sum_low[at], sum_high[at], at))
        infos.append(info | (weights[at] if left >= 0 else np.full(len(at), 3)))  # 3: no slack, never skipped
        deleted = (segment >= s.plain) & (segment < n_written)
        if deleted.any():
            seg = segment[deleted]
            if left >= 0:
                deleted[deleted] = held[seg] > 1
                seg = segment[deleted]
            signatures.append(signed(sum_low[seg] - low[deleted], sum_high[seg] - high[deleted], seg))
            infos.append(np.full(len(seg), info | (2 if left >= 0 else 3)))
    if not signatures:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(signatures).view(np.int64), np.concatenate(infos)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the set's shingles over SKETCH_BITS bins."""
    bins = (mix64(tokens) >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


# --- passes over the texts -----------------------------------------------------------------------


def _name(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits of a set's content, as two signed numbers."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    return (value >> 64) - (1 << 63), (value & (1 << 64) - 1) - (1 << 63)


def _features(df: DataFrame, key: str, text: str, words: int, num: int, den: int, seed: int) -> DataFrame:
    """Rows (key, h text hash, n, name, other, sketch, signatures, infos): name and other are 128 bits of the set's content.

    signatures and infos are the set's index rows.
    """

    def lists(parts, kind):
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)).cast(kind))

    def run(batches):
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            out = {n: [] for n in ("n", "name", "other", "sketch", "signatures", "infos")}
            for t in batch.column(2).to_pylist():
                tokens = shingle_set(t, words)
                name, other = _name(tokens, seed)
                signatures, infos = index_rows(tokens, num, den) if len(tokens) else none
                out["n"].append(len(tokens))
                out["name"].append(name if len(tokens) else None)
                out["other"].append(other)
                out["sketch"].append(sketch(tokens) if len(tokens) else None)
                out["signatures"].append(signatures)
                out["infos"].append(infos)
            _HASHES.trim()
            columns = [pa.array(out["n"], pa.int64()), pa.array(out["name"], pa.int64()), pa.array(out["other"], pa.int64()), pa.array(out["sketch"], pa.binary()), lists(out["signatures"], pa.int64()), lists(out["infos"], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [key, "h", *out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.xxhash64(text).alias("h"), text).mapInArrow(run, f"`{key}` {kind}, h long, n long, name long, other long, sketch binary, signatures array<long>, infos array<int>")


def _sets(df: DataFrame, text: str, words: int, seed: int) -> DataFrame:
    """Rows (name, tokens binary: sorted 64-bit shingles) of the texts of df, empty sets left out."""

    def run(batches):
        for batch in batches:
            names, tokens = [], []
            for t in batch.column(0).to_pylist():
                found = shingle_set(t, words)
                if len(found):
                    names.append(_name(found, seed)[0])
                    tokens.append(found.tobytes())
            _HASHES.trim()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(tokens, pa.binary())], ["name", "tokens"])

    return df.select(text).mapInArrow(run, "name long, tokens binary")


# --- buckets -------------------------------------------------------------------------------------


def _met(index: DataFrame) -> DataFrame:
    """Index rows of signatures that two classes or more hold, once for each class; a task's first and last signatures all stay."""

    def run(batches):
        last, emitted, pending, first = None, False, None, None
        for batch in batches:
            signature, name, info = (batch.column(k).to_numpy() for k in range(3))
            if not len(signature):
                continue
            if first is None:
                first = signature[0]
            new = np.ones(len(signature), bool)  # copies wrote equal rows: one for each class stays
            new[1:] = (signature[1:] != signature[:-1]) | (name[1:] != name[:-1])
            if last is not None:
                new[0] = (signature[0], name[0]) != last
            last = (signature[-1], name[-1])
            signature, name, info = signature[new], name[new], info[new]
            if pending is not None:
                signature, name, info = (np.concatenate(([p], x)) for p, x in zip(pending, (signature, name, info)))
                pending = None
            if not len(signature):
                continue
            starts = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
            sizes = np.diff(np.append(starts, len(signature)))
            keep = (sizes > 1) | (signature[starts] == first)
            if emitted is not False and signature[0] == emitted:
                keep[0] = True
            if not keep[-1]:  # alone so far
                pending = (signature[-1], name[-1], info[-1])
            emitted = signature[-1] if keep[-1] else False
            stay = np.repeat(keep, sizes)
            if stay.any():
                yield pa.RecordBatch.from_arrays([pa.array(signature[stay]), pa.array(name[stay]), pa.array(info[stay].astype(np.int32))], ["signature", "name", "info"])
        if pending is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], k) for x, k in zip(pending, (pa.int64(), pa.int64(), pa.int32()))], ["signature", "name", "info"])

    return index.repartitionByRange("signature", "name").sortWithinPartitions("signature", "name").mapInArrow(run, "signature long, name long, info int")


def _near(sketches, sizes, i, others, num, den):
    """Which of ``others`` may link with member i by sketch and size."""
    differ = np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1)
    s = sizes[others] + sizes[i]
    fits = differ <= (den - num) * s // (den + num)
    return fits & (den * np.minimum(sizes[others], sizes[i]) >= num * np.maximum(sizes[others], sizes[i]))


def _cells(batches, n_keys):
    """Of batches sorted by their first n_keys columns: arrays of whole cells (binary columns as rows of 64-bit numbers), and the cells' edges."""

    def arrays(batch):
        return [np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), -1) if pa.types.is_binary(x.type) else x.to_numpy() for x in batch.columns]

    def edges(x):
        change = np.zeros(len(x[0]), bool)
        for k in range(n_keys):
            change[1:] |= x[k][1:] != x[k][:-1]
        return np.array([0, *np.flatnonzero(change), len(change)])

    kept = []  # pieces of the last cell, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        goes_on = not kept or all(kept[-1][k][-1] == now[k][0] for k in range(n_keys))
        last = edges(now)[-2]
        if not last and goes_on:
            kept.append(now)
            continue
        whole = [np.concatenate(x) for x in zip(*kept, [x[:last] for x in now])]
        yield whole, edges(whole)
        kept = [[x[last:] for x in now]]
    if kept:
        whole = [np.concatenate(x) for x in zip(*kept)]
        yield whole, edges(whole)


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _pivot_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of bucket members (signature, name, n, sketch, c) and the pivots of their blocks whose sketches and sizes allow a link.

    c is the bucket's size. A pair (a, a) says that a pivot without partner may link with a member that another pivot has taken.
    """

    def run(batches):
        for (_, _, names, sizes, sketches), edges in _cells(batches, 2):
            found, at, size = [], edges[:-1], np.diff(edges)
            twos = at[size == 2]  # most cells
            if len(twos):
                hit = twos[_near(sketches, sizes, twos, twos + 1, num, den)]
                found.append(np.stack((names[hit], names[hit + 1])))
            for start, n in zip(at[size > 2].tolist(), size[size > 2].tolist()):
                left = np.arange(start, start + n)
                while len(left):
                    pivot, left = left[0], left[1:]
                    hit = _near(sketches, sizes, pivot, left, num, den)
                    if hit.any():
                        found.append(np.stack((np.full(int(hit.sum()), names[pivot]), names[left[hit]])))
                        left = left[~hit]
                    elif _near(sketches, sizes, pivot, np.delete(np.arange(start, start + n), pivot - start), num, den).any():
                        found.append(np.array([[names[pivot]], [names[pivot]]]))
            if found:
                yield _pairs_batch(found)

    block = F.pmod(F.xxhash64("name"), F.ceil(F.col("c") / BLOCK)).cast("int")
    dealt = rows.withColumn("block", block).repartition("signature", "block").sortWithinPartitions("signature", "block", "name")
    return dealt.select("signature", "block", "name", "n", "sketch").mapInArrow(run, "a long, b long").distinct()


def _cross_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members (signature, name, n, sketch, label) of a bucket with different labels, sketches and sizes allowing a link.

    A bucket of many blocks is dealt to cells of two blocks each; its largest label's blocks meet those of all others, never each other.
    """
    counts = rows.groupBy("signature", "label").agg(F.count(F.lit(1)).alias("m"))
    whole = counts.groupBy("signature").agg(F.sum("m").alias("c"), F.max(F.struct("m", "label")).alias("top"))
    whole = whole.select("signature", "c", F.col("top.label").alias("major"), F.col("top.m").alias("m"))
    rows = rows.join(whole.hint("merge"), "signature").where("c > m")
    hot = F.col("c") > BLOCK
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")
    rows = rows.withColumn("big", F.when(hot & (F.col("m") > BLOCK), blocks(F.col("m"))).otherwise(0))
    rows = rows.withColumn("is_big", (F.col("big") > 0) & (F.col("label") == F.col("major")))
    rest = F.when(F.col("big") > 0, F.col("c") - F.col("m")).otherwise(F.col("c"))
    rows = rows.withColumn("rest", blocks(rest)).withColumn("own", F.pmod(F.xxhash64("name"), F.when(F.col("is_big"), F.col("big")).otherwise(F.col("rest"))).cast("int"))
    # a cell (i, j): block i >= 0 and j >= i of the rest; or -1 - i, block i of the largest label, and j of the rest. side: 0 for block i.
    others = F.sequence(F.lit(0), F.col("rest") - 1)
    of_big = F.transform(others, lambda j: F.struct((-1 - F.col("own")).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    among = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), F.when(k < F.col("own"), 1).otherwise(0).alias("side")))
    to_big = F.transform(F.sequence(F.lit(0), F.col("big") - 1), lambda i: F.struct((-1 - i).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    cells = F.when(F.col("is_big"), of_big).when(F.col("big") > 0, F.concat(among, to_big)).otherwise(among)
    dealt = rows.withColumn("cell", F.explode(cells)).select("signature", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), F.col("cell.side").alias("side"), "name", "n", "sketch", "label")

    def run(batches):
        for (_, i, j, side, names, sizes, sketches, labels), edges in _cells(batches, 3):
            found, starts, size = [], edges[:-1], np.diff(edges)
            twos = starts[(size == 2) & (i[starts] == j[starts])]
            twos = twos[labels[twos] != labels[twos + 1]]
            if len(twos):
                hit = twos[_near(sketches, sizes, twos, twos + 1, num, den)]
                found.append(np.stack((names[hit], names[hit + 1])))
            for start, end in zip(edges, edges[1:]):
                inside = i[start] == j[start]
                if inside and end - start == 2:
                    continue
                every = np.arange(start, end)
                left, right = every[side[start:end] == 0], every[side[start:end] == 1]
                few, many = (left, right) if inside or len(left) <= len(right) else (right, left)
                for at in few:
                    others = np.arange(at + 1, end) if inside else many
                    others = others[labels[others] != labels[at]]
                    if len(others):
                        others = others[_near(sketches, sizes, at, others, num, den)]
                        found.append(np.stack((np.full(len(others), names[at]), names[others])))
            if found:
                yield _pairs_batch(found)

    return dealt.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _tiles(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (g, i, j, name, against) of the sets that verify pairs (a, b): tile (i, j) of a group g has up to about ``TILE`` sets on either side.

    against has the a of a tile that its b meets; it is null for the a themselves. A group has the pairs whose a share their
    least name within two steps, so where many sets of a cluster meet each other a set is copied for each tile, not for each pair.
    """
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    near = scratch.put("near", ends.groupBy("x").agg(F.least("x", F.min("y")).alias("m")))
    of_a = pairs.join(near.withColumnRenamed("x", "b").hint("merge"), "b").groupBy("a").agg(F.min("m").alias("g"))
    of_a = scratch.put("groups", of_a.join(sets.select(F.col("name").alias("a"), "size").hint("merge"), "a"))
    grouped = scratch.put("grouped", pairs.join(of_a.select("a", "g").hint("merge"), "a"))
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    left = of_a.groupBy("g").agg(F.greatest(parts(F.count(F.lit(1)), TILE), parts(F.sum("size"), TILE_BYTES)).alias("n_i"))
    right = grouped.select("g", "b").distinct().groupBy("g").agg(parts(F.count(F.lit(1)), TILE).alias("n_j"))
    shape = scratch.put("shape", left.join(right.hint("merge"), "g"))  # a join of two tables is one that Spark may split
    block = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    dealt = scratch.put("dealt", grouped.join(shape.hint("merge"), "g").select("g", block("a", "n_i").alias("i"), block("b", "n_j").alias("j"), "a", "b"))
    ours = dealt.select("g", "i", "j", F.col("a").alias("name"), F.lit(None).cast("array<long>").alias("against")).distinct()
    theirs = dealt.groupBy("g", "i", "j", F.col("b").alias("name")).agg(F.collect_list("a").alias("against"))
    found = scratch.put("tiles", ours.unionByName(theirs))
    scratch.drop("near", "groups", "grouped", "shape", "dealt")
    return found


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """pairs with ``linked``: the exact test on whole sets, tile by tile, so that sets that meet many others are not copied for each of them.

    Where the tiles' sets are many more bytes than sets itself, or than ``SLICE_BYTES``, slices of the tiles follow each other, each one's shuffle
    files going before the next one's come.
    """

    def run(batches):
        tile, mine = None, {}
        for batch in batches:
            out = {"a": [], "b": [], "linked": []}
            keys = zip(*[batch.column(k).to_pylist() for k in range(3)])
            for key, name, against, tokens in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                other = np.frombuffer(tokens.as_buffer(), np.uint64)
                if key != tile:
                    tile, mine = key, {}
                if against is None:
                    mine[name] = other.copy()
                    continue
                for a in against:
                    at = np.searchsorted(mine[a], other)
                    at[at == len(mine[a])] = 0
                    shared = int((mine[a][at] == other).sum())
                    out["a"].append(a)
                    out["b"].append(name)
                    out["linked"].append(den * shared >= num * (len(mine[a]) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["linked"], pa.bool_())], list(out))

    tiles = _tiles(pairs, sets, scratch)
    copied = tiles.join(sets.select("name", "size").hint("merge"), "name").agg(F.sum("size")).first()[0] or 0
    slices = math.ceil(copied / max(SLICE_BYTES, sets.agg(F.sum("size")).first()[0] or 0)) or 1
    found = None
    for k in range(slices):
        wanted = tiles.where(F.pmod(F.xxhash64("g", "i"), F.lit(slices)) == k) if slices > 1 else tiles
        rows = wanted.join(sets.select("name", "tokens").hint("merge"), "name").select("g", "i", "j", "name", "against", "tokens")
        beside = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", F.col("against").isNotNull())
        part = scratch.put("pairs", beside.mapInArrow(run, "a long, b long, linked boolean"))
        found = part if found is None else found.unionByName(part)
    scratch.drop("tiles")
    return found


def join(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", links: str = "components"):
    """The join of df's texts with themselves at Jaccard similarity num / den or more.

    Returns (rows, pairs): rows (key, h, n, name) with a class name for each document (null: empty set),
    and verified links (a, b) between class names; these connect every component, and with
    ``links="all"`` they are all links between different sets.
    """
    return _join(df, words, num, den, key, text, links, Scratch(df.sparkSession, "join"))[:2]


def _join(df: DataFrame, words: int, num: int, den: int, key: str, text: str, links: str, scratch: Scratch):
    """(rows, pairs) of ``join``, and the labels (node, label) of the components but for ``links="all"``."""
    if not 0 < num <= den:
        raise ValueError("the similarity lies in (0, 1]")
    for seed in range(100):
        rows = scratch.put("rows", _features(df, key, text, words, num, den, seed))
        classes = rows.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("other").alias("o1"), F.max("other").alias("o2"), F.min(F.struct(key, "h")).alias("x"))
        classes = scratch.put("classes", classes)
        if not classes.where("o1 <> o2").limit(1).count():
            break
        scratch.drop("rows", "classes")
    else:
        raise RuntimeError("class names clash under every seed")

    index = rows.where("n > 0").select("name", "infos", F.posexplode("signatures").alias("at", "signature")).select("signature", "name", F.col("infos")[F.col("at")].alias("info"))
    met = scratch.put("met", _met(index), SHORT_ROWS)
    rows = scratch.put("ids", rows.select(key, "h", "n", "name"))
    scratch.drop("rows")
    counts = met.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = scratch.put("members", met.join(counts.hint("merge"), "signature"))
    scratch.drop("met")
    weight, slack, band = F.col("info").bitwiseAND(3), F.shiftright("info", 2).bitwiseAND(0x3FFFF), F.shiftright("info", 20)
    crowd = members.where(F.col("c") > CROWDED).groupBy("name", band.alias("band")).agg(F.sum(weight).alias("load"))
    stays = (F.col("c") <= CROWDED) | (F.col("load") > slack) | (weight == 3)
    stayed = members.withColumn("band", band).join(crowd.hint("merge"), ["name", "band"], "left").where(stays).select("signature", "name", "c")
    buckets = scratch.put("buckets", stayed.join(classes.select("name", "n", "sketch").hint("merge"), "name"))
    scratch.drop("members")

    many = links == "all"
    if many:
        pairs = scratch.put("candidates", _cross_pairs(buckets.withColumn("label", F.col("name")).drop("c"), num, den), SHORT_ROWS)
    else:
        pairs = scratch.put("candidates", _pivot_pairs(buckets, num, den), SHORT_ROWS)
    names = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).unionByName(buckets.where(F.col("c") > BLOCK).select("name")).distinct()
    # one text of each class is enough
    absent = F.lit(-(2**63))
    chosen = classes.join(names.hint("merge"), "name", "left_semi").select(F.coalesce(F.col(f"x.{key}").cast("long"), absent).alias("_k"), F.col("x.h").alias("_h"))
    keyed = df.select(F.coalesce(F.col(key).cast("long"), absent).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    texts = keyed.join(chosen.hint("merge"), ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"])
    sets = scratch.put("sets", _sets(texts, "_text", words, seed).dropDuplicates(["name"]).withColumn("size", F.length("tokens")))

    def tested(candidates: DataFrame) -> DataFrame:
        return _verified(candidates, sets, num, den, scratch)

    done = tested(pairs.where("a <> b"))
    linked = done.where("linked").select("a", "b")
    scratch.drop("candidates")
    if many:
        return rows, linked, None

    def marked(labels: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with their labels."""
        named = buckets.join(labels.withColumnRenamed("node", "name").hint("merge"), "name", "left").withColumn("label", F.coalesce("label", "name"))
        mixed = named.groupBy("signature").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("signature")
        return scratch.put("marked", named.join(mixed.hint("merge"), "signature", "left_semi"))

    labels = components(linked, scratch=scratch)
    rows_left = marked(labels)
    while rows_left.where(F.col("c") > BLOCK).limit(1).count():
        one = rows_left.where(F.col("c") > BLOCK).groupBy("signature", "label").agg(F.min(F.struct("name", "n", "sketch")).alias("x")).select("signature", "x.*")
        one = scratch.put("ones", one)
        one = one.join(one.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).hint("merge"), "signature")
        again = scratch.put("candidates", _pivot_pairs(one, num, den).where("a <> b").join(done.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), SHORT_ROWS)
        more = tested(again)
        scratch.drop("ones", "candidates")
        done, more = done.unionByName(more), more.where("linked").select("a", "b")
        if not more.limit(1).count():
            break
        linked, labels = linked.unionByName(more), merged(labels, more, scratch)
        scratch.drop("marked")
        rows_left = marked(labels)
    last = _cross_pairs(rows_left.drop("c"), num, den).join(done.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
    more = tested(scratch.put("candidates", last, SHORT_ROWS)).where("linked").select("a", "b")
    scratch.drop("marked", "buckets", "classes", "sets", "candidates")
    return rows, linked.unionByName(more), merged(labels, more, scratch)


def groups(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, h, n_shingles, component_id): the smallest key reachable by links (with an empty set: its own)."""
    scratch = Scratch(df.sparkSession, "join")
    rows, _, labels = _join(df, words, num, den, key, text, "components", scratch)
    labels = labels.withColumnRenamed("node", "name")
    classes = rows.where("n > 0").groupBy("name").agg(F.min(key).alias("least"))
    labelled = scratch.put("labelled", classes.join(labels.hint("merge"), "name", "left").withColumn("label", F.coalesce("label", "name")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least.hint("merge"), "label").select("name", "component_id")
    found = rows.select(key, "h", "n", "name").join(named.hint("merge"), "name", "left")
    found = found.select(key, "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))
    result = written(found, "join-groups")
    scratch.clear()
    return result


def without_near_copies(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one document of each group: the smallest key, then the smallest text hash. Rows equal in key and text count once.

    Documents with an empty set stay. Columns of df may have any names.
    """
    found = groups(df, words, num, den, key, text)
    absent = F.lit(-(2**63))
    lone = found.where("n_shingles = 0").select(F.coalesce(F.col(key).cast("long"), absent).alias("k"), "h")
    best = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "h")).alias("x"))
    keep = lone.unionByName(best.select(F.coalesce(F.col("x.k").cast("long"), absent).alias("k"), F.col("x.h").alias("h"))).distinct()
    keyed = df.select(F.coalesce(F.col(key).cast("long"), absent).alias("k"), F.xxhash64(text).alias("h"), F.struct(*df.columns).alias("row"))
    kept = keyed.join(keep.hint("merge"), ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op7_jaccard(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op7_jaccard": op7_jaccard}

ORACLE_SQL = {
    "op7_jaccard": r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')) END) AS s
  FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 90 * (p.n + q.n - m)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS node FROM documents UNION SELECT reached.doc_id, b FROM reached JOIN both_ways ON a = node
)
SELECT reached.doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, min(node) AS component_id FROM reached LEFT JOIN sizes ON sizes.doc_id = reached.doc_id GROUP BY reached.doc_id
""",
}

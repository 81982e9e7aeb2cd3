"""Least set costs of many queries at once where a tree of points leads to their terminals.

A target with one producing edge needs that edge; its tails take the target's place. What then is left to reach are terminals.
Where only arcs lead to them, from points that have one way each (the trunk, a tree that hangs on what is free), the cheapest set is
a cheapest subtree of the trunk with an arc to each terminal. cost[S] of a point, the least weight that leads from it to the
terminals S, follows from its children's, so a query looks at each point once, and only points where terminals meet have a cost
of more than one terminal.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: More terminals than that are left to the search: work triples with each.
MAX_TERMINALS = 18
#: Cells of cost that are worked on at once.
CELLS, BLOCK = 1 << 21, 1 << 18
#: Points where so few terminals meet offer each set of them to their parent, instead of all costs.
FEW = 4
ROOT = 0


class Trunk:
    """A tree of points by number, level by level and siblings side by side; 0 is the root, which what is free hangs on."""

    def __init__(self, parent, weight, level):
        self.parent, self.weight, self.level = (np.asarray(x, np.int64) for x in (parent, weight, level))
        self.depth, self.dist = int(self.level.max()), np.zeros(len(self.parent), np.int64)
        for n in range(1, self.depth + 1):
            at = np.flatnonzero(self.level == n)
            self.dist[at] = self.dist[self.parent[at]] + self.weight[at]


def numbered(ways: dict) -> tuple[Trunk, dict, set]:
    """(trunk, number of each point in it, points behind which there is more than a tree) from the ways by point.

    A way is (parent, weight) of a point with one arc into it, parent None at what is free; None stands for any other point.
    Points that lead nowhere are in neither.
    """
    below: dict = {}
    for p, way in ways.items():
        if way is not None:
            below.setdefault(way[0], []).append(p)
    parent, weight, level, number = [ROOT], [0], [0], {}
    new = [(ROOT, p) for p in below.get(None, ())]
    while new:
        depth, ahead = level[-1] + 1, []
        for at, p in new:
            number[p] = len(parent)
            parent.append(at)
            weight.append(ways[p][1])
            level.append(depth)
            ahead += [(number[p], c) for c in below.get(p, ())]
        new = ahead
    other, todo = set(), [p for p, way in ways.items() if way is None]
    while todo:
        p = todo.pop()
        if p not in other:
            other.add(p)
            todo += below.get(p, ())
    return Trunk(parent, weight, level), number, other


def least_costs(trunk: Trunk, first: np.ndarray, nodes: np.ndarray, weights: np.ndarray, asked: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least cost of each query.

    Arcs of terminal t: nodes and weights from first[t] up to first[t + 1], at least one. Terminals of query q: asked from
    ends[q] up to ends[q + 1], distinct.
    """
    sizes, out = np.diff(ends), np.zeros(len(ends) - 1, np.int64)
    dearest = int((trunk.dist[nodes] + weights).max(initial=0))
    for k in np.unique(sizes):
        if not k:
            continue
        rows, kind = np.flatnonzero(sizes == k), np.int32 if dearest * int(k) < 1 << 29 else np.int64
        step = max(1, min(4096, CELLS >> (int(k) + 5)))
        for c in range(0, len(rows), step):
            some = rows[c : c + step]
            terminals = asked[ends[some][:, None] + np.arange(k)]
            out[some] = _solved(trunk, first, nodes, weights, terminals, int(k), kind)
    return out


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from begin on, count of them, one after the other."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - count), count)


def _sums(direct: np.ndarray, far: int) -> np.ndarray:
    """cost[S] by column where each terminal is reached on its own: direct is (k, columns)."""
    cost = np.zeros((1 << len(direct), direct.shape[1]), direct.dtype)
    for b, own in enumerate(direct):
        np.minimum(cost[: 1 << b] + own, far, out=cost[1 << b : 2 << b])
    return cost


def _within(bits: list[int]) -> np.ndarray:
    """All sets of these terminals, the empty one first and the whole one last."""
    out = np.zeros(1, np.int64)
    for b in bits:
        out = np.concatenate((out, out | 1 << b))
    return out


def _merged(cost: np.ndarray) -> None:
    """Lets each column's sets be made of two, in place; sets of one size at once."""
    k = len(cost).bit_length() - 1
    for size in range(2, k + 1):
        bits = 1 << np.array(list(combinations(range(k), size)))
        step = max(1, BLOCK // (cost.shape[1] << size - 1))
        for c in range(0, len(bits), step):
            some = bits[c : c + step]
            whole, parts = some.sum(axis=1), some[:, :1]  # parts hold the least terminal
            for b in range(1, size):
                parts = np.concatenate((parts, parts + some[:, b : b + 1]), axis=1)
            parts = parts[:, :-1]
            made = cost.take(parts, 0)
            made += cost.take(whole[:, None] - parts, 0)
            cost[whole] = np.minimum(cost[whole], made.min(axis=1))


def _offered(cost: np.ndarray, column: np.ndarray, sets: np.ndarray, price: np.ndarray) -> None:
    """Takes offers (column, set, price) into the columns, each once, in place."""
    order = np.lexsort((price, column, sets))
    column, sets, price = column[order], sets[order], price[order]
    least = (np.diff(column, prepend=-1) != 0) | (np.diff(sets, prepend=-1) != 0)
    column, sets, price = column[least], sets[least], price[least]
    ends = np.append(np.flatnonzero(np.diff(sets, prepend=-1)), len(sets))
    bits = range(len(cost).bit_length() - 1)
    for a, b in zip(ends, ends[1:]):
        t, c = int(sets[a]), column[a:b]
        apart = _within([x for x in bits if not t >> x & 1])[:, None]
        cost[apart | t, c] = np.minimum(cost[apart | t, c], cost[apart, c] + price[a:b])


def _solved(trunk: Trunk, first, nodes, weights, terminals: np.ndarray, k: int, kind) -> np.ndarray:
    """The least costs of queries (rows of terminals) with k terminals each."""
    far, n, size = (1 << 29 if kind is np.int32 else 1 << 61), len(terminals), len(trunk.parent)
    flat = terminals.ravel()
    count = first[flat + 1] - first[flat]
    arc = _spread(first[flat], count)
    line = np.repeat(np.arange(n * k), count)
    at, levels = nodes[arc], trunk.level[nodes[arc]]
    few = min(FEW, k // 2)
    # what a level's points are reached by: singles (query, node, terminal, cost); from below also offers (query * size + node, set, price) and tables
    waiting = [(line[o] // k, at[o], line[o] % k, weights[arc[o]].astype(kind)) for o in (np.flatnonzero(levels == d) for d in range(trunk.depth + 1))]
    singles, offers, tables = None, None, None
    for depth in range(trunk.depth, -1, -1):
        own = waiting[depth]
        q, v, i, d = own if singles is None else tuple(np.concatenate(x) for x in zip(singles, own))
        key = q * size + v
        order = np.argsort(key, kind="stable")
        key, i, d = key[order], i[order], d[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        many = np.diff(begins, append=len(key)) > 1
        met = np.repeat(many, np.diff(begins, append=len(key)))
        alone = key[~met], i[~met], d[~met]
        columns = key[begins[many]]
        direct = np.full((len(columns), k), far, kind)
        np.minimum.at(direct.reshape(-1), np.searchsorted(columns, key[met]) * k + i[met], d[met])
        mask = ((direct < far) << np.arange(k)).sum(axis=1)
        weight = trunk.weight[columns % size].astype(kind)
        # columns that children's sets come to have all costs
        full = np.zeros(len(columns), bool)
        if offers is not None:
            column, sets, price = np.searchsorted(columns, offers[0]), offers[1], offers[2]
            apart = np.where(sets[:, None] >> np.arange(k) & 1, direct[column], 0).sum(axis=1)
            worth = price < apart
            column, sets, price = column[worth], sets[worth], price[worth]
            full[column] = True
        if tables is not None:
            below, made = tables
            above = np.searchsorted(columns, below)
            full[above] = True
        bits = np.bitwise_count(mask)
        if depth:
            full |= bits > few
            full &= bits > 1
        which = np.flatnonzero(full)
        place = np.cumsum(full) - 1
        cost = _sums(np.ascontiguousarray(direct[which].T), far) if len(which) else None
        if offers is not None and len(column):
            _offered(cost, place[column], sets, price)
        if tables is not None:
            starts = np.flatnonzero(np.diff(above, prepend=-1))
            best = np.minimum.reduceat(made, starts, axis=1)
            into = place[above[starts]]
            merged = np.minimum(cost[:, into], best)
            _merged(merged)
            cost[:, into] = merged
        if not depth:
            break
        up = lambda x: x // size * size + trunk.parent[x % size]
        single_key, single_i, single_d = [up(alone[0])], [alone[1]], [alone[2] + trunk.weight[alone[0] % size].astype(kind)]
        col, term = np.nonzero(direct < far)
        single_key.append(up(columns[col]))
        single_i.append(term)
        single_d.append(direct[col, term] + weight[col])
        keys = np.concatenate(single_key)
        singles = keys // size, keys % size, np.concatenate(single_i), np.concatenate(single_d)
        offers, tables = None, None
        small = np.flatnonzero(~full & (bits > 1))
        if len(small):
            got = []
            for b in np.unique(bits[small]):
                some = small[bits[small] == b]
                held = np.nonzero(direct[some] < far)[1].reshape(-1, b)  # each column's terminals
                for s in range(3, 1 << int(b)):
                    if s & (s - 1):
                        taken = held[:, [x for x in range(b) if s >> x & 1]]
                        price = np.take_along_axis(direct[some], taken, axis=1).sum(axis=1, dtype=kind) + weight[some]
                        got.append((up(columns[some]), (1 << taken).sum(axis=1), price))
            offers = tuple(np.concatenate(x) for x in zip(*got))
        if len(which):
            tables = up(columns[which]), np.minimum(cost + weight[which], far)
    # the root: what has only its own ways to all terminals is their sum
    out = np.full(n, far, np.int64)
    if k == 1:
        np.minimum.at(out, key // size, d)
        return out
    out[columns // size] = direct.sum(axis=1, dtype=np.int64)
    if len(which):
        out[columns[which] // size] = cost[-1]
    return out

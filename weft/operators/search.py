"""The exact search for the cheapest edge set, one query at a time.

States are sets of selected edges; what they derive and which points they still need follow from the
set. The search takes the state with the least bound first (selected weight plus a bound by disjoint
cuts of what it still needs, selected edges weighing nothing), so the first complete state is a
cheapest one, and at any time the least open bound is a certified lower bound.
"""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass

INF = float("inf")


@dataclass
class Found:
    edges: list[int] | None
    cost: int | None
    lower: int
    proven: bool
    nodes: int
    pruned: int
    millis: int


def derived(starts: frozenset, edges: list[tuple[int, frozenset, object]], chosen) -> set:
    """Points available when only the chosen edges may fire."""
    known, left, moved = set(starts), list(chosen), True
    while moved:
        moved, waiting = False, []
        for e in left:
            if edges[e][1] <= known:
                if edges[e][2] not in known:
                    known.add(edges[e][2])
                    moved = True
            else:
                waiting.append(e)
        left = waiting
    return known


def depths(known, edges, of_point, weights) -> tuple[dict, list]:
    """Depth bounds from the known points, and of each edge the tail reached last (None: no such tail)."""
    best = dict.fromkeys(known, 0)
    left = [len(tails) for _, tails, _ in edges]
    last: list = [None] * len(edges)
    heap: list = []
    order = 0

    def reached(p, d):
        nonlocal order
        for e in of_point.get(p, ()):
            left[e] -= 1
            last[e] = p
            if not left[e]:
                heapq.heappush(heap, (d + weights[e], order, edges[e][2]))
                order += 1

    for e, n in enumerate(left):
        if not n:
            heapq.heappush(heap, (weights[e], order, edges[e][2]))
            order += 1
    for p in known:
        reached(p, 0)
    while heap:
        d, _, p = heapq.heappop(heap)
        if p not in best:
            best[p] = d
            reached(p, d)
    return best, [t if not n else -1 for t, n in zip(last, left)]


def cut_bound(known, edges, of_point, into, paid, goals):
    """(bound, depth bounds): a lower bound of the weight that derives all goals; edges in ``paid`` weigh nothing.

    Whatever derives the dearest goal holds an edge of the cut around the points that lead to it for
    nothing, followed along each edge's last tail. The cut's least weight counts and is taken off its
    edges, so that the sum over cuts stays a lower bound; cuts are made until every goal is free.
    """
    weights = [0 if e in paid else edge[0] for e, edge in enumerate(edges)]
    total, first = 0, None
    while True:
        reach, last = depths(known, edges, of_point, weights)
        first = reach if first is None else first
        if any(g not in reach for g in goals):
            return INF, first
        goal = max(goals, key=lambda g: (reach[g], str(g)))
        if not reach[goal]:
            return total, first
        inside, todo, crossing = {goal}, [goal], []
        while todo:
            for e in into.get(todo.pop(), ()):
                if last[e] == -1:
                    continue  # never fires
                if weights[e]:
                    crossing.append(e)
                elif last[e] not in inside:
                    inside.add(last[e])
                    todo.append(last[e])
        crossing = [e for e in crossing if last[e] not in inside]
        least = min(weights[e] for e in crossing)
        total += least
        for e in crossing:
            weights[e] -= least


def cheapest(starts, edges, targets, incumbent: list[int], lower: int, max_nodes: int, max_millis: int) -> Found:
    """The cheapest set of edges that derives all targets.

    edges: (weight, tails, head) by number; incumbent: numbers of a set that works. A goal whose
    producing edge is already selected isn't opened again, and a state counts as complete only when
    its own edges derive the targets.
    """
    began = time.monotonic()
    starts, targets = frozenset(starts), frozenset(targets)
    edges = [(w, frozenset(t), h) for w, t, h in edges]
    into: dict = {}
    for e, (_, _, head) in enumerate(edges):
        into.setdefault(head, []).append(e)
    of_point: dict = {}
    for e, (_, tails, _) in enumerate(edges):
        for p in tails:
            of_point.setdefault(p, []).append(e)
    for numbers in into.values():
        numbers.sort(key=lambda e: (edges[e][0], e))
    best, upper = list(incumbent), sum(edges[e][0] for e in incumbent)
    # (bound, less the selected weight, order, selected weight, edges, whether the bound is the state's own)
    heap: list = [(lower, 0, 0, 0, frozenset(), False)]
    seen, reached, order, nodes, pruned = {frozenset()}, {}, 1, 0, 0

    def elapsed() -> int:
        return int((time.monotonic() - began) * 1000)

    while heap:
        bound, _, _, cost, chosen, own = heap[0]
        if bound >= upper:
            break
        if nodes >= max_nodes or elapsed() >= max_millis:
            return Found(best, upper, min(upper, max(lower, int(bound))), False, nodes, pruned, elapsed())
        heapq.heappop(heap)
        nodes += not own
        known = derived(starts, edges, chosen)
        if targets <= known:
            if cost < upper:
                best, upper = sorted(chosen), cost
            continue
        promised = {edges[e][2] for e in chosen}
        needed = set(targets)
        for e in chosen:
            needed |= edges[e][1]
        needed -= known
        goals = needed - promised
        if not goals:
            pruned += 1  # selected edges wait for each other
            continue
        if not own:
            more, reach = cut_bound(known, edges, of_point, into, chosen, needed)
            if more == INF or cost + more >= upper:
                pruned += 1
                continue
            if cost + more > bound:
                heapq.heappush(heap, (cost + more, -cost, order, cost, chosen, True))
                order += 1
                reached[chosen] = reach
                continue
        else:
            reach = reached.pop(chosen)
        goal = max(goals, key=lambda g: (reach[g], str(g)))
        for e in into.get(goal, ()):
            if e in chosen or edges[e][1] & {goal}:
                continue
            after = chosen | {e}
            total = cost + edges[e][0]
            if total >= upper:
                pruned += 1
                break  # edges come by weight
            if after not in seen:
                seen.add(after)
                heapq.heappush(heap, (max(total, bound), -total, order, total, after, False))
                order += 1
    return Found(best, upper, upper, True, nodes, pruned, elapsed())

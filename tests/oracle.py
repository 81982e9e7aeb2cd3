"""Plain Python answers on small graphs, written apart from the engine."""

import random

INF = float("inf")


def closure(starts, edges):
    known, moved = set(starts), True
    while moved:
        moved = False
        for _, tails, head in edges:
            if head not in known and set(tails) <= known:
                known.add(head)
                moved = True
    return known


def bound(starts, edges, gather):
    d = {p: 0 for p in starts}
    moved = True
    while moved:
        moved = False
        for w, tails, head in edges:
            if head in starts or not all(t in d for t in tails):
                continue
            c = w + gather([d[t] for t in set(tails)])
            if c < d.get(head, INF):
                d[head] = c
                moved = True
    return d


def depth(starts, edges):
    return bound(starts, edges, lambda v: max(v, default=0))


def tree(starts, edges):
    return bound(starts, edges, sum)


def set_cost(starts, edges, targets):
    best = INF
    for mask in range(1 << len(edges)):
        chosen = [e for i, e in enumerate(edges) if mask >> i & 1]
        cost = sum(e[0] for e in chosen)
        if cost < best and set(targets) <= closure(starts, chosen):
            best = cost
    return best


def random_graph(r: random.Random, n_points=6, n_edges=8, tails=(0, 2), weights=(0, 5)):
    names = [f"p{i}" for i in range(n_points)]
    return names, [(r.randint(*weights), tuple(r.sample(names, r.randint(*tails))), r.choice(names)) for _ in range(n_edges)]



"""The search kernel against brute force, without Spark."""

import random

from tests import oracle
from weft.operators.search import cheapest

F3 = [(2, ("s",), "a"), (0, ("s",), "d"), (2, ("d",), "e"), (1, ("e",), "a"), (0, ("a", "e"), "h"), (0, ("e", "h"), "i"), (0, ("i",), "t")]


def witness(starts, edges, targets):
    """All edges that can fire: always derives what is reachable."""
    known = oracle.closure(starts, edges)
    return [i for i, e in enumerate(edges) if set(e[1]) <= known]


def test_promised_goal():
    found = cheapest({"s"}, F3, {"t"}, witness({"s"}, F3, {"t"}), 2, 10**6, 10**6)
    assert found.proven and found.cost == 3


def test_random_graphs_match_brute_force():
    r, searched = random.Random(6), 0
    for _ in range(400):
        names, edges = oracle.random_graph(r, 6, 9, (0, 3))
        starts = set(r.sample(names, r.randint(0, 2)))
        targets = set(r.sample(names, r.randint(1, 2)))
        if not targets <= oracle.closure(starts, edges):
            continue
        low = max(oracle.depth(starts, edges)[t] for t in targets)
        found = cheapest(starts, edges, targets, witness(starts, edges, targets), low, 10**6, 10**6)
        assert found.proven and found.lower == found.cost == oracle.set_cost(starts, edges, targets)
        chosen = [edges[i] for i in found.edges]
        assert targets <= oracle.closure(starts, chosen) and sum(e[0] for e in chosen) == found.cost
        searched += found.nodes > 0
    assert searched >= 80


def test_budget_leaves_a_true_interval():
    r = random.Random(9)
    for _ in range(60):
        names, edges = oracle.random_graph(r, 6, 9, (1, 3))
        starts, targets = set(names[:2]), {names[-1]}
        if not targets <= oracle.closure(starts, edges):
            continue
        low = max(oracle.depth(starts, edges)[t] for t in targets)
        found = cheapest(starts, edges, targets, witness(starts, edges, targets), low, r.choice((0, 1, 2)), 10**6)
        assert found.lower <= oracle.set_cost(starts, edges, targets) <= found.cost

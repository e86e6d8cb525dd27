"""What the findings of round 4 ask for: edges end where they are read."""

import random
from collections import defaultdict

import numpy as np

from pairgrammar.operators import graph


def _components(edges):
    """Component (lowest node) and whether it has an odd cycle, of every node: walks over (node, side)."""
    near = defaultdict(set)
    for u, v, odd in edges:
        for side in (0, 1):
            near[u, side].add((v, side ^ odd))
            near[v, side ^ odd].add((u, side))
    out = {}
    for node in {n for n, _ in near}:
        seen, todo = {(node, 0)}, [(node, 0)]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[node] = min(n for n, _ in seen), (node, 1) in seen
    return out


def test_forest_keeps_components_and_odd_cycles():
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randrange(1, 14)
        edges = [(draw.randrange(n), draw.randrange(n), draw.random() < 0.7) for _ in range(draw.randrange(1, 16))]
        u, v, odd = (np.array(c) for c in zip(*edges))
        less = list(zip(*(c.tolist() for c in graph.forest(u.astype(np.int64), v.astype(np.int64), odd, n))))
        met = {x for e in edges for x in e[:2]}
        want = {k: c for k, c in _components(edges).items() if k in met}
        got = _components(less)
        assert all(got.get(k, (k, False)) == c for k, c in want.items()) and set(got) <= met
        assert len(less) <= len(met)


def test_repeated_edges_end_in_the_task_that_reads_them(spark, monkeypatch):
    """Of many edges no more are shuffled than there are nodes; an odd cycle split over tasks is still found."""
    rows = [(f"a{i % 30}", f"b{i % 7}") for i in range(3000)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), (None, "a0")]
    edges = spark.createDataFrame(rows, "left_tf string, right_tf string").repartition(4)
    want = [("a0", 37, False), ("s", 1, True), ("x", 3, True)]
    for held in (1 << 20, 40):
        monkeypatch.setattr(graph, "FOREST", held)
        assert sorted(map(tuple, graph.identifiability_components(edges).collect())) == want
    monkeypatch.setattr(graph, "FOREST", 1 << 20)
    assert graph.contracted(edges, "left_tf", "right_tf").count() <= 4 * 41

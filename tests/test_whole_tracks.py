"""Kernels over a track's graph take all of its nodes; against distances by relaxation of all pairs."""
import math
import random

import pandas as pd

from tessera.plans import kernel_queries as Q

R = random.Random(4)
N = 16
EDGES = {(k, k + 1): 9.0 for k in range(N - 1)} | {(R.randrange(N), R.randrange(N)): float(R.randrange(1, 20)) for _ in range(30)}
EDGES = {(u, v): w for (u, v), w in EDGES.items() if u != v}
TRACK = pd.DataFrame([(u, v, w, (u + v) % 7) for (u, v), w in sorted(EDGES.items())], columns=["u", "v", "w", "label"])


def distances(edges):
    d = {(a, b): 0.0 if a == b else edges.get((a, b), math.inf) for a in range(N) for b in range(N)}
    for k in range(N):
        for a in range(N):
            for b in range(N):
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def both():
    out = {}
    for (u, v), w in EDGES.items():
        out[u, v] = out[v, u] = min(w, out.get((u, v), math.inf))
    return out


def test_matrices():
    d = distances(EDGES)
    assert sorted(Q._matrix(TRACK)) == sorted((a, b, x) for (a, b), x in d.items() if x < math.inf)
    assert sorted(Q._costs(TRACK)) == sorted((a, b, 1_000_000 if x == math.inf else int(x * 1000)) for (a, b), x in d.items())


def test_orders_and_links():
    d, at, left, want = distances(both()), 0, set(range(N)), []
    while left:
        at = min(left, key=lambda n: (d[at, n], n))
        left.remove(at)
        want.append(at)
    assert list(Q._legal(TRACK)) == list(enumerate(want))
    links = dict(Q._links(TRACK))
    assert sorted(links) == list(range(N - 1))
    d = distances(EDGES)
    assert all(links[k] == d[k, k + 1] for k in range(3, N - 1))
    avoided = distances({(u, v): w for (u, v), w in EDGES.items() if (u + v) % 7 > 2})
    assert links[0] == (None if avoided[0, 1] == math.inf else avoided[0, 1])
    graph, stitched = both(), dict(Q._stitch(TRACK))
    d = distances(graph)
    assert sorted(stitched) == list(range(N - 1))
    for k, between in stitched.items():
        reach = {k: 0.0}
        for _ in range(between + 1):
            reach = {v: min(reach[u] + graph[u, v] for u in reach if (u, v) in graph) for v in range(N) if any((u, v) in graph for u in reach)}
        assert reach[k + 1] == d[k, k + 1]

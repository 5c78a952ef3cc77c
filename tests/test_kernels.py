import itertools
import math
import random

import pytest

from tessera.operators import kernels as K

R = random.Random(9)


def graph(n=9, m=16):
    return [(R.randrange(n), R.randrange(n), R.randrange(1, 20)) for _ in range(m)]


def test_shortest_paths_against_relaxation():
    for _ in range(20):
        edges = graph()
        want = {0: 0}
        for _ in range(10):
            for u, v, w in edges:
                if u in want and want[u] + w < want.get(v, math.inf):
                    want[v] = want[u] + w
        got = K.shortest_paths(K.adjacency(edges), 0)
        assert {k: v[0] for k, v in got.items()} == want
        for t in got:
            route = K.path_to(got, t)
            assert route[0] == 0 and route[-1] == t
    edges = [(0, 1, 1, "a"), (1, 2, 1, "b"), (0, 2, 9, "c")]
    assert K.shortest_paths(K.adjacency(edges), 0, avoid={"b"})[2][0] == 9
    assert 2 not in K.shortest_paths(K.adjacency(edges), 0, limit=1)


def test_matching_and_tree():
    pts = [(R.random(), R.random()) for _ in range(8)]
    cost = lambda a, b: math.dist(pts[a], pts[b])
    pairs, exact = K.minimum_matching(range(8), cost)

    def all_matchings(left):
        if not left:
            yield 0.0
            return
        a = left[0]
        for b in left[1:]:
            for rest in all_matchings([x for x in left if x not in (a, b)]):
                yield cost(a, b) + rest

    assert exact and abs(sum(cost(*p) for p in pairs) - min(all_matchings(list(range(8))))) < 1e-9
    tree = K.minimum_tree(list(range(6)), cost)
    best = min(sum(cost(*e) for e in t) for t in itertools.combinations(list(itertools.combinations(range(6), 2)), 5) if len(set(K.graph_components(t).values())) == 1 and len(K.graph_components(t)) == 6)
    assert abs(sum(e[2] for e in tree) - best) < 1e-9
    pairs, exact = K.minimum_matching(range(20), lambda a, b: abs(a - b))
    assert not exact and sorted(x for p in pairs for x in p) == list(range(20))


def test_postman():
    edges = [(0, 1, 2.0), (1, 2, 3.0), (2, 0, 4.0), (2, 3, 1.0)]
    tour, miles = K.postman_tour(edges, 0)
    assert miles == 11 and tour[0] == tour[-1] == 0
    walked = {frozenset(p) for p in itertools.pairwise(tour)}
    assert {frozenset(e[:2]) for e in edges} <= walked


def test_covers():
    for _ in range(15):
        target = set(range(7))
        cands = {k: (set(R.sample(range(7), R.randrange(1, 4))), R.randrange(1, 9)) for k in range(10)}
        cands |= {100 + x: ({x}, 9) for x in target}
        chosen, exact = K.exact_cover_min_cost(cands, target)
        best = min(sum(cands[k][1] for k in c) for n in range(1, 8) for c in itertools.combinations(cands, n) if set().union(*(cands[k][0] for k in c)) >= target)
        assert exact and sum(cands[k][1] for k in chosen) == best
        part = K.exact_partition(cands, target)
        cost = min(sum(cands[k][1] for k in c) for n in range(1, 8) for c in itertools.combinations(cands, n) if sorted(x for k in c for x in cands[k][0]) == sorted(target))
        assert sum(cands[k][1] for k in part) == cost
    with pytest.raises(ValueError):
        K.exact_cover_min_cost({1: ({1}, 1)}, {1, 2})


def test_orders_and_lines():
    segs = [((R.random(), R.random()), (R.random(), R.random())) for _ in range(5)]
    flags, gap = K.orient_for_continuity(segs)

    def total(fl):
        ends = [(s, e) if not f else (e, s) for (s, e), f in zip(segs, fl, strict=True)]
        return sum(K.haversine_miles(a[1], b[0]) for a, b in itertools.pairwise(ends))

    assert abs(gap - min(total(f) for f in itertools.product((False, True), repeat=5))) < 1e-9 and abs(total(flags) - gap) < 1e-9
    assert sorted(k for k, _ in K.nearest_order(segs, (0, 0))) == list(range(5))
    tour, _ = K.two_opt([(0, 0), (1, 1), (0, 1), (1, 0)])
    assert sorted(tour) == [0, 1, 2, 3]
    pts = [(-116.2, 43.6), (-116.21, 43.61), (-116.25, 43.7)]
    assert K.decode_polyline(K.encode_polyline(pts)) == pts
    assert K.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert K.simplify([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], 0.5) == [0, 2, 3, 4] and K.simplify([(0, 0), (1, 0.1), (2, 0)], 0.5, [1]) == [0, 1, 2]
    assert K.resample_since_keep([(0, 0), (0, 0.001), (0, 0.1)], 1) == [0, 2]
    assert K.monotonic_positions([[5, 1], [0, 3], [2]]) == [1, 3, 2]
    assert K.first_fit_decreasing([5, 7, 3, 9], 10) == [2, 1, 1, 0] and K.assign_days([5, 6, 5], [10, 10]) == [0, 1, 0]
    assert K.online_clusters([(0, 0), (0, 0.001), (1, 1)], 1) == [0, 0, 1]
    assert K.reprice_in_order([({1}, {1, 2}), ({2}, {2}), ({3, 1}, {3})]) == [("kept", 1), ("dropped", 0), ("shrunk", 1)]
    assert K.connected_combinations({1: {2}, 2: {1, 3}, 3: {2}}, 5, 2) == [(1,), (1, 2), (2,), (2, 3), (3,)]

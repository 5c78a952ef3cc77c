"""Covers hold the real segments of an owner, and outings are snapped across all owners; against plain Python."""
import itertools

import pandas as pd
import pytest

from tessera.operators import kernels as K
from tessera.plans import catalog

# Owner 1: segments 1, 13 and 25 have equal remainders by 12; outing 4 repeats what 1 and 2 hold, for less.
CLAIMS = {1: {1, 2}, 2: {13, 14}, 3: {25}, 4: {1, 2, 13, 14}, 5: {3, 15}, 6: set(range(1, 30, 2))}
OWNERS = {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3} | {k: k for k in range(1000, 1220)}
MINUTES = {1: 100, 2: 120, 3: 30, 4: 150, 5: 40, 6: 50}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("covers")
    n = len(OWNERS)
    pd.DataFrame({"o_orderkey": list(OWNERS), "o_custkey": list(OWNERS.values()), "o_orderstatus": ["O"] * n, "o_orderdate": pd.to_datetime(["1995-01-02"] * n).as_unit("us"), "o_totalprice": [MINUTES.get(k, 30) - 20.0 for k in OWNERS]}).to_parquet(at / "orders.parquet", index=False)
    pd.DataFrame([(o, s) for o, c in CLAIMS.items() for s in c], columns=["l_orderkey", "l_partkey"]).to_parquet(at / "lineitem.parquet", index=False)
    return lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, str(at)).collect())


def test_covers(rows):
    best = []
    for owner in (1, 2, 3):
        mine = [o for o in CLAIMS if OWNERS[o] == owner]
        target = set().union(*(CLAIMS[o] for o in mine))
        covers = [c for n in range(1, 5) for c in itertools.combinations(mine, n) if set().union(*(CLAIMS[o] for o in c)) == target]
        best += [(owner, o, True) for o in min(covers, key=lambda c: sum(MINUTES[o] for o in c))]
    assert best[:2] == [(1, 3, True), (1, 4, True)]
    for name in ("opt_01_set_cover", "opt_15_branch_and_bound"):
        assert rows(name) == best
    for name in ("opt_13_greedy_max_coverage", "opt_14_greedy_ratio_cover"):
        chosen = {o for _, o, _ in rows(name)}
        assert set().union(*(CLAIMS[o] for o in chosen if OWNERS[o] == 1)) == {1, 2, 13, 14, 25}
    assert rows("opt_08_exact_partition") == [(o, k) for o, k, _ in best]
    assert rows("opt_29_loop_selection") == [(1, 3, 1), (1, 4, 4), (2, 5, 2), (3, 6, 15)]
    assert rows("opt_34_repricing") == [(1, 1, "kept", 2), (1, 2, "kept", 2), (1, 3, "kept", 1), (1, 4, "dropped", 0), (2, 5, "kept", 2), (3, 6, "kept", 15)]


def test_snap(rows):
    where = {k: (-116.43 + k * 7919 % 5000 / 10000, 43.48 + k * 104729 % 3700 / 10000) for k in OWNERS}
    near = [(a, b) for a, b in itertools.combinations(where, 2) if K.haversine_miles(where[a], where[b]) <= 1.0]
    want = K.graph_components([*near, *((k, k) for k in where)])
    assert 10 < len(set(want.values())) < len(want) - 10
    assert rows("grf_10_snapped_endpoints") == sorted(want.items())

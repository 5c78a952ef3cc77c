"""Registered names have rules of their own, not those of another query."""
import pandas as pd

from tessera.operators import kernels as K
from tessera.plans import catalog, kernel_queries as Q


def test_no_name_shares_a_query():
    names = {k: v for k, v in catalog.queries().items() if k != "grf_09_directed_distances"}
    assert len({id(v) for v in names.values()}) == len(names)


def test_first_cluster():
    # The third point lies within the radius of both centres and nearer to the second.
    points = [(0.0, 0.0), (0.0, 0.0020), (0.0, 0.0011)]
    assert K.online_clusters(points, 180 / 1609.344, first=True) == [0, 1, 0]
    assert K.online_clusters(points, 180 / 1609.344) == [0, 1, 1]
    track = pd.DataFrame([(k, *p) for k, p in enumerate(points)], columns=["idx", "lon", "lat"])
    assert list(Q._dense(track)) == [(0, 0), (1, 1), (2, 0)]


def test_package_keeps_originals():
    outings = {1: ({1, 2}, 5), 2: ({2, 3}, 5), 3: ({1, 3}, 5), 4: ({1, 2, 3}, 9)}
    assert Q._package(outings, {1, 2, 3}) == ([4], True)
    assert Q._package(outings, {1, 2, 3}, max_states=0) == ([1, 2, 3, 4], False)


def test_union_find():
    track = pd.DataFrame([(1, 2, 1.0, 0), (3, 2, 1.0, 0), (5, 4, 1.0, 0)], columns=["u", "v", "w", "label"])
    assert list(Q._union_find(track)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]

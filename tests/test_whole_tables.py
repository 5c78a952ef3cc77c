"""Queries take every row of their tables: small tables with rows that no id or modulo filter lets through, against plain Python."""
import datetime
import itertools
from collections import defaultdict

import pandas as pd
import pytest

from tessera.functions.expressions import render
from tessera.plans import catalog

DAY = datetime.date(1970, 1, 1)
CLAIMS = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 5), (3, 5), (3, 7), (7, 8), (9, 9), (9, 13), (11, 9)]
OWNERS = {1: 1, 2: 1, 3: 2, 7: 2, 9: 3, 11: 7}
DAYS = {k: 26 + k % 5 for k in OWNERS}
EVENTS = [(1, 3, "click"), (2, 3, "refund"), (3, 5, "purchase"), (404, 7, "view"), (403, 9, "refund"), (6, 11, "view")]


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    put = lambda name, **c: pd.DataFrame(c).to_parquet(at / f"{name}.parquet", index=False)
    put("lineitem", l_orderkey=[o for o, _ in CLAIMS], l_partkey=[s for _, s in CLAIMS], l_suppkey=[2] * len(CLAIMS), l_quantity=[1.0] * len(CLAIMS))
    put("orders", o_orderkey=list(OWNERS), o_custkey=list(OWNERS.values()), o_orderstatus=["O"] * 6, o_orderdate=pd.to_datetime([DAY + datetime.timedelta(DAYS[k]) for k in OWNERS]).as_unit("us"), o_totalprice=[k * 60.0 for k in OWNERS])
    put("part", p_partkey=list(range(1, 14)), p_retailprice=[900.0 + k for k in range(1, 14)], p_name=["x"] * 13, p_size=[k % 20 for k in range(1, 14)], p_type=["red tin" if k == 3 else "zinc ash" for k in range(1, 14)])
    put("supplier", s_suppkey=list(range(1, 100, 9)), s_name=["s"] * 11, s_acctbal=[1.0] * 11)
    put("events", event_id=[e for e, _, _ in EVENTS], user_id=[u for _, u, _ in EVENTS], event_type=[t for _, _, t in EVENTS], ts=pd.to_datetime(["2024-01-05"] * len(EVENTS)).as_unit("us"), value=[1.0] * len(EVENTS))
    return str(at)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return lambda name: sorted(tuple(r) for r in catalog.queries()[name](spark, sf).collect())


def place(k):
    return -116.43 + k * 7919 % 5000 / 10000, 43.48 + k * 104729 % 3700 / 10000


def claims():
    by = defaultdict(set)
    for o, s in CLAIMS:
        by[o].add(s)
    return by


def components(edges):
    low = {x: x for e in edges for x in e}
    while any(low[u] != low[v] for u, v in edges):
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    return low


def test_components(rows):
    edges = [(o, 100000000 + s) for o, s in CLAIMS]
    whole = components(edges)
    assert rows("grf_12_components") == sorted(whole.items())
    assert rows("grf_13_components_avoiding") == sorted(components([e for e in edges if e[1] % 3]).items())
    assert rows("grf_14_component_sizes") == sorted((c, list(whole.values()).count(c)) for c in set(whole.values()))


def test_combinations(rows):
    anchors = list(range(1, 100, 9))
    lat, minutes = {k: place(k * 31 + 7)[1] for k in anchors}, {k: 40 + k % 50 for k in anchors}
    near = lambda a, b: abs(lat[a] - lat[b]) < 0.1
    want = [(a, b, c, minutes[a] + minutes[b] + minutes[c]) for a, b, c in itertools.combinations(anchors, 3) if near(a, b) and near(b, c) and minutes[a] + minutes[b] + minutes[c] <= 200]
    assert any(c > 60 for _, _, c, _ in want) and rows("opt_19_field_day_combos") == want
    by = {o: {s % 4 for s in c} for o, c in claims().items()}
    assert rows("opt_24_covering_combos") == [(a, b) for a, b in itertools.combinations(sorted(by), 2) if by[a] | by[b] == {0, 1, 2, 3}]


def test_claims(rows):
    by = claims()
    pairs = [(a, b) for a, b in itertools.permutations(sorted(by), 2) if by[a] & by[b]]
    assert rows("opt_33_removal_simulation") == sorted((a, b, "removed" if by[b] <= by[a] else "shrunk") for a, b in pairs)
    assert rows("join_22_latent_relationships") == [(a, b, ",".join(map(str, sorted(by[a] & by[b])))) for a, b in pairs if a < b]
    short = [s for s in range(1, 14) if s % 20 <= 10]
    near = lambda s, t: all(abs(x - y) < 0.02 for x, y in zip(place(s), place(t), strict=True))
    assert rows("join_27_tail_opportunities") == sorted({(o, t) for o in by for s in by[o] for t in short if t not in by[o] and near(s, t)})


def test_ledger(rows):
    kinds = defaultdict(set)
    for e, _, t in EVENTS:
        kinds[e % 400].add({"click": "completed", "view": "completed", "purchase": "missed"}.get(t, "blocked"))
    assert rows("stm_02_fold_to_state") == sorted((s, next(k for k in ("blocked", "completed", "missed") if k in kinds[s])) for s in kinds)
    assert rows("agg_10_set_fold") == sorted(("2024-01", s) for s in kinds if "completed" in kinds[s] and "blocked" not in kinds[s])


def test_days_and_tokens(spark, sf, rows):
    outings = spark.sql(render("SELECT minutes <= 240 AND foot_miles <= 10 AND ascent_ft <= 2000 FROM @outings() o").replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`")).collect()
    small = sum(r[0] for r in outings)
    assert 0 < small < len(outings)
    assert rows("flt_14_day_constraints") == sorted((d, len(outings) if d % 30 < 25 else small) for d in set(DAYS.values()))
    assert rows("str_05_token_overlap") == [(k, "red tin" if k == 3 else "zinc ash", "part") for k in range(1, 14)]

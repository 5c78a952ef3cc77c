"""Queries with a Spark text of their own: small tables with answers known, and plans that hold no table in the driver."""
import datetime
import random

import pandas as pd
import pytest

from tessera.plans import catalog
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2024, 1, 5)


def tables(at, **columns):
    for name, frame in columns.items():
        pd.DataFrame(frame).to_parquet(at / f"{name}.parquet", index=False)
    return str(at)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("orders, claimed, passed, uncovered", [([1, 2], [1, 2], True, 0), ([1, 2], [1, 1], False, 1), ([1, 2], [1, None], True, 0), ([None, 2], [2, 2], True, 0), ([None, 2], [], False, 2)])
def test_claims_by_anti_join(spark, tmp_path, orders, claimed, passed, uncovered):
    keys = lambda k: pd.array(k, dtype="Int64")
    sf = tables(
        tmp_path,
        orders={"o_orderkey": keys(orders), "o_custkey": [1, 1], "o_orderstatus": ["O", "F"], "o_orderdate": pd.to_datetime([DAY, DAY]).as_unit("us"), "o_totalprice": [400.0, 10.0]},
        part={"p_partkey": keys(orders), "p_name": ["x", "y"], "p_size": [1, 2]},
        lineitem={"l_orderkey": keys(claimed), "l_partkey": keys(claimed)},
    )
    gates, proof = (catalog.queries()[k](spark, sf) for k in ("aud_06_requirements", "aud_15_schedule_proof"))
    assert {r.gate: r.passed for r in gates.collect()}["every_outing_claims"] == passed
    assert {r.issue: r.n for r in proof.collect()}.get("uncovered", 0) == uncovered
    con = connect(sf)
    for name in ("aud_06_requirements", "aud_15_schedule_proof"):
        assert check(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], sf) in (None, "no rows")


@pytest.mark.parametrize("name", ["aud_06_requirements", "aud_15_schedule_proof"])
def test_no_keys_in_the_driver(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "LeftAnti" in text and "BroadcastHashJoin" not in text


def test_sums_in_the_order_of_events(spark, tmp_path):
    # Added in one order they reach the half at which 90.65 becomes 907 tenths, in the other they stay below it.
    values = {7: 16.96, 8: 26.27, 9: 47.42}
    answers = []
    for order in ([7, 8, 9], [7, 9, 8]):
        at = tmp_path / "".join(map(str, order))
        at.mkdir()
        sf = tables(at, events={"event_id": order, "user_id": [1] * 3, "ts": pd.to_datetime([DAY] * 3).as_unit("us"), "event_type": ["view"] * 3, "value": [values[k] for k in order]})
        answers.append(tuple(catalog.queries()["agg_09_five_numbers"](spark, sf).first()))
    assert len(set(answers)) == 1


NEAR = ("join_05_nearest_within_tolerance", "join_17_named_overlap", "join_19_endpoint_adjacency", "join_20_road_band", "join_26_neighbour_top_k", "join_29_track_index_match", "grf_25_heal_graph", "opt_19_field_day_combos", "srt_06_top_k_plus_forced", "join_09_best_match", "join_11_orientation_match", "join_15_edge_preference", "str_04_name_similarity")


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Places repeat every 185,000 keys: several segments and anchors on one place, and lone ones far off."""
    parts = [k + 185_000 * n for k in sorted(random.Random(1).sample(range(9_000), 300)) for n in range(1 + k % 4)]
    anchors = [k + 185_000 * n for k in sorted(random.Random(2).sample(range(900), 40)) for n in range(1 + k % 3)]
    return tables(
        tmp_path_factory.mktemp("crowded"),
        part={"p_partkey": parts, "p_name": [("red tin", "blue ash", "old oak")[k % 3] if k % 50 else f"lone {k}" for k in parts], "p_type": [("TIN", "BRASS", "OLD TIN")[k % 3] for k in parts], "p_size": [k % 50 + 1 for k in parts]},
        supplier={"s_suppkey": anchors, "s_name": [f"blue {k % 5}" for k in anchors], "s_acctbal": [k * 37 % 4000 - 100.0 if k % 11 else None for k in anchors]},
        events={"event_id": list(range(0, 4000, 13)), "user_id": [k % 9 for k in range(0, 4000, 13)], "ts": pd.to_datetime([DAY] * 308).as_unit("us"), "event_type": ["view"] * 308, "value": [1.0] * 308},
    )


@pytest.mark.parametrize("name", [n for n in NEAR if n in catalog.oracle_sql()])
def test_crowded_places(spark, crowded, name):
    assert check(spark, connect(crowded), catalog.queries()[name], catalog.oracle_sql()[name], crowded) is None


@pytest.mark.parametrize("name", ["join_05_nearest_within_tolerance", "join_17_named_overlap", "join_19_endpoint_adjacency", "join_20_road_band", "join_26_neighbour_top_k", "grf_25_heal_graph", "srt_06_top_k_plus_forced", "join_09_best_match", "str_04_name_similarity"])
def test_no_pairs_of_all_rows(spark, crowded, name):
    text = plan(catalog.queries()[name](spark, crowded))
    assert "NestedLoop" not in text and "Cartesian" not in text and "rank" not in text.lower() and "Window" not in text


def test_tracks_meet_counts(spark, crowded):
    text = plan(catalog.queries()["join_29_track_index_match"](spark, crowded))
    assert "sum(n#" in text


def test_triples_in_many_tasks(spark, crowded):
    assert catalog.queries()["opt_19_field_day_combos"](spark, crowded).rdd.getNumPartitions() >= 48


@pytest.mark.parametrize("name", ["join_11_orientation_match", "join_15_edge_preference"])
def test_few_rows_kept_of_a_dense_place(spark, tmp_path, monkeypatch, name):
    """Over a hundred segments within half a mile of an anchor: the search keeps the nearest of each kind, not all within its slack."""
    from tessera.operators import nearest as module

    parts = [5 + 185_000 * n for n in range(20)] + [k for k in range(185_000) if abs(k * 7919 % 5000 - 5 * 7919 % 5000) < 60 and abs(k * 104729 % 3700 - 5 * 104729 % 3700) < 40]
    sf = tables(tmp_path, supplier={"s_suppkey": [(5 - 7) * pow(31, -1, 185_000) % 185_000], "s_name": ["a"], "s_acctbal": [1.0]}, part={"p_partkey": parts, "p_name": ["x"] * len(parts), "p_type": ["x"] * len(parts), "p_size": [k % 50 + 1 for k in parts]})
    kept, keep = [], module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df: kept.append(keep(df)) or kept[-1])
    assert check(spark, connect(sf), catalog.queries()[name], catalog.oracle_sql()[name], sf) is None
    assert len(parts) > 100 and max(df.count() for df in kept if "miles" in df.columns) < 60


@pytest.mark.parametrize("name", ["join_12_coverage_match", "join_13_completion_review"])
def test_samples_are_not_built_in_the_driver(spark, name):
    assert "BroadcastHashJoin" not in plan(catalog.queries()[name](spark, SF))


def test_covering_combos_in_blocks(spark, tmp_path):
    # Ids far apart, below zero and null, segments below zero and null, more outings of a mask than a block takes.
    r = random.Random(4)
    ids = r.sample(range(-(10**12), 10**12), 900) + list(range(2, 902))
    claims = [(k, s) for k in ids for s in r.sample(range(1, 60), r.choice((1, 2, 3, 6)))] + [(ids[0], None), (ids[1], None), (ids[2], -1), (ids[2], -5), (None, 1), (None, 7)]
    sf = tables(tmp_path, lineitem={"l_orderkey": pd.array([a for a, _ in claims], dtype="Int64"), "l_partkey": pd.array([b for _, b in claims], dtype="Int64")})
    name = "opt_24_covering_combos"
    catalog.queries()[name](spark, sf).coalesce(1).write.parquet(str(tmp_path / "out"))
    got = pd.read_parquet(tmp_path / "out").sort_values(["a", "b"], ignore_index=True)
    assert got.equals(connect(sf).execute(f"SELECT * FROM ({catalog.oracle_sql()[name]}) ORDER BY a, b").df())
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.8 * len(got)

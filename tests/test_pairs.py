"""Queries whose result is all pairs: against their SQL on tables with nulls, copies and large groups, and what they shuffle for it."""
import random

import pandas as pd
import pytest

from tessera.plans import catalog
from tests.compare import check, connect


def shuffled(spark, query, sf):
    """(rows of the result, records that its stages shuffled)."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = written()
    rows = len(query(spark, sf).collect())
    return rows, sum(n for k, n in written().items() if k not in before)


def claimed(at, claims, parts=range(0)):
    pd.DataFrame({"l_orderkey": pd.array([o for o, _ in claims], dtype="Int64"), "l_partkey": pd.array([s for _, s in claims], dtype="Int64")}).to_parquet(at / "lineitem.parquet", index=False)
    pd.DataFrame({"p_partkey": pd.array(list(parts), dtype="Int64"), "p_name": ["x"] * len(parts), "p_size": pd.array([None if k is None else k % 50 + 1 for k in parts], dtype="Int64")}).to_parquet(at / "part.parquet", index=False)
    return str(at)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Copies of outings, repeated claims, an outing of 400 segments, nulls on both sides, a segment that many claim, places that repeat."""
    pick = random.Random(3)
    claims = [(o, pick.randrange(900)) for o in range(300) for _ in range(1 + o % 9)]
    claims += [(o + 1000, s) for o, s in claims if o % 10 == 0] + [(2000, s) for s in range(400)] + [(3000 + k, 7) for k in range(30)]
    claims += [(5, None), (3001, None), (4000, None), (None, 7), (None, None), (-4, -7), (-5, 7), (-5, 8), *claims[:40]]
    parts = [*range(0, 900), *range(185_000, 185_060), None, 7]
    return claimed(tmp_path_factory.mktemp("odd"), claims, parts)


def test_removal_of_odd_claims(spark, odd):
    assert check(spark, connect(odd), catalog.queries()["opt_33_removal_simulation"], catalog.oracle_sql()["opt_33_removal_simulation"], odd) is None


def test_removal_shuffles_claims_not_pairs(spark, tmp_path):
    # 60 outings on each segment: 212,400 pairs of 3,600 claims
    sf = claimed(tmp_path, [(o, s) for o in range(3600) for s in [o % 60]] + [(10_000 + o, 100 + o) for o in range(100)])
    rows, moved = shuffled(spark, catalog.queries()["opt_33_removal_simulation"], sf)
    assert rows == 60 * 60 * 59 and moved < 40_000


def test_tail_of_odd_claims(spark, odd):
    assert check(spark, connect(odd), catalog.queries()["join_27_tail_opportunities"], catalog.oracle_sql()["join_27_tail_opportunities"], odd) is None


def test_tail_of_groups_over_batches(spark, odd):
    """Groups go on over batches: one that becomes large, and one that ends with the last batch."""
    query, sql = catalog.queries()["join_27_tail_opportunities"], catalog.oracle_sql()["join_27_tail_opportunities"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert check(spark, connect(odd), query, sql, odd) is None
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tail_shuffles_claims_not_pairs(spark, tmp_path):
    # 100 short segments on one place, each outing claims one of them
    sf = claimed(tmp_path, [(o, 185_000 * 50 * (o % 100)) for o in range(1000)], [185_000 * 50 * k for k in range(100)])
    rows, moved = shuffled(spark, catalog.queries()["join_27_tail_opportunities"], sf)
    assert rows == 1000 * 99 and moved < 20_000

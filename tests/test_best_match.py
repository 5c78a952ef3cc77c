"""Matches up to two miles east or west are found, where 0.03 degrees of longitude are only 1.5 miles."""
import pandas as pd

from tessera.operators.kernels import haversine_miles
from tessera.plans import catalog


def place(k):
    return -116.43 + k * 7919 % 5000 / 10000, 43.48 + k * 104729 % 3700 / 10000


def test_wide_matches(spark, tmp_path):
    here = place(38)
    far = next(k for k in range(1, 100_000) if abs(place(k)[0] - here[0]) > 0.032 and haversine_miles(place(k), here) <= 2)
    out = next(k for k in range(1, 100_000) if 2 < haversine_miles(place(k), here) < 2.05)
    pd.DataFrame({"s_suppkey": [1], "s_name": ["a"], "s_acctbal": [1.0]}).to_parquet(tmp_path / "supplier.parquet", index=False)
    pd.DataFrame({"p_partkey": [far, out], "p_name": ["b", "a"], "p_size": [1, 1]}).to_parquet(tmp_path / "part.parquet", index=False)
    assert [tuple(r) for r in catalog.queries()["join_09_best_match"](spark, str(tmp_path)).collect()] == [(1, far)]

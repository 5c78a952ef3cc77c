"""Widening cells against all pairs: sparse and crowded places, ties, slack and a limit."""

import math
import random

from tessera.operators.kernels import haversine_miles
from tessera.operators.nearest import nearest


def test_against_all_pairs(spark):
    r = random.Random(6)
    left = [(k, r.uniform(-117, -115), r.uniform(42, 45)) for k in range(60)] + [(90, None, 43.0), (91, -150.0, 10.0)]
    right = [(k, -116 + r.gauss(0, 0.02), 43 + r.gauss(0, 0.02)) for k in range(150)] + [(200 + k, r.uniform(-117, -115), r.uniform(42, 45)) for k in range(12)]
    right += [(300, *left[0][1:]), (299, *left[0][1:]), (400, 1.0, None)]
    a = spark.createDataFrame(left, "k long, lon double, lat double")
    b = spark.createDataFrame(right, "s long, lon double, lat double")
    for slack, limit in ((0.0, math.inf), (2.0, math.inf), (0.0, 5.0), (1.0, 5.0)):
        want = set()
        for k, x, y in left:
            away = sorted((int(haversine_miles((x, y), p[1:]) * 1e6 + 0.5), p[0], haversine_miles((x, y), p[1:])) for p in right if p[2] is not None) if x is not None else []
            away = [z for z in away if z[2] <= limit]
            want |= {(k, z[1]) for z in (away if slack else away[:1]) if z[2] <= away[0][2] + slack}
        for start in (None, 0.5):
            assert {(q.k, q.s) for q in nearest(a, b, "k", "s", slack, limit, start).collect()} == want
    assert nearest(a, b.limit(0), "k", "s").count() == nearest(a.limit(0), b, "k", "s").count() == 0

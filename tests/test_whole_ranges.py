"""Sorts and ranges have no cap: more than 100 outings, and dates over more than a week; against plain Python."""
import datetime

import pandas as pd

from tessera.plans import catalog

N = 230
DAY = datetime.date(1970, 1, 1)


def test_every_place_and_day(spark, tmp_path):
    cost, owner, day = [k * 7 % 300 for k in range(N)], [k % 3 for k in range(N)], [k * 11 % 40 + 5 * (k % 3) for k in range(N)]
    pd.DataFrame({"o_orderkey": range(N), "o_custkey": owner, "o_orderstatus": ["FO"[k % 2] for k in range(N)], "o_orderdate": pd.to_datetime([DAY + datetime.timedelta(d) for d in day]).as_unit("us"), "o_totalprice": [float(c) for c in cost]}).to_parquet(tmp_path / "orders.parquet", index=False)
    bucket = lambda m: next((b for top, b in ((60, "under_1_hour"), (119, "one_to_two_hours"), (180, "two_to_three_hours"), (240, "three_to_four_hours")) if m <= top), "four_plus_hours")
    order = sorted(range(N), key=lambda k: (bucket(20 + cost[k]), k % 2 == 0 and -1 or 0, -(k * 37 % 190), 20 + cost[k], k))
    got = {r.outing_id: r.place for r in catalog.queries()["srt_01_menu_sort"](spark, str(tmp_path)).collect()}
    assert sorted(got, key=got.get) == order and sorted(got.values()) == list(range(1, N + 1))
    spans = {o: [d for d, x in zip(day, owner, strict=True) if x == o] for o in range(3)}
    want = [(o, d) for o, s in spans.items() for d in range(min(s), max(s) + 1)]
    assert all(max(s) - min(s) > 7 for s in spans.values())
    assert sorted(tuple(r) for r in catalog.queries()["str_22_date_range"](spark, str(tmp_path)).collect()) == want

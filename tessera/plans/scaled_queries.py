"""Spark's own texts of queries whose shared text is no plan for large tables; the shared text stays their oracle."""

# What NOT IN means for nulls, without its broadcast of the other side: no row where that has a null, every row where it is empty.
_CLAIM_KEYS = "(SELECT count(*) AS every, count_if({key} IS NULL) AS unknown FROM lineitem) k"
_EVENT_ORDER = "array_sort(collect_list(CASE WHEN value IS NOT NULL THEN named_struct('e', event_id, 'v', value) END))"
# Claims with the bits (of 256) that the outing's other segments hash to: outings that share a segment and none of these bits share
# no other segment, so only the rest has to be counted. Both parts read one shuffle, so they take the same columns of it.
_WORDS = range(4)
_MARKED = (
    "WITH c AS (SELECT DISTINCT l_orderkey AS outing_id, l_partkey AS seg_id FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL) l), "
    "b AS (SELECT *, count(*) OVER (PARTITION BY outing_id, bit) > 1 AS twice FROM (SELECT *, CAST(pmod(xxhash64(seg_id), 256) AS INT) AS bit FROM c)), "
    f"w AS (SELECT *, {', '.join(f'CASE WHEN bit DIV 64 = {k} THEN shiftleft(1L, bit % 64) ELSE 0L END AS w{k}' for k in _WORDS)} FROM b), "
    f"m AS (SELECT outing_id, seg_id, count(*) OVER (PARTITION BY outing_id) AS n, {', '.join(f'bit_or(w{k}) OVER (PARTITION BY outing_id) & ~CASE WHEN twice THEN 0L ELSE w{k} END AS w{k}' for k in _WORDS)} FROM w), "
    "s AS (SELECT * FROM m WHERE seg_id IS NOT NULL) "
)
_PAIRS = "FROM s x JOIN s y ON x.seg_id = y.seg_id AND x.outing_id < y.outing_id AND (" + " | ".join(f"(x.w{k} & y.w{k})" for k in _WORDS) + ")"
# Outings of one mask in blocks of 256 ids that lie together: blocks are joined, not outings, and an outing's partners stand one
# after another in the order in which the next outing has them, which files hold in few bytes. Where blocks end is of no account.
_MASK_BLOCKS = (
    "WITH c AS (SELECT DISTINCT l_orderkey AS outing_id, l_partkey % 4 AS t FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL) l), "
    "m AS (SELECT outing_id, CAST(sum(CASE t WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) AS BIGINT) AS mask FROM c GROUP BY outing_id), "
    "s AS (SELECT * FROM (SELECT /*+ REPARTITION_BY_RANGE(mask, outing_id) */ * FROM m) m SORT BY mask, outing_id), "
    "k AS (SELECT outing_id, mask, monotonically_increasing_id() DIV 256 AS block FROM s), "
    "g AS (SELECT /*+ REPARTITION(24) */ mask, sort_array(collect_list(outing_id)) AS ids, min(outing_id) AS lo, max(outing_id) AS hi FROM k GROUP BY mask, block) "
)
_BOTH_WAYS = "SELECT stack(2, a, b, CASE WHEN covered = bn THEN 'removed' ELSE 'shrunk' END, b, a, CASE WHEN covered = an THEN 'removed' ELSE 'shrunk' END) AS (subject, outing_id, effect) FROM"

SQL = {
    "aud_06_requirements": "SELECT 'targets' AS gate, count(*) > 0 AS passed FROM @segments() s UNION ALL "
    "SELECT 'every_outing_claims', unknown > 0 OR CASE WHEN every = 0 THEN outings ELSE named END = 0 FROM (SELECT count(*) AS outings, count(outing_id) AS named FROM (SELECT /*+ MERGE(l) */ o.outing_id FROM @outings() o LEFT ANTI JOIN lineitem l ON l.l_orderkey = o.outing_id) x) o CROSS JOIN "
    + _CLAIM_KEYS.format(key="l_orderkey")
    + " UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT seg_id) FROM @segments() s UNION ALL SELECT 'no_negative_minutes', min(minutes) >= 0 FROM @outings() o",
    # Tracks meet the number of segments of a cell, not each of them.
    "join_29_track_index_match": "WITH t AS (SELECT DISTINCT track_id, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @track() t), s AS (SELECT @floor(lon * 20) AS cx, @floor(lat * 20) AS cy, count(*) AS n FROM @segments() s GROUP BY 1, 2) SELECT t.track_id, @isum(s.n) AS n FROM t JOIN s ON s.cx = t.cx AND s.cy = t.cy GROUP BY t.track_id",
    "opt_19_field_day_combos": "WITH l AS (SELECT anchor_id, lon, lat, 40 + anchor_id % 50 AS minutes FROM @anchors() a), p AS (SELECT /*+ REPARTITION(48) */ i.anchor_id AS a, j.anchor_id AS b, j.lat, i.minutes + j.minutes AS minutes FROM l i JOIN l j ON i.anchor_id < j.anchor_id AND abs(i.lat - j.lat) < 1e-1) SELECT p.a, p.b, k.anchor_id AS c, p.minutes + k.minutes AS minutes FROM p JOIN l k ON p.b < k.anchor_id AND abs(p.lat - k.lat) < 1e-1 WHERE p.minutes + k.minutes <= 200",
    "aud_15_schedule_proof": "SELECT issue, count(*) AS n FROM (SELECT 'over_bound' AS issue FROM @outings() o WHERE minutes > 360 UNION ALL "
    "SELECT 'uncovered' FROM (SELECT /*+ MERGE(l) */ s.seg_id FROM @segments() s LEFT ANTI JOIN lineitem l ON l.l_partkey = s.seg_id) s CROSS JOIN "
    + _CLAIM_KEYS.format(key="l_partkey")
    + " WHERE unknown = 0 AND (seg_id IS NOT NULL OR every = 0) UNION ALL SELECT 'claimed_twice' FROM (SELECT seg_id FROM @claims() c GROUP BY seg_id HAVING count(*) > 1) x) y GROUP BY issue",
    # A day's values are added in the order of events: floating sums depend on it, and files are read in any order.
    "agg_09_five_numbers": f"WITH s AS (SELECT user_id, @day(ts) AS day, {_EVENT_ORDER} AS s, count(*) AS n FROM events GROUP BY user_id, @day(ts)), "
    "d AS (SELECT user_id, n, CASE WHEN size(s) > 0 THEN aggregate(s, 0e0, (t, x) -> t + x.v) END AS v FROM s) "
    "SELECT user_id, @q(min(v),1e2) AS lo, @q(@percentile(v,5e-1),1e1) AS mid, @q(max(v),1e2) AS hi, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_days FROM d GROUP BY user_id",
    "opt_24_covering_combos": f"{_MASK_BLOCKS} SELECT a, b FROM (SELECT a, ids FROM (SELECT p.ids AS firsts, q.ids FROM g p JOIN g q ON (p.mask | q.mask) = 15 AND p.lo < q.hi) j LATERAL VIEW explode(firsts) x AS a) j LATERAL VIEW explode(ids) y AS b WHERE a < b",
    "opt_33_removal_simulation": f"{_MARKED} {_BOTH_WAYS} (SELECT x.outing_id AS a, y.outing_id AS b, x.n AS an, y.n AS bn, 1L AS covered {_PAIRS} = 0) p UNION ALL "
    f"{_BOTH_WAYS} (SELECT x.outing_id AS a, y.outing_id AS b, x.n AS an, y.n AS bn, count(*) AS covered {_PAIRS} <> 0 GROUP BY 1, 2, 3, 4) p",
}

"""Graph, combination, ledger, rule and audit operators that relations express (GRF, OPT, STM, UDF, AUD)."""

SQL = {
    "grf_01_edge_table": "SELECT track_id, idx, @node4(lon) AS x, @node4(lat) AS y, @node4(lon2) AS x2, @node4(lat2) AS y2, @q(@haversine_miles(lon,lat,lon2,lat2),1e4) AS d FROM (SELECT track_id, idx, lon, lat, lead(lon) OVER (PARTITION BY track_id ORDER BY idx) AS lon2, lead(lat) OVER (PARTITION BY track_id ORDER BY idx) AS lat2 FROM @track() t) l WHERE lon2 IS NOT NULL",
    "grf_02_edge_guard": "SELECT a.seg_id, b.seg_id AS other_id FROM @segments() a JOIN @segments() b ON b.seg_id = a.seg_id + 1 WHERE @haversine_miles(a.lon,a.lat,b.lon,b.lat) > 0",
    "grf_03_graph_assembly": "SELECT kind, count(*) AS n FROM (SELECT 'official' AS kind, seg_id AS k FROM @segments() s UNION ALL SELECT 'official', seg_id FROM @segments() s WHERE direction = 'both' UNION ALL SELECT 'connector', o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '5%') x GROUP BY kind",
    "grf_07_distance_or_gap": "SELECT a.anchor_id, b.anchor_id AS other_id, @q(coalesce(CASE WHEN a.anchor_id % 3 = b.anchor_id % 3 THEN (a.anchor_id + b.anchor_id) / 10e0 END, 125e-2 * @haversine_miles(a.lon,a.lat,b.lon,b.lat)),1e4) AS d FROM @anchors() a JOIN @anchors() b ON b.anchor_id BETWEEN a.anchor_id + 1 AND a.anchor_id + 4",
    "grf_15_odd_nodes": "SELECT node, count(*) AS degree FROM (SELECT l_suppkey AS node FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) x GROUP BY node HAVING count(*) % 2 = 1",
    "grf_25_heal_graph": "WITH s AS (SELECT seg_id, seg_id % 2 AS comp, lon, lat FROM @segments() s), d AS (SELECT a.comp AS a, b.comp AS b, a.seg_id AS x, b.seg_id AS y, row_number() OVER (PARTITION BY a.comp, b.comp ORDER BY @q(@haversine_miles(a.lon,a.lat,b.lon,b.lat),1e6), a.seg_id, b.seg_id) AS r FROM s a JOIN s b ON a.comp < b.comp AND abs(a.lon - b.lon) < 3e-2 AND abs(a.lat - b.lat) < 3e-2) SELECT a, b, x, y FROM d WHERE r = 1",
    "grf_26_elevation_cost": "SELECT seg_id, @q(miles + (seg_id % 900) * 3 / 5280e0,1e4) AS cost FROM @segments() s",
    "grf_30_access_orientation": "SELECT outing_id, forward FROM (SELECT o.outing_id, f.forward, row_number() OVER (PARTITION BY o.outing_id ORDER BY (o.outing_id * 3 + f.forward * 7) % 5 DESC, (o.outing_id + f.forward * 11) % 17, f.forward DESC) AS r FROM @outings() o CROSS JOIN (SELECT 0 AS forward UNION ALL SELECT 1) f) x WHERE r = 1",
    "grf_32_return_strategy": "SELECT strategy, count(*) AS n FROM (SELECT CASE WHEN outing_id % 10 = 0 THEN 'closed_loop' WHEN foot_miles <= greatest(minutes / 60e0 * 15e-1, 25e-1) THEN 'mapped_return' WHEN outing_id % 3 = 0 THEN 'out_and_back' ELSE 'estimated_connector' END AS strategy FROM @outings() o) x GROUP BY strategy",
    "opt_19_field_day_combos": "WITH l AS (SELECT anchor_id, lon, lat, 40 + anchor_id % 50 AS minutes FROM @anchors() a) SELECT i.anchor_id AS a, j.anchor_id AS b, k.anchor_id AS c, i.minutes + j.minutes + k.minutes AS minutes FROM l i JOIN l j ON i.anchor_id < j.anchor_id AND abs(i.lat - j.lat) < 1e-1 JOIN l k ON j.anchor_id < k.anchor_id AND abs(j.lat - k.lat) < 1e-1 WHERE i.minutes + j.minutes + k.minutes <= 200",
    "opt_21_best_permutation": "WITH l AS (SELECT anchor_id, lon, lat, @floor((anchor_id - 1) / 3e0) AS trio FROM @anchors() a), p AS (SELECT x.trio, x.anchor_id AS a, y.anchor_id AS b, z.anchor_id AS c, @haversine_miles(x.lon,x.lat,y.lon,y.lat) + @haversine_miles(y.lon,y.lat,z.lon,z.lat) AS d FROM l x JOIN l y ON x.trio = y.trio AND x.anchor_id <> y.anchor_id JOIN l z ON z.trio = x.trio AND z.anchor_id <> x.anchor_id AND z.anchor_id <> y.anchor_id) SELECT trio, a, b, c FROM (SELECT trio, a, b, c, row_number() OVER (PARTITION BY trio ORDER BY @q(d,1e6), a, b) AS r FROM p) w WHERE r = 1",
    "opt_22_same_anchor_combos": "SELECT a.outing_id AS a, b.outing_id AS b, a.minutes + b.minutes AS minutes FROM @outings() a JOIN @outings() b ON a.owner_id = b.owner_id AND a.outing_id < b.outing_id WHERE a.minutes + b.minutes <= 390",
    "opt_23_component_combos": "SELECT owner_id, a, b FROM (SELECT a.owner_id, a.outing_id AS a, b.outing_id AS b, row_number() OVER (PARTITION BY a.owner_id ORDER BY @q(a.foot_miles + b.foot_miles,1e2), a.outing_id, b.outing_id) AS r FROM @outings() a JOIN @outings() b ON a.owner_id = b.owner_id AND a.outing_id < b.outing_id) x WHERE r = 1",
    "opt_24_covering_combos": "WITH c AS (SELECT DISTINCT outing_id, seg_id % 4 AS t FROM @claims() c), m AS (SELECT outing_id, CAST(sum(CASE t WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) AS BIGINT) AS mask FROM c GROUP BY outing_id) SELECT a.outing_id AS a, b.outing_id AS b FROM m a JOIN m b ON a.outing_id < b.outing_id AND (a.mask | b.mask) = 15",
    "opt_25_two_way_partitions": "WITH o AS (SELECT outing_id, count(*) AS n FROM @claims() c GROUP BY outing_id HAVING count(*) BETWEEN 2 AND 5), m AS (SELECT outing_id, n, @series(CAST(1 AS BIGINT), CAST(pow(2, n) AS BIGINT) - 2) AS mask FROM o) SELECT outing_id, mask FROM m WHERE @popcount(mask) <= 3 AND mask % 2 = 1",
    "opt_26_owner_choice": "SELECT seg_id, outing_id FROM (SELECT c.seg_id, c.outing_id, row_number() OVER (PARTITION BY c.seg_id ORDER BY o.day, @q(o.foot_miles,1e2), o.outing_id) AS r FROM @claims() c JOIN @outings() o ON o.outing_id = c.outing_id WHERE o.status <> 'P') x WHERE r = 1",
    "opt_33_removal_simulation": "WITH s AS (SELECT outing_id AS subject, seg_id FROM @claims() c), n AS (SELECT outing_id, count(*) AS n FROM @claims() c GROUP BY outing_id), h AS (SELECT s.subject, c.outing_id, count(*) AS covered FROM s JOIN @claims() c ON c.seg_id = s.seg_id AND c.outing_id <> s.subject GROUP BY s.subject, c.outing_id) SELECT h.subject, h.outing_id, CASE WHEN h.covered = n.n THEN 'removed' ELSE 'shrunk' END AS effect FROM h JOIN n ON n.outing_id = h.outing_id",
    "opt_37_reorder_scenarios": "WITH o AS (SELECT outing_id, owner_id, @day(day) AS d, minutes FROM @outings() o) SELECT a.outing_id AS source, b.outing_id AS owner, CASE WHEN a.d = b.d THEN 'delete_owner_same_day' WHEN a.d > b.d THEN 'swap_source_ahead' ELSE 'in_order' END AS scenario, a.minutes + b.minutes <= 600 AS fits FROM o a JOIN o b ON a.owner_id = b.owner_id AND a.outing_id <> b.outing_id",
    "stm_01_ledger_upsert": "SELECT epoch, day_id, event_id, kind FROM (SELECT epoch, day_id, event_id, kind, row_number() OVER (PARTITION BY epoch, day_id, user_id ORDER BY event_id DESC) AS r FROM @ledger() l) x WHERE r = 1",
    "stm_02_fold_to_state": "SELECT seg_id, CASE WHEN bool_or(kind = 'blocked') THEN 'blocked' WHEN bool_or(kind = 'completed') THEN 'completed' ELSE 'missed' END AS state FROM @ledger() l GROUP BY seg_id",
    "stm_03_baseline_lock": "SELECT epoch, day_id FROM (SELECT epoch, day_id, row_number() OVER (PARTITION BY epoch ORDER BY day_id, event_id) AS r FROM @ledger() l) x WHERE r = 1",
    "stm_04_epoch_reset": "SELECT kind, count(*) AS n FROM @ledger() l WHERE epoch <> '2024-01' OR kind <> 'completed' GROUP BY kind",
    "stm_06_recertification_trigger": "SELECT epoch, bool_or(kind IN ('completed', 'missed', 'blocked')) AS needed FROM @ledger() l GROUP BY epoch",
    "stm_07_replace_duplicates": "SELECT day_id, user_id, max(event_id) AS event_id, count(*) AS replaced FROM @ledger() l GROUP BY day_id, user_id",
    "udf_03_rules_as_data": "WITH r AS (SELECT 'odd_even' AS rule_type, 3 AS who UNION ALL SELECT 'direction', 5 UNION ALL SELECT 'mode', 7) SELECT r.rule_type, CASE r.rule_type WHEN 'odd_even' THEN CASE WHEN @day(o.day) % 2 = 1 THEN 'blocked' ELSE 'clear' END WHEN 'direction' THEN CASE WHEN o.outing_id % 2 = 0 THEN 'blocked' ELSE 'clear' END ELSE 'context_required' END AS verdict, count(*) AS n FROM @outings() o JOIN r ON o.owner_id % r.who = 0 GROUP BY 1, 2",
    "udf_04_replacement_index": "WITH k AS (SELECT outing_id, @joined(seg_id,seg_id) AS ids FROM @claims() c GROUP BY outing_id) SELECT ids, count(*) AS n, min(outing_id) AS replacement FROM k GROUP BY ids HAVING count(*) > 1",
    "aud_01_drift_repair": "SELECT c.outing_id, @joined(CASE WHEN c.seg_id % 89 = 0 THEN c.seg_id + 1000000 ELSE c.seg_id END,c.seg_id) AS ids FROM @claims() c WHERE c.seg_id % 97 <> 0 GROUP BY c.outing_id",
    "aud_02_latent_credit": "WITH x AS (SELECT DISTINCT l_orderkey AS outing_id, l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT DISTINCT l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'A') SELECT o.outing_id, CASE WHEN o.outing_id % 41 = 0 THEN 'missing_gpx' WHEN count(x.seg_id) = 0 THEN 'passed' WHEN bool_and(k.seg_id IS NOT NULL) THEN 'reconciled' ELSE 'needs_repair' END AS verdict FROM @outings() o LEFT JOIN x ON x.outing_id = o.outing_id LEFT JOIN k ON k.seg_id = x.seg_id GROUP BY o.outing_id",
    "aud_03_route_repeats": "SELECT l_orderkey AS outing_id, count(*) - count(DISTINCT l_partkey) AS repeats, count(DISTINCT l_partkey) AS segments FROM lineitem GROUP BY l_orderkey",
    "aud_04_walkthrough": "SELECT track_id, CAST(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS unnamed, bool_and(value >= 1) AS passed FROM @track() t GROUP BY track_id",
    "aud_06_requirements": "SELECT 'targets' AS gate, count(*) > 0 AS passed FROM @segments() s UNION ALL SELECT 'every_outing_claims', NOT EXISTS (SELECT 1 FROM @outings() o WHERE o.outing_id NOT IN (SELECT outing_id FROM @claims() c)) UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT seg_id) FROM @segments() s UNION ALL SELECT 'no_negative_minutes', min(minutes) >= 0 FROM @outings() o",
    "aud_07_route_efficiency": "SELECT outing_id, CASE WHEN foot_miles > 15 THEN 'too_long' WHEN minutes > 300 THEN 'too_slow' WHEN route_status = 'draft' THEN 'unproven' ELSE 'efficient' END AS verdict FROM @outings() o",
    "aud_08_special_management": "SELECT c.outing_id, s.direction, count(*) AS n FROM @claims() c JOIN @segments() s ON s.seg_id = c.seg_id JOIN @outings() o ON o.outing_id = c.outing_id WHERE s.direction = 'ascent' AND @day(o.day) % 2 = 1 GROUP BY c.outing_id, s.direction",
    "aud_09_same_anchor_spurs": "SELECT a.outing_id AS host, b.outing_id AS spur, a.minutes + b.minutes <= 360 AS within_minutes, a.foot_miles + b.foot_miles <= 18 AS within_miles FROM @outings() a JOIN @outings() b ON a.owner_id = b.owner_id AND a.outing_id <> b.outing_id AND b.foot_miles < a.foot_miles WHERE NOT EXISTS (SELECT 1 FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey WHERE x.l_orderkey = a.outing_id AND y.l_orderkey = b.outing_id)",
    "aud_10_anchor_preservation": "SELECT anchor_id FROM @anchors() a WHERE has_parking AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = a.anchor_id AND c.c_acctbal > 0)",
    "aud_11_review_gate": "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l.toxic = 1 AND d.doc_id % 2 = 0 THEN 'WAIVED' WHEN l.toxic = 1 THEN 'FAIL' WHEN l.quality = 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM labels l JOIN documents d ON d.doc_id = l.doc_id) x GROUP BY verdict",
    "aud_12_certificate_gates": "SELECT 'coverage' AS gate, count(DISTINCT seg_id) AS observed, count(DISTINCT seg_id) >= 100 AS passed FROM @claims() c UNION ALL SELECT 'day_minutes', max(total), max(total) <= 100000 FROM (SELECT CAST(sum(minutes) AS BIGINT) AS total FROM @outings() o GROUP BY day) x UNION ALL SELECT 'drafts', count(*), count(*) = 0 FROM @outings() o WHERE route_status = 'draft'",
    "aud_13_bound_violations": "SELECT @day(day) AS day, @isum(minutes) AS minutes FROM @outings() o GROUP BY 1 HAVING sum(minutes) > CASE WHEN max(@weekday(day)) >= 5 THEN 720 ELSE 480 END",
    "aud_15_schedule_proof": "SELECT issue, count(*) AS n FROM (SELECT 'over_bound' AS issue FROM @outings() o WHERE minutes > 360 UNION ALL SELECT 'uncovered' FROM @segments() s WHERE seg_id NOT IN (SELECT seg_id FROM @claims() c) UNION ALL SELECT 'claimed_twice' FROM (SELECT seg_id FROM @claims() c GROUP BY seg_id HAVING count(*) > 1) x) y GROUP BY issue",
    "aud_16_preflight": "SELECT @time_bucket(minutes) AS bucket, count(*) AS n, CAST(sum(CASE WHEN @weekday(day) >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS weekend, CAST(sum(CASE WHEN route_status = 'draft' THEN 1 ELSE 0 END) AS BIGINT) AS manual FROM @outings() o GROUP BY 1",
    "aud_17_recertification_gates": "SELECT 'progress' AS gate, bool_or(kind = 'completed') AS passed FROM @ledger() l UNION ALL SELECT 'baseline', count(DISTINCT epoch) = 1 FROM @ledger() l UNION ALL SELECT 'calendar', count(*) > 0 FROM @outings() o",
    "aud_18_final_completion": "SELECT s.direction, count(*) AS targets, count(c.seg_id) AS covered FROM @segments() s LEFT JOIN (SELECT DISTINCT seg_id FROM @claims() c) c ON c.seg_id = s.seg_id GROUP BY s.direction",
    "aud_19_execution_checks": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN owner_id % 7 = 0 OR owner_id % 11 = 0 THEN 'blocked_by_logistics' WHEN outing_id % 5 = 0 OR route_status = 'draft' THEN 'blocked_by_route_validation' ELSE 'simulated_ready' END AS status FROM @outings() o) x GROUP BY status",
    "aud_20_ownership_reconciliation": "WITH x AS (SELECT DISTINCT l_orderkey AS outing_id, l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'R'), own AS (SELECT DISTINCT l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'N'), done AS (SELECT DISTINCT l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'A') SELECT kind, count(*) AS n FROM (SELECT CASE WHEN own.seg_id IS NOT NULL THEN 'owned_elsewhere' WHEN done.seg_id IS NOT NULL THEN 'completed_at_export' ELSE 'unclaimed' END AS kind FROM x LEFT JOIN own ON own.seg_id = x.seg_id LEFT JOIN done ON done.seg_id = x.seg_id) y GROUP BY kind",
    # headline aggregates
    "agg_pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "remaining_menu": "WITH done AS (SELECT DISTINCT l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'), r AS (SELECT c.outing_id, count(*) AS new_segments, sum(s.miles) AS miles FROM @claims() c JOIN @segments() s ON s.seg_id = c.seg_id LEFT JOIN done d ON d.seg_id = c.seg_id WHERE d.seg_id IS NULL GROUP BY c.outing_id) SELECT o.outing_id, @time_bucket(o.minutes) AS bucket, r.new_segments, @q(r.miles,1e2) AS miles, CAST(row_number() OVER (PARTITION BY @time_bucket(o.minutes) ORDER BY CASE WHEN o.route_status = 'graph_validated' THEN 0 ELSE 1 END, r.new_segments DESC, o.minutes, o.outing_id) AS BIGINT) AS place FROM r JOIN @outings() o ON o.outing_id = r.outing_id",
}

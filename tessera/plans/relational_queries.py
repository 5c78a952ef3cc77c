"""Joins, aggregations, sorts and set operators (JOIN, AGG, SRT, SET)."""

_NEAR = "@q(@haversine_miles(a.lon,a.lat,s.lon,s.lat),1e6)"

SQL = {
    "join_01_equi_lookup": "SELECT c.outing_id, c.seg_id, @q(s.miles,1e2) AS miles FROM @claims() c LEFT JOIN @segments() s ON s.seg_id = c.seg_id",
    "join_02_enrich_overlay": "SELECT a.anchor_id, coalesce(b.confidence, a.confidence) AS confidence, coalesce(b.has_parking, a.has_parking) AS has_parking FROM @anchors() a LEFT JOIN (SELECT anchor_id, 'user_review_confirmed_paved_road_parking' AS confidence, true AS has_parking FROM @anchors() x WHERE has_parking AND confidence = 'unknown') b ON b.anchor_id = a.anchor_id",
    "join_03_composite_key": "SELECT l.l_orderkey, l.l_linenumber, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderkey % 7 = l.l_linenumber GROUP BY l.l_orderkey, l.l_linenumber",
    "join_05_nearest_within_tolerance": f"WITH a AS (SELECT anchor_id, lon, lat, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @anchors() a), p AS (SELECT anchor_id, lon, lat, cx + dx AS cx, cy + dy AS cy FROM a CROSS JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) i CROSS JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) j), s AS (SELECT seg_id, lon, lat, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @segments() s), d AS (SELECT a.anchor_id, s.seg_id, row_number() OVER (PARTITION BY a.anchor_id ORDER BY {_NEAR}, s.seg_id) AS r FROM p a JOIN s ON s.cx = a.cx AND s.cy = a.cy WHERE @haversine_miles(a.lon,a.lat,s.lon,s.lat) <= 2e0) SELECT anchor_id, seg_id FROM d WHERE r = 1",
    "join_08_bbox_semi": "SELECT s.seg_id FROM @segments() s WHERE EXISTS (SELECT 1 FROM @anchors() a WHERE abs(a.lon - s.lon) <= 1e-2 AND abs(a.lat - s.lat) <= 1e-2)",
    "join_14_candidates_or_planned": "SELECT s.seg_id, s.seg_id IN (SELECT seg_id FROM @claims() c WHERE outing_id IN (SELECT outing_id FROM @outings() o WHERE status = 'P')) AS planned FROM @segments() s WHERE s.seg_id IN (SELECT seg_id FROM @claims() c WHERE outing_id IN (SELECT outing_id FROM @outings() o WHERE status = 'P')) OR @boxes_meet(s.lon,s.lat,s.lon,s.lat,-1163e-1,435e-1,-1162e-1,436e-1,1e-2,1e-2)",
    "join_16_match_groups": "WITH f AS (SELECT track_id, idx, event_type, value, CASE WHEN lag(event_type) OVER (PARTITION BY track_id ORDER BY idx) = event_type THEN 0 ELSE 1 END AS new FROM @track() t), g AS (SELECT track_id, event_type, value, idx, sum(new) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f) SELECT track_id, CAST(grp AS BIGINT) AS grp, min(event_type) AS edge, @q(sum(value),1e2) AS miles FROM g GROUP BY track_id, grp",
    "join_17_named_overlap": "SELECT seg_id, other_id FROM (SELECT a.seg_id, b.seg_id AS other_id, row_number() OVER (PARTITION BY a.seg_id ORDER BY b.seg_id) AS r FROM @segments() a JOIN @segments() b ON a.trail_name = b.trail_name AND a.seg_id <> b.seg_id AND @haversine_miles(a.lon,a.lat,b.lon,b.lat) <= 8e0) x WHERE r = 1",
    "join_18_exact_edge_override": "WITH o AS (SELECT x, y, seg_id FROM (SELECT @floor(lon * 50) AS x, @floor(lat * 50) AS y, seg_id, row_number() OVER (PARTITION BY @floor(lon * 50), @floor(lat * 50) ORDER BY seg_id DESC) AS r FROM @segments() s) z WHERE r = 1) SELECT a.anchor_id, o.seg_id FROM @anchors() a JOIN o ON o.x = @floor(a.lon * 50) AND o.y = @floor(a.lat * 50)",
    "join_19_endpoint_adjacency": "WITH s AS (SELECT seg_id, lon, lat, direction, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @segments() s), p AS (SELECT seg_id, lon, lat, cx + dx AS cx, cy + dy AS cy FROM s CROSS JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) i CROSS JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) j) SELECT p.seg_id, s.seg_id AS other_id, @q(@haversine_miles(p.lon,p.lat,s.lon,s.lat),1e4) AS d FROM p JOIN s ON s.cx = p.cx AND s.cy = p.cy AND s.seg_id > p.seg_id WHERE @haversine_miles(p.lon,p.lat,s.lon,s.lat) <= 1e0",
    "join_20_road_band": "WITH s AS (SELECT seg_id, lon, lat, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @segments() s), p AS (SELECT seg_id, lon, lat, cx + dx AS cx, cy + dy AS cy FROM s CROSS JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) i CROSS JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) j) SELECT p.seg_id, count(*) AS roads FROM p JOIN s ON s.cx = p.cx AND s.cy = p.cy AND s.seg_id <> p.seg_id WHERE @haversine_miles(p.lon,p.lat,s.lon,s.lat) > 5e-1 AND @haversine_miles(p.lon,p.lat,s.lon,s.lat) <= 15e-1 GROUP BY p.seg_id",
    "join_21_coverers": "SELECT seg_id, @joined(outing_id,outing_id) AS outings, count(*) AS n FROM @claims() c GROUP BY seg_id",
    "join_22_latent_relationships": "WITH x AS (SELECT a.outing_id AS source, b.outing_id AS owner, a.seg_id FROM @claims() a JOIN @claims() b ON a.seg_id = b.seg_id AND a.outing_id < b.outing_id) SELECT source, owner, @joined(seg_id,seg_id) AS segments FROM x GROUP BY source, owner",
    "join_23_order_comparison": "WITH o AS (SELECT outing_id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY day, outing_id) AS pos FROM @outings() o) SELECT a.outing_id, b.outing_id AS other_id, CASE WHEN b.pos < a.pos THEN 'owner_before' ELSE 'owner_after' END AS relation FROM o a JOIN o b ON a.owner_id = b.owner_id AND a.outing_id <> b.outing_id",
    "join_24_co_coverage": "SELECT a.outing_id AS a, b.outing_id AS b, count(*) AS shared, @q(sum(s.miles),1e2) AS miles FROM @claims() a JOIN @claims() b ON a.seg_id = b.seg_id AND a.outing_id < b.outing_id JOIN @segments() s ON s.seg_id = a.seg_id GROUP BY a.outing_id, b.outing_id HAVING count(*) > 1",
    "join_26_neighbour_top_k": "SELECT a, b, CAST(r AS BIGINT) AS place FROM (SELECT a.anchor_id AS a, b.anchor_id AS b, row_number() OVER (PARTITION BY a.anchor_id ORDER BY @q(@haversine_miles(a.lon,a.lat,b.lon,b.lat),1e6), b.anchor_id) AS r FROM @anchors() a JOIN @anchors() b ON a.anchor_id <> b.anchor_id) x WHERE r <= 5",
    "join_27_tail_opportunities": "WITH own AS (SELECT outing_id, seg_id FROM @claims() c), short AS (SELECT seg_id, lon, lat, @floor(lon * 50) AS cx, @floor(lat * 50) AS cy FROM @segments() s WHERE miles <= 1e0), cell AS (SELECT seg_id, lon, lat, @floor(lon * 50) + dx AS cx, @floor(lat * 50) + dy AS cy FROM @segments() s CROSS JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) i CROSS JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) j), near AS (SELECT s.seg_id, t.seg_id AS other FROM cell s JOIN short t ON t.cx = s.cx AND t.cy = s.cy WHERE abs(t.lon - s.lon) < 2e-2 AND abs(t.lat - s.lat) < 2e-2) SELECT DISTINCT o.outing_id, n.other AS seg_id FROM own o JOIN near n ON n.seg_id = o.seg_id LEFT JOIN own x ON x.outing_id = o.outing_id AND x.seg_id = n.other WHERE x.seg_id IS NULL",
    "join_28_waiver_match": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN d.source <> 'src1' AND d.doc_id % 4 = 0 THEN 'route_label_mismatch' WHEN d.doc_id % 5 = 0 THEN 'segment_ids_mismatch' WHEN l.quality = 0 THEN 'missing_reason' WHEN l.toxic = 1 THEN 'expired' ELSE 'valid' END AS reason FROM documents d JOIN labels l ON l.doc_id = d.doc_id) x GROUP BY reason",
    "join_29_track_index_match": "WITH t AS (SELECT DISTINCT track_id, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @track() t), s AS (SELECT seg_id, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @segments() s) SELECT t.track_id, count(*) AS n FROM t JOIN s ON s.cx = t.cx AND s.cy = t.cy GROUP BY t.track_id",
    "join_31_block_index": "SELECT name, block, previous FROM (SELECT p_name AS name, p_brand AS block, lag(p_brand) OVER (PARTITION BY p_name ORDER BY p_partkey) AS previous, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r FROM part) x WHERE r = 1",
    "join_32_full_outer_diff": "WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 89 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 97 <> 0 UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_partkey % 101 = 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS seg_id, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM part a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size",
    "join_33_keyed_update": "SELECT o.outing_id, coalesce(c.minutes, o.minutes) AS minutes FROM @outings() o LEFT JOIN (SELECT l_orderkey AS outing_id, CAST(max(l_linenumber) * 30 AS BIGINT) AS minutes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) c ON c.outing_id = o.outing_id",
    "join_34_claim_index": "SELECT c.seg_id, @joined(concat(@text(c.outing_id), ':', o.status),c.outing_id) AS claims FROM @claims() c JOIN @outings() o ON o.outing_id = c.outing_id GROUP BY c.seg_id",
    "agg_01_group_by_trail": "SELECT trail_name, count(*) AS n, @q(sum(miles),1e2) AS miles, CAST(sum(CASE WHEN direction = 'ascent' THEN 1 ELSE 0 END) AS BIGINT) AS ascents, @joined(seg_id,seg_id) AS segments FROM @segments() s GROUP BY trail_name",
    "agg_02_value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "agg_03_conditional_summary": "SELECT count(*) AS n, CAST(sum(CASE WHEN direction = 'ascent' THEN 1 ELSE 0 END) AS BIGINT) AS ascents, @q(sum(CASE WHEN direction = 'both' THEN miles ELSE 0e0 END),1e2) AS both_miles FROM @segments() s",
    "agg_04_median": "SELECT l_partkey AS seg_id, @q(@percentile(l_quantity,5e-1),1e2) AS median FROM lineitem GROUP BY l_partkey",
    "agg_05_nearest_rank": "WITH r AS (SELECT l_suppkey AS k, l_quantity AS v, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS BIGINT) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), t AS (SELECT k, v, i, (n - 1) * 3 AS a FROM r) SELECT k, @q(v,1e2) AS p75 FROM t WHERE i = 1 + CASE WHEN a % 4 = 2 THEN CASE WHEN @floor(a / 4e0) % 2 = 1 THEN @floor(a / 4e0) + 1 ELSE @floor(a / 4e0) END ELSE @floor((a + 2) / 4e0) END",
    "agg_06_linear_percentile": "SELECT l_suppkey AS k, @q(@percentile(l_quantity,9e-1),1e2) AS p90 FROM lineitem GROUP BY l_suppkey",
    "agg_07_history": "WITH r AS (SELECT l_partkey AS seg_id, l_quantity AS v, l_orderkey AS activity, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS BIGINT) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) SELECT seg_id, @q(max(CASE WHEN i = 1 + @floor(n / 2e0) THEN v END),1e2) AS upper_median, @q(min(v),1e2) AS best, count(DISTINCT activity) AS activities FROM r GROUP BY seg_id",
    "agg_08_daily_totals": "SELECT @day(ts) AS day, count(*) AS n, @q(sum(value),1e2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "agg_09_five_numbers": "WITH d AS (SELECT user_id, @day(ts) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY user_id, @day(ts)) SELECT user_id, @q(min(v),1e2) AS lo, @q(@percentile(v,5e-1),1e1) AS mid, @q(max(v),1e2) AS hi, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_days FROM d GROUP BY user_id",
    "agg_10_set_fold": "WITH k AS (SELECT DISTINCT epoch, kind, seg_id FROM @ledger() l) SELECT c.epoch, c.seg_id FROM k c WHERE c.kind = 'completed' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.epoch = c.epoch AND b.seg_id = c.seg_id AND b.kind = 'blocked')",
    "agg_11_coverage_validation": "WITH n AS (SELECT s.seg_id, count(c.outing_id) AS n FROM @segments() s LEFT JOIN @claims() c ON c.seg_id = s.seg_id GROUP BY s.seg_id) SELECT count(*) AS targets, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM n",
    "agg_12_outing_menu": "SELECT owner_id, min(outing_id) AS first_outing, count(*) AS parts, @isum(minutes) AS minutes, bool_and(route_status = 'graph_validated') AS all_valid, bool_or(minutes > 300) AS any_long FROM @outings() o GROUP BY owner_id",
    "agg_13_weekly_load": "SELECT owner_id AS who, @floor(@day(day) / 7e0) AS week, @isum(minutes) AS minutes, CAST(sum(CASE WHEN minutes >= 240 THEN 1 ELSE 0 END) AS BIGINT) AS long_days FROM @outings() o GROUP BY 1, 2",
    "agg_14_package_recompute": "SELECT o.owner_id, count(DISTINCT c.seg_id) AS segments, count(DISTINCT o.outing_id) AS outings FROM @outings() o JOIN @claims() c ON c.outing_id = o.outing_id GROUP BY o.owner_id",
    "agg_15_metric_sums": "SELECT count(*) AS n, @isum(minutes) AS minutes, @q(sum(foot_miles),1e1) AS foot_miles, @isum(ascent_ft) AS ascent FROM @outings() o",
    "agg_16_edge_accumulation": "SELECT least(l_suppkey, l_partkey % 100 + 1) AS a, greatest(l_suppkey, l_partkey % 100 + 1) AS b, count(*) AS n, @joined_set(l_returnflag) AS reasons FROM lineitem GROUP BY 1, 2",
    "agg_17_union_of_selection": "SELECT o.status, count(DISTINCT c.seg_id) AS covered, count(DISTINCT o.outing_id) AS outings FROM @outings() o JOIN @claims() c ON c.outing_id = o.outing_id GROUP BY o.status",
    "agg_18_argmax_block": "WITH w AS (SELECT c.outing_id, p.p_brand AS block, sum(p.p_size) AS size FROM @claims() c JOIN part p ON p.p_partkey = c.seg_id GROUP BY c.outing_id, p.p_brand) SELECT outing_id, block FROM (SELECT outing_id, block, row_number() OVER (PARTITION BY outing_id ORDER BY size DESC, block DESC) AS r FROM w) x WHERE r = 1",
    "agg_19_miles_by_direction": "SELECT c.outing_id, s.direction, @q(sum(s.miles),1e2) AS miles FROM @claims() c JOIN @segments() s ON s.seg_id = c.seg_id GROUP BY c.outing_id, s.direction HAVING sum(s.miles) >= 95e-2 + 1e-6",
    "agg_20_mile_index": "SELECT seg_id, @q(max(CASE WHEN priority = top THEN miles END),1e2) AS miles FROM (SELECT seg_id, miles, priority, max(priority) OVER (PARTITION BY seg_id) AS top FROM (SELECT seg_id, miles, 1 AS priority FROM @segments() s UNION ALL SELECT l_partkey, max(l_quantity) / 10e0, 2 FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey) x) y GROUP BY seg_id",
    "agg_21_class_counts": "SELECT o_orderpriority AS class, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus",
    "agg_22_repeat_classes": "SELECT kind, count(*) AS n, @q(sum(quantity),1e0) AS miles FROM (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'productive_repeat' WHEN l_partkey % 10 = 1 THEN 'dead_repeat_candidate' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'dead_repeat_candidate' ELSE 'necessary_repeat' END AS kind, l_quantity AS quantity FROM lineitem) x GROUP BY kind",
    "agg_23_calendar_conflicts": "WITH d AS (SELECT day, count(*) AS n, sum(minutes) AS minutes FROM @outings() o GROUP BY day) SELECT count(*) AS days, CAST(sum(CASE WHEN minutes > 600 THEN 1 ELSE 0 END) AS BIGINT) AS over_budget, bool_and(minutes <= 600) AS passed FROM d",
    "agg_24_decision_counts": "SELECT l.quality, l.toxic, d.lang, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY l.quality, l.toxic, d.lang",
    "agg_25_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "agg_26_fallback_chain": "SELECT s.seg_id, @q(coalesce(nullif(CASE WHEN s.seg_id % 4 = 0 THEN 12e0 ELSE 0e0 END, 0e0), m.pace, 16e0),1e2) AS pace, CASE WHEN s.seg_id % 4 = 0 THEN 'manual' WHEN m.pace IS NOT NULL THEN 'segment' ELSE 'default' END AS source FROM @segments() s LEFT JOIN (SELECT l_partkey, @percentile(l_quantity,5e-1) AS pace FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey) m ON m.l_partkey = s.seg_id",
    "agg_27_effort_summary": "SELECT p.p_brand AS name, count(*) AS n, @q(@percentile(l.l_quantity,5e-1),1e2) AS pace FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY p.p_brand",
    "agg_28_trail_families": "SELECT @clean_trail_name(concat(p_type, ' ', @text(p_size % 5))) AS family, count(*) AS n FROM part GROUP BY 1",
    "agg_29_missing_classes": "WITH o AS (SELECT s.seg_id, c.outing_id, row_number() OVER (PARTITION BY s.seg_id ORDER BY c.outing_id) AS r FROM @segments() s LEFT JOIN @claims() c ON c.seg_id = s.seg_id AND c.outing_id IN (SELECT outing_id FROM @outings() v WHERE route_status = 'graph_validated')) SELECT seg_id, CASE WHEN max(outing_id) IS NULL THEN 'no_option' ELSE 'option_not_selected' END AS class, count(outing_id) AS options FROM o WHERE r <= 4 GROUP BY seg_id",
    "agg_30_forced_swap": "SELECT class, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'no_strict_field_day_candidate' WHEN o_orderkey % 9 = 1 THEN 'force_infeasible' WHEN o_orderkey % 9 = 2 THEN 'force_did_not_recover_segment' WHEN o_orderkey % 5 > 2 THEN 'improves_max_coverage' WHEN o_orderkey % 5 = 2 AND o_orderstatus = 'F' THEN 'one_for_one_swap' WHEN o_orderkey % 5 = 2 THEN 'recovers_without_coverage_loss' ELSE 'coverage_loss_swap' END AS class FROM orders) x GROUP BY class",
    "win_01_rank_in_bucket": "SELECT outing_id, @time_bucket(minutes) AS bucket, CAST(row_number() OVER (PARTITION BY @time_bucket(minutes) ORDER BY CASE WHEN route_status = 'graph_validated' THEN 0 ELSE 1 END, foot_miles / minutes DESC, foot_miles DESC, minutes, outing_id) AS BIGINT) AS place FROM @outings() o",
    "win_08_gap_islands": "WITH d AS (SELECT DISTINCT owner_id AS who, @day(day) AS d FROM @outings() o), i AS (SELECT who, d, d - row_number() OVER (PARTITION BY who ORDER BY d) AS island FROM d) SELECT who, min(d) AS first_day, count(*) AS days FROM i GROUP BY who, island HAVING count(*) > 1",
    "win_11_progressive_bundles": "WITH r AS (SELECT owner_id, outing_id, sum(minutes) OVER (PARTITION BY owner_id ORDER BY foot_miles, outing_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM @outings() o), b AS (SELECT owner_id, outing_id, total, row_number() OVER (PARTITION BY owner_id, @time_bucket(total) ORDER BY total) AS first_in FROM r WHERE total <= 390) SELECT owner_id, outing_id, CAST(total AS BIGINT) AS total FROM b WHERE first_in = 1",
    "win_17_schedule_position": "SELECT owner_id, min(place) AS place FROM (SELECT owner_id, CAST(row_number() OVER (ORDER BY day, outing_id) AS BIGINT) AS place FROM @outings() o WHERE status = 'F') x GROUP BY owner_id",
    "srt_01_menu_sort": "SELECT outing_id, place FROM (SELECT outing_id, CAST(row_number() OVER (ORDER BY @time_bucket(minutes), route_status DESC, foot_miles DESC, minutes, outing_id) AS BIGINT) AS place FROM @outings() o) x",
    "srt_02_today_options": "WITH n AS (SELECT c.outing_id, count(*) AS new_count FROM @claims() c WHERE c.seg_id % 3 > 0 GROUP BY c.outing_id) SELECT limit_minutes, outing_id, CAST(r AS BIGINT) AS place FROM (SELECT f.limit_minutes, o.outing_id, row_number() OVER (PARTITION BY f.limit_minutes ORDER BY n.new_count DESC, o.minutes, o.outing_id) AS r FROM @outings() o JOIN n ON n.outing_id = o.outing_id CROSS JOIN (SELECT 60 AS limit_minutes UNION ALL SELECT 120 UNION ALL SELECT 240) f WHERE o.minutes <= f.limit_minutes) x WHERE r <= 10",
    "srt_03_best_today": "SELECT outing_id, minutes FROM @outings() o WHERE route_status = 'graph_validated' AND minutes <= 180 ORDER BY foot_miles DESC, minutes, outing_id LIMIT 1",
    "srt_04_top_before_combos": "SELECT outing_id FROM @outings() o ORDER BY CASE WHEN status = 'F' THEN 0 ELSE 1 END, foot_miles DESC, minutes, outing_id LIMIT 12",
    "srt_05_best_per_bucket": "SELECT bucket, source, outing_id FROM (SELECT bucket, source, outing_id, row_number() OVER (PARTITION BY bucket ORDER BY foot_miles DESC, source, minutes, outing_id) AS r FROM (SELECT @time_bucket(minutes) AS bucket, 1 AS source, outing_id, foot_miles, minutes FROM @outings() o WHERE status = 'F' UNION ALL SELECT @time_bucket(minutes), 2, outing_id, foot_miles, minutes FROM @outings() o WHERE status = 'O' UNION ALL SELECT @time_bucket(minutes), 3, outing_id, foot_miles, minutes FROM @outings() o WHERE status = 'P') x) y WHERE r = 1",
    "srt_06_top_k_plus_forced": "WITH d AS (SELECT s.seg_id % 40 AS comp, a.anchor_id, a.has_parking, min(@q(@haversine_miles(a.lon,a.lat,s.lon,s.lat),1e4)) AS d FROM @segments() s CROSS JOIN @anchors() a GROUP BY 1, 2, 3), r AS (SELECT comp, anchor_id, has_parking, d, row_number() OVER (PARTITION BY comp ORDER BY d, anchor_id) AS r, row_number() OVER (PARTITION BY comp, has_parking ORDER BY d, anchor_id) AS c FROM d) SELECT comp, anchor_id FROM r WHERE r <= 3 OR (has_parking AND c = 1)",
    "srt_07_combo_sort": "SELECT outing_id, CAST(row_number() OVER (ORDER BY ascent_ft, minutes, outing_id) AS BIGINT) AS place FROM @outings() o",
    "srt_08_sweep_ranking": "SELECT owner_id, CAST(row_number() OVER (ORDER BY count(*) DESC, sum(minutes) DESC, min(outing_id)) AS BIGINT) AS place FROM @outings() o GROUP BY owner_id",
    "srt_09_richness_order": "SELECT doc_id, (CASE WHEN text IS NULL THEN 0 ELSE 1 END + CASE WHEN lang IS NULL THEN 0 ELSE 1 END + CASE WHEN source IS NULL THEN 0 ELSE 1 END) AS richness FROM documents",
    # What counts as a material difference (miles, minutes, ascent feet).
    "srt_10_dominance": "WITH d AS (SELECT a.owner_id, a.outing_id AS current_id, b.outing_id AS candidate_id, a.foot_miles - b.foot_miles AS miles, a.minutes - b.minutes AS minutes, a.ascent_ft - b.ascent_ft AS ascent FROM @outings() a JOIN @outings() b ON a.owner_id = b.owner_id AND a.outing_id <> b.outing_id) SELECT current_id, candidate_id, (miles > 25e-2 OR minutes > 10 OR ascent > 250) AND NOT (miles < -25e-2 OR minutes < -10 OR ascent < -250) AS dominates FROM d",
    "srt_11_replacement_deltas": "SELECT o.outing_id, o.minutes - r.minutes AS saved FROM @outings() o LEFT JOIN @outings() r ON r.outing_id = o.outing_id + 1",
    "srt_12_plan_selection": "SELECT owner_id FROM (SELECT owner_id, bool_and(status = 'F') AS ok, count(*) AS n, sum(foot_miles) AS miles FROM @outings() o GROUP BY owner_id) x ORDER BY ok DESC, n DESC, @q(miles,1e1) DESC, owner_id LIMIT 1",
    "set_01_keyed_union": "SELECT name, anchor_id FROM (SELECT name, anchor_id, row_number() OVER (PARTITION BY name ORDER BY priority, anchor_id) AS r FROM (SELECT p_brand AS name, p_partkey AS anchor_id, 1 AS priority FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, p_partkey, 2 FROM part) x) y WHERE r = 1",
    "set_02_layer_union": "SELECT layer, count(*) AS n FROM (SELECT 'official' AS layer, seg_id FROM @segments() s UNION ALL SELECT coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'osm' END, 'r2r'), o_orderkey FROM orders) x GROUP BY layer",
    "set_03_id_difference": "SELECT seg_id FROM @segments() s EXCEPT SELECT seg_id FROM @claims() c WHERE outing_id IN (SELECT outing_id FROM @outings() o WHERE status = 'P' AND minutes <= 60)",
    "set_04_progress_precedence": "SELECT user_id, seg_id FROM @ledger() l WHERE kind = 'completed' EXCEPT SELECT user_id, seg_id FROM @ledger() l WHERE kind IN ('missed', 'blocked')",
    "set_05_outing_status": "WITH done AS (SELECT DISTINCT l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT p_partkey AS seg_id FROM part WHERE p_size = 7) SELECT c.outing_id, CASE WHEN bool_and(d.seg_id IS NOT NULL) THEN 'completed' WHEN bool_and(d.seg_id IS NOT NULL OR b.seg_id IS NOT NULL) THEN 'inactive' ELSE 'open' END AS status FROM @claims() c LEFT JOIN done d ON d.seg_id = c.seg_id LEFT JOIN b ON b.seg_id = c.seg_id GROUP BY c.outing_id",
    "set_06_route_delta": "WITH done AS (SELECT DISTINCT l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F') SELECT c.outing_id, count(*) AS remaining, @joined(c.seg_id,c.seg_id) AS ids FROM @claims() c LEFT JOIN done d ON d.seg_id = c.seg_id WHERE d.seg_id IS NULL GROUP BY c.outing_id",
    "set_07_held_segments": "SELECT l_partkey AS seg_id FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size = 7",
    "set_08_dedupe_richest": "SELECT owner_id, outing_id FROM (SELECT owner_id, outing_id, row_number() OVER (PARTITION BY owner_id ORDER BY CASE WHEN route_status = 'graph_validated' THEN 0 ELSE 1 END, minutes, outing_id) AS r FROM @outings() o) x WHERE r = 1",
    "set_09_merge_anchors": "SELECT x, y, anchor_id FROM (SELECT @floor(lon * 10) AS x, @floor(lat * 10) AS y, anchor_id, row_number() OVER (PARTITION BY @floor(lon * 10), @floor(lat * 10) ORDER BY @confidence_rank(confidence) DESC, anchor_id) AS r FROM @anchors() a) z WHERE r = 1",
    "set_10_collection_merge": "SELECT seg_id, count(*) AS n FROM (SELECT seg_id FROM @segments() s UNION ALL SELECT seg_id FROM @claims() c) x GROUP BY seg_id",
    "set_11_keyed_replace": "SELECT outing_id, minutes FROM @outings() o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.outing_id AND l.l_linenumber = 7) UNION ALL SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) FROM lineitem WHERE l_linenumber = 7 GROUP BY l_orderkey",
    "set_12_progress_overlay": "SELECT seg_id FROM (SELECT seg_id FROM @segments() s UNION SELECT seg_id FROM @ledger() l WHERE kind = 'completed') x WHERE seg_id NOT IN (SELECT seg_id FROM @ledger() l WHERE kind = 'missed')",
}

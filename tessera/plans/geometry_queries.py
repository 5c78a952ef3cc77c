"""Geometry and scalar operators (inventory sections GEO and WIN on tracks) as queries over the engine's roles."""

_LEGS = "(SELECT track_id, idx, lon, lat, lead(lon) OVER (PARTITION BY track_id ORDER BY idx) AS lon2, lead(lat) OVER (PARTITION BY track_id ORDER BY idx) AS lat2 FROM @track() t)"

SQL = {
    # GEO-01, 09, 10, 24: legs of a track with length, midpoint and bearing
    "geo_01_haversine": "SELECT seg_id, @q(@haversine_miles(lon,lat,-1162e-1,436e-1),1e4) AS d FROM @segments() s",
    "geo_02_local_xy": "SELECT seg_id, @q(@local_x(lon,lat),1e4) AS x, @q(@local_y(lat),1e4) AS y FROM @segments() s",
    "geo_03_index_xy": "SELECT seg_id, @q(@index_x(lon,436e-1),1e4) AS x FROM @segments() s",
    "geo_04_point_to_segment": "SELECT seg_id, @q(@segment_miles(@local_x(lon,lat),@local_y(lat),@local_x(-1162e-1,lat),@local_y(435e-1),@local_x(-1161e-1,lat),@local_y(437e-1)),1e4) AS d FROM @segments() s",
    "geo_05_point_to_polyline": f"SELECT a.anchor_id, l.track_id, @q(min(@segment_miles(@local_x(a.lon,a.lat),@local_y(a.lat),@local_x(l.lon,a.lat),@local_y(l.lat),@local_x(l.lon2,a.lat),@local_y(l.lat2))),1e4) AS d FROM {_LEGS} l JOIN @anchors() a ON a.anchor_id % 150 = l.track_id % 150 WHERE l.lon2 IS NOT NULL GROUP BY a.anchor_id, l.track_id",
    "geo_06_project_along_polyline": f"""
        WITH legs AS (SELECT track_id, idx, lon, lat, lon2, lat2, @haversine_miles(lon,lat,lon2,lat2) AS d FROM {_LEGS} l WHERE lon2 IS NOT NULL),
        placed AS (SELECT track_id, idx, d, sum(d) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d AS before,
            @along(@local_x(-1162e-1,436e-1),@local_y(436e-1),@local_x(lon,436e-1),@local_y(lat),@local_x(lon2,436e-1),@local_y(lat2)) AS f,
            @segment_miles(@local_x(-1162e-1,436e-1),@local_y(436e-1),@local_x(lon,436e-1),@local_y(lat),@local_x(lon2,436e-1),@local_y(lat2)) AS off FROM legs),
        ranked AS (SELECT track_id, before + f * d AS along, off, row_number() OVER (PARTITION BY track_id ORDER BY @q(off,1e9), idx) AS r FROM placed)
        SELECT track_id, @q(along,1e3) AS along, @q(off,1e4) AS off FROM ranked WHERE r = 1""",
    "geo_07_fraction_along_polyline": f"""
        WITH legs AS (SELECT track_id, idx, lon, lat, lon2, lat2, @haversine_miles(lon,lat,lon2,lat2) AS d FROM {_LEGS} l WHERE lon2 IS NOT NULL),
        placed AS (SELECT track_id, idx, d, sum(d) OVER (PARTITION BY track_id) AS total, sum(d) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d AS before,
            @along(@local_x(-1163e-1,436e-1),@local_y(435e-1),@local_x(lon,436e-1),@local_y(lat),@local_x(lon2,436e-1),@local_y(lat2)) AS f,
            @segment_miles(@local_x(-1163e-1,436e-1),@local_y(435e-1),@local_x(lon,436e-1),@local_y(lat),@local_x(lon2,436e-1),@local_y(lat2)) AS off FROM legs),
        ranked AS (SELECT track_id, (before + f * d) / total AS f, row_number() OVER (PARTITION BY track_id ORDER BY @q(off,1e9), idx) AS r FROM placed)
        SELECT track_id, @q(greatest(0e0, least(1e0, f)),1e5) AS fraction FROM ranked WHERE r = 1""",
    "geo_08_fraction_along_segment": "SELECT seg_id, @q(@along(@local_x(lon,436e-1),@local_y(lat),@local_x(-1163e-1,436e-1),@local_y(435e-1),@local_x(-1160e-1,436e-1),@local_y(438e-1)),1e6) AS f FROM @segments() s",
    "geo_09_line_length": f"SELECT track_id, @q(sum(@haversine_miles(lon,lat,lon2,lat2)),1e2) AS miles FROM {_LEGS} l WHERE lon2 IS NOT NULL GROUP BY track_id",
    "geo_10_interpolate": f"SELECT track_id, idx, @q(@lerp(lon,lon2,25e-2),1e5) AS lon, @q(@lerp(lat,lat2,25e-2),1e5) AS lat FROM {_LEGS} l WHERE lon2 IS NOT NULL",
    "geo_11_sample_line": f"""
        WITH legs AS (SELECT track_id, idx, lon, lat, lon2, lat2, greatest(CAST(1 AS BIGINT), @ceil(@haversine_miles(lon,lat,lon2,lat2) / 5e0 - 1e-6)) AS n FROM {_LEGS} l WHERE lon2 IS NOT NULL),
        steps AS (SELECT track_id, idx, lon, lat, lon2, lat2, n, @series(CAST(1 AS BIGINT), n) AS k FROM legs)
        SELECT track_id, idx, k, @q(@lerp(lon,lon2,k / CAST(n AS DOUBLE)),1e5) AS lon, @q(@lerp(lat,lat2,k / CAST(n AS DOUBLE)),1e5) AS lat FROM steps""",
    "geo_12_downsample": """
        WITH t AS (SELECT track_id, idx, lon, lat, count(*) OVER (PARTITION BY track_id) AS n FROM @track() x)
        SELECT track_id, idx, @q(lon,1e4) AS lon FROM t WHERE (idx - 1) % @ceil(n / 20e0) = 0 OR idx = n""",
    "geo_13_even_sample": """
        WITH t AS (SELECT track_id, count(*) AS n FROM @track() x GROUP BY track_id),
        k AS (SELECT track_id, n, @series(CAST(0 AS BIGINT), CAST(17 AS BIGINT)) AS i FROM t),
        w AS (SELECT track_id, i, (2 * i * (n - 1) + 17) AS a FROM k)
        SELECT w.track_id, w.i, x.idx FROM w JOIN @track() x ON x.track_id = w.track_id AND x.idx = 1 + CASE WHEN a % 34 = 0 AND @floor(a / 34e0) % 2 = 1 THEN @floor(a / 34e0) - 1 ELSE @floor(a / 34e0) END""",
    "geo_15_densify": f"""
        WITH legs AS (SELECT track_id, idx, lon, lat, lon2, lat2, @ceil(@haversine_miles(lon,lat,lon2,lat2) / 8e0) AS n FROM {_LEGS} l WHERE lon2 IS NOT NULL)
        SELECT track_id, idx, n - 1 AS added FROM legs WHERE n > 1""",
    "geo_17_bounding_box": "SELECT track_id, @q(min(lon),1e4) AS w, @q(min(lat),1e4) AS s, @q(max(lon),1e4) AS e, @q(max(lat),1e4) AS n FROM @track() t GROUP BY track_id",
    "geo_18_bbox_overlap": """
        WITH b AS (SELECT outing_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM @claims() c JOIN @segments() g ON c.seg_id = g.seg_id WHERE outing_id <= 300 OR outing_id % 3 < 3 GROUP BY outing_id)
        SELECT outing_id, @boxes_meet(w,s,e,n,-1163e-1,435e-1,-1162e-1,436e-1,1e-2,1e-2) AS meets FROM b""",
    "geo_19_bbox_expand": "SELECT track_id, @q(min(lon) - 1e-2,1e4) AS w, @q(max(lat) + 1e-2,1e4) AS n FROM @track() t GROUP BY track_id",
    "geo_20_centroid": "SELECT outing_id, @q(avg(lon) + 3e-6,1e4) AS lon, @q(avg(lat) + 3e-6,1e4) AS lat FROM @claims() c JOIN @segments() g ON c.seg_id = g.seg_id GROUP BY outing_id",
    "geo_21_node_key4": "SELECT seg_id, @node4(lon) AS x, @node4(lat) AS y FROM @segments() s",
    "geo_22_node_key5": "SELECT seg_id, @node5(lon) AS x, @node5(lat) AS y FROM @segments() s",
    "geo_23_grid_cell": "SELECT @cell(lon + 1e-7) AS cx, @cell(lat + 1e-7) AS cy, count(*) AS n FROM @segments() s GROUP BY 1, 2",
    "geo_24_bearing": f"SELECT track_id, idx, @q(@bearing(lon,lat,lon2,lat2),1e3) AS b FROM {_LEGS} l WHERE lon2 IS NOT NULL",
    "geo_25_bearing_delta": f"WITH b AS (SELECT track_id, idx, @bearing(lon,lat,lon2,lat2) AS b FROM {_LEGS} l WHERE lon2 IS NOT NULL), d AS (SELECT track_id, idx, @bearing_delta(lag(b) OVER (PARTITION BY track_id ORDER BY idx),b) AS d FROM b) SELECT track_id, idx, @q(d,1e3) AS d FROM d WHERE d IS NOT NULL",
    "geo_26_turn_phrase": f"WITH b AS (SELECT track_id, idx, @bearing(lon,lat,lon2,lat2) AS b FROM {_LEGS} l WHERE lon2 IS NOT NULL), d AS (SELECT @bearing_delta(lag(b) OVER (PARTITION BY track_id ORDER BY idx),b) AS d FROM b) SELECT @turn_phrase(d) AS phrase, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1",
    "geo_27_web_mercator": "SELECT seg_id, @q(@mercator_lon(-12940000e0 + seg_id * 10),1e5) AS lon, @q(@mercator_lat(5400000e0 + seg_id * 10),1e5) AS lat FROM @segments() s",
    "geo_28_reverse": "SELECT track_id, idx, CAST(count(*) OVER (PARTITION BY track_id) + 1 - idx AS BIGINT) AS reversed FROM @track() t",
    "geo_29_orientations": "SELECT seg_id, o AS reversed FROM (SELECT seg_id, @series(CAST(0 AS BIGINT), CASE WHEN direction = 'both' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END) AS o FROM @segments() s) x",
    "geo_30_interval_direction": "WITH m AS (SELECT track_id, idx, value AS a, lead(value) OVER (PARTITION BY track_id ORDER BY idx) AS b FROM @track() t) SELECT CASE WHEN b > a + 1e-6 THEN 'forward' WHEN b < a - 1e-6 THEN 'reverse' ELSE 'stationary' END AS direction, count(*) AS n FROM m WHERE b IS NOT NULL GROUP BY 1",
    "geo_31_gain_loss": "WITH d AS (SELECT track_id, value - lag(value) OVER (PARTITION BY track_id ORDER BY idx) AS d FROM @track() t) SELECT track_id, @q(sum(CASE WHEN d > 0 THEN d ELSE 0e0 END),1e2) AS gain, @q(sum(CASE WHEN d < 0 THEN -d ELSE 0e0 END),1e2) AS loss FROM d GROUP BY track_id",
    "geo_32_elevation_rows": "SELECT seg_id, o AS reversed, CASE WHEN o = 0 THEN seg_id % 300 ELSE 300 - seg_id % 300 END AS gain_ft, (direction = 'both' OR o = 0) AS allowed_for_credit FROM (SELECT seg_id, direction, @series(CAST(0 AS BIGINT), CAST(1 AS BIGINT)) AS o FROM @segments() s) x WHERE direction = 'both' OR o = 0",
    "geo_33_effort": "SELECT outing_id, @ceil_minutes(@effort_minutes(minutes,ascent_ft)) AS effort, @p75_minutes(@effort_minutes(minutes,ascent_ft)) AS p75, @q(foot_miles + ascent_ft / 1e3,1e2) AS grade_miles FROM @outings() o",
    "geo_34_route_finding_penalty": "SELECT outing_id, CAST(@route_finding_penalty(CASE outing_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END,outing_id % 6,foot_miles / 8,foot_miles / 20,1 + outing_id % 7) AS BIGINT) AS penalty FROM @outings() o",
    "geo_35_time_estimates": "WITH e AS (SELECT outing_id, minutes, 12 + outing_id % 40 AS drive, @ceil_minutes(@effort_minutes(minutes,ascent_ft)) AS moving, @p75_minutes(@effort_minutes(minutes,ascent_ft)) AS moving75, outing_id % 20 AS penalty FROM @outings() o) SELECT outing_id, 2 * drive + 8 + minutes AS raw, 2 * drive + 8 + moving AS p50, 2 * drive + 8 + moving75 + penalty AS p75, @p75_minutes(2 * drive + 8 + moving75 + penalty) AS p90 FROM e",
    "geo_36_drive_to_trailhead": "SELECT anchor_id, CAST(@drive_minutes(@haversine_miles(lon,lat,-1162e-1,4361e-2),125e-2,22e-1,4) AS BIGINT) AS minutes FROM @anchors() a",
    "geo_37_drive_between": "SELECT a.anchor_id, b.anchor_id AS other_id, CAST(@drive_between(@haversine_miles(a.lon,a.lat,b.lon,b.lat),12e-1,2e0,4) AS BIGINT) AS minutes FROM @anchors() a JOIN @anchors() b ON b.anchor_id BETWEEN a.anchor_id AND a.anchor_id + 5",
    "geo_38_round_miles": "SELECT outing_id, @q(@round_miles(foot_miles / 3),1e2) AS miles FROM @outings() o",
    "geo_39_ceil_minutes": "SELECT outing_id, @ceil_minutes(minutes / 7e0) AS m FROM @outings() o",
    "geo_40_time_bucket": "SELECT @time_bucket(minutes) AS bucket, count(*) AS n, @isum(minutes) AS minutes FROM @outings() o GROUP BY 1",
    "geo_41_outing_bucket": "SELECT @outing_bucket(minutes) AS bucket, count(*) AS n FROM @outings() o GROUP BY 1",
    "geo_42_pain_score": "SELECT outing_id, @q(@pain_score(foot_miles / 2,foot_miles,minutes,minutes * 112 / 100e0,outing_id % 2 = 0,outing_id % 3 = 0,outing_id % 5 > 0,outing_id % 11 = 0,outing_id % 4,foot_miles / 3),1e2) AS pain FROM @outings() o",
    "geo_43_action_priority": "SELECT outing_id, @q(@action_priority(CASE outing_id % 6 WHEN 0 THEN 'access_verification_sprint' WHEN 1 THEN 'promote_or_recertify_split' WHEN 2 THEN 'certifiable_anchor_redesign' WHEN 3 THEN 'parked_start_certification' WHEN 4 THEN 'human_cost_research' ELSE 'monitor' END,minutes / 2e0,foot_miles,outing_id % 90 - 45),1e2) AS priority FROM @outings() o",
    "geo_44_parking_risk": "SELECT anchor_id, CAST(@parking_risk(has_parking,confidence) AS BIGINT) AS risk FROM @anchors() a",
    "geo_45_confidence_rank": "SELECT anchor_id, CAST(@confidence_rank(confidence) AS BIGINT) AS rank FROM @anchors() a",
    "geo_46_objective_cost": "SELECT outing_id, @q(@objective_cost(foot_miles / (1 + outing_id % 4),foot_miles,minutes,ascent_ft,outing_id % 30),1e3) AS cost FROM @outings() o",
    "geo_47_candidate_cost": "SELECT outing_id, @q(@candidate_cost(foot_miles / (1 + outing_id % 4),foot_miles,route_status,15e-1),1e3) AS cost FROM @outings() o",
    "geo_48_normalized_objective": "WITH t AS (SELECT sum(foot_miles) AS miles, sum(minutes) AS minutes FROM @outings() o WHERE status = 'F') SELECT o.outing_id, @q(1e6 * (o.foot_miles / t.miles + o.minutes / CAST(t.minutes AS DOUBLE)) + 5e-2,1e2) AS cost FROM @outings() o CROSS JOIN t",
    "geo_50_segment_time": "WITH m AS (SELECT l_partkey AS seg_id, @percentile(l_quantity,5e-1) AS pace FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey) SELECT s.seg_id, @ceil_minutes(s.miles * coalesce(m.pace, 16e0)) AS minutes, CASE WHEN m.pace IS NULL THEN 'fallback' ELSE 'matched' END AS source FROM @segments() s LEFT JOIN m ON s.seg_id = m.seg_id",
    "geo_51_direction_validation": "WITH d AS (SELECT c.outing_id, CASE WHEN s.seg_id % 13 = 0 THEN NULL ELSE CAST((s.seg_id * 7 % 100) - 20 AS BIGINT) END AS delta FROM @claims() c JOIN @segments() s ON c.seg_id = s.seg_id WHERE s.direction = 'ascent') SELECT outing_id, count(*) AS checked, CAST(sum(CASE WHEN delta IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, bool_and(coalesce(delta > 0, false)) AS passed FROM d GROUP BY outing_id",
    # WIN: sequence operators over tracks
    "win_02_lag_delta": "SELECT track_id, idx, @q(value - lag(value) OVER (PARTITION BY track_id ORDER BY idx),1e2) AS d FROM @track() t",
    "win_03_cumulative_miles": f"SELECT track_id, idx, @q(sum(@haversine_miles(lon,lat,lon2,lat2)) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),1e2) AS miles FROM {_LEGS} l WHERE lon2 IS NOT NULL",
    "win_04_lane_index": "WITH e AS (SELECT track_id, idx, least(event_type, prev) AS a, greatest(event_type, prev) AS b FROM (SELECT track_id, idx, event_type, lag(event_type) OVER (PARTITION BY track_id ORDER BY idx) AS prev FROM @track() t) x WHERE prev IS NOT NULL) SELECT track_id, idx, CAST(row_number() OVER (PARTITION BY track_id, a, b ORDER BY idx) AS BIGINT) AS lane, count(*) OVER (PARTITION BY track_id, a, b) AS lanes FROM e",
    "win_05_nearest_index": "SELECT track_id, idx FROM (SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY @q(@haversine_miles(lon,lat,-1162e-1,436e-1),1e6), idx) AS r FROM @track() t) x WHERE r = 1",
    "win_06_direction_by_index": "WITH n AS (SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY @q(@haversine_miles(lon,lat,-1163e-1,435e-1),1e6), idx) AS a, row_number() OVER (PARTITION BY track_id ORDER BY @q(@haversine_miles(lon,lat,-1160e-1,438e-1),1e6), idx) AS b FROM @track() t), m AS (SELECT track_id, max(CASE WHEN a = 1 THEN idx END) AS s, max(CASE WHEN b = 1 THEN idx END) AS e FROM n GROUP BY track_id) SELECT track_id, CASE WHEN track_id % 10 = 0 THEN NULL ELSE s < e END AS uphill FROM m",
    "win_07_dedupe_adjacent": "SELECT track_id, idx, event_type FROM (SELECT track_id, idx, event_type, lag(event_type) OVER (PARTITION BY track_id ORDER BY idx) AS prev FROM @track() t) x WHERE prev IS NULL OR prev <> event_type",
    "win_09_gap_split": "WITH g AS (SELECT track_id, idx, @epoch(ts) - lag(@epoch(ts)) OVER (PARTITION BY track_id ORDER BY idx) AS gap FROM @track() t), p AS (SELECT track_id, idx, sum(CASE WHEN gap > 36000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM g) SELECT track_id, CAST(part AS BIGINT) AS part, count(*) AS points, min(idx) AS first_idx FROM p GROUP BY track_id, part",
    "win_12_car_passes": "WITH d AS (SELECT track_id, idx, @q(@haversine_miles(lon,lat,-1162e-1,436e-1),1e2) AS d FROM @track() t), near AS (SELECT track_id, idx, d, idx - lag(idx) OVER (PARTITION BY track_id ORDER BY idx) AS gap FROM d WHERE d <= 800 AND idx > 3), s AS (SELECT track_id, idx, d, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pass FROM near) SELECT track_id, CAST(pass AS BIGINT) AS pass, idx, d FROM (SELECT track_id, pass, idx, d, row_number() OVER (PARTITION BY track_id, pass ORDER BY d, idx) AS r FROM s) x WHERE r = 1",
    "win_13_interval_overlap": "WITH c AS (SELECT track_id, idx, @floor(idx / 10e0) AS part, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @track() t), m AS (SELECT a.track_id, a.part, b.part AS earlier, count(DISTINCT a.idx) AS shared FROM c a JOIN c b ON a.track_id = b.track_id AND a.cx = b.cx AND a.cy = b.cy AND b.part < a.part GROUP BY a.track_id, a.part, b.part) SELECT track_id, part, earlier, shared, shared >= 2 AS overlaps FROM m",
    "win_14_best_earlier_overlap": "WITH c AS (SELECT track_id, idx, @floor(idx / 10e0) AS part, @floor(lon * 20) AS cx, @floor(lat * 20) AS cy FROM @track() t), m AS (SELECT a.track_id, a.part, b.part AS earlier, count(DISTINCT a.idx) AS shared FROM c a JOIN c b ON a.track_id = b.track_id AND a.cx = b.cx AND a.cy = b.cy AND b.part < a.part GROUP BY a.track_id, a.part, b.part) SELECT track_id, part, earlier, shared FROM (SELECT track_id, part, earlier, shared, row_number() OVER (PARTITION BY track_id, part ORDER BY shared DESC, earlier) AS r FROM m) x WHERE r = 1",
    "win_16_credit_before_event": "SELECT conv_id, turn, count(DISTINCT role) AS needed_total FROM conversations GROUP BY conv_id, turn",
    "win_18_point_at_mile": f"WITH legs AS (SELECT track_id, idx, lon, lon2, @haversine_miles(lon,lat,lon2,lat2) AS d FROM {_LEGS} l WHERE lon2 IS NOT NULL), c AS (SELECT track_id, idx, lon, lon2, d, sum(d) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM legs) SELECT track_id, idx, @q(@lerp(lon,lon2,CASE WHEN d = 0 THEN 0e0 ELSE (1000 - (reach - d)) / d END),1e4) AS lon FROM c WHERE reach >= 1000 AND reach - d < 1000",
    "win_19_name_groups": "WITH f AS (SELECT track_id, idx, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY track_id ORDER BY idx) = event_type THEN 0 ELSE 1 END AS new FROM @track() t), g AS (SELECT track_id, idx, event_type, sum(new) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f) SELECT track_id, CAST(grp AS BIGINT) AS grp, min(event_type) AS event_type, min(idx) AS first_idx, count(*) AS n FROM g GROUP BY track_id, grp",
    "win_20_direction_evidence": "WITH c AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 3 = 0 THEN 'special_rule' WHEN role = 'user' THEN 'cue_text' ELSE 'rule' END AS evidence FROM conversations WHERE text IS NOT NULL) SELECT conv_id, role, evidence FROM (SELECT conv_id, role, evidence, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, evidence) AS r FROM c) x WHERE r = 1",
}
SQL["win_16_credit_before_event"] = """
    WITH c AS (SELECT user_id, event_id % 12 AS seg_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS idx FROM events),
    firsts AS (SELECT user_id, seg_id, min(idx) AS idx FROM c GROUP BY user_id, seg_id)
    SELECT user_id, CAST(12 - sum(CASE WHEN idx < 10 THEN 1 ELSE 0 END) AS BIGINT) AS uncredited_at_pass, CAST(sum(CASE WHEN idx < 10 THEN 1 ELSE 0 END) AS BIGINT) AS credited FROM firsts GROUP BY user_id"""
SQL["geo_18_bbox_overlap"] = SQL["geo_18_bbox_overlap"].replace(" WHERE outing_id <= 300 OR outing_id % 3 < 3", "")

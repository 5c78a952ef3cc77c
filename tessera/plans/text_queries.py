"""Text, id, date and hash operators (STR), row filters (FLT) and table scans with derived columns (SRC)."""

# The stop words in str_03.
SQL = {
    "str_01_clean_trail_name": "SELECT p_partkey AS seg_id, @clean_trail_name(concat(p_name, ' ', @text(p_partkey % 7))) AS name FROM part",
    "str_02_normalize_name": "SELECT p_partkey AS seg_id, @normal_name(concat('Tom''s `', p_name, '` #', @text(p_size), ' & 12 ', p_brand)) AS name FROM part",
    "str_03_name_tokens": "SELECT token, count(DISTINCT seg_id) AS n FROM (SELECT p_partkey AS seg_id, @words(@normal_name(concat(p_name, ' trail to the ', p_type))) AS token FROM part) x WHERE token NOT IN ('trail', 'trails', 'the', 'to', 'of', 'from', 'and', 'up', 'down', 'climb', 'lap', 'loop', 'cw', 'ccw', 'counter', 'clockwise', 'sign', '') GROUP BY token",
    "str_07_id_sort_key": "SELECT seg_id, CAST(row_number() OVER (ORDER BY @pad(seg_id,12), seg_id) AS BIGINT) AS place FROM @segments() s",
    "str_08_slugify": "SELECT p_partkey AS seg_id, @slug(p_name) AS slug FROM part",
    "str_10_name_variants": "SELECT DISTINCT seg_id, trim(variant) AS variant FROM (SELECT p_partkey AS seg_id, @words(replace(replace(concat(p_name, '/', p_brand, '-', p_type), '/', ' '), '-', ' ')) AS variant FROM part) x WHERE trim(variant) <> ''",
    "str_11_unambiguous_lookup": "SELECT concat(p_name, '/', @text(p_size)) AS name, min(p_brand) AS brand FROM part GROUP BY concat(p_name, '/', @text(p_size)) HAVING count(DISTINCT p_brand) = 1",
    "str_12_human_route_name": "WITH k AS (SELECT c.outing_id, p.p_brand, p.p_name, row_number() OVER (PARTITION BY c.outing_id ORDER BY c.seg_id) AS r FROM @claims() c JOIN part p ON p.p_partkey = c.seg_id) SELECT outing_id, CASE WHEN p_brand = p_name THEN p_brand ELSE concat(p_brand, ': ', p_name) END AS name FROM k WHERE r = 1",
    "str_13_signposts": "SELECT doc_id, length(text) - length(@rxall(text,'[0-9]','')) AS digits, @rxget(text,'([0-9]+)') AS first_number FROM documents WHERE text IS NOT NULL",
    "str_14_token_sequence": "SELECT doc_id, @has(@repeat_space(@rxall(lower(text),'[^a-z0-9]+',' ')),' of the ') AS mentioned FROM documents WHERE text IS NOT NULL",
    "str_15_private_text": "SELECT doc_id, @sha256(@private_text(text)) AS scrubbed FROM documents WHERE text IS NOT NULL",
    "str_16_id_list": "SELECT outing_id, @joined(seg_id,seg_id) AS ids FROM @claims() c GROUP BY outing_id",
    "str_17_access_reasons": "SELECT o_orderkey AS edge_id, concat(CASE WHEN lower(o_orderpriority) LIKE '1%' THEN 'access=no;' ELSE '' END, CASE WHEN o_orderstatus = 'P' THEN 'foot=private;' ELSE '' END) AS reasons FROM orders",
    "str_18_connector_class": "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'official_repeat' WHEN o_orderpriority LIKE '1%' THEN 'explicit' WHEN o_orderpriority LIKE '2%' THEN 'r2r_trail' WHEN o_orderpriority LIKE '3%' AND o_orderstatus = 'O' THEN 'osm_path_footway' WHEN o_orderpriority LIKE '3%' AND o_orderstatus = 'F' THEN 'osm_public_road' ELSE 'unknown_connector' END AS kind FROM orders) x GROUP BY kind",
    "str_19_canonical_hash": "SELECT p_partkey AS seg_id, @sha256(concat('{\"brand\":\"', p_brand, '\",\"name\":\"', p_name, '\",\"size\":', @text(p_size), '}')) AS h FROM part",
    "str_20_geometry_hash": "SELECT seg_id, @sha256(concat('[', @text(@node5(lon)), ',', @text(@node5(lat)), ']')) AS h FROM @segments() s",
    "str_22_date_range": "SELECT owner_id, d FROM (SELECT owner_id, @series(lo, hi) AS d FROM (SELECT owner_id, min(@day(day)) AS lo, max(@day(day)) AS hi FROM @outings() o GROUP BY owner_id) x) y",
    "str_23_weekday_counts": "SELECT @month(day) AS month, CAST(sum(CASE WHEN @weekday(day) >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS weekend, CAST(sum(CASE WHEN @weekday(day) < 5 THEN 1 ELSE 0 END) AS BIGINT) AS weekday FROM @outings() o GROUP BY 1",
    "str_24_month_day_window": "SELECT outing_id FROM @outings() o WHERE @monthday(day) BETWEEN '06-18' AND '07-18'",
    "str_25_named_window": "WITH w AS (SELECT 1 AS ord, 'spring' AS name, '03-01' AS a, '05-31' AS b UNION ALL SELECT 2, 'challenge', '05-15', '07-18' UNION ALL SELECT 3, 'autumn', '09-01', '11-30') SELECT outing_id, name FROM (SELECT o.outing_id, w.name, row_number() OVER (PARTITION BY o.outing_id ORDER BY w.ord) AS r FROM @outings() o JOIN w ON @monthday(o.day) BETWEEN w.a AND w.b) x WHERE r = 1",
    "str_26_preflight_rule": "SELECT outing_id, CASE WHEN @day(day) % 2 = 1 AND owner_id % 3 = 0 THEN 'blocking' WHEN minutes > 300 THEN 'warning' WHEN route_status = 'draft' THEN 'manual' ELSE 'clear' END AS verdict FROM @outings() o",
    "str_27_five_minutes": "SELECT outing_id, 5 * CASE WHEN (minutes % 5) * 2 > 5 THEN @floor(minutes / 5e0) + 1 ELSE @floor(minutes / 5e0) END AS m FROM @outings() o",
    "str_28_number_or_zero": "SELECT o_orderkey AS k, @q(coalesce(@number(CASE WHEN o_orderkey % 3 = 0 THEN 'bad' WHEN o_orderkey % 3 = 1 THEN '' ELSE @text(o_orderkey) END), 0e0),1e0) AS v FROM orders",
    "str_29_id_cast": "SELECT outing_id, CASE WHEN @number(key) IS NULL THEN 1 ELSE 0 END AS is_text FROM (SELECT o_orderkey AS outing_id, CASE WHEN o_orderkey % 9 = 0 THEN concat('x', @text(o_orderkey)) ELSE @text(o_orderkey) END AS key FROM orders) x",
    "str_30_review_decision": "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'reject' WHEN l.quality = 0 THEN 'revise' WHEN l.quality = 1 THEN 'accept' ELSE 'pending' END AS decision FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "flt_01_remaining_segments": "SELECT s.seg_id FROM @segments() s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = s.seg_id AND l.l_returnflag = 'A' AND l.l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = 13 AND @normal_name(b.p_name) = @normal_name(s.trail_name))",
    "flt_02_foot_activity": "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')",
    "flt_03_usable_feature": "SELECT o_orderkey AS edge_id FROM orders o WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT LIKE '5%' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
    "flt_04_field_ready": "SELECT outing_id FROM @outings() o WHERE route_status = 'graph_validated' AND minutes <= 300 AND owner_id % 5 <> 0",
    "flt_05_available_routes": "SELECT o.outing_id FROM @outings() o WHERE o.route_status = 'graph_validated' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.outing_id AND l.l_partkey % 37 = 0)",
    "flt_06_executable": "SELECT outing_id FROM @outings() o WHERE route_status = 'graph_validated' AND minutes IS NOT NULL AND foot_miles IS NOT NULL AND foot_miles > 0",
    "flt_07_navigation_payload": "SELECT l_orderkey AS outing_id, bool_and(l_quantity <= 45 OR l_returnflag <> 'R') AS complete FROM lineitem GROUP BY l_orderkey",
    "flt_08_unique_segments": "SELECT a.owner_id, count(*) AS claims, count(DISTINCT c.seg_id) AS segments, count(*) = count(DISTINCT c.seg_id) AS disjoint FROM @outings() a JOIN @claims() c ON c.outing_id = a.outing_id GROUP BY a.owner_id",
    "flt_09_parking_validated": "SELECT anchor_id FROM @anchors() a WHERE has_parking AND confidence LIKE '%validated%'",
    "flt_10_route_status": "SELECT outing_id, CASE WHEN outing_id % 2 = 0 AND outing_id % 7 > 0 AND outing_id % 3 <> 2 THEN 'graph_validated' ELSE 'draft' END AS status, CASE WHEN outing_id % 2 = 0 AND outing_id % 7 > 0 AND outing_id % 3 <> 2 THEN 2 WHEN outing_id % 5 = 0 AND outing_id % 3 <> 2 THEN 1 ELSE 0 END AS rank FROM @outings() o",
    "flt_11_selection_reasons": "SELECT outing_id, concat(CASE WHEN @monthday(day) BETWEEN '06-18' AND '07-18' THEN 'window;' ELSE '' END, CASE WHEN @day(day) >= 10000 THEN 'recent;' ELSE '' END) AS reasons FROM @outings() o WHERE @monthday(day) BETWEEN '06-18' AND '07-18' OR @day(day) >= 10000",
    "flt_12_reject_reasons": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'sport' WHEN @haversine_miles(lon,lat,-1162e-1,436e-1) < 3e0 THEN 'home_radius' WHEN value < 10 THEN 'too_short' ELSE 'kept' END AS reason FROM @track() t) x GROUP BY reason",
    "flt_13_max_consecutive": "WITH d AS (SELECT DISTINCT owner_id AS who, @day(day) AS d FROM @outings() o), i AS (SELECT who, d - row_number() OVER (PARTITION BY who ORDER BY d) AS island FROM d), n AS (SELECT who, island, count(*) AS run FROM i GROUP BY who, island) SELECT who, max(run) AS longest, max(run) > 3 AS exceeds FROM n GROUP BY who",
    "flt_14_day_constraints": "WITH dy AS (SELECT DISTINCT @day(day) AS d FROM @outings() o), k AS (SELECT minutes <= 240 AND foot_miles <= 10 AND ascent_ft <= 2000 AS small, count(*) AS n FROM @outings() o GROUP BY 1) SELECT d.d, @isum(k.n) AS allowed FROM dy d JOIN k ON d.d % 30 < 25 OR k.small GROUP BY d.d",
    "flt_15_completion_safe": "WITH c AS (SELECT DISTINCT l_orderkey AS outing_id, l_partkey AS seg_id FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT seg_id, count(*) AS n FROM c GROUP BY seg_id) SELECT c.outing_id, CAST(sum(CASE WHEN n.n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_here, bool_and(n.n > 1) AS safe FROM c JOIN n ON n.seg_id = c.seg_id GROUP BY c.outing_id",
    "src_02_segments": "SELECT seg_id, trail_name, @q(miles,1e2) AS miles, direction, @node4(lon) AS x, @node4(lat) AS y FROM @segments() s",
    "src_03_named_lines": "SELECT p_partkey AS seg_id, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), nullif(p_brand, ''), 'unnamed') AS name FROM part",
    "src_06_trailheads": "SELECT anchor_id, name, @node4(lon) AS x, @node4(lat) AS y, 8 AS parking_minutes FROM @anchors() a WHERE has_parking",
    "src_07_parking_index": "SELECT name, anchor_id FROM (SELECT @normal_name(p_brand) AS name, p_partkey AS anchor_id, row_number() OVER (PARTITION BY @normal_name(p_brand) ORDER BY p_partkey DESC) AS r FROM part) x WHERE r = 1",
    "src_08_activity_paces": "SELECT event_id, @q(value / 3e0,1e2) AS pace FROM events WHERE event_type IN ('click', 'view') AND value >= 5e-1",
    "src_09_segment_paces": "SELECT p_partkey AS seg_id, p_size AS pace FROM part WHERE p_size BETWEEN 5 AND 40",
    "src_10_activity_dates": "SELECT event_id, @month(ts) AS month, @weekday(ts) AS weekday, @weekday(ts) >= 5 AS weekend FROM events WHERE event_type = 'click'",
    "src_12_efforts_with_parent": "SELECT o.o_orderkey AS activity_id, @day(o.o_orderdate) AS day, l.l_partkey AS seg_id, l.l_linenumber AS ord, @q(l.l_quantity,1e0) AS seconds FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 5",
    "src_17_dem_pixels": "SELECT s.seg_id, @floor((s.lon + 117) * 50) AS col, @floor((45 - s.lat) * 50) AS row_no, CASE WHEN s.seg_id % 29 = 0 THEN NULL ELSE @q((s.seg_id % 900) * 3280839895e-9,1e2) END AS elevation_ft FROM @segments() s",
    "src_19_rule_overrides": "SELECT seg_id, allowed FROM (SELECT p_partkey AS seg_id, CASE WHEN p_size % 4 = 0 THEN 'forward' WHEN p_size % 4 = 1 THEN 'reverse' ELSE 'forward,reverse' END AS allowed FROM part) x WHERE allowed <> 'forward,reverse'",
    "src_21_condition_row": "SELECT page_id, @rxget(html,'<title>([^<]*)') AS title FROM pages WHERE html IS NOT NULL",
    "src_24_embedded_json": "SELECT event_id, @json_int(props,'k') AS k FROM events",
    "src_26_track_stats": "SELECT track_id, count(*) AS points, min(@day(ts)) AS first_day, max(@day(ts)) AS last_day FROM @track() t GROUP BY track_id",
    "snk_03_csv_upsert": "SELECT l_orderkey AS run_id, l_partkey AS seg_id, n FROM (SELECT l_orderkey, l_partkey, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC) AS r FROM lineitem) x WHERE r = 1",
    "snk_05_gpx_points": "SELECT track_id, @sha256(@joined(concat(@text(@node5(lat)), ' ', @text(@node5(lon))),idx)) AS gpx FROM @track() t GROUP BY track_id",
    "snk_08_manifest_verification": "WITH e AS (SELECT doc_id AS path, @sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE @sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0) SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem FROM e FULL OUTER JOIN a ON e.path = a.path WHERE e.path IS NULL OR a.path IS NULL OR e.h <> a.h",
    "snk_12_public_safety": "SELECT doc_id, CASE WHEN @has(text,'token = ') THEN 'secret' ELSE 'licence' END AS failure FROM documents WHERE @has(text,'token = ') OR text LIKE '%Licensed under%'",
}

"""Scalar functions of the engine, each stated once as an SQL expression.

``render`` expands ``@name(arguments)`` in SQL text for Spark or for DuckDB; ``expr`` makes a Column. All are built-in
expressions, so they stay inside whole-stage code generation. Distances are miles, angles degrees, times minutes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: name -> (parameters, expression) or (parameters, Spark expression, DuckDB expression)
MACROS: dict[str, tuple[str, ...]] = {
    # engine differences
    "q": ("x,s", "CAST(FLOOR((x) * s + 5e-1) AS BIGINT)"),
    "isum": ("x", "CAST(sum(x) AS BIGINT)"),
    "floor": ("x", "CAST(FLOOR(x) AS BIGINT)"),
    "ceil": ("x", "CAST(CEIL(x) AS BIGINT)"),
    "rxall": ("x,p,r", "regexp_replace(x, p, r)", "regexp_replace(x, p, r, 'g')"),
    "rxget": ("x,p", "regexp_extract(x, p, 1)", "regexp_extract(x, p, 1)"),
    "has": ("x,y", "contains(x, y)"),
    "sha256": ("x", "sha2(x, 256)", "sha256(x)"),
    "day": ("x", "CAST(unix_date(CAST(x AS DATE)) AS BIGINT)", "CAST(CAST(x AS DATE) - DATE '1970-01-01' AS BIGINT)"),
    "weekday": ("x", "CAST(weekday(CAST(x AS DATE)) AS BIGINT)", "CAST(isodow(CAST(x AS DATE)) - 1 AS BIGINT)"),
    "monthday": ("x", "date_format(x, 'MM-dd')", "strftime(x, '%m-%d')"),
    "month": ("x", "date_format(x, 'yyyy-MM')", "strftime(x, '%Y-%m')"),
    "epoch": ("x", "unix_micros(CAST(x AS TIMESTAMP))", "epoch_us(x)"),
    "series": ("a,b", "explode(sequence(a, b))", "unnest(generate_series(a, b))"),
    "words": ("x", "explode(split(x, ' '))", "unnest(string_split(x, ' '))"),
    "joined": ("x,o", "array_join(transform(array_sort(collect_list(named_struct('o', o, 'v', CAST(x AS STRING)))), s -> s.v), ',')", "string_agg(CAST(x AS VARCHAR), ',' ORDER BY o)"),
    "joined_set": ("x", "array_join(transform(array_sort(collect_set(x)), s -> CAST(s AS STRING)), ',')", "string_agg(DISTINCT CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR))"),
    "number": ("x", "try_cast(x AS DOUBLE)", "TRY_CAST(x AS DOUBLE)"),
    "json_int": ("x,k", "CAST(get_json_object(x, concat('$.', k)) AS BIGINT)", "CAST(json_extract_string(x, concat('$.', k)) AS BIGINT)"),
    "pad": ("x,n", "lpad(CAST(x AS STRING), n, '0')", "lpad(CAST(x AS VARCHAR), n, '0')"),
    "percentile": ("x,p", "percentile(x, p)", "quantile_cont(x, p)"),
    "text": ("x", "CAST(x AS STRING)", "CAST(x AS VARCHAR)"),
    "popcount": ("x", "CAST(bit_count(x) AS BIGINT)"),
    "repeat_space": ("x", "concat(' ', x, ' ')"),
    # geometry
    "haversine_a": ("a,b,c,d", "(pow(sin(radians((d) - (b)) / 2), 2) + cos(radians(b)) * cos(radians(d)) * pow(sin(radians((c) - (a)) / 2), 2))"),
    "haversine_miles": ("a,b,c,d", "(2 * 39587613e-4 * atan2(sqrt(@haversine_a(a,b,c,d)), sqrt(greatest(0e0, 1 - @haversine_a(a,b,c,d)))))"),
    "local_x": ("x,z", "((x) * 69172e-3 * cos(radians(z)))"),
    "local_y": ("y", "((y) * 69e0)"),
    "index_x": ("x,z", "((x) * cos(radians(z)) * 69e0)"),
    "along": ("p,r,a,b,c,d", "CASE WHEN pow((c) - (a), 2) + pow((d) - (b), 2) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (((p) - (a)) * ((c) - (a)) + ((r) - (b)) * ((d) - (b))) / (pow((c) - (a), 2) + pow((d) - (b), 2)))) END"),
    "segment_miles": ("p,r,a,b,c,d", "sqrt(pow((p) - ((a) + (@along(p,r,a,b,c,d)) * ((c) - (a))), 2) + pow((r) - ((b) + (@along(p,r,a,b,c,d)) * ((d) - (b))), 2))"),
    "lerp": ("a,b,f", "((a) + ((b) - (a)) * (f))"),
    "bearing": ("a,b,c,d", "CASE WHEN (a) = (c) AND (b) = (d) THEN NULL ELSE (degrees(atan2(sin(radians((c) - (a))) * cos(radians(d)), cos(radians(b)) * sin(radians(d)) - sin(radians(b)) * cos(radians(d)) * cos(radians((c) - (a))))) + 360e0) % 360e0 END"),
    "bearing_delta": ("a,b", "((((b) - (a) + 540e0) % 360e0 + 360e0) % 360e0 - 180e0)"),
    # The phrases and limits of the turn classes.
    "turn_phrase": ("x", "CASE WHEN abs(x) < 25 THEN 'continue straight' WHEN abs(x) < 60 THEN CASE WHEN (x) > 0 THEN 'bear right' ELSE 'bear left' END WHEN abs(x) < 140 THEN CASE WHEN (x) > 0 THEN 'turn right' ELSE 'turn left' END WHEN abs(x) < 170 THEN CASE WHEN (x) > 0 THEN 'make a sharp right' ELSE 'make a sharp left' END ELSE 'turn around' END"),
    "mercator_lon": ("x", "((x) / 20037508342789244e-9 * 180e0)"),
    "mercator_lat": ("y", "degrees(2 * atan(exp((y) / 20037508342789244e-9 * pi())) - pi() / 2)"),
    "node4": ("x", "@q(x,1e4)"),
    "node5": ("x", "@q(x,1e5)"),
    "cell": ("x", "@floor((x) * 1e3)"),
    "boxes_meet": ("a,b,c,d,e,f,g,h,p,r", "((a) - (p) <= (g) AND (c) + (p) >= (e) AND (b) - (r) <= (h) AND (d) + (r) >= (f))"),
    # minutes and scores
    "round_miles": ("x", "round((x) + 1e-9, 2)"),
    "ceil_minutes": ("x", "@ceil(greatest(0e0, x) - 1e-9)"),
    # Names and limits of the time buckets.
    "time_bucket": ("x", "CASE WHEN (x) <= 60 THEN 'under_1_hour' WHEN (x) <= 119 THEN 'one_to_two_hours' WHEN (x) <= 180 THEN 'two_to_three_hours' WHEN (x) <= 240 THEN 'three_to_four_hours' ELSE 'four_plus_hours' END"),
    "outing_bucket": ("x", "CASE WHEN coalesce(x, 0) <= 120 THEN '2 hours or less' WHEN (x) <= 180 THEN '2-3 hours' WHEN (x) <= 240 THEN '3-4 hours' ELSE '4+ hours' END"),
    "effort_minutes": ("m,a", "((m) + (a) / 100e0)"),
    "p75_minutes": ("x", "@ceil_minutes((x) * 112e-2)"),
    "drive_minutes": ("d,f,m,least_minutes", "greatest(@ceil_minutes((d) * (f) * (m)), least_minutes)"),
    "drive_between": ("d,f,m,least_minutes", "CASE WHEN (d) = 0 THEN 0 WHEN (d) > 5e-2 THEN greatest(@ceil_minutes((d) * (f) * (m)), least_minutes) ELSE @ceil_minutes((d) * (f) * (m)) END"),
    "route_finding_penalty": ("snap,links,noncredit,repeats,trails", "least(25, CASE snap WHEN 'medium' THEN 4 WHEN 'low' THEN 10 ELSE 0 END + CASE WHEN (links) > 1 THEN least(8, ((links) - 1) * 2) ELSE 0 END + CASE WHEN (noncredit) + CASE WHEN (trails) > 1 THEN repeats ELSE 0e0 END >= 15e-1 THEN 8 WHEN (noncredit) + CASE WHEN (trails) > 1 THEN repeats ELSE 0e0 END >= 5e-1 THEN 4 ELSE 0 END + CASE WHEN (trails) >= 5 THEN 4 WHEN (trails) >= 3 THEN 2 ELSE 0 END)"),
    "pain_score": ("official,foot,p75,p90,carpass,water,parking,unverified,warnings,leg", "(greatest((foot) - (official), 0e0) * 10 + greatest((p75) - 240, 0) / 10e0 + greatest((p90) - 300, 0) / 10e0 + CASE WHEN carpass THEN 0 ELSE 8 END + CASE WHEN water THEN 0 ELSE 4 END + CASE WHEN parking THEN 0 ELSE 12 END + CASE WHEN unverified THEN 18 ELSE 0 END + (warnings) * 2 + greatest((leg) - 3, 0e0) * 2)"),
    "action_priority": ("status,pain,savings,delta", "CASE status WHEN 'access_verification_sprint' THEN 1000 + (savings) * 100 + greatest(-(delta), 0) * 2 + (pain) / 10e0 WHEN 'promote_or_recertify_split' THEN 800 + (savings) * 100 + greatest(-(delta), 0) + (pain) / 10e0 WHEN 'certifiable_anchor_redesign' THEN 700 + (savings) * 80 + greatest(-(delta), 0) + (pain) / 10e0 WHEN 'parked_start_certification' THEN 300 + (pain) WHEN 'human_cost_research' THEN 200 + (pain) ELSE 0e0 END"),
    "parking_risk": ("parking,confidence", "CASE WHEN NOT coalesce(parking, false) THEN 3 WHEN lower(confidence) LIKE '%validated%' OR lower(confidence) LIKE '%strava_reused%' THEN 0 WHEN lower(confidence) LIKE '%strava_seen%' OR lower(confidence) LIKE '%osm_amenity%' THEN 1 ELSE 2 END"),
    # Ranks of parking confidences; a longer name takes the rank of the one it begins with, others have 40.
    "confidence_rank": ("x", "CASE WHEN (x) LIKE 'source_validated_trailhead%' THEN 90 WHEN (x) LIKE 'source_verified_roadside_plus_strava_seen%' THEN 88 WHEN (x) LIKE 'source_verified_roadside%' THEN 86 WHEN (x) LIKE 'osm_amenity_parking_fee_no_capacity_36_source_checked%' THEN 84 WHEN (x) LIKE 'osm_amenity_parking_capacity_16_source_checked%' THEN 84 WHEN (x) LIKE 'osm_amenity_parking_source_checked%' THEN 82 WHEN (x) LIKE 'osm_amenity_parking_near_official_start%' THEN 80 WHEN (x) LIKE 'user_review_confirmed_paved_road_parking%' THEN 78 WHEN (x) LIKE 'strava_reused_prior_challenge_window%' THEN 76 WHEN (x) LIKE 'strava_seen_prior_challenge_window%' THEN 72 WHEN (x) LIKE 'inferred_from_trailhead_layer%' THEN 64 WHEN (x) LIKE 'user_configured_trailhead%' THEN 62 WHEN (x) LIKE 'strava_single_prior_challenge_window%' THEN 50 WHEN (x) LIKE 'street_parking_probe_manual_required%' THEN 28 WHEN (x) LIKE 'manual_required%' THEN 20 ELSE 40 END"),
    "candidate_cost": ("official,foot,status,weight", "((weight) + (foot) + CASE WHEN (official) < 2 THEN 8 ELSE 0 END + CASE WHEN (official) < 1 THEN 12 ELSE 0 END + greatest(0e0, CASE WHEN (official) > 0 THEN (foot) / (official) ELSE 99e0 END - 18e-1) * 5 + CASE WHEN (status) = 'graph_validated' THEN 0 ELSE 10000 END)"),
    "objective_cost": ("official,foot,minutes,ascent,day", "((foot) + greatest(0e0, (foot) - (official)) * 15e-1 + (minutes) * 2e-2 + (ascent) / 1e3 * 35e-2 + (day) * 1e-5 + CASE WHEN (official) / (foot) < 35e-2 THEN 2 ELSE 0 END)"),
    "match_confidence": ("d,s", "CASE WHEN (d) <= 2e-2 AND (s) >= 75e-2 THEN 'high' WHEN (d) <= 5e-2 AND (s) >= 45e-2 THEN 'medium' WHEN (d) <= 1e-1 THEN 'low' ELSE 'review' END"),
    "review_status": ("fraction,a,b,touch,near,direction", "CASE WHEN (fraction) >= 85e-2 AND (a) <= touch AND (b) <= touch AND (direction) THEN 'completed' WHEN (fraction) >= 85e-2 AND (a) <= touch AND (b) <= touch AND NOT (direction) THEN 'wrong_ascent_direction' WHEN (fraction) >= 85e-2 AND (a) <= touch AND (b) <= touch THEN 'direction_unverified' WHEN ((a) <= touch) <> ((b) <= touch) AND (fraction) < 35e-2 THEN 'near_touch' WHEN (fraction) >= 5e-1 THEN 'partial' WHEN (a) <= near OR (b) <= near THEN 'near_touch' ELSE 'not_matched' END"),
    # text
    "clean_trail_name": ("x", "trim(@rxall(x,'[ ]+[0-9]+$',''))"),
    "normal_name": ("x", "trim(@rxall(@rxall(concat(' ', @rxall(@rxall(@rxall(lower(x),'[''`]',''),'[^a-z0-9]+',' '),' ','  '), ' '),' [0-9]+ ',' '),' +',' '))"),
    "slug": ("x", "CASE WHEN @normal_name(x) = '' THEN 'candidate' ELSE replace(@normal_name(x), ' ', '-') END"),
    "private_text": ("x", "@rxall(@rxall(x,'[A-Za-z0-9._%+-]+@@[A-Za-z0-9.-]+',':email:'),'[0-9]{1,3}([.][0-9]{1,3}){3}',':address:')"),
    "lon": ("k", "(CAST(-11643e-2 AS DOUBLE) + ((k) * 7919 % 5000) / CAST(10000 AS DOUBLE))"),
    "lat": ("k", "(CAST(4348e-2 AS DOUBLE) + ((k) * 104729 % 3700) / CAST(10000 AS DOUBLE))"),
    # the engine's roles on relational tables: segments, outings that claim them, anchors, tracks, ledger
    "segments": ("", "(SELECT p_partkey AS seg_id, p_name AS trail_name, p_size / 10e0 AS miles, CASE WHEN p_partkey % 11 = 0 THEN 'ascent' ELSE 'both' END AS direction, @lon(p_partkey) AS lon, @lat(p_partkey) AS lat FROM part)"),
    "claims": ("", "(SELECT DISTINCT l_orderkey AS outing_id, l_partkey AS seg_id FROM lineitem)"),
    "outings": ("", "(SELECT o_orderkey AS outing_id, o_custkey AS owner_id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, 20 + @floor(o_totalprice) % 380 AS minutes, 1 + (o_orderkey * 37 % 190) / 10e0 AS foot_miles, (o_orderkey * 53 % 3000) AS ascent_ft, CASE WHEN o_orderstatus = 'F' THEN 'graph_validated' ELSE 'draft' END AS route_status FROM orders)"),
    "anchors": ("", "(SELECT s_suppkey AS anchor_id, s_name AS name, @lon(s_suppkey * 31 + 7) AS lon, @lat(s_suppkey * 31 + 7) AS lat, s_acctbal > 2000 AS has_parking, CASE s_suppkey % 5 WHEN 0 THEN 'source_validated_trailhead' WHEN 1 THEN 'strava_reused_prior_challenge_window' WHEN 2 THEN 'strava_seen_prior_challenge_window' WHEN 3 THEN 'osm_amenity_parking_source_checked' ELSE 'unknown' END AS confidence FROM supplier)"),
    "track": ("", "(SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS idx, ts, @lon(event_id) AS lon, @lat(event_id) AS lat, event_type, value FROM events)"),
    "ledger": ("", "(SELECT @month(ts) AS epoch, @day(ts) AS day_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'completed' WHEN event_type = 'purchase' THEN 'missed' ELSE 'blocked' END AS kind, event_id % 400 AS seg_id, user_id FROM events)"),
}
_CALL = re.compile(r"@(\w+)\(")


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of the call whose parenthesis opens before ``start``, and the place after it closes."""
    depth, quoted, parts, begin, i = 0, False, [], start, start
    while True:
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c in "([":
                depth += 1
            elif c in ")]" and depth:
                depth -= 1
            elif c == ")":
                parts.append(text[begin:i].strip())
                return ([] if parts == [""] else parts), i + 1
            elif c == "," and not depth:
                parts.append(text[begin:i].strip())
                begin = i + 1
        i += 1


def render(text: str, dialect: str = "spark") -> str:
    """``text`` with all ``@name(arguments)`` expanded; ``@@`` stands for the character itself."""
    at = 0
    while m := _CALL.search(text, at):
        if m.start() and text[m.start() - 1] == "@":
            at = m.end()
            continue
        values, end = _arguments(text, m.end())
        names, *bodies = MACROS[m[1]]
        names = [n for n in names.split(",") if n]
        if len(names) != len(values):
            raise ValueError(f"{m[1]} takes {len(names)} arguments, got {len(values)}")
        body = bodies[dialect == "duckdb" and len(bodies) > 1]
        if names:
            given = dict(zip(names, values, strict=True))
            body = re.sub(r"'(?:[^']|'')*'|(?<![@\w.])\b(?:" + "|".join(names) + r")\b(?!\()", lambda x: given.get(x[0], x[0]), body)
        text, at = text[: m.start()] + body + text[end:], m.start()
    return text.replace("@@", "@")


def expr(name: str, *arguments: str) -> Column:
    """Column of one of the functions; arguments are column names or SQL expressions."""
    return F.expr(render(f"@{name}({', '.join(arguments)})"))

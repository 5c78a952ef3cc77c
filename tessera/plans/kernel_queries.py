"""Operators that need a sequential kernel, each on bounded groups. SQL states an oracle only where it can."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window, functions as F

from ..functions import text
from ..functions.expressions import render
from ..operators import kernels as K
from ..operators.checkpoints import checkpointed
from ..operators.components import connected_components
from ..operators.grouped import apply_to_groups, apply_to_lists
from ..operators.nearest import nearest

HOME = (-116.2, 43.6)
QUERIES, ORACLES = {}, {}


def _rows(spark, sf_dir, sql):
    from .sql_queries import _runner

    return _runner(sql)(spark, sf_dir)


def kernel(name: str, sql: str, key: str, schema: str, order: str):
    """Register a kernel over the groups of an SQL input."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: apply_to_groups(_rows(spark, sf_dir, sql), key, schema, function, order.split(","))
        return function

    return register


def list_kernel(name: str, sql: str, key: str, schema: str, columns: str):
    """Register a kernel over the lists of each group's columns; a column may be an expression with a name."""

    def register(function):
        def query(spark, sf_dir):
            rows = _rows(spark, sf_dir, sql).selectExpr(key, *columns.split(";"))
            return apply_to_lists(rows, key, schema, function, rows.columns[1:])

        QUERIES[name] = query
        return function

    return register


_TRACK = "SELECT track_id, idx, lon, lat, event_type, value FROM @track() t"
_GRAPH = "SELECT track_id, u, v, min(w) AS w, min(label) AS label FROM (SELECT track_id, CAST(@floor(lon * 20) * 100000 + @floor(lat * 20) AS BIGINT) AS u, CAST(@floor(lon2 * 20) * 100000 + @floor(lat2 * 20) AS BIGINT) AS v, @haversine_miles(lon,lat,lon2,lat2) AS w, idx % 7 AS label FROM (SELECT track_id, idx, lon, lat, lead(lon) OVER (PARTITION BY track_id ORDER BY idx) AS lon2, lead(lat) OVER (PARTITION BY track_id ORDER BY idx) AS lat2 FROM @track() t) l WHERE lon2 IS NOT NULL) e WHERE u <> v GROUP BY track_id, u, v"
_COVER = "SELECT o.owner_id, o.outing_id, c.seg_id, o.minutes, o.foot_miles AS miles FROM @outings() o JOIN @claims() c ON c.outing_id = o.outing_id"
_OUTINGS = "SELECT owner_id, outing_id, minutes, foot_miles, @day(day) AS day FROM @outings() o"


def _edges(pdf):
    return list(zip(pdf.u, pdf.v, pdf.w, pdf.label, strict=True))


def _undirected(pdf):
    seen = {}
    for u, v, w, _ in _edges(pdf):
        key = (min(u, v), max(u, v))
        seen[key] = min(w, seen.get(key, w))
    return [(u, v, w) for (u, v), w in sorted(seen.items())]


def _both(pdf):
    edges = _undirected(pdf)
    return K.adjacency([*edges, *((v, u, w) for u, v, w in edges)])


def _nodes(pdf):
    return sorted(set(pdf.u) | set(pdf.v))


def _candidates(pdf):
    return {int(k): (set(g.seg_id.tolist()), float(g.minutes.iloc[0])) for k, g in pdf.groupby("outing_id")}


@kernel("grf_04_constrained_path", _GRAPH, "track_id", "target long, miles double, hops long", "u,v")
def _constrained(pdf):
    graph, nodes = K.adjacency(_edges(pdf)), sorted(set(pdf.u) | set(pdf.v))
    paths = K.shortest_paths(graph, nodes[0], avoid={3}, limit=400.0, targets={nodes[-1]})
    if nodes[-1] in paths:
        yield nodes[-1], paths[nodes[-1]][0], len(K.path_to(paths, nodes[-1])) - 1


@kernel("grf_05_distances_to_targets", _GRAPH, "track_id", "target long, miles double", "u,v")
def _targets(pdf):
    nodes = sorted(set(pdf.u) | set(pdf.v))
    paths = K.shortest_paths(_both(pdf), nodes[0], targets=set(nodes[-3:]))
    yield from ((t, paths[t][0]) for t in nodes[-3:] if t in paths)


@kernel("grf_06_distance_index", _GRAPH, "track_id", "target long, miles double", "u,v")
def _index(pdf):
    yield from ((t, d) for t, (d, _) in sorted(K.shortest_paths(_both(pdf), int(pdf.u.min())).items()))


@kernel("grf_08_node_matrix", _GRAPH, "track_id", "source long, target long, miles double", "u,v")
def _matrix(pdf):
    graph = K.adjacency(_edges(pdf))
    for s in _nodes(pdf):
        yield from ((s, t, d) for t, (d, _) in sorted(K.shortest_paths(graph, s).items()))


QUERIES["grf_09_directed_distances"] = QUERIES["grf_08_node_matrix"]


@kernel("grf_16_min_matching", _GRAPH, "track_id", "pairs long, miles double, exact boolean", "u,v")
def _matching(pdf):
    odd = K.odd_nodes(_undirected(pdf))
    where = {n: (n // 100000 / 20, n % 100000 / 20) for n in odd}
    pairs, exact = K.minimum_matching(odd, lambda a, b: K.haversine_miles(where[a], where[b]))
    yield len(pairs), sum(K.haversine_miles(where[a], where[b]) for a, b in pairs), exact


@kernel("grf_17_graph_matching", _GRAPH, "track_id", "pairs long, miles double, exact boolean", "u,v")
def _graph_matching(pdf):
    graph, odd = _both(pdf), K.odd_nodes(_undirected(pdf))
    paths = {x: K.shortest_paths(graph, x) for x in odd}
    pairs, exact = K.minimum_matching(odd, lambda a, b: paths[a].get(b, (1e9,))[0])
    yield len(pairs), sum(paths[a][b][0] for a, b in pairs), exact


@kernel("grf_18_postman_bound", _GRAPH, "track_id", "required double, parity double, bound double", "u,v")
def _bound(pdf):
    edges = _undirected(pdf)
    required = sum(w for _, _, w in edges)
    ((_, parity, _),) = _graph_matching(pdf)
    yield required, parity, required + parity


@kernel("grf_19_attachment_tree", _TRACK, "track_id", "edges long, miles double", "idx")
def _tree(pdf):
    points = list(zip(pdf.lon, pdf.lat, strict=True))
    tree = K.minimum_tree(list(range(len(points))), lambda a, b: K.haversine_miles(points[a], points[b]))
    yield len(tree), sum(d for _, _, d in tree)


@kernel("grf_20_edge_cover_bound", _GRAPH, "track_id", "generated double, bound double, ratio double", "u,v")
def _cover_bound(pdf):
    ((_, _, bound),) = _bound(pdf)
    yield float(pdf.w.sum()), bound, float(pdf.w.sum()) / bound


@kernel("grf_21_path_on_segments", _GRAPH, "track_id", "target long, miles double", "u,v")
def _segments(pdf):
    nodes = sorted(set(pdf.u) | set(pdf.v))
    paths = K.shortest_paths(K.adjacency([*_edges(pdf), *((v, u, w, x) for u, v, w, x in _edges(pdf))]), nodes[0], avoid={1, 2})
    if nodes[-1] in paths:
        yield nodes[-1], paths[nodes[-1]][0]


@kernel("grf_22_chained_credit", _GRAPH, "track_id", "removed long, parts long", "u,v")
def _chained(pdf):
    for label in range(7):
        yield label, len(set(K.graph_components(_edges(pdf), avoid={label}).values()))


@kernel("grf_23_postman_circuit", _GRAPH, "track_id", "steps long, miles double", "u,v")
def _circuit(pdf):
    edges = _undirected(pdf)
    tour, miles = K.postman_tour(edges, edges[0][0])
    yield len(tour) - 1, miles


@kernel("grf_24_component_tour", _TRACK, "track_id", "place long, idx long", "idx")
def _tour(pdf):
    tour, _ = K.two_opt(list(zip(pdf.lon, pdf.lat, strict=True)))
    yield from ((k, int(pdf.idx.iloc[i])) for k, i in enumerate(tour))


def _pieces(pdf):
    points = list(zip(pdf.lon, pdf.lat, strict=True))
    return list(zip(points[::2], points[1::2], strict=False))


@kernel("grf_27_continuity", _TRACK, "track_id", "piece long, reversed boolean", "idx")
def _continuity(pdf):
    yield from enumerate(K.orient_for_continuity(_pieces(pdf))[0])


@kernel("grf_28_nearest_order", _TRACK, "track_id", "place long, piece long, reversed boolean", "idx")
def _order(pdf):
    yield from ((k, i, f) for k, (i, f) in enumerate(K.nearest_order(_pieces(pdf), HOME)))


@kernel("grf_29_legal_cost_order", _GRAPH, "track_id", "place long, node long", "u,v")
def _legal(pdf):
    graph, left, at = _both(pdf), _nodes(pdf), int(pdf.u.min())
    for place in range(len(left)):
        paths = K.shortest_paths(graph, at, targets=set(left))
        at = min(left, key=lambda n: (paths.get(n, (1e9,))[0], n))
        left.remove(at)
        yield place, at


@kernel("grf_31_trailhead_access", _GRAPH, "track_id", "node long, one_way double, round_trip double", "u,v")
def _access(pdf):
    paths = K.shortest_paths(_both(pdf), int(pdf.u.min()))
    node = int(pdf.v.max())
    d = paths[node][0] if node in paths else 1.25 * K.haversine_miles(HOME, (node // 100000 / 20, node % 100000 / 20))
    yield node, d, 2 * d


@kernel("grf_33_inter_segment_links", _GRAPH, "track_id", "link long, miles double", "u,v")
def _links(pdf):
    nodes, earned = _nodes(pdf), set()
    for k, (a, b) in enumerate(zip(nodes[:-1], nodes[1:], strict=True)):
        paths = K.shortest_paths(K.adjacency(_edges(pdf)), a, avoid=set(range(3)) - earned, targets={b})
        earned.add(k % 3)
        yield k, paths[b][0] if b in paths else None


@kernel("grf_35_gap_stitching", _GRAPH, "track_id", "gap long, nodes long", "u,v")
def _stitch(pdf):
    graph, nodes = _both(pdf), _nodes(pdf)
    for k, (a, b) in enumerate(zip(nodes[:-1], nodes[1:], strict=True)):
        yield k, max(0, len(K.path_to(K.shortest_paths(graph, a, targets={b}), b)) - 2)


@kernel("grf_36_exit_check", _GRAPH, "track_id", "planned double, shortest double, avoidable boolean", "u,v")
def _exit(pdf):
    nodes = sorted(set(pdf.u))
    planned = float(pdf.w.iloc[:5].sum())
    best = K.shortest_paths(_both(pdf), nodes[0], targets={nodes[-1]}).get(nodes[-1], (planned,))[0]
    yield planned, best, best < planned - 0.05


def _edges_frame(spark, sf_dir):
    return _rows(spark, sf_dir, "SELECT DISTINCT l_orderkey AS u, 100000000 + l_partkey AS v FROM lineitem")


_COMPONENTS = "WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS x, 100000000 + l_partkey AS y FROM lineitem), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r(node, component) USING KEY (node) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, min(r.component) FROM r JOIN b ON b.x = r.node JOIN recurring.r t ON t.node = b.y WHERE r.component < t.component GROUP BY b.y) SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM r"
QUERIES["grf_12_components"] = lambda spark, sf_dir: connected_components(_edges_frame(spark, sf_dir))
QUERIES["grf_13_components_avoiding"] = lambda spark, sf_dir: connected_components(_edges_frame(spark, sf_dir).where("v % 3 <> 0"))
QUERIES["grf_14_component_sizes"] = lambda spark, sf_dir: connected_components(_edges_frame(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
ORACLES["grf_12_components"] = _COMPONENTS
ORACLES["grf_13_components_avoiding"] = _COMPONENTS.replace("FROM lineitem)", "FROM lineitem WHERE (100000000 + l_partkey) % 3 <> 0)")
ORACLES["grf_14_component_sizes"] = f"SELECT component, count(*) AS n FROM ({_COMPONENTS}) c GROUP BY component"


#: A cell of 0.01 degrees measures under a mile across its diagonal, so its points are linked to its smallest one; points
#: of two cells are linked if one pair is close. A mile spans at most 2 cells of latitude and, up to latitude 60, 3 of longitude.
_SNAP = "SELECT outing_id, lon, lat, @floor(lon * 100) AS cx, @floor(lat * 100) AS cy, min(outing_id) OVER (PARTITION BY @floor(lon * 100), @floor(lat * 100)) AS node FROM (SELECT outing_id, @lon(outing_id) AS lon, @lat(outing_id) AS lat FROM @outings() o) p"
_AHEAD = [(dx, dy) for dx in range(-3, 4) for dy in range(3) if dy or dx > 0]


_MILE = math.sin(0.5 / 3958.7613) ** 2


def _haversine(lon, lat, cosines):
    return np.sin(lat / 2) ** 2 + cosines * np.sin(lon / 2) ** 2


def _close(pdf):
    first, points = (pdf.node == pdf.node.min()).to_numpy(), np.radians(pdf[["lon", "lat"]].to_numpy())
    a, b, least = points[first], points[~first], np.cos(np.abs(points[:, 1]).max()) ** 2
    # Points over a mile from the other cell's box have no partner there.
    for _ in range(2):
        if len(b):
            gap = np.maximum(0, np.maximum(b.min(0) - a, a - b.max(0)))
            a, b = b, a[_haversine(gap[:, 0], gap[:, 1], least) <= _MILE * (1 + 1e-9)]
    if len(b) and any((_haversine(b[:, 0] - x, b[:, 1] - y, np.cos(b[:, 1]) * math.cos(y)) <= _MILE).any() for x, y in a):
        yield int(pdf.node.min()), int(pdf.node.max())


def _snap(spark, sf_dir):
    points = checkpointed(_rows(spark, sf_dir, _SNAP))
    cells = points.select("cx", "cy", "node").distinct()
    ahead = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _AHEAD)))
    there = cells.select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("node").alias("other"))
    pairs = cells.withColumn("d", ahead).join(there, (F.col("x") == F.col("cx") + F.col("d.dx")) & (F.col("y") == F.col("cy") + F.col("d.dy"))).select(F.concat_ws(",", "node", "other").alias("pair"), F.explode(F.array("node", "other")).alias("node"))
    links = checkpointed(apply_to_groups(pairs.join(points, "node").select("pair", "node", "outing_id", "lon", "lat"), "pair", "u long, v long", _close, ["outing_id"]).select("u", "v"))
    return connected_components(links.union(points.select(F.col("outing_id").alias("u"), F.col("node").alias("v")))).select(F.col("node").alias("outing_id"), F.col("component").alias("node"))


QUERIES["grf_10_snapped_endpoints"] = _snap
@kernel("grf_11_union_find", _GRAPH, "track_id", "node long, component long", "u,v")
def _union_find(pdf):
    yield from sorted(K.graph_components(_edges(pdf)).items())


def _cover(name, choose):
    @kernel(name, _COVER, "owner_id", "outing_id long, exact boolean", "outing_id,seg_id")
    def run(pdf):
        candidates = _candidates(pdf)
        target = set().union(*(s for s, _ in candidates.values()))
        chosen, exact = choose(candidates, target)
        yield from ((k, exact) for k in chosen)


_exact = lambda c, t: K.exact_cover_min_cost(c, t)
for _name in ("opt_01_set_cover", "opt_15_branch_and_bound"):
    _cover(_name, _exact)


def _package(c, t, max_states=200_000):
    """The cheapest cover, or all outings where the state bound ends the search."""
    chosen, exact = K.exact_cover_min_cost(c, t, max_states)
    return (chosen, True) if exact else (sorted(c), False)


_cover("opt_02_package_cover", _package)
_cover("opt_04_objective_cover", lambda c, t: K.exact_cover_min_cost({k: (s, 1.0 + 0.001 * w) for k, (s, w) in c.items()}, t))
_cover("opt_12_fewest_days", lambda c, t: K.exact_cover_min_cost({k: (s, 1.0) for k, (s, _) in c.items()}, t))
_cover("opt_13_greedy_max_coverage", lambda c, t: (K.greedy_cover(c, t, by_ratio=False)[0], False))
_cover("opt_14_greedy_ratio_cover", lambda c, t: (K.greedy_cover(c, t)[0], False))


def _bounded(c, t):
    chosen, used = [], 0.0
    for k in K.greedy_cover(c, t, by_ratio=False)[0]:
        if used + c[k][1] <= 600:
            chosen.append(k)
            used += c[k][1]
    return chosen, False


_cover("opt_06_max_coverage_in_budget", _bounded)
_cover("opt_35_forced_swap", lambda c, t: K.exact_cover_min_cost({k: v for k, v in c.items() if k != min(c)} | {-1: (t, 1e6)}, t))


@kernel("opt_08_exact_partition", _COVER, "owner_id", "outing_id long", "outing_id,seg_id")
def _partition(pdf):
    candidates = _candidates(pdf)
    target = set().union(*(s for s, _ in candidates.values()))
    singles = {-1 - x: ({x}, 500.0) for x in target}
    yield from ((k,) for k in K.exact_partition(candidates | singles, target, 20_000) or ())


@kernel("opt_17_greedy_calendar", _OUTINGS, "owner_id", "outing_id long, day long", "minutes,outing_id")
def _calendar(pdf):
    days = K.assign_days(pdf.minutes.tolist(), [300, 300, 300, 480, 480] * 3, rest_after=400)
    yield from zip(pdf.outing_id.tolist(), days, strict=True)


@kernel("opt_20_connected_combinations", "SELECT @floor(anchor_id / 10e0) AS part, anchor_id, lon, lat FROM @anchors() a", "part", "combination string", "anchor_id")
def _connected(pdf):
    rows = list(zip(pdf.anchor_id.tolist(), pdf.lon, pdf.lat, strict=True))
    near = {a[0]: {b[0] for b in rows if b[0] != a[0] and K.haversine_miles(a[1:], b[1:]) < 15} for a in rows}
    yield from ((",".join(map(str, c)),) for c in K.connected_combinations(near, 4, 3))


@kernel("opt_27_vehicle_routes", _TRACK, "track_id", "idx long, vehicle long", "idx")
def _vehicles(pdf):
    tour, _ = K.two_opt(list(zip(pdf.lon, pdf.lat, strict=True)))
    load, vehicle = 0.0, 0
    for i in tour:
        if load + pdf.value.iloc[i] > 500:
            load, vehicle = 0.0, vehicle + 1
        load += pdf.value.iloc[i]
        yield int(pdf.idx.iloc[i]), vehicle


@kernel("opt_28_cost_matrix", _GRAPH, "track_id", "source long, target long, cost long", "u,v")
def _costs(pdf):
    graph, nodes = K.adjacency(_edges(pdf)), _nodes(pdf)
    for a in nodes:
        paths = K.shortest_paths(graph, a)
        yield from ((a, b, int(paths[b][0] * 1000) if b in paths else 1_000_000) for b in nodes)


@kernel("opt_29_loop_selection", _COVER, "owner_id", "outing_id long, added long", "outing_id,seg_id")
def _loops(pdf):
    covered, candidates = set(), _candidates(pdf)
    for k in sorted(candidates, key=lambda k: (-len(candidates[k][0]), k)):
        new = candidates[k][0] - covered
        if new:
            covered |= new
            yield k, len(new)


@kernel("opt_30_day_packing", _OUTINGS, "owner_id", "outing_id long, day long", "outing_id")
def _days(pdf):
    yield from zip(pdf.outing_id.tolist(), K.first_fit_decreasing(pdf.minutes.tolist(), 480, 100), strict=True)


@kernel("opt_31_endpoint_clusters", _TRACK, "track_id", "idx long, cluster long", "idx")
def _clusters(pdf):
    yield from zip(pdf.idx.tolist(), K.online_clusters(list(zip(pdf.lon, pdf.lat, strict=True)), 5.0), strict=True)


@kernel("opt_32_dense_areas", _TRACK, "track_id", "idx long, cluster long", "idx")
def _dense(pdf):
    yield from zip(pdf.idx.tolist(), K.online_clusters(list(zip(pdf.lon, pdf.lat, strict=True)), 180 / 1609.344, first=True), strict=True)


@kernel("opt_34_repricing", "SELECT o.owner_id, o.outing_id, @day(o.day) AS day, c.seg_id FROM @outings() o JOIN @claims() c ON c.outing_id = o.outing_id", "owner_id", "outing_id long, status string, remaining long", "day,outing_id,seg_id")
def _reprice(pdf):
    groups = [(int(k), set(g.seg_id.tolist())) for k, g in pdf.groupby("outing_id", sort=False)]
    for (k, _), (status, left) in zip(groups, K.reprice_in_order([(s, {x for y in s for x in (y, y + 1)}) for _, s in groups]), strict=True):
        yield k, status, left


@kernel("opt_36_availability_sweep", _OUTINGS, "owner_id", "bound long, placed long", "minutes,outing_id")
def _sweep(pdf):
    for bound in (120, 240, 360):
        yield bound, sum(d >= 0 for d in K.assign_days(pdf.minutes.tolist(), [bound] * 5))


@kernel("geo_14_resample_since_keep", _TRACK, "track_id", "idx long", "idx")
def _resample(pdf):
    yield from ((int(pdf.idx.iloc[i]),) for i in K.resample_since_keep(list(zip(pdf.lon, pdf.lat, strict=True)), 40.0))


@kernel("geo_16_simplify", _TRACK, "track_id", "idx long", "idx")
def _simplify(pdf):
    yield from ((int(pdf.idx.iloc[i]),) for i in K.simplify(list(zip(pdf.lon, pdf.lat, strict=True)), 0.2))


@kernel("geo_49_candidate_costing", _OUTINGS, "owner_id", "outing_id long, p75 long, efficiency double", "outing_id")
def _costing(pdf):
    for k, m, miles in zip(pdf.outing_id.tolist(), pdf.minutes.tolist(), pdf.foot_miles.tolist(), strict=True):
        p75 = -int(-(m * 1.12 - 1e-9) // 1)
        yield k, p75, miles / p75


@kernel("geo_52_snap_confidence", _GRAPH, "track_id", "confidence string", "u,v")
def _confidence(pdf):
    d = K.shortest_paths(_both(pdf), int(pdf.u.min())).get(int(pdf.v.max()), (1e9,))[0]
    yield ("high" if d <= 0.1 else "medium" if d < 1e9 else "low",)


@kernel("win_10_repeated_nodes", _TRACK, "track_id", "score long, idx long", "idx")
def _repeated(pdf):
    cells = {}
    for i, (x, y) in enumerate(zip((pdf.lon * 10).astype(int), (pdf.lat * 10).astype(int), strict=True)):
        cells.setdefault((x, y), []).append(i)
    yield from K.spaced_top([(len(v), int(pdf.idx.iloc[v[0]])) for v in cells.values() if len(v) > 1 and v[-1] - v[0] > 2], 4, 5)


@kernel("win_15_monotonic_snap", _TRACK, "track_id", "idx long, position double", "idx")
def _monotonic(pdf):
    yield from zip(pdf.idx.tolist(), K.monotonic_positions([[v, v / 2, v + 30] for v in pdf.value.tolist()]), strict=True)


@kernel("src_16_polyline_decode", _TRACK, "track_id", "idx long, lon double, lat double", "idx")
def _polyline(pdf):
    line = K.encode_polyline(list(zip(pdf.lon, pdf.lat, strict=True)))
    yield from ((k + 1, a, b) for k, (a, b) in enumerate(K.decode_polyline(line)))


ORACLES["src_16_polyline_decode"] = render("SELECT track_id, idx, round(lon, 5) AS lon, round(lat, 5) AS lat FROM @track() t", "duckdb")
QUERIES["src_18_state_defaults"] = lambda spark, sf_dir: _rows(spark, sf_dir, "SELECT event_id, map_concat(map('pace', '16', 'k', '0'), from_json(props, 'MAP<STRING,STRING>')) AS state FROM events").select("event_id", F.element_at("state", "pace").alias("pace"), F.element_at("state", "k").alias("k")) if _last_wins(spark) else None
ORACLES["src_18_state_defaults"] = "SELECT event_id, '16' AS pace, json_extract_string(props, '$.k') AS k FROM events"


def _last_wins(spark) -> bool:
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return True


def _similar(spark, sf_dir):
    """Each part with the three ids after it, by an equi-join on these."""
    pairs = _rows(spark, sf_dir, "SELECT a.p_partkey AS a, b.p_partkey AS b, lower(a.p_type) AS x, lower(b.p_type) AS y FROM (SELECT p_partkey, p_type, @series(p_partkey + 1, p_partkey + 3) AS next FROM part) a JOIN part b ON b.p_partkey = a.next")
    return pairs.select("a", "b", text.name_similarity("x", "y").alias("similarity"))


def _best_match(spark, sf_dir):
    """Names move a score by 0.08 miles at most, so only segments so much farther than the nearest are scored, one of each name."""
    anchors, segments = _rows(spark, sf_dir, "SELECT anchor_id, lon, lat, lower(name) AS x FROM @anchors() a"), _rows(spark, sf_dir, "SELECT seg_id, lon, lat, lower(trail_name) AS y FROM @segments() s")
    near = nearest(anchors.select("anchor_id", "lon", "lat").distinct(), segments, "anchor_id", "seg_id", slack=0.081, limit=2.0)
    pairs = near.join(segments.select("seg_id", "y"), "seg_id").join(anchors.select("anchor_id", "x"), "anchor_id").groupBy("anchor_id", "x", "y").agg(F.min(F.struct("miles", "seg_id")).alias("z")).select("anchor_id", "x", "y", F.col("z.miles").alias("d"), "z.seg_id")
    scored = pairs.withColumn("score", F.col("d") + F.greatest(F.lit(0.0), 0.08 - 0.08 * text.name_similarity("x", "y")))
    return scored.groupBy("anchor_id").agg(F.min_by("seg_id", F.struct("score", "seg_id")).alias("seg_id"))


def _menu_sort(spark, sf_dir):
    """Places over ranges of the sort keys: a place is its row in the range after the rows of the ranges before."""
    keys = [F.expr(render("@time_bucket(minutes)")), F.desc("route_status"), F.desc("foot_miles"), F.col("minutes"), F.col("outing_id")]
    rows = checkpointed(_rows(spark, sf_dir, "SELECT outing_id, minutes, route_status, foot_miles FROM @outings() o").repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*keys))).join(F.broadcast(before), "part").select("outing_id", (F.col("start") + F.col("r")).alias("place"))


QUERIES["srt_01_menu_sort"] = _menu_sort
QUERIES["str_04_name_similarity"] = _similar
QUERIES["join_09_best_match"] = _best_match
QUERIES["str_06_natural_key"] = lambda spark, sf_dir: _rows(spark, sf_dir, "SELECT p_partkey, p_name FROM part").select("p_partkey", text.natural_key(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("key"))
QUERIES["str_09_visible_text"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.visible_text("html").alias("text"))


@kernel("stm_05_day_replay", "SELECT user_id, day_id, event_id, kind, seg_id FROM @ledger() l", "user_id", "day long, credited long", "day_id,event_id")
def _replay(pdf):
    done: set = set()
    for day, g in pdf.groupby("day_id"):
        done |= set(g[g.kind == "completed"].seg_id)
        yield int(day), len(done)


ORACLES["stm_05_day_replay"] = render("WITH d AS (SELECT DISTINCT user_id, day_id FROM @ledger() l), c AS (SELECT user_id, seg_id, min(day_id) AS first_day FROM @ledger() l WHERE kind = 'completed' GROUP BY user_id, seg_id) SELECT d.user_id, d.day_id AS day, count(c.seg_id) AS credited FROM d LEFT JOIN c ON c.user_id = d.user_id AND c.first_day <= d.day_id GROUP BY d.user_id, d.day_id", "duckdb")


@kernel("aud_14_exit_audit", _GRAPH, "track_id", "verdict string", "u,v")
def _audit(pdf):
    ((_, _, avoidable),) = _exit(pdf)
    yield ("avoidable" if avoidable else "passed",)


@kernel("udf_01_elevation_sampler", _TRACK, "track_id", "idx long, feet double", "idx")
def _elevation(pdf):
    yield from ((int(i), (abs(int(lon * 1000)) % 900) * 3.280839895) for i, lon in zip(pdf.idx, pdf.lon, strict=True))


QUERIES["snk_07_artifact_manifest"] = lambda spark, sf_dir: spark.read.format("binaryFile").load(f"{sf_dir}/region.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))

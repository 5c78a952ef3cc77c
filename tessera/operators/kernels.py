"""Sequential algorithms on one bounded group: paths, trees, matchings, covers, packings, orderings.

They take plain Python values and are called inside grouped Arrow or pandas functions; the group (a track, a component,
a package) bounds their memory.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from itertools import combinations


def haversine_miles(a, b) -> float:
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 3958.7613 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


# -- graphs --------------------------------------------------------------------------------------------------------
def adjacency(edges) -> dict:
    """{u: [(v, weight, label)]} of (u, v, weight[, label]) rows; edges of no positive weight are dropped."""
    out = defaultdict(list)
    for u, v, w, *label in edges:
        if w > 0:
            out[u].append((v, w, label[0] if label else None))
    return out


def shortest_paths(graph, source, avoid=frozenset(), limit=math.inf, targets=None) -> dict:
    """{node: (distance, node before)} from ``source``, without edges labelled in ``avoid``; stops once all targets are settled."""
    out, heap, left = {}, [(0.0, 0, source, None)], set(targets or ())
    count = 0
    while heap:
        d, _, u, before = heapq.heappop(heap)
        if u in out:
            continue
        out[u] = (d, before)
        left.discard(u)
        if targets is not None and not left:
            break
        for v, w, label in graph.get(u, ()):
            if v not in out and label not in avoid and d + w <= limit:
                count += 1
                heapq.heappush(heap, (d + w, count, v, u))
    return out


def path_to(paths: dict, target) -> list:
    out = []
    while target is not None:
        if target not in paths:
            return []
        out.append(target)
        target = paths[target][1]
    return out[::-1]


def graph_components(edges, avoid=frozenset()) -> dict:
    """{node: smallest node of its component}."""
    parent: dict = {}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v, *rest in edges:
        parent.setdefault(u, u)
        parent.setdefault(v, v)
        if len(rest) > 1 and rest[1] in avoid:
            continue
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    return {x: top(x) for x in parent}


def odd_nodes(edges) -> list:
    degree = defaultdict(int)
    for u, v, *_ in edges:
        degree[u] += 1
        degree[v] += 1
    return sorted(x for x, d in degree.items() if d % 2)


def minimum_tree(nodes: list, cost) -> list[tuple]:
    """Edges (a, b, cost) of a minimum spanning tree over all pairs with finite cost."""
    if not nodes:
        return []
    out, near = [], {x: (cost(nodes[0], x), nodes[0]) for x in nodes[1:]}
    while near:
        x = min(near, key=lambda n: (near[n][0], n))
        d, a = near.pop(x)
        if d == math.inf:
            break
        out.append((a, x, d))
        for y in near:
            c = cost(x, y)
            if c < near[y][0]:
                near[y] = (c, x)
    return out


EXACT_MATCHING = 14


def minimum_matching(nodes: list, cost) -> tuple[list[tuple], bool]:
    """(pairs, exact): perfect matching of least total cost; by subsets up to EXACT_MATCHING nodes, else greedy pairs improved by exchanges."""
    nodes = list(nodes)
    if len(nodes) % 2:
        raise ValueError("an odd number of nodes has no perfect matching")
    n = len(nodes)
    if n <= EXACT_MATCHING:
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for mask in range(1, 1 << n):
            if mask.bit_count() % 2:
                continue
            i = (mask & -mask).bit_length() - 1
            options = []
            for j in range(i + 1, n):
                if mask >> j & 1:
                    rest = best[mask & ~(1 << i) & ~(1 << j)]
                    options.append((rest[0] + cost(nodes[i], nodes[j]), (*rest[1], (nodes[i], nodes[j]))))
            best[mask] = min(options, key=lambda o: o[0])
        return list(best[(1 << n) - 1][1]), True
    left, pairs = set(nodes), []
    for _, a, b in sorted((cost(a, b), a, b) for a, b in combinations(nodes, 2)):
        if a in left and b in left:
            left -= {a, b}
            pairs.append((a, b))
    improved = True
    while improved:
        improved = False
        for i, j in combinations(range(len(pairs)), 2):
            (a, b), (c, d) = pairs[i], pairs[j]
            now = cost(a, b) + cost(c, d)
            for p, q in (((a, c), (b, d)), ((a, d), (b, c))):
                if cost(*p) + cost(*q) < now - 1e-12:
                    pairs[i], pairs[j], improved = p, q, True
                    break
    return pairs, False


def euler_circuit(edges, start) -> list:
    """Node sequence that uses every undirected edge (u, v) once; all degrees must be even and the edges connected."""
    graph, used = defaultdict(list), set()
    for k, (u, v) in enumerate(edges):
        graph[u].append((v, k))
        graph[v].append((u, k))
    stack, out = [start], []
    while stack:
        u = stack[-1]
        while graph[u] and graph[u][-1][1] in used:
            graph[u].pop()
        if graph[u]:
            v, k = graph[u].pop()
            used.add(k)
            stack.append(v)
        else:
            out.append(stack.pop())
    return out[::-1]


def postman_tour(edges, start) -> tuple[list, float]:
    """(node sequence, miles) over all undirected (u, v, weight) edges of one component: odd nodes are matched along shortest paths."""
    both = adjacency([*((u, v, w) for u, v, w in edges), *((v, u, w) for u, v, w in edges)])
    odd = odd_nodes(edges)
    paths = {x: shortest_paths(both, x) for x in odd}
    pairs, _ = minimum_matching(odd, lambda a, b: paths[a].get(b, (math.inf,))[0])
    extra = []
    for a, b in pairs:
        route = path_to(paths[a], b)
        extra += list(zip(route[:-1], route[1:], strict=True))
    total = sum(w for _, _, w in edges) + sum(paths[a][b][0] for a, b in pairs)
    return euler_circuit([(u, v) for u, v, _ in edges] + extra, start), total


# -- orders --------------------------------------------------------------------------------------------------------
def orient_for_continuity(segments) -> tuple[list[bool], float]:
    """(reversed flags, total gap) of (start, end) segments in order, with the least sum of gaps between them; forward on ties."""
    if not segments:
        return [], 0.0
    ends = [((s, e), (e, s)) for s, e in segments]
    cost, back = [0.0, 0.0], []
    for k in range(1, len(segments)):
        new, choice = [], []
        for o in (0, 1):
            options = [cost[p] + haversine_miles(ends[k - 1][p][1], ends[k][o][0]) for p in (0, 1)]
            p = 0 if options[0] <= options[1] else 1
            new.append(options[p])
            choice.append(p)
        cost, back = new, [*back, choice]
    o = 0 if cost[0] <= cost[1] else 1
    flags, total = [bool(o)], cost[o]
    for choice in reversed(back):
        o = choice[o]
        flags.append(bool(o))
    return flags[::-1], total


def nearest_order(segments, start, distance=haversine_miles) -> list[tuple[int, bool]]:
    """Greedy order of (start, end) segments, either way round, from ``start``; the first wins ties."""
    left, at, out = list(range(len(segments))), start, []
    while left:
        _, k, flipped = min((distance(at, segments[k][r]), k, r) for k in left for r in (0, 1))
        out.append((k, bool(flipped)))
        at = segments[k][1 - flipped]
        left.remove(k)
    return out


def two_opt(points) -> tuple[list[int], float]:
    """(closed tour of point indexes from 0, length): nearest neighbour, then reversals while they shorten it."""
    n = len(points)
    d = [[haversine_miles(a, b) for b in points] for a in points]
    tour, left = [0], set(range(1, n))
    while left:
        k = min(left, key=lambda j: (d[tour[-1]][j], j))
        tour.append(k)
        left.remove(k)
    improved = n > 3
    while improved:
        improved = False
        for i in range(n - 1):
            for j in range(i + 2, n - (i == 0)):
                a, b, c, e = tour[i], tour[i + 1], tour[j], tour[(j + 1) % n]
                if d[a][c] + d[b][e] < d[a][b] + d[c][e] - 1e-12:
                    tour[i + 1 : j + 1] = tour[i + 1 : j + 1][::-1]
                    improved = True
    return tour, sum(d[tour[i]][tour[(i + 1) % n]] for i in range(n))


# -- lines ---------------------------------------------------------------------------------------------------------
def decode_polyline(text: str) -> list[tuple[float, float]]:
    """(lon, lat) points of an encoded polyline of precision 5."""
    values, value, shift = [], 0, 0
    for c in text:
        five = ord(c) - 63
        value |= (five & 31) << shift
        shift += 5
        if five < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    lat = lon = 0
    out = []
    for a, b in zip(values[::2], values[1::2], strict=False):
        lat, lon = lat + a, lon + b
        out.append((lon / 1e5, lat / 1e5))
    return out


def encode_polyline(points) -> str:
    out, before = [], (0, 0)
    for lon, lat in points:
        now = (round(lat * 1e5), round(lon * 1e5))
        for a, b in zip(now, before, strict=True):
            v = (a - b) << 1
            v = ~v if a < b else v
            while v >= 32:
                out.append(chr((32 | v & 31) + 63))
                v >>= 5
            out.append(chr(v + 63))
        before = now
    return "".join(out)


def simplify(points, tolerance: float, pinned=()) -> list[int]:
    """Indexes that Douglas-Peucker keeps of planar points; pinned indexes split the line first."""
    keep = sorted({0, len(points) - 1, *pinned}) if points else []
    stack, out = list(zip(keep[:-1], keep[1:], strict=True)), set(keep)
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        far, at = -1.0, None
        for k in range(a + 1, b):
            px, py = points[k]
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = 0.0 if n == 0 else max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n))
            d = math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))
            if d > far:
                far, at = d, k
        if at is not None and far > tolerance:
            out.add(at)
            stack += [(a, at), (at, b)]
    return sorted(out)


def resample_since_keep(points, spacing: float) -> list[int]:
    """Indexes kept when the distance run since the last kept point reaches ``spacing``; first and last always."""
    if not points:
        return []
    out, run = [0], 0.0
    for k in range(1, len(points)):
        run += haversine_miles(points[k - 1], points[k])
        if run >= spacing:
            out.append(k)
            run = 0.0
    if out[-1] != len(points) - 1:
        out.append(len(points) - 1)
    return out


def monotonic_positions(candidates) -> list[float | None]:
    """For each list of candidate positions the smallest one not before the last choice, else the last candidate."""
    out, at = [], -math.inf
    for options in candidates:
        ahead = sorted(x for x in options if x >= at)
        pick = ahead[0] if ahead else (max(options) if options else None)
        out.append(pick)
        if pick is not None:
            at = max(at, pick)
    return out


def spaced_top(visits, spacing: int, k: int) -> list:
    """Greedy top k of (score, index) rows by falling score, none within ``spacing`` of one taken before."""
    out = []
    for score, index in sorted(visits, key=lambda v: (-v[0], v[1])):
        if all(abs(index - i) >= spacing for _, i in out):
            out.append((score, index))
        if len(out) == k:
            break
    return out


# -- covers and packings -------------------------------------------------------------------------------------------
def greedy_cover(candidates: dict, target: set, by_ratio: bool = True) -> tuple[list, set]:
    """(chosen ids, uncovered) over {id: (set, cost)}: least cost for each new element, or most new elements then least cost."""
    left, out = set(target), []
    while left:
        options = [((cost / len(s & left), cost, k) if by_ratio else (-len(s & left), cost, k)) for k, (s, cost) in candidates.items() if s & left]
        if not options:
            break
        k = min(options)[-1]
        out.append(k)
        left -= candidates[k][0]
    return out, left


def exact_cover_min_cost(candidates: dict, target: set, max_states: int = 200_000) -> tuple[list, bool]:
    """(chosen ids, exact) of least total cost that cover ``target``: branch on the rarest element, bounded by the greedy cover."""
    greedy, missing = greedy_cover(candidates, target)
    if missing:
        raise ValueError(f"not coverable: {sorted(missing)[:5]}")
    order = sorted(target)
    bit = {x: 1 << i for i, x in enumerate(order)}
    masks = {k: sum(bit[x] for x in s & target) for k, (s, _) in candidates.items()}
    # One with no more elements and no less cost than another is never needed.
    kept: list = []
    for k in sorted(masks, key=lambda k: (candidates[k][1], -masks[k].bit_count(), str(k))):
        if masks[k] and not any(masks[k] & ~masks[j] == 0 for j in kept):
            kept.append(k)
    holders = {b: [k for k in kept if masks[k] & b] for b in bit.values()}
    best = [sum(candidates[k][1] for k in greedy), sorted(greedy, key=str)]
    states, seen = 0, {}

    def branch(covered: int, cost: float, chosen: list) -> bool:
        nonlocal states
        if covered == (1 << len(order)) - 1:
            if cost < best[0] - 1e-12:
                best[:] = [cost, sorted(chosen, key=str)]
            return True
        states += 1
        if states > max_states:
            return False
        if seen.get(covered, math.inf) <= cost:
            return True
        seen[covered] = cost
        rarest = min((b for b in holders if not covered & b), key=lambda b: (len(holders[b]), b))
        done = True
        for k in sorted(holders[rarest], key=lambda k: (candidates[k][1] / (masks[k] & ~covered).bit_count(), str(k))):
            if cost + candidates[k][1] < best[0] - 1e-12:
                done &= branch(covered | masks[k], cost + candidates[k][1], [*chosen, k])
        return done

    exact = branch(0, 0.0, [])
    return best[1], exact


def exact_partition(candidates: dict, target: set, max_states: int = 200_000) -> list | None:
    """Least-cost ids whose sets are disjoint and make up ``target``; None if there are none or the state bound ends the search."""
    best: list = [math.inf, None]
    holders = {x: sorted((k for k, (s, _) in candidates.items() if x in s and s <= target), key=lambda k: (candidates[k][1], str(k))) for x in target}
    # What an element costs at least: the least cost for each element of the sets that hold it.
    share = {x: min((candidates[k][1] / len(candidates[k][0]) for k in holders[x]), default=math.inf) for x in target}
    states = 0

    def branch(left: frozenset, cost: float, chosen: list) -> None:
        nonlocal states
        states += 1
        if states > max_states or cost + sum(share[x] for x in left) >= best[0]:
            return
        if not left:
            best[:] = [cost, chosen]
            return
        x = min(left, key=lambda y: (sum(candidates[k][0] <= left for k in holders[y]), y))
        for k in holders[x]:
            if candidates[k][0] <= left:
                branch(left - candidates[k][0], cost + candidates[k][1], [*chosen, k])

    branch(frozenset(target), 0.0, [])
    return best[1]


def first_fit_decreasing(sizes, capacity: float, bins: int | None = None) -> list[int]:
    """Bin of each item, largest first into the first bin with room; -1 where none of at most ``bins`` has room."""
    out, room = [-1] * len(sizes), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = next((b for b, r in enumerate(room) if r >= sizes[k]), None)
        if fit is None and sizes[k] <= capacity and (bins is None or len(room) < bins):
            room.append(capacity)
            fit = len(room) - 1
        if fit is not None:
            room[fit] -= sizes[k]
            out[k] = fit
    return out


def assign_days(minutes, budgets, rest_after: float = math.inf) -> list[int]:
    """Day of each item in order, the first whose budget it fits; a day with ``rest_after`` minutes or more leaves the next one free."""
    used, out = [0.0] * len(budgets), []
    for m in minutes:
        day = next((d for d, b in enumerate(budgets) if used[d] + m <= b and not (d and used[d - 1] >= rest_after) and not (d + 1 < len(budgets) and m + used[d] >= rest_after and used[d + 1])), -1)
        if day >= 0:
            used[day] += m
        out.append(day)
    return out


def online_clusters(points, radius: float, first: bool = False) -> list[int]:
    """Cluster of each point in order: the nearest (or ``first``) centroid within ``radius``, which moves to the new mean, or a new one."""
    centres: list[list[float]] = []
    out = []
    for lon, lat in points:
        away = ((haversine_miles((c[0], c[1]), (lon, lat)), k) for k, c in enumerate(centres))
        near = next((d for d in away if d[0] <= radius), (math.inf, -1)) if first else min(away, default=(math.inf, -1))
        if near[0] <= radius:
            c = centres[near[1]]
            c[2] += 1
            c[0] += (lon - c[0]) / c[2]
            c[1] += (lat - c[1]) / c[2]
            out.append(near[1])
        else:
            centres.append([lon, lat, 1])
            out.append(len(centres) - 1)
    return out


def reprice_in_order(routes) -> list[tuple[str, int]]:
    """(status, remaining) of (claimed ids, physically covered ids) routes in order: one is dropped when earlier kept routes
    have covered all it claims; a dropped route gives no credit."""
    credited, out = set(), []
    for claimed, covered in routes:
        left = set(claimed) - credited
        if claimed and not left:
            out.append(("dropped", 0))
        else:
            out.append(("shrunk" if len(left) < len(set(claimed)) else "kept", len(left)))
            credited |= set(covered)
    return out


def connected_combinations(neighbours: dict, limit: int, size: int) -> list[tuple]:
    """Connected sets of at most ``size`` keys, grown from each key through at most ``limit`` first neighbours; each once."""
    frontier, out = {frozenset([k]) for k in neighbours}, set()
    for _ in range(size):
        out |= frontier
        frontier = {s | {n} for s in frontier for k in s for n in sorted(neighbours[k])[:limit] if n not in s}
    return sorted(tuple(sorted(s)) for s in out if len(s) <= size)

"""How many samples of a segment lie near a track, for all pairs that meet, without a shuffle or a sort of pairs.

A segment lives in the tile of its middle; pieces of tracks (two edges at a time) go to every tile whose segments they may
reach. So a tile knows all about its segments, and only pairs that are asked for leave it. Long segments live in tiles of a
higher tier, whose sides are four times as long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Least miles of a tile's side, shares of the tracks that are dealt to each tile, least tasks, distances taken at once.
SIDE, DEALS, TASKS, AT_ONCE = 2.0, 2, 48, 1 << 14
#: A segment reaches at most this share of a tile's side from its middle; tiers over the lowest.
HALF, TIERS = 0.125, 7
MILES_LON, MILES_LAT = 69.172, 69.0
FOUND = "track_id long, seg_id long, close long, samples long"


def _distance(ax, ay, dy, across, scale) -> np.ndarray:
    """Squared miles from the origin to pieces from (ax, ay); their other end lies ``across`` degrees (``scale`` miles each) and ``dy`` miles on."""
    dx = across * scale
    square = dx * dx
    square += dy * dy
    if not square.all():
        square += square == 0
    t = ax * dx
    t += ay * dy
    t /= square
    np.negative(t, out=t)
    np.clip(t, 0.0, 1.0, out=t)
    dx *= t
    dx += ax
    t *= dy
    t += ay
    dx *= dx
    t *= t
    dx += t
    return dx


class _Segments:
    """Segments of a tile with equally many samples, by bands of latitude and longitude; a row for each sample, a column for each segment.

    A box that holds ``least`` of the samples reaches from the segment's low to its high side, which may lie below the low one.
    """

    def __init__(self, ids, lon, lat, least):
        low_x, high_x, low_y, high_y = (f * np.sort(f * v, 0)[least - 1] for v in (lon, lat) for f in (1, -1))
        known = np.flatnonzero(~np.isnan(low_x + high_x + low_y + high_y))
        x, y = ((low_x + high_x) / 2)[known], ((low_y + high_y) / 2)[known]
        self.empty = not len(known)
        if self.empty:
            return
        self.left, self.low = x.min(), y.min()
        self.span = x.max() - self.left
        self.hx, self.hy = (max(0.0, (b - a)[known].max()) / 2 + 1e-9 for a, b in ((low_x, high_x), (low_y, high_y)))
        self.band = 2 * self.hy + 1e-3
        band = np.floor((y - self.low) / self.band)
        key = band * (self.span + 1) + (x - self.left)
        order = np.argsort(key, kind="stable")
        self.key, self.bands = key[order], int(band.max()) + 1
        order = known[order]
        self.ids, self.lon, self.lat = ids[order], np.ascontiguousarray(lon[:, order]), np.ascontiguousarray(lat[:, order])
        self.box = low_x[order], high_x[order], low_y[order], high_y[order]
        self.scale = MILES_LON * np.cos(np.radians(self.lat))

    def near(self, pieces, x0, x1, y0, y1):
        """(piece, segment) that may meet in ``least`` samples, of the given pieces."""
        out, segments = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.empty or not len(pieces):
            return out[0], segments[0]
        x0, x1, y0, y1 = (v[pieces] for v in (x0, x1, y0, y1))
        band = np.clip(np.floor((y0 - self.hy - self.low) / self.band), 0, self.bands)
        last = np.clip(np.floor((y1 + self.hy - self.low) / self.band), -1, self.bands - 1)
        left, right = (np.clip(v - self.left, -0.4, self.span + 0.4) for v in (x0 - self.hx, x1 + self.hx))
        while len(some := np.flatnonzero(band <= last)):
            base = band[some] * (self.span + 1)
            a, b = np.searchsorted(self.key, base + left[some]), np.searchsorted(self.key, base + right[some], "right")
            n = np.maximum(b - a, 0)
            p, s = np.repeat(some, n), np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
            low_x, high_x, low_y, high_y = self.box
            meet = (low_y[s] <= y1[p]) & (high_y[s] >= y0[p])
            meet &= (low_x[s] <= x1[p]) & (high_x[s] >= x0[p])
            out.append(pieces[p[meet]])
            segments.append(s[meet])
            band = band + 1
        return np.concatenate(out), np.concatenate(segments)


def _tile(ids, lists, min_fraction=0.0):
    """The segments of a tile by their number of samples, for pieces that are alone and for others: lists hold all longitudes and then all latitudes."""
    sizes, values, starts = np.diff(lists[1]) // 2, lists[0], lists[1][:-1]
    out = []
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        v = values[np.arange(2 * n)[:, None] + starts[at]]
        least = 1 + int(np.count_nonzero(np.arange(1, n) / n < min_fraction))
        every = _Segments(ids[at], v[:n], v[n:], 1)
        out.append((n, every if least == 1 else _Segments(ids[at], v[:n], v[n:], least), every))
    return out


def _counts(tile, track, v, reach, wide, tall):
    """track, segment, close, samples of the pieces (six coordinates each, by track) of whole tracks."""
    x, y = v[:, 0::2], v[:, 1::2]
    box = np.fmin.reduce(x, 1) - wide, np.fmax.reduce(x, 1) + wide, np.fmin.reduce(y, 1) - tall, np.fmax.reduce(y, 1) + tall
    of = np.cumsum(np.concatenate([[0], track[1:] != track[:-1]]))
    # Pieces of one track may be near the same sample, which counts once, and only together near enough samples.
    alone = np.bincount(of)[of] == 1
    square, out, ends = reach * reach, [], np.ascontiguousarray(v.T)
    across = ends[2] - ends[0], ends[4] - ends[2]
    along = (ends[3] - ends[1]) * MILES_LAT, (ends[5] - ends[3]) * MILES_LAT
    lone, others = np.flatnonzero(alone), np.flatnonzero(~alone)
    for n, few, every in tile:
        step = max(1, AT_ONCE // n)

        def close_to(group, p, s):
            lon, lat, scale = (np.take(c, s, axis=1) for c in (group.lon, group.lat, group.scale))
            near = None
            for k in (0, 1):
                ax, ay = (ends[2 * k][p] - lon), (ends[2 * k + 1][p] - lat)
                ax *= scale
                ay *= MILES_LAT
                got = _distance(ax, ay, along[k][p], across[k][p], scale) <= square
                near = got if near is None else near | got
            return near

        small = np.int16 if n < 32768 else np.int64
        pieces, segments = few.near(lone, *box)
        for begin in range(0, len(pieces), step):
            p, s = pieces[begin : begin + step], segments[begin : begin + step]
            close = np.add.reduce(close_to(few, p, s), 0, dtype=small)
            p, s, close = (c[close > 0] for c in (p, s, close))
            out.append((track[p], few.ids[s], close, np.full(len(p), n)))
        again, (pieces, segments) = [], every.near(others, *box)
        for begin in range(0, len(pieces), step):
            p, s = pieces[begin : begin + step], segments[begin : begin + step]
            k, row = np.nonzero(close_to(every, p, s))
            again.append((of[p[row]] * len(every.ids) + s[row]) * n + k)
        if again:
            pair, close = np.unique(np.unique(np.concatenate(again)) // n, return_counts=True)
            first = np.searchsorted(of, pair // len(every.ids))
            out.append((track[first], every.ids[pair % len(every.ids)], close, np.full(len(pair), n)))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def _walk(reach: float, wide: float, tall: float, min_fraction: float):
    """Rows (tile, piece, id, v) by tile, segments first, then pieces by track, to FOUND."""

    def columns(batches):
        rows = pa.Table.from_batches(batches)
        v = rows.column("v").combine_chunks()
        v = v if isinstance(v, pa.ListArray) else pa.concat_arrays(v.chunks)
        offsets = v.offsets.to_numpy()
        return [rows.column(c).to_numpy() for c in ("tile", "piece", "id")] + [v.values.to_numpy(zero_copy_only=False), offsets]

    def run(batches):
        names = ["track_id", "seg_id", "close", "samples"]
        held, tile, at = [], None, None

        def work(batches, whole):
            """Gives what is found, and how many rows at the end may go on in the next batch."""
            nonlocal tile, at
            tiles, piece, ids, values, offsets = columns(batches)
            cuts = np.concatenate([[0], np.flatnonzero((tiles[1:] != tiles[:-1]) | (piece[1:] != piece[:-1])) + 1, [len(tiles)]])
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                last = b == len(tiles) and not whole
                if not piece[a]:
                    if last:
                        return found, b - a
                    tile, at = _tile(ids[a:b], (values, offsets[a : b + 1]), min_fraction), tiles[a]
                    continue
                end = a + int(np.searchsorted(ids[a:b], ids[b - 1])) if last else b
                if at == tiles[a] and end > a:
                    v = values[offsets[a] : offsets[end]].reshape(-1, 6)
                    got = _counts(tile, ids[a:end], v, reach, wide, tall)
                    if got is not None:
                        keep = got[2] / got[3] >= min_fraction
                        found.append(pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in got], names))
                if last:
                    return found, b - end
            return found, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            # What is held is one run (a tile's segments, or a track's pieces in a tile): it waits until another begins.
            key = lambda b, i: tuple(b.column(c)[i].as_py() for c in ("tile", "piece")) + ((b.column("id")[i].as_py(),) if b.column("piece")[i].as_py() else ())
            if held and key(held[-1], held[-1].num_rows - 1) == key(batch, batch.num_rows - 1):
                held.append(batch)
                continue
            held.append(batch)
            found, rest = work(held, False)
            yield from found
            table = pa.Table.from_batches(held)
            held = table.slice(table.num_rows - rest).to_batches() if rest else []
        if held:
            yield from work(held, True)[0]

    def quiet(batches):
        with np.errstate(all="ignore"):
            yield from run(batches)

    return quiet


def _key(tier: int, deal: str, cx: str, cy: str) -> str:
    return f"(({tier}L * {DEALS} + {deal}) * 281474976710656L + ({cx} + 8388608L) * 16777216L + {cy} + 8388608L)"


def close_counts(lines: DataFrame, tracks: DataFrame, reach: float, min_fraction: float = 0.0) -> DataFrame:
    """track_id, seg_id, close, samples: how many of a segment's samples lie within ``reach`` of a track, for pairs with one
    at least and with the share ``min_fraction``.

    ``lines`` has seg_id, lons, lats (arrays of samples) and is read twice; ``tracks`` has track_id and points.
    """
    spark = lines.sparkSession
    side = max(SIDE, 32 * reach)
    boxes = lines.select("seg_id", F.concat("lons", "lats").alias("v"), *[f(c).alias(n) for n, f, c in (("x0", F.array_min, "lons"), ("x1", F.array_max, "lons"), ("y0", F.array_min, "lats"), ("y1", F.array_max, "lats"))]).where("x0 is not null and y0 is not null")
    top = boxes.select(F.max(F.greatest(F.abs("y0"), F.abs("y1")))).first()[0] or 0.0
    narrow = max(1e-3, math.cos(math.radians(min(89.9, top))))
    tall, wide = side / MILES_LAT, side / (MILES_LON * narrow)
    half = f"greatest((x1 - x0) / {wide!r}D, (y1 - y0) / {tall!r}D) / {2 * HALF!r}D"
    boxes = boxes.withColumn("tier", F.expr(f"CASE WHEN {half} <= 1 THEN 0 ELSE least({TIERS}, CAST(ceil(log(4, {half})) AS INT)) END"))
    tiers = boxes.groupBy("tier").agg(F.max(F.expr("x1 - x0")).alias("w"), F.max(F.expr("y1 - y0")).alias("h")).collect()
    if not tiers:
        return spark.createDataFrame([], FOUND)
    home = F.lit(None).cast("array<bigint>")
    near_x, near_y = 1.000001 * reach / (MILES_LON * narrow), 1.000001 * reach / MILES_LAT
    keys = []
    for t in tiers:
        w, h = wide * 4.0**t.tier, tall * 4.0**t.tier
        middle = [f"CAST(floor(({a} + {b}) / 2 / {s!r}D) AS BIGINT)" for a, b, s in (("x0", "x1", w), ("y0", "y1", h))]
        home = F.when(F.col("tier") == t.tier, F.expr("array(" + ", ".join(_key(t.tier, f"{d}L", *middle) for d in range(DEALS)) + ")")).otherwise(home)
        mx, my = t.w / 2 + near_x + 1e-9, t.h / 2 + near_y + 1e-9
        cells = lambda x0, x1, y0, y1: (
            f"flatten(transform(sequence(CAST(floor(({x0} - {mx!r}D) / {w!r}D) AS BIGINT), CAST(floor(({x1} + {mx!r}D) / {w!r}D) AS BIGINT)), cx -> transform(sequence(CAST(floor(({y0} - {my!r}D) / {h!r}D) AS BIGINT), CAST(floor(({y1} + {my!r}D) / {h!r}D) AS BIGINT)), cy -> {_key(t.tier, 'deal', 'cx', 'cy')})))"
        )
        # A piece longer than a tile goes to the tiles along it, not to all of its box.
        steps = f"CAST(ceil(greatest((x1 - x0) / {w!r}D, (y1 - y0) / {h!r}D)) AS BIGINT)"
        parts = []
        for p, q in (("one", "two"), ("two", "three")):
            u0, u1, v0, v1 = (f"({p}.{c} + ({q}.{c} - {p}.{c}) * (s - {k}) / {steps})" for c in ("lon", "lat") for k in (1, 0))
            inner = cells(f"least({u0}, {u1})", f"greatest({u0}, {u1})", f"least({v0}, {v1})", f"greatest({v0}, {v1})")
            parts.append(f"CASE WHEN {u0.replace('(s - 1)', '0')} + {v0.replace('(s - 1)', '0')} + {q}.lon + {q}.lat IS NOT NULL THEN flatten(transform(sequence(1L, {steps}), s -> {inner})) ELSE array() END")
        keys.append(f"CASE WHEN {steps} <= 1 THEN {cells('x0', 'x1', 'y0', 'y1')} ELSE array_distinct(concat({', '.join(parts)})) END")
    held = boxes.select(F.explode(home).alias("tile"), F.lit(0).alias("piece"), F.col("seg_id").alias("id"), "v")
    edges = F.expr(
        "transform(sequence(1, greatest(size(points) - 1, 1), 2), i -> struct(points[i - 1] AS one, coalesce(get(points, i), points[i - 1]) AS two, "
        "CASE WHEN get(points, i) IS NULL THEN points[i - 1] ELSE coalesce(get(points, i + 1), get(points, i)) END AS three))"
    )
    pieces = tracks.where("size(points) > 0").select("track_id", F.explode(edges).alias("edges")).select("track_id", "edges.*")
    pieces = pieces.select("*", F.expr(f"pmod(xxhash64(track_id), {DEALS}L)").alias("deal"), *[F.expr(f"{f}(one.{c}, two.{c}, three.{c})").alias(n) for n, f, c in (("x0", "least", "lon"), ("x1", "greatest", "lon"), ("y0", "least", "lat"), ("y1", "greatest", "lat"))])
    pieces = pieces.where("x0 is not null and y0 is not null").select(
        F.explode(F.expr(keys[0] if len(keys) == 1 else f"concat({', '.join(keys)})")).alias("tile"), F.lit(1).alias("piece"), F.col("track_id").alias("id"), F.expr("array(one.lon, one.lat, two.lon, two.lat, three.lon, three.lat)").alias("v")
    )
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = held.union(pieces).repartition(tasks, "tile").sortWithinPartitions("tile", "piece", "id")
    return dealt.mapInArrow(_walk(reach, near_x, near_y, min_fraction), FOUND)

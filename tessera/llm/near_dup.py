"""Near-duplicate documents: chosen-path set similarity join on word shingles, exact check, connected components.

Documents of equal shingle sets are one class. Classes enter independent trees: a node picks coordinates of the
min-wise sketch by its own random choice (1 / ``threshold`` of them on average), and a document branches to the child
of each picked coordinate and its value there. Every node is first compared with its smallest class, its pivot. Nodes of
at most ``LEAF`` classes are compared pair by pair across the components that the verified links leave. Larger nodes of
one pivot, mostly the same family met in several trees, are one group: it is compared with further pivots in turns that
are linear in its size, what they join is contracted, and only members outside the largest component go to all blocks of
the group. Nodes of groups over ``WIDE`` classes branch on first. A pair counts only after the exact comparison of the
full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .kernels import lower_ascii, mix, prefix_hash, range_hash, text_chunks, words
from .storage import bounded_batches, shared_if_small, written

COORDINATES = 64
TREES = 14
START_DEPTH, MAX_DEPTH = 3, 10
#: Classes of a leaf that are compared exhaustively; of a group that is compared in blocks, and of a block.
LEAF, WIDE, BLOCK = 64, 4096, 512
#: Pivots of a large group in a turn, and turns at most; a turn that joins under a GAIN of the group ends them.
PIVOTS, TURNS, GAIN = 8, 4, 0.05
#: Shingles of a class that one task compares with others; longer sets are compared slice by slice.
SLICE_ITEMS = 4096
#: Sketch agreement below which a pair is not checked: about four standard errors under the threshold.
MARGIN = 0.18
#: Class ids broadcast at most to pick the texts whose sets are needed (8 bytes each); joined by a shuffle beyond.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(77)
_MULTIPLIERS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_PLACE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, joined; bounds with one more entry than rows).

    A row with fewer than ``width`` words has its whole word sequence as one shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = lower_ascii(data)
    starts, ends, first = words(low, offsets)
    h = range_hash(prefix_hash(low), starts, ends)
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(rows), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][row]
    size = np.minimum(n, width)[row]
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    value = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        value = mix(value + np.where(size > k, padded[at + k], np.uint64(0)) * _PLACE[k])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(rows + 1))


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-wise values (rows x COORDINATES, 32 bits) of each row's set; an empty set has the largest value everywhere."""
    rows = len(bounds) - 1
    out = np.full((rows, COORDINATES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(COORDINATES):
            hashed = ((values * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(hashed, bounds[:-1][full])
    return out


def _signer(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                values, bounds = shingles(data, offsets, width)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + s))]) for s in (np.uint64(0), np.uint64(0x5851F42D4C957F2D))]
                f1, f2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                sketch = sketches(values, bounds)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES), hi - lo, [None, pa.py_buffer(sketch.astype("<u4").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), sketch], ["doc_id", "n", "f1", "f2", "sketch"])

    return run


def _matrix(column: pa.Array, kind: str = "<u4") -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def _branches(keys: np.ndarray, sketch: np.ndarray, row: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(child keys, index of the parent): node ``keys[i]``, of sketch ``row[i]``, picks one coordinate, and a second one with probability 1/threshold - 1."""
    out, rows = [], []
    for k in range(2):
        r = mix(keys + np.uint64(0xA24BAED4963EE407 * (k + 1) % (1 << 64)))
        pick = np.arange(len(keys)) if not k else np.flatnonzero((r >> np.uint64(32)) % np.uint64(10_000) < np.uint64(10_000 * (1 / threshold - 1)))
        c = (r[pick] % np.uint64(COORDINATES)).astype(np.int64)
        out.append(mix(keys[pick] * np.uint64(0x9FB21C651E98DF25) + (c.astype(np.uint64) << np.uint64(32)) + sketch[row[pick], c] + np.uint64(1)))
        rows.append(pick)
    return np.concatenate(out), np.concatenate(rows)


def _grower(depth: int, threshold: float, from_root: bool):
    """Maps (id, sketch) or (id, sketch, node) to (node, id) after ``depth`` branchings."""

    def run(batches):
        for batch in batches:
            sketch = _matrix(batch.column(1))
            row = np.arange(len(batch)) if not from_root else np.tile(np.arange(len(batch)), TREES)
            keys = batch.column(2).to_numpy().view(np.uint64) if not from_root else mix(np.repeat(np.arange(1, TREES + 1, dtype=np.uint64), len(batch)) * np.uint64(0xE7037ED1A0B428DB))
            for _ in range(depth):
                keys, parent = _branches(keys, sketch, row, threshold)
                row = row[parent]
            # Two ways to one node within a batch are one.
            both = np.unique(np.stack([keys.view(np.int64), row], 1), axis=0) if len(keys) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), batch.column(0).take(pa.array(both[:, 1]))], ["node", "id"])

    return run


def _likely(floor: float, threshold: float):
    """Keeps the pairs whose sketches agree often enough and whose set sizes allow the threshold."""

    def run(batches):
        for batch in batches:
            a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            keep = ((a == b).mean(1) >= floor) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def _setter(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                values, bounds = shingles(data, offsets, width)
                raw = values.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([raw[8 * x : 8 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["id", "items"])

    return run


def _verifier(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


class _Join:
    """State of one run: classes with sketches, and how to check pairs of them."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.threshold = percent / 100
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        signed = written(rows.mapInArrow(_signer(width), "doc_id long, n long, f1 long, f2 long, sketch binary"), "near-signed")
        self.signed = signed.drop("sketch")
        by_class = signed.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"))
        self.classes = written(by_class, "near-classes")
        # One sketch for each class: that of its smallest document (equal in all of them; a repeated row gives it again).
        own = signed.where("n > 0").join(self.classes.withColumnRenamed("id", "doc_id"), ["n", "f1", "f2", "doc_id"], "left_semi")
        self.sketches = written(own.select(F.col("doc_id").alias("id"), "n", "sketch").dropDuplicates(["id", "n"]).dropDuplicates(["id"]), "near-sketches")
        self.sets = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        a = self.sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        b = self.sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb")
        return written(joined.mapInArrow(_likely(self.threshold - MARGIN, self.threshold), "a long, b long"), "near-likely")

    def items(self, ids: DataFrame) -> DataFrame:
        """id, items: the sorted shingle hashes of the classes ``ids``."""
        ids = written(ids.distinct(), "near-ids")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(shared_if_small(ids, BROADCAST_IDS), "id", "left_semi")
        sets = texts.mapInArrow(_setter(self.width), "id long, items binary").join(self.sketches.select("id", "n"), "id")
        # Rows that share an id may differ in text: the class's own set is one of its size.
        return written(sets.where(F.octet_length("items") == 8 * F.col("n")).select("id", "items").dropDuplicates(["id"]), "near-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        sets = self.items(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
        a, b = sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
        joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ia", "ib")
        return written(joined.mapInArrow(_verifier(self.percent), "a long, b long"), "near-links")


def _open(nodes: DataFrame, known: DataFrame | None) -> DataFrame:
    """node, id, component of the nodes that hold more than one component, with the node's size and smallest id (pivot)."""
    if known is None:
        placed = nodes.withColumn("component", F.col("id"))
    else:
        placed = nodes.join(known, "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))
    shape = placed.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(shape.select("node", "size", "pivot"), "node")


def _pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """a, b: the members of each node with pivots of other components; in turn 0 the smallest id, later PIVOTS random members."""
    orders = [F.xxhash64("id", F.lit(turn * PIVOTS + k)) for k in range(PIVOTS)] if turn else [F.col("id")]
    chosen = rows.groupBy("node").agg(F.array_distinct(F.array(*[F.min_by(F.struct("id", "component"), o) for o in orders])).alias("pivots"))
    met = rows.join(chosen, "node").select("id", "component", F.explode("pivots").alias("p")).where("component != p.component")
    return met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()


def _with_partners(floor: float, threshold: float):
    """(group, members (id, component, n, sketch)) to (group, id, component, n) of the members with a likely partner in another component."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            m = lists.flatten()
            if not len(m):
                continue
            group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            component, n = m.field(1).to_numpy(), m.field(2).to_numpy()
            sketch, found = _matrix(m.field(3)), np.zeros(len(m), bool)
            for lag in range(1, int(np.bincount(group).max())):
                i = np.flatnonzero(group[lag:] == group[:-lag])
                j = i + lag
                keep = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[keep], j[keep]
                keep = (sketch[i] == sketch[j]).mean(1) >= floor
                found[i[keep]] = found[j[keep]] = True
            at = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(group[found])), *(m.field(k).take(at) for k in range(3))], ["group", "id", "component", "n"])

    return run


def _common(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0-1 matrices over the shingles that occur twice, in slices."""
    member = np.repeat(np.arange(len(items)), [len(x) for x in items])
    value = np.concatenate(items)
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    column, member = np.unique(column[shared], return_inverse=True)[1], member[shared]
    out = np.zeros((len(items), len(items)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(items), 4096), np.float32)
        part[member[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def _slicer(batches):
    """(group, id, component, n, slices, items) to (group, slice, id, component, n, items): the items of each range of hashes.

    A class gives a row for each slice it has items in, and one for slice 0 in any case.
    """
    names = ["group", "slice", "id", "component", "n", "items"]
    for batch in batches:
        at, slices, parts = [], [], []
        for i, (n, raw) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5), strict=True)):
            items = np.frombuffer(raw.as_buffer(), "<u8")
            step = (1 << 64) // n + 1
            cuts = np.searchsorted(items, np.array([k * step for k in range(1, n)], np.uint64)) if n > 1 else np.empty(0, np.int64)
            for k, part in enumerate(np.split(items, cuts)):
                if k == 0 or len(part):
                    at.append(i)
                    slices.append(k)
                    parts.append(part.tobytes())
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(slices, pa.int32()), *(batch.column(k).take(at) for k in (1, 2, 3)), pa.array(parts, pa.binary())], names)


def _counter(batches):
    """(group, members (id, component, n, items) of a slice) to (group, members, pairwise intersections as a matrix)."""
    for batch in batches:
        groups, members, counts = [], [], []
        for group, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            m = rows.values
            groups.append(group)
            members.append(np.stack([m.field(k).to_numpy() for k in range(3)]).astype("<i8").tobytes())
            counts.append(_common([np.frombuffer(x.as_buffer(), "<u8") for x in m.field(3)]).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(members, pa.binary()), pa.array(counts, pa.binary())], ["group", "members", "common"])


def _linker(percent: int):
    """The slices (members, common) of a group to (a, b): a forest of exact links that joins all that the group's links join."""

    def run(batches):
        for batch in batches:
            out = []
            for slices in batch.column(0):
                parts = [np.frombuffer(x.as_buffer(), "<i8").reshape(3, -1) for x in slices.values.field(0)]
                ids, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
                component, n = (np.concatenate([p[k] for p in parts])[first] for k in (1, 2))
                common = np.zeros((len(ids), len(ids)), np.int64)
                for p, raw in zip(parts, slices.values.field(1), strict=True):
                    at = np.searchsorted(ids, p[0])
                    common[np.ix_(at, at)] += np.frombuffer(raw.as_buffer(), "<i4").reshape(len(at), -1)
                union = n[:, None] + n[None, :] - common
                other = component[:, None] != component[None, :]
                link = (100 * common >= percent * union) & other
                seen = np.zeros(len(ids), bool)
                for root in range(len(ids)):
                    frontier = [] if seen[root] else [root]
                    seen[root] = True
                    while len(frontier):
                        step = link[frontier]
                        new = np.flatnonzero((step.any(0) | ~other[frontier].all(0)) & ~seen)
                        for x in new.tolist():
                            by = int(step[:, x].argmax())
                            if step[by, x]:
                                out.append((ids[frontier[by]], ids[x]))
                        seen[new] = True
                        frontier = new.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([min(a, b) for a, b in out], pa.int64()), pa.array([max(a, b) for a, b in out], pa.int64())], ["a", "b"])

    return run


def _links_within(rows: DataFrame, run: _Join) -> DataFrame:
    """a, b of the links across components in groups whose size the caller bounds (LEAF, or twice BLOCK)."""
    members = rows.join(run.sketches, "id").select("group", F.struct("id", "component", "n", "sketch").alias("m"))
    lists = members.groupBy("group").agg(F.collect_list("m").alias("m")).select("group", "m")
    likely = written(lists.mapInArrow(_with_partners(run.threshold - MARGIN, run.threshold), "group string, id long, component long, n long"), "near-partners")
    wide = likely.groupBy("group").agg(F.ceil(F.max("n") / SLICE_ITEMS).cast("int").alias("slices"))
    held = likely.join(wide, "group").join(run.items(likely.select("id")), "id").select("group", "id", "component", "n", "slices", "items")
    sliced = held.mapInArrow(_slicer, "group string, slice int, id long, component long, n long, items binary")
    lists = sliced.groupBy("group", "slice").agg(F.collect_list(F.struct("id", "component", "n", "items")).alias("m")).select("group", "m")
    counted = lists.mapInArrow(_counter, "group string, members binary, common binary")
    whole = counted.groupBy("group").agg(F.collect_list(F.struct("members", "common")).alias("slices")).select("slices")
    return whole.mapInArrow(_linker(run.percent), "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Members of large groups: each goes to its own block, those outside the group's largest component to all blocks.

    Outsiders are dealt to turns of at most about BLOCK, so that one task compares at most about twice BLOCK members. Up
    to WIDE members, rows are at most WIDE / BLOCK times the members.
    """
    largest = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max_by("component", F.struct("k", F.col("component"))).alias("giant"))
    dealt = rows.join(largest, "node").withColumn("outside", F.col("component") != F.col("giant"))
    shape = dealt.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum(F.col("outside").cast("int")) / BLOCK).cast("int").alias("rounds"))
    dealt = dealt.join(shape, "node").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("turn", F.pmod(F.xxhash64("id"), "rounds").cast("int"))
    home = dealt.select("node", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("turn"))
    away = dealt.where("outside").select("node", "id", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "turn")
    return home.union(away).distinct().select(F.concat_ws("/", "node", "own", "turn").alias("group"), "id", "component")


def similarity_links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, classes, verified links between class ids) of ``docs`` (doc_id, text).

    Null, empty and blank texts have no class; neither has a null doc_id. Equal sets are one class, whose id is the smallest
    doc_id; repeated rows are signed each. An empty table gives three empty ones.
    """
    bounded_batches(docs.sparkSession)
    run = _Join(docs, width, percent)
    nodes = written(run.sketches.select("id", "sketch").mapInArrow(_grower(START_DEPTH, run.threshold, True), "node long, id long"), "near-nodes")
    rows = written(_open(nodes, None), "near-open")
    links = run.verified(run.likely(_pivot_pairs(rows, 0)))
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows, leaves = written(_open(rows.select("node", "id"), found), "near-open"), []
    for depth in range(START_DEPTH, MAX_DEPTH + 1):
        small = rows.where(F.col("size") <= LEAF)
        if depth == START_DEPTH:  # the pivot has been compared with every member: what is left are the pairs of the others
            small = small.where("size > 2 and id != pivot")
        leaves.append(small.select(F.col("node").cast("string").alias("group"), "id", "component"))
        large = rows.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        groups = written(_open(large.select(F.col("pivot").alias("node"), "id").distinct(), found), "near-groups")
        for turn in range(1, TURNS + 1):
            more = run.verified(run.likely(_pivot_pairs(groups, turn)))
            gained, size = more.count(), groups.count()
            if gained:
                links = links.union(more)
                found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
                groups = written(_open(groups.select("node", "id"), found), "near-groups")
            if gained < GAIN * size:
                break
        wide = groups.where(F.col("size") > WIDE)
        if depth == MAX_DEPTH or wide.isEmpty():
            leaves.append(_blocks(groups))
            break
        leaves.append(_blocks(groups.where(F.col("size") <= WIDE)))
        again = large.select("id", "node", "pivot").join(wide.select(F.col("node").alias("pivot")).distinct(), "pivot", "left_semi")
        grown = again.select("id", "node").join(run.sketches, "id").select("id", "sketch", "node").mapInArrow(_grower(1, run.threshold, False), "node long, id long")
        rows = written(_open(written(grown.distinct(), "near-nodes"), found), "near-open")
    dealt = leaves[0]
    for more in leaves[1:]:
        dealt = dealt.union(more)
    links = links.union(written(_links_within(dealt, run), "near-rest"))
    return run.signed, run.classes, links.distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Links: 100 * intersection >= percent * union of the sets of ``width``-word shingles (A-Z lower-cased). Null, empty
    and blank texts have size 0 and link with nothing. Repeated rows stay; rows that share a doc_id and differ in text
    are looked at by their own sets. A null doc_id is its own component (null) and kept. Empty table: no rows.
    """
    signed, classes, links = similarity_links(docs, width, percent)
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("component", "linked")
    named = written(classes.join(found, "id", "left").select("n", "f1", "f2", F.coalesce("linked", "id").alias("component_id")), "near-named")
    out = signed.join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

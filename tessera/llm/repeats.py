"""Removal of byte strings that repeat anywhere in the corpus, by local suffix sorting with bucket-pointer refinement.

Every ``length``-byte string holds a window whose hash is the smallest in it (leftmost of equals): its anchor. Equal
strings have equal anchors, so only texts around equal anchors need sorting. An anchor stands for the strings that chose
it; together they are its context. Equal contexts are one (a context that occurs twice is repeated as a whole); the
bytes of the others are gathered by anchor, and their suffixes are sorted by bucket-pointer refinement to ``length``.
An anchor with more contexts than one sort takes is split by the bytes next to it: a string reaches at least half of what
it has beside the anchor to the left, or more than half to the right, so it goes with the strings that are equal there.
Texts are shuffled only where a bitmap of bounded size says that they may hold repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import prefix_hash, range_hash, released, text_chunks, window_hash
from .storage import bounded_batches, sieve, sifted, written

ANCHOR = 32
Q = 8
#: Bytes of contexts that are sorted at once (a sort takes some seventy times as much and is fastest within the caches),
#: and contexts of one anchor up to which they are; more are split first.
SORT_BYTES = 1 << 18
GROUP_CONTEXTS = 1000
#: A text with more than one in HOT_SHARE of all rows as copies is hot: at most HOT_SHARE keys, found without a shuffle of texts.
HOT_SHARE = 2000


# -- suffix sorting ---------------------------------------------------------------------------------------------
def repeated_starts(data: np.ndarray, bounds: np.ndarray, owned: np.ndarray, length: int) -> np.ndarray:
    """Flags the ``owned`` starts whose ``length``-byte string also is at another owned start of data[bounds[i]:bounds[i+1]].

    Bucket-pointer refinement: suffixes are put in buckets by their first Q bytes; the pointer of a suffix is the place
    where its bucket begins in the suffix array. Each pass sorts the suffixes of shared buckets by the pointers of the
    suffixes ``depth`` bytes on and splits the buckets; the new pointers serve the next pass, which looks twice as far.
    Suffixes that do not reach ``length`` within their context, or are alone in their bucket, drop out.
    """
    n = len(data)
    room = (np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)).astype(np.int32)
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(Q):
        key <<= np.uint64(8)
        key |= padded[k : n + k]
    live = np.flatnonzero(room >= Q).astype(np.int32)
    key = key[live]
    order = np.argsort(key)  # the order inside a bucket is of no account, so no sort need be stable
    pointer = np.arange(n, 2 * n, dtype=np.int32)  # all alone at first, outside the suffix array's places
    depth, ranked, key = Q, live[order], key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(ranked) else np.empty(0, bool)
    pointer[ranked] = np.maximum.accumulate(np.where(first, np.arange(len(ranked), dtype=np.int32), np.int32(0)))
    active = ranked[_shared(first)]
    del key, live, order, ranked
    while depth < length and len(active):
        step = min(depth, length - depth)
        depth += step
        # One that drops out keeps its pointer: whoever reaches ``depth`` looks only at those that reached the depth before.
        active = active[room[active] >= depth]
        if not len(active):
            break
        both = pointer[active].astype(np.int64) * (2 * n) + pointer[active + step]  # the bucket, then the later pointer
        order = np.argsort(both)
        active, both = active[order], both[order]
        old = pointer[active]
        new_bucket = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.concatenate([[True], both[1:] != both[:-1]])
        index = np.arange(len(active), dtype=np.int32)
        bucket_at = np.maximum.accumulate(np.where(new_bucket, index, np.int32(0)))
        pointer[active] = old + np.maximum.accumulate(np.where(first, index, np.int32(0))) - bucket_at
        active = active[_shared(first)]
    out = np.zeros(n, bool)
    mine = active[owned[active]]
    # A string counts where two owned starts share it: other suffixes are part of some other context's strings.
    values, inverse, counts = np.unique(pointer[mine], return_inverse=True, return_counts=True)
    out[mine] = counts[inverse] > 1 if len(values) else False
    return out


def _shared(first: np.ndarray) -> np.ndarray:
    """Of sorted rows with flags where a bucket begins: those whose bucket has more than one row."""
    follows = np.concatenate([~first[1:], [False]])
    return ~first | follows


# -- anchors ------------------------------------------------------------------------------------------------------
def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in h[i:i+width] for each full window (blockwise running minima)."""
    n = len(h) - width + 1
    size = -(-len(h) // width) * width
    padded = np.concatenate([h, np.full(size - len(h), ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    # The next place at or after i with this value is the leftmost one: it lies in the window.
    change = np.concatenate([[True], low[1:] != low[:-1]])
    runs = np.flatnonzero(change)
    out = np.empty(n, np.int64)
    for a, b in zip(runs.tolist(), np.append(runs[1:], n).tolist(), strict=True):
        hits = a + np.flatnonzero(h[a : b + width - 1] == low[a])
        if len(hits) == 1:
            out[a:b] = hits[0]
        else:
            out[a:b] = hits[np.searchsorted(hits, np.arange(a, b))]
    return out


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                prefix = prefix_hash(data)
                h = window_hash(prefix, ANCHOR)
                rows, place, first, last = [], [], [], []
                for r in np.flatnonzero(np.diff(offsets) >= length):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    chosen = _sliding_argmin(h[a : b - ANCHOR + 1], length - ANCHOR + 1)
                    edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
                    rows.append(np.full(len(edge), r))
                    place.append(chosen[edge] + a)
                    first.append(edge + a)
                    last.append(np.append(edge[1:], len(chosen)) - 1 + a)
                if not rows:
                    continue
                rows, place, first, last = map(np.concatenate, (rows, place, first, last))
                base = offsets[rows]
                context = range_hash(prefix, first, last + length)
                context = context ^ ((place - first).astype(np.uint64) << np.uint64(40)) ^ ((last - place).astype(np.uint64) << np.uint64(20))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[place].view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array((place - base).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array((last - first).astype(np.int32))],
                    ["anchor", "context", "key", "place", "before", "more"],
                )

    return released(run)


ANCHOR_SCHEMA = "anchor long, context long, key binary, place int, before int, more int"


def _context_bytes(length: int):
    """(text, wanted: array of (anchor, context, start, before, more)) to (anchor, context, before, more, bytes)."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(0), (x.as_py() for x in batch.column(1)), strict=True):
                data = text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py().encode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["anchor"] for w in wanted], pa.int64()), pa.array([w["context"] for w in wanted], pa.int64()), pa.array([w["before"] for w in wanted], pa.int32()), pa.array([w["more"] for w in wanted], pa.int32()), pa.array([data[w["start"] : w["start"] + w["more"] + length] for w in wanted], pa.binary())],
                    ["anchor", "context", "before", "more", "bytes"],
                )

    return released(run)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _sorted_groups(length: int):
    """Contexts, all of an anchor one after another, to (anchor, context, first, last): runs of repeated starts."""

    def sort(parts):
        table = pa.Table.from_batches(parts)
        more = table["more"].to_numpy()
        raw = table["bytes"].combine_chunks()
        from .kernels import text_buffers

        data, bounds = text_buffers(raw)
        local = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
        owned = local <= np.repeat(more, np.diff(bounds))
        flags = repeated_starts(data, bounds, owned, length)
        # A byte between contexts ends a run: each context's last start has length - 1 >= 1 bytes behind it.
        a, b = _runs(flags)
        row = np.searchsorted(bounds, a, "right") - 1
        return pa.RecordBatch.from_arrays([table["anchor"].combine_chunks().take(pa.array(row)), table["context"].combine_chunks().take(pa.array(row)), pa.array((a - bounds[row]).astype(np.int32)), pa.array((b - bounds[row]).astype(np.int32))], ["anchor", "context", "first", "last"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            # Pieces end where the anchor changes, so that no group is split.
            cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            begin = 0
            widths = np.diff(np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset : batch.column(3).offset + len(batch) + 1])
            total = np.concatenate([[0], np.cumsum(widths)])
            if held and held[-1].column(0)[len(held[-1]) - 1].as_py() != anchor[0] and size >= SORT_BYTES:
                yield sort(held)
                held, size = [], 0
            for cut in cuts.tolist():
                if size + total[cut] - total[begin] >= SORT_BYTES:
                    yield sort([*held, batch.slice(begin, cut - begin)])
                    held, size, begin = [], 0, cut
            held.append(batch.slice(begin))
            size += int(total[-1] - total[begin])
        if held:
            yield sort(held)

    return released(run)


PIECE = "anchor long, context long, of_anchor long, of_context long, shift int, before int, more int, width int, bytes binary"


def _halves(length: int):
    """Contexts (anchor, context, before, more, width, bytes) to their two pieces (PIECE).

    All strings of a context hold the ``width`` bytes at ``before``, its core. Those that reach at least half of the rest
    to its left are one piece, whose core grows to the left by that half; the others have a core that grows to the right.
    The new anchor is a hash of the old one, the side and the new core, so equal strings keep meeting; the new context is
    a hash of the piece. ``shift`` is the piece's first string within the old context.
    """

    def run(batches):
        for batch in batches:
            out = []
            for anchor, context, before, more, width, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                half = -(-(length - width) // 2)
                edge = before - half  # the last string that reaches half of the rest to the left
                for side, lo, hi in ((0, 0, min(more, edge)), (1, max(0, edge + 1), more)):
                    if hi < lo:
                        continue
                    data = raw[lo : hi + length]
                    core, wide = (before - half - lo, width + half) if side == 0 else (before - lo, length - half + 1)
                    names = [hashlib.blake2b(x, digest_size=8).digest() for x in (b"%d %d " % (anchor, side) + data[core : core + wide], b"%d " % core + data)]
                    out.append((*(int.from_bytes(x, "little", signed=True) for x in names), anchor, context, lo, core, hi - lo, wide, data))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "context", "of_anchor", "of_context", "shift", "before", "more", "width", "bytes"])

    return released(run)


FOUND = "anchor long, context long, first int, last int"


def _sorted_runs(contexts: DataFrame, length: int) -> DataFrame:
    """FOUND: runs of repeated starts of ``contexts`` (anchor, context, more, bytes), each anchor's sorted in one task."""
    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "context", "more", "bytes")
    return dealt.mapInArrow(_sorted_groups(length), FOUND)


def _runs_of_large(contexts: DataFrame, length: int) -> DataFrame:
    """FOUND of anchors with more contexts than one sort takes: split level by level until a sort takes each group.

    Every level halves what strings have beside their core, so after about log2(length) levels a group's strings are equal.
    """
    levels = []
    rows = contexts.select("anchor", "context", "before", "more", F.lit(ANCHOR).alias("width"), "bytes")
    while True:
        pieces = written(rows.mapInArrow(_halves(length), PIECE), "repeat-pieces")
        same = pieces.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("before", "more", "width", "bytes")).alias("p"))
        same = written(same.select("anchor", "context", "copies", "p.*"), "repeat-same")
        groups = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        same = same.join(groups, "anchor")
        found = same.where("copies > 1").select("anchor", "context", F.lit(0).alias("first"), F.col("more").alias("last"))
        found = found.union(_sorted_runs(same.where(F.col("n").between(2, GROUP_CONTEXTS)), length))
        levels.append((pieces.select("anchor", "context", "of_anchor", "of_context", "shift"), written(found, "repeat-runs")))
        rows = written(same.where(F.col("n") > GROUP_CONTEXTS).select("anchor", "context", "before", "more", "width", "bytes"), "repeat-large")
        if rows.isEmpty():
            break
    below = None
    for pieces, found in reversed(levels):
        found = found.union(below) if below is not None else found
        met = pieces.join(found, ["anchor", "context"])
        below = met.select(F.col("of_anchor").alias("anchor"), F.col("of_context").alias("context"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
    return below


def repeated_spans(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """(spans, copied): spans has key and array of (start, end) bytes to remove of texts that occur once; copied has the
    keys of texts of at least ``length`` bytes that occur more often, which are repeated as a whole, and whether a key is
    hot. ``docs`` has key, doc_id and text."""
    bounded_batches(docs.sparkSession)
    long = docs.where(F.octet_length("text") >= length).select("key", "doc_id", "text")
    counts = written(long.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("as_id")), "repeat-counts")
    rows = counts.agg(F.sum("copies")).first()[0] or 0
    copied = counts.where("copies > 1").select("key", (F.col("copies") * HOT_SHARE > rows).alias("hot"))
    listed, single = sifted(long, "key", sieve(copied, "key"))
    # One row of each text: met on key and id, so that the copies of a hot text don't meet in one task.
    first = listed.alias("x").join(counts.alias("y"), (F.col("x.key") == F.col("y.key")) & F.col("x.doc_id").eqNullSafe(F.col("y.as_id")), "left_semi")
    one = first.union(single).select("key", "text")
    anchors = written(one.mapInArrow(_anchor_rows(length), ANCHOR_SCHEMA), "repeat-anchors")
    at = F.struct("key", "place")
    contexts = anchors.groupBy("anchor", "context").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min("before").alias("before"), F.min("more").alias("more"))
    contexts = contexts.select("anchor", "context", "a", (F.col("a") != F.col("b")).alias("twice"), "before", "more")
    contexts = written(contexts, "repeat-contexts")
    groups = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any")).where("n > 1 or any")
    kept = written(contexts.join(groups, "anchor").select("anchor", "context", "a", "twice", "before", "more", "n"), "repeat-kept")
    solid = kept.where("twice").select("anchor", "context", F.lit(0).alias("first"), F.col("more").alias("last"))
    mixed = kept.where("n > 1").select("a.key", F.struct("anchor", "context", (F.col("a.place") - F.col("before")).alias("start"), "before", "more").alias("w"))
    wanted = written(mixed.groupBy("key").agg(F.collect_list("w").alias("wanted")).join(counts.select("key", "as_id"), "key"), "repeat-wanted")
    texts = sifted(long, "key", sieve(wanted, "key"))[0].alias("x").join(wanted.alias("y"), (F.col("x.key") == F.col("y.key")) & F.col("x.doc_id").eqNullSafe(F.col("y.as_id")))
    raw = texts.select(F.col("text").cast("binary"), "wanted").mapInArrow(_context_bytes(length), "anchor long, context long, before int, more int, bytes binary")
    raw = written(raw, "repeat-bytes")
    large = written(kept.where(F.col("n") > GROUP_CONTEXTS).select("anchor").distinct(), "repeat-large")
    found, small = solid, raw
    if not large.isEmpty():
        small = raw.join(large, "anchor", "left_anti")
        found = found.union(_runs_of_large(raw.join(large, "anchor", "left_semi"), length))
    found = written(found.union(_sorted_runs(small, length)), "repeat-found")
    hits = anchors.join(found, ["anchor", "context"]).select("key", (F.col("place") - F.col("before") + F.col("first")).alias("start"), (F.col("place") - F.col("before") + F.col("last") + length).alias("end"))
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(copied, "key", "left_anti")
    return written(spans, "repeat-spans"), written(copied, "repeat-copied")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted disjoint (start, end) of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its text (null: empty) and key, the first 16 bytes of the text's SHA-256."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` (keyed) with ``spans``: the byte ranges to remove, not merged; null or empty for none. One row for each row."""
    spans, copied = repeated_spans(docs, length)
    every = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end")))
    names, kind = docs.columns, spans.schema["spans"].dataType
    # Hot texts are at most HOT_SHARE keys; a text that no bitmap knows has no repeats. The rest meets its spans by key.
    hot = docs.join(F.broadcast(copied.where("hot").select("key", F.col("hot").alias("__whole"))), "key", "left")
    known = spans.select("key", "spans", F.lit(False).alias("__copied")).union(copied.select("key", F.lit(None).cast(kind), F.lit(True)))
    met, clean = sifted(hot.where("__whole is null"), "key", sieve(known, "key"))
    met = met.join(known, "key", "left").select(*names, F.when(F.col("__copied"), every).otherwise(F.col("spans")).alias("spans"))
    return hot.where("__whole").select(*names, every.alias("spans")).union(met).union(clean.select(*names, F.lit(None).cast(kind).alias("spans")))


def _cut(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    gone = merged((s["start"], s["end"]) for s in spans or ())
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), gone


def repeat_report(docs: DataFrame, length: int = 400, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text; other columns are ignored).

    A byte goes where a ``length``-byte string over it also starts anywhere else in the input; repeated rows count as
    elsewhere. Null text is empty; texts shorter than ``length`` stay. Empty table: no rows. ``kept_text`` adds ``text``, what is
    left as characters (one that is cut in part goes whole; the other columns are of bytes).
    """

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * kept_text
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + kept_text)

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(*((x.as_py() for x in batch.column(k)) for k in (1, 2)), strict=True):
                kept, gone = _cut(text, spans)
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore").encode() if gone else kept] if kept_text else [])))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = with_spans(keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), length)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return rows.mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * kept_text)


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; a character that is cut in part goes whole. Null text becomes empty."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = [_cut(t.encode(), s)[0].decode("utf-8", "ignore") if s else t for t, s in zip(*((x.as_py() for x in batch.column(k)) for k in (at, len(names))), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    hidden = docs.select(F.col("doc_id"), F.col("text"), F.struct(*names).alias("__row"))  # clashing names stay apart
    rows = with_spans(keyed(hidden), length)
    return rows.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in names], F.col("spans").alias("__spans")).mapInArrow(released(run), schema)

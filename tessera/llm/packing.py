"""Best-fit-decreasing packing of token pieces into fixed windows.

Overlong documents are cut into full windows; the tails are packed. Best fit needs the multiset of tail lengths only
(at most ``window`` - 1 distinct ones), so the plan is made over counts: a segment tree over remaining capacity finds
the tightest open window for a length, and runs of equal windows are filled at once. The plan is as long as the
number of runs, not of documents; documents then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import cached_bpe
from .storage import bounded_batches, written


class CapacityTree:
    """Segment tree over remaining capacities: which is the smallest open one of at least x?"""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """Smallest capacity >= least with an open window, or -1."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:  # the right sibling holds larger capacities
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_best_fit(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, first bin, items a bin, offset of the first)], number of bins).

    Item of rank r in its length, in the last segment with first rank <= r, goes to bin + (r - first) // items.
    """
    tree, runs = CapacityTree(window), {}  # capacity -> stack of (first bin, bins)
    out, bins = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, first = window, bins
                n = -(-left // (window // length))
                bins += n
            else:
                first, n = runs[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                out.append((length, rank, first + full, each, window - capacity))
                put(capacity - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(capacity, first + full, n - full)
    return out, bins


def _piece_maker(tokenizer: str, end_id: int, window: int):
    def run(batches):
        from pyspark import TaskContext

        shard, bpe = TaskContext.get().partitionId(), cached_bpe(tokenizer)
        tail_rank, full_rank = np.zeros(window, np.int64), 0
        for batch in batches:
            for lo, hi, counts, ids in bpe.encode_column(batch.column(1)):
                size = counts + 1
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                ends = np.cumsum(size)
                pieces = -(-size // window)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, size[doc] - start)
                begin = (ends - size)[doc] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                rank = np.empty(len(doc), np.int64)
                full = length == window
                rank[full] = full_rank + np.arange(full.sum())
                full_rank += int(full.sum())
                tails = np.flatnonzero(~full)
                order = tails[np.argsort(length[tails], kind="stable")]
                own = length[order]
                first = np.searchsorted(own, own)
                rank[order] = tail_rank[own] + np.arange(len(own)) - first
                tail_rank += np.bincount(own, minlength=window)[:window]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), size[doc])), pa.array(np.full(len(doc), shard, np.int32)), pa.array(rank)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "rank"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: a piece of the end id alone. Repeated rows are packed each. An empty table gives no rows.
    Sequence ids are dense: packed windows first, then the full ones. ``docs`` needs doc_id and text; other columns are
    ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, rank long"
    # The written table fixes each piece's rank, whatever happens to executors later.
    pieces = written(rows.mapInArrow(_piece_maker(tokenizer, end_id, window), schema), "pack-pieces")
    counts = written(pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each length and input partition, so it grows with the input: Spark broadcasts it only under its own threshold.
    bases = counts.select("length", "shard", before.alias("base"))
    # At most ``window`` rows, whatever the number of documents.
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    totals.pop(window, 0)
    plan, bins = plan_best_fit(totals, window)
    table = np.array(plan or [(window + 1, 0, 0, 1, 0)], np.int64)
    key = table[:, 0] << 44 | table[:, 1]
    order = np.argsort(key)
    table, key = table[order], key[order]

    def place(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = column["length"].to_numpy()
            rank = column["rank"].to_numpy() + column["base"].to_numpy()
            row = table[np.maximum(np.searchsorted(key, length << 44 | rank, "right") - 1, 0)]
            extra = rank - row[:, 1]
            full = length == window
            sequence = np.where(full, bins + rank, row[:, 2] + extra // row[:, 3])
            offset = np.where(full, 0, row[:, 4] + extra % row[:, 3] * length)
            yield pa.RecordBatch.from_arrays([column[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = pieces.join(bases, ["length", "shard"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "base")
    return placed.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

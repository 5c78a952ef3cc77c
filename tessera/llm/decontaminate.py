"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; its hash ignores the tokens at the mask's gaps. The hashes of items and
texts are joined; an equal pair puts the item's tokens on a diagonal of the text. Along it the tokens are compared, and
the best-scoring stretch is an overlap where it is long enough and agrees enough. Substituted tokens thus neither hide a
hit (some mask skips them) nor an overlap. A bitmap of the items' hashes, of a fixed size, keeps most hashes of texts out
of the join, and only texts with hits are shuffled for the comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import lower_ascii, mix, prefix_hash, range_hash, text_chunks
from .repeats import keyed
from .storage import bounded_batches, shared_if_small, sieve, sifted, written

#: Masks over consecutive tokens (1: compared, 0: ignored), six compared tokens each.
MASKS = ("111111", "1111011", "1101111", "11011011", "101110101", "1101001011", "10101010101")
#: An overlap has at least this many tokens (or the whole item, if shorter) and this share of equal ones.
MIN_TOKENS, MIN_SHARE = 12, 0.75
#: Items with fewer tokens than a mask compares have one seed, all their tokens.
SEED_TOKENS = 6
#: Bits of the bitmap of item hashes (4 MB, at most 524,288 words sent to the driver).
BITMAP_BITS = 25
#: Rows of item seeds (20 bytes each) broadcast at most; joined by a shuffle beyond.
BROADCAST_SEEDS = 500_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each row with one more entry): runs of letters and digits, A-Z lower-cased."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = lower_ascii(data)
    inside = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    return range_hash(prefix_hash(low), starts, ends), np.searchsorted(starts, offsets)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at each position where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += tokens[k : k + n] * np.uint64(pow(0xD1B54A32D192ED03, k + 1, 1 << 64) | 1)
    return mix(out)


def best_overlap(equal: np.ndarray) -> tuple[int, int]:
    """(start, end) of the stretch with the largest score, +1 for an equal token and -2 for another; ends are equal tokens."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end


def _masks(lengths) -> list[str]:
    return [*MASKS, *("1" * n for n in sorted(lengths) if n < SEED_TOKENS)]


def _item_seeds(batches):
    """(item_id, text) to (item_id, tokens as raw hashes, its seeds)."""
    for batch in batches:
        raw, seeds = [], []
        for text in batch.column(1).to_pylist():
            data = np.frombuffer(text.encode(), np.uint8)
            tokens = token_hashes(data, np.array([0, len(data)]))[0]
            raw.append(tokens.astype("<u8").tobytes())
            masks = MASKS if len(tokens) >= SEED_TOKENS else ["1" * len(tokens)] if len(tokens) else []
            seeds.append([{"hash": h, "place": k} for m in masks for k, h in enumerate(seed_hashes(tokens, m).view(np.int64).tolist())])
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(seeds, kind)], ["item_id", "tokens", "seeds"])


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bitmap of the low BITMAP_BITS bits of all hashes, as bytes."""
    low = f"(hash & {(1 << BITMAP_BITS) - 1}L)"
    words = seeds.select(F.expr(f"shiftright({low}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({low} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), "<i8")
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint8)


def _candidates(bitmap: np.ndarray, masks: list[str]):
    """(key, text) to (key, hash, place) of the seeds whose hash may be an item's."""

    def run(batches):
        low = np.uint64((1 << BITMAP_BITS) - 1)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                tokens, first = token_hashes(data, offsets)
                hashes, rows, places = [], [], []
                for mask in masks:
                    h = seed_hashes(tokens, mask)
                    bit = h & low
                    at = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + len(mask) <= first[row + 1]
                    at, row = at[inside], row[inside]
                    hashes.append(h[at])
                    rows.append(row)
                    places.append(at - first[row])
                hashes, rows, places = (np.concatenate(x) for x in (hashes, rows, places))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), pa.array(hashes.view(np.int64)), pa.array(places.astype(np.int32))], ["key", "hash", "place"])

    return run


def _compared(batches):
    """(doc_id, text, hits: (item_id, diagonal, tokens)) to the largest overlap of each item (OVERLAP_SCHEMA)."""
    for batch in batches:
        out = []
        for row in zip(*(batch.column(k) for k in range(3)), strict=True):
            doc_id, text, hits = (x.as_py() for x in row)
            data = np.frombuffer(text.encode(), np.uint8)
            tokens, best = token_hashes(data, np.array([0, len(data)]))[0], {}
            for hit in sorted(hits, key=lambda h: (h["item_id"], h["diagonal"])):
                item, diagonal = np.frombuffer(hit["tokens"], "<u8"), hit["diagonal"]
                a, b = max(diagonal, 0), min(diagonal + len(item), len(tokens))
                equal = tokens[a:b] == item[a - diagonal : b - diagonal]
                s, e = best_overlap(equal)
                same = int(equal[s:e].sum())
                if e - s >= min(MIN_TOKENS, len(item)) and same >= MIN_SHARE * (e - s):
                    if hit["item_id"] not in best or same > best[hit["item_id"]][3]:
                        best[hit["item_id"]] = (a + s, a + s - diagonal, e - s, same)
            out += [(doc_id, item, *v) for item, v in best.items()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "doc_token", "item_token", "n_tokens", "n_equal"])


OVERLAP_SCHEMA = "doc_id long, item_id long, doc_token long, item_token long, n_tokens long, n_equal long"


def _matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, hits) of the texts of ``docs`` (keyed) whose seeds meet an item's, and ``docs`` where the key may be one of them."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).where("item_id is not null")
    items = written(items.select("item_id", "text").mapInArrow(_item_seeds, "item_id long, tokens binary, seeds array<struct<hash: long, place: int>>"), "leak-items")
    seeds = written(items.select("item_id", F.explode("seeds").alias("s")).select("item_id", "s.hash", F.col("s.place").alias("item_place")), "leak-seeds")
    short = [r.n for r in items.select(F.expr("cast(octet_length(tokens) / 8 as int)").alias("n")).where(F.col("n").between(1, SEED_TOKENS - 1)).distinct().collect()]
    met = docs.select("key", "text").mapInArrow(_candidates(_bitmap(seeds), _masks(short)), "key binary, hash long, place int")
    hits = met.join(shared_if_small(seeds, BROADCAST_SEEDS), "hash").select("key", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    hits = written(hits, "leak-hits").join(items.select("item_id", "tokens"), "item_id")
    hits = written(hits.groupBy("key").agg(F.collect_list(F.struct("item_id", "diagonal", "tokens")).alias("hits")), "leak-texts")
    return hits, sifted(docs, "key", sieve(hits, "key"))[0]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_token, item_token, n_tokens, n_equal: the largest overlap of each document and item that share one.

    Null and empty texts and items without tokens have none; an item under SEED_TOKENS tokens overlaps where all of it
    stands. Equal item texts are one, as the smallest item_id. Repeated rows report each; ties between places take the
    first. An empty table on either side: no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    hits, met = _matches(rows, benchmark)
    return met.join(hits, "key").select("doc_id", "text", "hits").mapInArrow(_compared, OVERLAP_SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap an item of SEED_TOKENS tokens at least: shorter ones are no evidence. All columns as they are."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    rows = keyed(docs.select("text", F.lit(None).cast("long").alias("doc_id"), F.struct(*names).alias("__row")))  # clashing names stay apart
    hits, met = _matches(rows, benchmark)
    # A text is compared once, whatever the number of its copies: its key tells it.
    one = met.select("key", "text").dropDuplicates(["key"]).join(hits, "key")

    def leaking(batches):
        for batch in batches:
            keep = [any(f["n_tokens"] >= SEED_TOKENS for r in _compared([pa.RecordBatch.from_arrays([pa.array([0]), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1)], ["doc_id", "text", "hits"])]) for f in r.to_pylist()) for k in range(len(batch))]
            yield batch.select([0]).filter(pa.array(keep, pa.bool_()))

    leaks = written(one.select("key", "text", "hits").mapInArrow(leaking, "key binary"), "leaks")
    maybe, clean = sifted(rows, "key", sieve(leaks, "key"))
    kept = maybe.join(leaks, "key", "left_anti").select("__row").union(clean.select("__row"))
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])

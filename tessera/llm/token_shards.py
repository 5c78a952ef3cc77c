"""Binary token-id shards and a minimal perfect hash index over document keys.

Shard file: 16 bytes header (magic "TSHARD1\\0", id width as uint32, zero), the ids of its documents back to back
(little-endian, 2 bytes where the vocabulary allows it, else 4), then the footer: the document bounds as uint64
(one more than documents), the number of documents and the footer's own magic.

Index file, one for each bucket of keys: a minimal perfect hash (levels of bit arrays, a key stays at the first level
where it is alone; each block of 512 bits has a stored rank, the number of keys before it) and, at the slot of each key,
a 32-bit fingerprint and the key's place (shard, first document in it, number of documents with the key). A lookup reads
a 64-byte block and its rank for each level tried (under two on average), one entry, and one range of the shard, whatever
the number of keys.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import cached_bpe
from .kernels import mix
from .storage import bounded_batches, fresh_path, open_fs, put_atomic, shared_if_small, written

MAGIC, END_MAGIC, INDEX_MAGIC = b"TSHARD1\0", b"TSHEND1\0", b"TSINDX1\0"
#: Keys per index bucket, about; a bucket is built and searched in one task.
BUCKET_KEYS = 50_000
LEVELS = 48
#: Bits of a rank block, in words of 64.
BLOCK_WORDS = 8
#: Shards whose starts are broadcast at most (16 bytes each); joined by a shuffle beyond.
BROADCAST_SHARDS = 500_000
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("copies", "<u4")])


# -- shard files -------------------------------------------------------------------------------------------------
def write_shard(uri: str, parts, width: int) -> None:
    """``parts`` yields (ids, tokens per document) arrays; one pass, nothing is held but the bounds."""

    def put(out):
        out.write(MAGIC + struct.pack("<II", width, 0))
        bounds, total = [np.zeros(1, np.uint64)], 0
        for ids, counts in parts:
            out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
            ends = total + np.cumsum(counts)
            bounds.append(ends.astype(np.uint64))
            total = int(ends[-1]) if len(ends) else total
        bounds = np.concatenate(bounds)
        out.write(bounds.astype("<u8").tobytes() + struct.pack("<Q", len(bounds) - 1) + END_MAGIC)

    put_atomic(uri, put)


class ShardReader:
    """Random access to the documents of one shard file by range reads."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(16, 0), self.file.read_at(16, size - 16)
        if head[:8] != MAGIC or tail[8:] != END_MAGIC:
            raise ValueError(f"{uri} is no whole token shard")
        self.width = struct.unpack("<I", head[8:12])[0]
        n = struct.unpack("<Q", tail[:8])[0]
        self.bounds = np.frombuffer(self.file.read_at(8 * (n + 1), size - 16 - 8 * (n + 1)), "<u8").astype(np.int64)

    def documents(self, first: int, end: int) -> np.ndarray:
        """Ids of documents first..end-1, joined, as uint32."""
        a, b = int(self.bounds[first]), int(self.bounds[end])
        raw = self.file.read_at((b - a) * self.width, 16 + a * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def close(self):
        self.file.close()


def shard_uri(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.ids"


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the shards in ascending doc_id order (nulls first, ties by text); returns the manifest doc_id, shard, ordinal, n_tokens.

    One range shuffle by doc_id; shards follow its partitions, which follow the session's shuffle sizes.
    """

    def run(batches):
        from pyspark import TaskContext

        shard, bpe = TaskContext.get().partitionId(), cached_bpe(tokenizer)
        width = 2 if max(bpe.size, end_id + 1) <= 1 << 16 else 4
        keys, counts_all = [], []

        def parts():
            for batch in batches:
                keys.append(batch.column(0))
                for _, _, counts, ids in bpe.encode_column(batch.column(1)):
                    ends = np.cumsum(counts)
                    counts_all.append(counts + 1)
                    yield np.insert(ids, ends, end_id), counts + 1

        source = parts()
        head = next(source, None)
        if head is None:
            return
        write_shard(shard_uri(path, shard), (p for part in ([head], source) for p in part), width)
        counts = np.concatenate(counts_all)
        done = 0
        for key in keys:
            n = len(key)
            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(done, done + n)), pa.array(counts[done : done + n])], ["doc_id", "shard", "ordinal", "n_tokens"])
            done += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "doc_id long, shard int, ordinal long, n_tokens long"), "token-manifest")


# -- minimal perfect hash ----------------------------------------------------------------------------------------
def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def build_mphf(hashes: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (as bool) of the levels; distinct 64-bit hashes only."""
    levels, rest = [], hashes
    while len(rest):
        if len(levels) == LEVELS:
            raise ValueError("hashes repeat")
        size = max(64, 2 * len(rest))
        at = _slots(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


def ranked(levels: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bits of the level, its bits in words, keys before each block of BLOCK_WORDS words, those of earlier levels included)."""
    out, base = [], 0
    for bits in levels:
        blocks = -(-len(bits) // (64 * BLOCK_WORDS))
        words = np.packbits(np.pad(bits, (0, blocks * 64 * BLOCK_WORDS - len(bits))), bitorder="little").view("<u8")
        ends = np.cumsum(np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(1, dtype=np.int64))
        out.append((len(bits), words, (base + ends - np.diff(ends, prepend=0)).astype("<u4")))
        base += int(ends[-1])
    return out


def mphf_slots(levels: list[tuple[int, np.ndarray, np.ndarray]], hashes: np.ndarray) -> np.ndarray:
    """Slot of each hash in 0..n-1 by the ``ranked`` levels; -1 for one that no level holds."""
    out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
    for k, (size, words, ranks) in enumerate(levels):
        at = _slots(hashes[todo], k, size)
        hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        mine = at[hit]
        block = mine // (64 * BLOCK_WORDS)
        inside = words.reshape(-1, BLOCK_WORDS)[block]
        # Of the block, the bits before the key's own: whole words, and the low part of its word.
        word = (mine >> 6) % BLOCK_WORDS
        place = np.arange(BLOCK_WORDS)
        low = (np.uint64(1) << (mine & 63).astype(np.uint64)) - np.uint64(1)
        mask = np.where(place < word[:, None], ~np.uint64(0), np.where(place == word[:, None], low[:, None], np.uint64(0)))
        out[todo[hit]] = ranks[block].astype(np.int64) + np.bitwise_count(inside & mask).sum(1, dtype=np.int64)
        todo = todo[~hit]
        if not len(todo):
            break
    return out


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0xA0761D6478BD642F))


def index_uri(path: str, bucket: int) -> str:
    return f"{path}/index-{bucket:08d}.mph"


class IndexFile:
    """One bucket's index by range reads; the head (sizes of the levels) is read once."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(16, 0)
        if head[:8] != INDEX_MAGIC:
            raise ValueError(f"{uri} is no index")
        sizes = np.frombuffer(self.file.read_at(8 * struct.unpack("<Q", head[8:])[0], 16), "<u8").astype(int).tolist()
        at, self.levels = 16 + 8 * len(sizes), []
        for size in sizes:
            blocks = -(-size // (64 * BLOCK_WORDS))
            self.levels.append((size, at, at + 8 * BLOCK_WORDS * blocks, blocks))
            at += (8 * BLOCK_WORDS + 4) * blocks
        self.entries_at, self.entries = at, (self.file.size() - at) // ENTRY.itemsize

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of many keys are held, their entries): the levels are read whole, once."""
        h = key_hash(keys)
        read = lambda at, n, kind: np.frombuffer(self.file.read_at(n, at), kind)
        levels = [(size, read(words, 8 * BLOCK_WORDS * blocks, "<u8"), read(ranks, 4 * blocks, "<u4")) for size, words, ranks, blocks in self.levels]
        entries = read(self.entries_at, ENTRY.itemsize * self.entries, ENTRY)
        slot = mphf_slots(levels, h)
        ok = slot >= 0
        ok[ok] = entries["fingerprint"][slot[ok]] == (h[ok] >> np.uint64(32)).astype(np.uint32)
        return ok, entries[slot[ok]]

    def get(self, key: int):
        """The entry of one key, or None: reads a block and a rank for each level tried, and one entry."""
        h = key_hash(np.array([key], np.int64))
        for k, (size, words, ranks, _) in enumerate(self.levels):
            at = int(_slots(h, k, size)[0])
            block, inside = divmod(at, 64 * BLOCK_WORDS)
            bits = int.from_bytes(self.file.read_at(8 * BLOCK_WORDS, words + 8 * BLOCK_WORDS * block), "little")
            if bits >> inside & 1:
                slot = struct.unpack("<I", self.file.read_at(4, ranks + 4 * block))[0] + (bits & (1 << inside) - 1).bit_count()
                entry = np.frombuffer(self.file.read_at(ENTRY.itemsize, self.entries_at + ENTRY.itemsize * slot), ENTRY)[0]
                return entry if entry["fingerprint"] == int(h[0] >> np.uint64(32)) else None
        return None

    def close(self):
        self.file.close()


def build_index(manifest: DataFrame, path: str) -> int:
    """Write an index file beside the shards for each bucket of distinct non-null keys; returns the number of buckets.

    Documents with a null key are in no index.
    """
    keyed = manifest.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("shard", "ordinal")).alias("at"), F.count(F.lit(1)).alias("copies"))
    keyed = keyed.select("doc_id", "at.shard", "at.ordinal", "copies")
    buckets = max(1, -(-manifest.count() // BUCKET_KEYS))

    def build(pdf):
        import pandas as pd

        h = key_hash(pdf.doc_id.to_numpy())
        levels = ranked(build_mphf(h))
        entries = np.zeros(len(pdf), ENTRY)
        slot = mphf_slots(levels, h)
        entries["fingerprint"][slot] = (h >> np.uint64(32)).astype(np.uint32)
        for name, column in (("shard", "shard"), ("first", "ordinal"), ("copies", "copies")):
            entries[name][slot] = pdf[column].to_numpy()
        bucket = int(pdf.bucket.iloc[0])
        parts = [INDEX_MAGIC, struct.pack("<Q", len(levels)), np.array([n for n, _, _ in levels], "<u8").tobytes()]
        parts += [x.tobytes() for _, words, ranks in levels for x in (words, ranks)] + [entries.tobytes()]
        put_atomic(index_uri(path, bucket), lambda out: [out.write(x) for x in parts])
        return pd.DataFrame({"bucket": [bucket]})

    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    written(keyed.groupBy("bucket").applyInPandas(build, "bucket long"), "token-index")
    return buckets


def lookup(path: str, buckets: int, keys: DataFrame) -> DataFrame:
    """doc_id, shard, first, copies of each distinct key of ``keys`` (doc_id) that the index holds; a fingerprint mismatch drops a key."""

    def find(pdf):
        import pandas as pd

        try:
            index = IndexFile(index_uri(path, int(pdf.bucket.iloc[0])))
        except FileNotFoundError:  # a bucket without keys
            return pd.DataFrame({"doc_id": [], "shard": [], "first": [], "copies": []})
        ok, e = index.find(pdf.doc_id.to_numpy())
        index.close()
        return pd.DataFrame({"doc_id": pdf.doc_id.to_numpy()[ok], "shard": e["shard"].astype(np.int32), "first": e["first"].astype(np.int64), "copies": e["copies"].astype(np.int64)})

    asked = keys.select("doc_id").where("doc_id is not null").distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    return asked.groupBy("bucket").applyInPandas(find, "doc_id long, shard int, first long, copies long")


def read_documents(path: str, found: DataFrame, shard_starts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``lookup`` found, by range reads of the shard files."""

    def read(pdf):
        import pandas as pd

        reader = ShardReader(shard_uri(path, int(pdf.shard.iloc[0])))
        base, out = int(pdf.shard_start.iloc[0]), []
        pdf = pdf.sort_values("first")
        for key, first, copies in zip(pdf.doc_id.tolist(), pdf["first"].tolist(), pdf["copies"].tolist(), strict=True):
            for k in range(first, first + copies):
                ids = reader.documents(k, k + 1)
                out.append((key, base + int(reader.bounds[k]), len(ids), zlib.crc32(ids)))
        reader.close()
        return pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = found.join(shared_if_small(shard_starts, BROADCAST_SHARDS), "shard")
    return placed.groupBy("shard").applyInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_starts(path: str, shards: DataFrame) -> DataFrame:
    """shard, shard_start of ``shards`` (shard): the tokens of all shards before, from the files' footers. One row for each file."""

    def read(batches):
        for batch in batches:
            totals = []
            for shard in batch.column(0).to_pylist():
                reader = ShardReader(shard_uri(path, shard))
                totals.append(int(reader.bounds[-1]))
                reader.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], ["shard", "n"])

    totals = written(shards.select("shard").distinct().mapInArrow(read, "shard int, n long"), "token-totals")
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    return written(totals.select("shard", before.alias("shard_start")), "token-starts")


def token_shards_roundtrip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write shards and index, then look every key up and read it back: doc_id, start, n_tokens, ids_crc32.

    Null or empty text: only the end id. Repeated ids: one row for each copy, in text order. A null doc_id is written
    and counted in ``start`` but has no key, so it is not returned.
    """
    bounded_batches(docs.sparkSession)
    path = fresh_path(docs.sparkSession, "token-shards")
    manifest = write_token_shards(docs, path, tokenizer, end_id)
    found = lookup(path, build_index(manifest, path), manifest)
    return read_documents(path, found, shard_starts(path, manifest))

"""Token counts with a digest cache.

Counts are stored under (content digest, tokenizer digest). Known texts are joined to the cache; only the
distinct misses are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import cached_bpe, vocabulary_path
from .storage import bounded_batches, fresh_path, written

#: Digests that occur repeatedly or are cached: broadcast up to this many (about 100 bytes each), joined by a shuffle beyond.
BROADCAST_DIGESTS = 200_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: another version of the file never meets the old counts."""
    with open(vocabulary_path(path), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(path: str):
    def run(batches):
        bpe = cached_bpe(path)
        for batch in batches:
            for lo, hi, counts, _ in bpe.encode_column(batch.column(1), want_ids=False):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts)], ["content_digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty text: 0 tokens. Repeated rows and repeated ids are kept, one result row each. Content is
    normalised only by null to empty: the tokenizer distinguishes everything else. Texts of equal digest are
    encoded once, as the row with their smallest doc_id. ``cache_path`` is a Parquet folder (made if missing,
    appended to); None uses a new one in shared storage.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache_path = cache_path or fresh_path(spark, "token-count-cache")
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("content_digest"), text.alias("text"))
    keys = written(keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    # An empty append makes the folder and its schema, so the first run reads an empty cache.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    cached = cache.select("content_digest", F.lit(True).alias("cached")).dropDuplicates(["content_digest"])
    seen = keys.groupBy("content_digest").agg(F.min("doc_id").alias("as_id"), F.count(F.lit(1)).alias("copies"))
    special = written(seen.join(cached, "content_digest", "left").where("cached or copies > 1").select("content_digest", "as_id", F.coalesce("cached", F.lit(False)).alias("cached"), F.lit(True).alias("listed")), "token-special")
    n = special.count()
    if n:
        tagged = keyed.join(F.broadcast(special) if n <= BROADCAST_DIGESTS else special, "content_digest", "left")
        keyed = tagged.where("listed is null or (not cached and doc_id <=> as_id)")
    fresh = keyed.select("content_digest", "text").mapInArrow(_encoder(tokenizer), "content_digest binary, n_tokens long")
    fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").option("compression", "zstd").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    stored = stored.groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens"))
    return keys.join(stored, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""The corpus pipeline: stages over ``documents``, each through its operator.

Every stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, near_dup, packing, repeats, toxicity
from tessera.llm.storage import written

TOKENIZER, END_ID, WINDOW = "byte_bpe_50k.json", 1, 2048
#: Word shingles and percent of the near-duplicate stage.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Bytes of a repeated passage: one of over fifty words is longer.
REPEAT_BYTES = 200


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: c if c in ("doc_id", "text") else f"__{k}" for k, c in enumerate(docs.columns)}  # clashing names stay apart
    scored = toxicity.score(docs.toDF(*own.values()), model, list(own.values()))
    return scored.where("predicted = 0").select(*[F.col(v).alias(c) for c, v in own.items()])


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id; of rows that repeat an id one."""
    verdict = near_dup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    rejected = written(verdict.where("not kept").select("doc_id").distinct(), "pipeline-rejected")
    return docs.join(near_dup.shared_if_small(rejected, near_dup.BROADCAST_IDS), "doc_id", "left_anti").select(docs.columns)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat anywhere are cut out of the texts; documents keep their rows."""
    return repeats.without_repeats(docs, REPEAT_BYTES).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER, END_ID, WINDOW)


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("repeats", _repeats),
    ("decontamination", _decontaminate),
    ("packing", _pack),
]
#: Trained scores, similarity components and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs

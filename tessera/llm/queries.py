"""The contract queries over these operators: thin, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracles import OP9, OP10

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import flac_roundtrip

    return flac_roundtrip(_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import token_shards_roundtrip

    return token_shards_roundtrip(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"), length=400, kept_text=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_roundtrip

    return warc_roundtrip(_table(spark, sf_dir, "pages"), revisit_from=0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {
    "op1_flac": op1_flac,
    "op2_html_text": op2_html_text,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_token_shards": op6_token_shards,
    "op7_repeats": op7_repeats,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_near_duplicates": op10_near_duplicates,
}
ORACLES: dict[str, str] = {"op9_warc": OP9, "op10_near_duplicates": OP10}

"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), width=400, shared_width=256)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digests, store

    return digests(store(table(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    found = pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ranks=tokenizer("byte_bpe_50k.tiktoken"))
    return pack(found)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import remove_passages

    out = remove_passages(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2(F.encode("kept", "UTF-8"), 256)).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_suffix_dedup, op3_bpe_round_trip, op4_html_text, op5_toxicity, op6_fingerprints, op7_near_duplicates, op8_media_columns, op9_best_fit_packing, op10_passage_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}

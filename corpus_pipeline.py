"""A training-data pipeline over documents: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) with the columns of documents and returns what the next stage reads; the last returns packed
pieces. Texts that a stage shortens get their length anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.llm.common import staged, table
from seriate.llm.near_duplicates import near_duplicates
from seriate.llm.packing import pack, pieces
from seriate.llm.passages import remove_passages
from seriate.llm.queries import tokenizer
from seriate.llm.toxicity import fit

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half. The model is fitted on labelled rows of these documents."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle near duplicates: the one with the least id."""
    found = staged(near_duplicates(docs, n=5, percent=80), "near-duplicates")
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    out = docs.join(kept.select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*COLUMNS)
    # Equal rows are copies of which one stays; where no id repeats, no shuffle is spent on them.
    return out if kept.where("n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has."""
    out = remove_passages(docs, keep=["lang", "source"])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 tokens."""
    return pack(pieces(docs, tokenizer("byte_bpe_50k.json"), ranks=tokenizer("byte_bpe_50k.tiktoken")))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("passages", drop_repeated_passages), ("packing", pack_sequences)]

#: No stage is expressible in SQL; tests hold the operators against plain versions, and the stages on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

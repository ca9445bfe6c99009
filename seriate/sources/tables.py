"""Readers and writers of tables that sequences are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns that are a unique order of the test tables.
ORDERS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, source: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(source).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, source: str = "parquet", mode: str = "error", by: list[str] = ()) -> None:
    writer = df.write.format(source).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)

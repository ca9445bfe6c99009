"""The sequence operators that make sense on unbounded input, by key and under a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(df: DataFrame, key: str, time: str, gap: str, late: str, *aggregates) -> DataFrame:
    """Runs of a key's rows without a pause longer than ``gap``, closed when the watermark passes them."""
    own = aggregates or (F.count(F.lit(1)).alias("n"),)
    out = df.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("_session")).agg(*own)
    return out.select(key, F.col("_session.start").alias("start"), F.col("_session.end").alias("end"), *[c for c in out.columns if c not in (key, "_session")])


def distinct(df: DataFrame, columns: list[str], time: str, late: str) -> DataFrame:
    """The first row of each value within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(columns)


def prefix_sum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running sums of each key, kept as state between batches; rows of one batch are taken in their order."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order, value)}

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(order)
        rows["prefix"] = rows[value].cumsum() + total
        state.update((float(rows["prefix"].iloc[-1]),))
        yield rows[[key, order, value, "prefix"]]

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, prefix double"
    return df.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "total double", "append", GroupStateTimeout.NoTimeout)

"""Helpers that the operators of this subpackage share: tables, staging, text buffers, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers take at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that are handed to a Python worker at once where rows hold whole texts.
TEXT_ROWS = 1000


def texts_of(df: DataFrame, *columns) -> DataFrame:
    """Select columns for a Python operator over whole texts, and have its session hand over few rows at once.

    With the usual 10,000 rows a batch, workers and the engine's buffers beside them hold hundreds of MB of text.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df.select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (single-machine sessions, tests) a temporary folder is chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="seriate-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a table below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seriate/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key is heavy above this number of rows and above this share of all, so that at most as many keys as its inverse are.
HEAVY_ROWS, HEAVY_SHARE = 10_000, 0.001


def join_heavy(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """Join rows to one row for each key, of which column ``n`` counts the rows; a key with very many of them fills no task.

    Heavy keys are at most 1 / HEAVY_SHARE, whatever the size of the data: those are broadcast. The others are joined by a shuffle.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    heavy = F.col(n) > max(HEAVY_ROWS, HEAVY_SHARE * total)
    few = keyed.where(heavy)
    if few.isEmpty():
        return rows.join(keyed, key)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(keyed.where(~heavy), key)
    return light.unionByName(rows.join(F.broadcast(few), key))


#: Bits of the filter below: 4 MB, whatever the size of the data.
FILTER_BITS = 1 << 25


def rows_with(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of df whose keys stand in ``wanted``, and a few more: a filter before a join that would otherwise shuffle every text.

    The filter is one bit for each hash of the keys in a bitmap of FILTER_BITS bits. With very many keys it lets everything pass; the join
    behind it decides.
    """
    spark = df.sparkSession
    bit = lambda d: F.pmod(F.xxhash64(*(d[k] for k in keys)), F.lit(FILTER_BITS))
    rows = wanted.select((bit(wanted) + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in rows:  # at most FILTER_BITS / 32768 rows of 4 KB
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        bits[(row["n"] - 1) * 4096 : (row["n"] - 1) * 4096 + len(own)] = own
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        table = shared.value
        for batch in batches:
            b = batch.column(batch.num_columns - 1).to_numpy()
            hit = table[b >> 3] >> (b & 7).astype(np.uint8) & 1
            if hit.any():
                yield batch.drop_columns(["_bit"]).filter(pa.array(hit.astype(bool)))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.withColumn("_bit", bit(df)).mapInArrow(run, schema)


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null texts are empty, offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            one = np.full(size, base, dtype=np.uint64)
            one[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(one))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash, row) of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64), empty
    inside = ~_WHITE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    power, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, hashes, rows


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of every run of n words within a row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size]
    whole = np.flatnonzero(rows[:size] == rows[n - 1 :])
    return mix(out[whole]), rows[whole], whole

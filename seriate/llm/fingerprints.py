"""Operator 6: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A sample of a weighted set takes, for each term, two gamma variates r and c and a uniform b from hashes of the term: with
t = floor(ln(w) / r + b), the term's value is ln(c) - r * (t - b + 1), and the sample is (term, t) of the least value. Two sets agree in
a sample with a probability equal to their generalised Jaccard similarity, the sum of minimum weights over that of maximum weights.

Texts are shuffled once, by ranges of falling id, so that a document's successor is the next row; the first row of each range goes to the
range before it, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Samples of a fingerprint: rows are spread over CHUNKS, each with PER samples, which keeps the generated code small.
CHUNKS, PER = 8, 8
SAMPLES = CHUNKS * PER
#: Ranges of ids, and tasks, for each shuffle partition: a task holds all terms of its texts in hash tables, which small tasks keep small.
RANGES_PER_PARTITION = 4

_HALF, _UNIT = (1 << 31) - 1, (1 << 25) - 1
#: ln(2) for the scale of a product of two 25-bit uniforms.
_SCALE = 50 * 0.6931471805599453


def _seed(k: int) -> int:
    """Well-spread signed 64-bit numbers, one for each hash function."""
    return ((k + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)


def _uniform(h: Column, shift: int) -> Column:
    """25 bits of a hash, as a number in (0, 2**25)."""
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_UNIT)) + F.lit(0.5)


def sample_keys(term: Column, log_weight: Column, number: int) -> Column:
    """A long whose minimum over a set's terms is its sample: the value in the upper bits, term and t in the lower 31.

    ``term`` is a hash of the term and of the chunk, ``log_weight`` null where the set lacks the term.
    """
    one, two = (F.xxhash64(term.bitwiseXOR(F.lit(_seed(2 * number + k)))) for k in range(2))
    r = F.lit(_SCALE) - F.log(_uniform(one, 0) * _uniform(one, 25))
    c = F.lit(_SCALE) - F.log(_uniform(two, 0) * _uniform(two, 25))
    # The 14 upper bits of both hashes, which nothing else reads.
    b = (F.shiftrightunsigned(one, 50).bitwiseOR(F.shiftleft(F.shiftrightunsigned(two, 50), 14)) + F.lit(0.5)) * F.lit(1.0 / (1 << 28))
    t = F.floor(log_weight / r + b)
    value = F.log(c) - r * (t - b + F.lit(1.0))
    # Values lie well within -128 .. 128 (r is below 36), so 31 bits keep their order to 1e-7.
    high = F.floor((value + F.lit(128.0)) * F.lit(float(1 << 23)))
    low = one.bitwiseXOR(F.shiftrightunsigned(two, 29)).bitwiseXOR(F.shiftleft(t, 3)).bitwiseAND(F.lit(_HALF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, cut at ASCII white space; empty strings at its ends, or for a text without words."""
    return F.split(F.lower(text), "[ \\t-\\r]+")


def weighted_samples(texts: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """The samples, as array<int>, of one or more text columns of each row.

    Rows must be told apart by their keys, and be partitioned by one of them if no shuffle is wanted. A text without words gives null.
    """
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(s).alias("text")) for k, s in enumerate(sides))))
    words = texts.select(*keys, parts.alias("part_")).select(*keys, "part_.side", F.explode(words_of(F.col("part_.text"))).alias("word"))
    # The side of an empty word is none, so that every row keeps its place.
    words = words.select(*keys, F.when(F.col("word") == "", -1).otherwise(F.col("side")).alias("side"), F.xxhash64("word").alias("h"))
    weights = [F.sum(F.when(F.col("side") == k, 1)).alias(f"w{k}") for k in range(len(sides))]
    terms = words.groupBy(*keys, "h").agg(*weights)
    logs = [f"l{k}" for k in range(len(sides))]
    terms = terms.select(*keys, "h", *(F.log(F.col(f"w{k}")).alias(f"l{k}") for k in range(len(sides))))
    spread = terms.select(*keys, *logs, "h", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))).alias("chunk"))
    spread = spread.select(*keys, "chunk", *logs, F.xxhash64("h", "chunk").alias("term"))
    least = [F.min(sample_keys(F.col("term"), F.col(f"l{k}"), j)).alias(f"s{k}_{j}") for k in range(len(sides)) for j in range(PER)]
    chunks = spread.groupBy(*keys, "chunk").agg(*least)
    lists = [F.collect_list(F.struct("chunk", F.array(*(F.col(f"s{k}_{j}") for j in range(PER))).alias("own"))).alias(s) for k, s in enumerate(sides)]
    low = lambda x: x.bitwiseAND(F.lit(_HALF)).cast("int")
    out = chunks.groupBy(*keys).agg(*lists)
    samples = lambda s: F.transform(F.flatten(F.transform(F.array_sort(F.col(s)), lambda x: x["own"])), low)
    return out.select(*keys, *(F.when(samples(s)[0].isNotNull(), samples(s)).alias(s) for s in sides))


def likeness(x: Column, y: Column) -> Column:
    """The share of equal samples; 1 if both texts lack words, 0 if one does."""
    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e)) / F.lit(float(SAMPLES))
    return F.when(x.isNull() & y.isNull(), 1.0).when(x.isNull() | y.isNull(), 0.0).otherwise(same).cast("double")


def as_string(x: Column) -> Column:
    """A fingerprint as hexadecimal digits, eight for each sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(x, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), ""), F.lit(""))


def range_heads(ids: DataFrame, ranges: int) -> list:
    """The first (id, th) of each range of rows by falling order, as many as ``ranges`` at most: what the driver gets of the order."""
    dealt = ids.select(F.struct("id", "th").alias("o")).repartitionByRange(ranges, F.col("o").desc())
    heads = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max("o").alias("head")).orderBy("p")
    return [row["head"] for row in heads.collect()]


def range_of(o: Column, heads: Column, n: int) -> Column:
    """The number of the range that a row (id, th) falls into, found in blocks of about the root of their number."""
    size = max(1, int(n**0.5))
    firsts = F.transform(F.sequence(F.lit(1), F.lit(n), F.lit(size)), lambda i: F.element_at(heads, i.cast("int")))
    block = F.size(F.filter(firsts, lambda h: h >= o)) - 1
    return (block * size + F.size(F.filter(F.slice(heads, block * size + 1, F.lit(size)), lambda h: h >= o)) - 1).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(part, own, ghost, id, text, next) of documents (id, th, text): each with the text of the next one by falling (id, th).

    A row with ``ghost`` stands for the first row of the following range, and gives nothing but its text; after the last comes the first.
    """
    spark = docs.sparkSession
    ids = staged(docs.select("id", "th"), "ids")
    heads = range_heads(ids, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = len(heads)
    if not n:
        return docs.select(F.lit(0).alias("part"), F.lit(0).alias("own"), F.lit(False).alias("ghost"), "id", "text", F.col("text").alias("next"))
    # One row: the heads of all ranges.
    schema = docs.select(F.array(F.struct("id", "th")).alias("heads")).schema
    dealt = docs.join(F.broadcast(spark.createDataFrame([([tuple(h) for h in heads],)], schema)))
    o = F.struct("id", "th")
    dealt = dealt.withColumn("part", range_of(o, F.col("heads"), n)).withColumn("leads", F.element_at("heads", F.col("part") + 1) == o).drop("heads")
    here, before = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.struct(F.pmod(F.col("part") - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("ghost"))
    dealt = dealt.select("id", "th", "text", F.explode(F.when(F.col("leads"), F.array(here, before)).otherwise(F.array(here))).alias("to")).select("id", "th", "text", "to.*")
    dealt = dealt.repartition(n, "part")
    order = Window.partitionBy("part").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("th").desc())
    return dealt.select("part", F.row_number().over(order).alias("own"), "ghost", "id", "text", F.lead("text").over(order).alias("next"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A text's edited form has its last floor(n / 2) code points replaced by the first as many, or all, of the next document by falling
    id; after the last comes the first, and a single document is its own next. A null text counts as empty. Rows with one id are ordered
    by a hash of their texts; equal rows count as one document here and give equal results. A null id comes last. Extra columns are
    ignored.
    """
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    times = staged(docs.groupBy("id", "th").agg(F.count("*").alias("times")).where("times > 1"), "times")
    repeated = not times.isEmpty()
    rows = with_next(docs.dropDuplicates(["id", "th"]) if repeated else docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.when(~F.col("ghost"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    rows = rows.withColumn("edited", edited)
    samples = weighted_samples(rows, ["part", "own"], ["text", "edited"]).withColumnsRenamed({"text": "x", "edited": "y"})
    samples = samples.withColumn("z", F.lead("x").over(Window.partitionBy("part").orderBy("own")))
    # The same shuffled texts again: only their digests leave the task.
    digests = rows.where("not ghost").select("part", "own", "id", F.xxhash64("text").alias("th"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    out = digests.hint("merge").join(samples, ["part", "own"])
    if repeated:
        copies = out["id"].eqNullSafe(times["id"]) & (out["th"] == times["th"])
        out = out.join(times, copies, "left").select(out["*"], F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))).alias("_copy"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("x")).alias("fingerprint"), as_string(F.col("y")).alias("edited_fingerprint"),
        likeness(F.col("x"), F.col("y")).alias("near_edited"), likeness(F.col("x"), F.col("z")).alias("near_next"),
    )

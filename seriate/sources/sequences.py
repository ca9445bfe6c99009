"""Sources: sequences and pairs from values, ranges, texts, arrays, trees and generators."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import Pairs
from ..operators.seq import Seq


def of(spark: SparkSession, values: Iterable, kind: str) -> Seq:
    """A sequence of given values, of a type named as in SQL; an empty one has no rows."""
    rows = [(k, v) for k, v in enumerate(values)]
    return Seq(spark.createDataFrame(rows, f"_pos bigint, value {kind}"))


def empty(spark: SparkSession, kind: str) -> Seq:
    return of(spark, [], kind)


def of_nullable(spark: SparkSession, value, kind: str) -> Seq:
    """One value, or none if it is null."""
    return of(spark, [] if value is None else [value], kind)


def of_slice(spark: SparkSession, values: list, start: int, stop: int, kind: str) -> Seq:
    """A part of a list, with checked bounds."""
    if not 0 <= start <= stop <= len(values):
        raise IndexError(f"{start}..{stop} is not within 0..{len(values)}")
    return of(spark, values[start:stop], kind)


def of_map(spark: SparkSession, mapping: dict, key: str, value: str) -> Pairs:
    return Pairs(spark.createDataFrame([(k, *e) for k, e in enumerate(mapping.items())], f"_pos bigint, key {key}, value {value}"))


def of_pairs(spark: SparkSession, pairs: Iterable[tuple], key: str, value: str) -> Pairs:
    return Pairs(spark.createDataFrame([(k, *e) for k, e in enumerate(pairs)], f"_pos bigint, key {key}, value {value}"))


def of_list(spark: SparkSession, values: list, kind: str) -> Pairs:
    """(index, element) of a list."""
    return of_pairs(spark, enumerate(values), "int", kind)


def of_frame(df: DataFrame, value: str, order: list[str] | str, by: list[str] | str = ()) -> Seq:
    return Seq(df, value, order, by)


def of_array(df: DataFrame, array: str, by: list[str]) -> Seq:
    """The elements of an array column, one sequence for each row, which ``by`` names."""
    return Seq(df.select(*by, F.posexplode(array).alias("_pos", "value")), by=by)


def of_indices(df: DataFrame, array: str, by: list[str], p: Callable[[Column], Column] | None = None) -> Seq:
    """The positions of an array's elements, of those that satisfy p."""
    seq = of_array(df, array, by)
    seq = seq if p is None else seq.filter(p)
    return Seq(seq.df.withColumn("value", F.col("_pos")), by=by)


def range_(spark: SparkSession, start: int, stop: int, step: int = 1, closed: bool = False) -> Seq:
    """Numbers from start to stop, which is left out unless closed. The wrong direction gives none, a step of 0 is an error."""
    if step == 0:
        raise ValueError("a step of 0")
    rows = spark.range(start, stop + (1 if step > 0 else -1) * closed, step).withColumnRenamed("id", "value")
    return Seq(rows.withColumn("_pos", F.col("value") if step > 0 else -F.col("value")))


def ints(spark: SparkSession) -> Seq:
    return range_(spark, 0, 2**31 - 1).map_to_int()


def longs(spark: SparkSession, n: int) -> Seq:
    return range_(spark, 0, n)


def constant(spark: SparkSession, value, n: int) -> Seq:
    return Seq(spark.range(n).select(F.col("id").alias("_pos"), F.lit(value).alias("value")))


def generate(spark: SparkSession, n: int, f: Callable[[Column], Column]) -> Seq:
    """n values of an expression over the position."""
    return Seq(spark.range(n).select(F.col("id").alias("_pos"), f(F.col("id")).alias("value")))


def random(spark: SparkSession, n: int, seed: int, low: float = 0.0, high: float = 1.0, whole: bool = False) -> Seq:
    """Seeded random numbers from low (included) to high (left out)."""
    x = F.rand(seed) * (high - low) + low
    return generate(spark, n, lambda _: F.floor(x) if whole else x)


@F.udtf(returnType="_pos bigint, value bigint")
class _Emit:
    """Values of a named generator: kept as state, one row a value."""

    def eval(self, name: str, seed: int, most: int):
        for k, v in enumerate(itertools.islice(EMITTERS[name](seed), most)):
            yield k, v


def _collatz(x: int):
    while True:
        yield x
        if x == 1:
            return
        x = x // 2 if x % 2 == 0 else 3 * x + 1


def _fibonacci(_: int):
    a, b = 0, 1
    while True:
        yield a
        a, b = b, a + b


#: Generators by name; each takes a seed.
EMITTERS: dict[str, Callable] = {"collatz": _collatz, "fibonacci": _fibonacci}


def emit(name: str, seed: int, most: int) -> Seq:
    """Values of a registered generator, at most so many; it runs in one task."""
    return Seq(_Emit(F.lit(name), F.lit(seed), F.lit(most)))


def iterate(spark: SparkSession, seed, step: str, kind: str, while_: str | None = None, most: int = 1_000_000) -> Seq:
    """seed, f(seed), ... as a recursive query; ``step`` and ``while_`` are SQL expressions over ``value``, and null ends it, too."""
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(max(100, most + 1)))
    stop = f"{step} is not null" + (f" and ({while_.replace('value', '(' + step + ')')})" if while_ else "")
    first = f"cast({seed!r} as {kind})"
    start = f"select {first} as value, cast(0 as bigint) as _pos" + (f" where {while_.replace('value', first)}" if while_ else "")
    return Seq(spark.sql(f"with recursive t(value, _pos) as ({start} union all select cast({step} as {kind}), _pos + 1 from t where _pos + 1 < {most} and {stop}) select * from t"))


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Seq:
    """The lines of text files, ordered within each file, which ``by`` names."""
    if encoding.upper() == "UTF-8":
        rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    else:
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("text"))
    text = F.regexp_replace("text", "(\r\n|\n|\r)\\z", "")
    return Seq(rows.select("file", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_pos", "value")), by="file")


def file_bytes(spark: SparkSession, path: str) -> Seq:
    """The bytes (0 to 255) of files, ordered within each."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.hex("content").alias("hex"))
    own = rows.select("file", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("hex") / 2).cast("int") - 1), lambda k: F.conv(F.substring(F.col("hex"), 2 * k + 1, F.lit(2)), 16, 10).cast("int"))).alias("_pos", "value"))
    return Seq(own, by="file")


def split(df: DataFrame, text: str, pattern: str, by: list[str]) -> Seq:
    """The parts of texts between matches: leading empty parts stay, trailing ones go, and an empty text is one empty part."""
    parts = F.split(F.col(text), pattern)
    last = F.coalesce(F.array_max(F.filter(F.transform(parts, lambda p, k: F.when(p != "", k + 1)), lambda k: k.isNotNull())), F.lit(0))
    kept = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(F.slice(parts, 1, last))
    return Seq(df.select(*by, F.posexplode(kept).alias("_pos", "value")), by=by)


def code_points(df: DataFrame, text: str, by: list[str]) -> Seq:
    return Seq(df.select(*by, F.posexplode(F.transform(F.filter(F.split(F.col(text), ""), lambda c: c != ""), lambda c: F.ascii(c))).alias("_pos", "value")), by=by)


def chars(df: DataFrame, text: str, by: list[str]) -> Seq:
    """16-bit units: two for a code point beyond the basic plane."""
    points = code_points(df, text, by)
    high, low = lambda x: F.shiftright(x - 0x10000, 10) + 0xD800, lambda x: (x - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
    return points.flat_map(lambda x: F.when(x > 0xFFFF, F.array(high(x), low(x))).otherwise(F.array(x)))


def sub_lists(seq: Seq, length: int, shift: int | None = None) -> Seq:
    """Arrays of ``length`` neighbours, a new one every ``shift``; the last may be shorter, none starts where all rows are covered."""
    shift = shift or length
    if length < 1 or shift < 1:
        raise ValueError("length and shift are at least 1")
    rows = seq.positions("_i").df
    # A row is in the windows k with k * shift <= i < k * shift + length.
    low, high = F.greatest(F.lit(0), F.floor((F.col("_i") - length) / shift) + 1), F.floor(F.col("_i") / shift)
    spread = rows.where(low <= high).withColumn("_window", F.explode(F.sequence(low, high)))
    from ..functions.collectors import to_list
    from ..plans.order import join_keys

    out = spread.groupBy(*seq.by, "_window").agg(to_list(seq.x, F.col("_i")).alias(seq.value))
    n = rows.groupBy(*seq.by).agg(F.count(F.lit(1)).alias("_n"))
    out = join_keys(out, n, seq.by, null_safe=seq.by) if seq.by else out.crossJoin(n)
    covered = (F.col("_window") == 0) | ((F.col("_window") - 1) * shift + length < F.col("_n"))
    return Seq(out.where(covered).drop("_n"), seq.value, "_window", seq.by)


def combinations(spark: SparkSession, n: int, k: int) -> Seq:
    """All k-subsets of 0 .. n-1 as ascending arrays, in lexicographic order, by joining one element after another."""
    if k < 0 or n < 0:
        raise ValueError("n and k are at least 0")
    out = spark.range(1).select(F.array().cast("array<bigint>").alias("value"))
    for i in range(k):
        nxt = spark.range(n).withColumnRenamed("id", "_next")
        out = out.crossJoin(F.broadcast(nxt)).where((F.size("value") == 0) | (F.col("_next") > F.coalesce(F.get("value", F.lit(i - 1)), F.lit(-1)))).select(F.concat("value", F.array("_next")).alias("value"))
    return Seq(out.withColumn("_order", F.col("value")), order="_order")


def permutations(spark: SparkSession, n: int) -> Seq:
    """All orders of 0 .. n-1, lexicographically."""
    out = spark.range(1).select(F.array().cast("array<bigint>").alias("value"))
    for _ in range(n):
        nxt = spark.range(n).withColumnRenamed("id", "_next")
        out = out.crossJoin(F.broadcast(nxt)).where(~F.array_contains("value", F.col("_next"))).select(F.concat("value", F.array("_next")).alias("value"))
    return Seq(out.withColumn("_order", F.col("value")), order="_order")


def cartesian_product(spark: SparkSession, lists: list[list], kind: str) -> Seq:
    """All tuples with one element of each list, the last running fastest; no lists give one empty tuple."""
    out = spark.range(1).select(F.array().cast(f"array<{kind}>").alias("value"), F.array().cast("array<int>").alias("_order"))
    for own in lists:
        right = spark.createDataFrame(list(enumerate(own)), f"_k int, _x {kind}")
        out = out.crossJoin(F.broadcast(right)).select(F.concat("value", F.array("_x")).alias("value"), F.concat("_order", F.array("_k")).alias("_order"))
    return Seq(out, order="_order")


def cartesian_power(spark: SparkSession, n: int, values: list, kind: str) -> Seq:
    return cartesian_product(spark, [values] * n, kind)


def tree(edges: DataFrame, id_col: str, parent_col: str, child_order: str, keep: list[str] = (), most_depth: int = 1000) -> Seq:
    """The nodes of a forest (parent null: a root) in pre-order, with depth, by a join for each level.

    The order is the path of child orders from the root, as an array.
    """
    level = edges.where(F.col(parent_col).isNull()).select(id_col, *keep, F.lit(0).alias("depth"), F.array(F.col(child_order).cast("bigint")).alias("_path"))
    out = level
    for depth in range(1, most_depth + 1):
        above = level.select(F.col(id_col).alias("_above"), F.col("_path").alias("_upper"))
        level = edges.join(above, edges[parent_col] == F.col("_above")).select(edges[id_col], *(edges[c] for c in keep), F.lit(depth).alias("depth"), F.concat("_upper", F.array(edges[child_order].cast("bigint"))).alias("_path"))
        if depth % 8 == 0 and edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            level = level.checkpoint()
        if level.isEmpty():
            return Seq(out, id_col, "_path")
        out = out.unionByName(level)
    raise ValueError(f"a path is longer than {most_depth}, or a cycle")


def schema_of(kind: str) -> T.DataType:
    return T._parse_datatype_string(kind)

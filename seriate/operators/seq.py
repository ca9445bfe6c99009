"""Seq: a DataFrame with one value column and an explicit total order, alone or one sequence for each key.

Every operator returns a new Seq (or a DataFrame, where it ends the sequence) and only composes column expressions, windows, joins and
aggregations; functions that are passed in take and return columns.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collectors as C
from ..functions import numeric as N
from ..plans import order as O

Fn = Callable[..., Column]

POS = "_pos"


class Seq:
    """A sequence, or one sequence for each combination of the ``by`` columns.

    ``order`` names columns whose values, within a key, are a unique total order. Columns other than value, order and ``by`` are kept where an
    operator keeps rows.
    """

    def __init__(self, df: DataFrame, value: str = "value", order: list[str] | str = POS, by: list[str] | str = ()):
        self.df, self.value = df, value
        self.order = [order] if isinstance(order, str) else list(order)
        self.by = [by] if isinstance(by, str) else list(by)

    # -- plumbing

    @property
    def x(self) -> Column:
        return F.col(self.value)

    @property
    def _at(self) -> Column:
        """The order as one value."""
        return F.struct(*self.order)

    def _with(self, df: DataFrame, value: str | None = None, order: list[str] | None = None) -> Seq:
        return type(self)(df, value or self.value, order or self.order, self.by)

    def chain(self, fn: Callable):
        return fn(self)

    def ordered(self) -> DataFrame:
        """The rows in order."""
        return self.df.orderBy(*self.by, *(F.col(c).asc_nulls_first() for c in self.order))

    def check_order(self) -> Seq:
        """Raise if the order columns repeat within a key (a full pass over the data)."""
        if not self.df.groupBy(*self.by, *self.order).count().where("count > 1").isEmpty():
            raise ValueError(f"{self.order} is no total order")
        return self

    def positions(self, name: str = POS) -> Seq:
        """Replace the order by dense positions from 0."""
        return self._with(O.with_position(self.df.drop(name) if name not in self.order else self.df, self.by, self.order, name), order=[name])

    with_indices = positions

    # -- execution control: the engine decides how to run; these only name what a plan allows

    def parallel(self, partitions: int) -> Seq:
        return self._with(self.df.repartition(partitions, *self.by) if self.by else self.df.repartition(partitions))

    def sequential(self) -> Seq:
        return self

    def is_parallel(self) -> bool:
        return self.df.rdd.getNumPartitions() > 1

    def unordered(self) -> Seq:
        return self

    @contextmanager
    def closing(self, on_close: Callable[[], None]):
        """The sequence within a block, after which ``on_close`` runs."""
        try:
            yield self
        finally:
            on_close()

    def peek(self, name: str, *aggregates: Column) -> Seq:
        """Observe aggregates of all rows that pass here, under a name."""
        return self._with(self.df.observe(name, *(aggregates or (F.count(F.lit(1)).alias("n"),))))

    # -- filters

    def filter(self, p: Fn) -> Seq:
        return self._with(self.df.where(p(self.x)))

    def remove(self, p: Fn) -> Seq:
        return self._with(self.df.where(~F.coalesce(p(self.x), F.lit(False))))

    def filter_by(self, f: Fn, value) -> Seq:
        return self._with(self.df.where(f(self.x).eqNullSafe(F.lit(value))))

    def remove_by(self, f: Fn, value) -> Seq:
        return self._with(self.df.where(~f(self.x).eqNullSafe(F.lit(value))))

    def non_null(self) -> Seq:
        return self._with(self.df.where(self.x.isNotNull()))

    def without(self, *values) -> Seq:
        """Drop values; null may be one of them."""
        p = F.lit(False)
        for v in values:
            p = p | self.x.eqNullSafe(F.lit(v))
        return self._with(self.df.where(~p))

    def at_least(self, v) -> Seq:
        return self.filter(lambda x: (x >= F.lit(v)) & ~self._nan(x))

    def at_most(self, v) -> Seq:
        return self.filter(lambda x: x <= F.lit(v))

    def greater(self, v) -> Seq:
        return self.filter(lambda x: (x > F.lit(v)) & ~self._nan(x))

    def less(self, v) -> Seq:
        return self.filter(lambda x: x < F.lit(v))

    def _nan(self, x: Column) -> Column:
        return F.isnan(x) if dict(self.df.dtypes)[self.value] in ("double", "float") else F.lit(False)

    def select(self, tag: str, kind) -> Seq:
        """Values whose type tag, a column, is the given one."""
        return self.filter(lambda _: F.col(tag) == F.lit(kind))

    # -- projections

    def map(self, f: Fn) -> Seq:
        return self._with(self.df.withColumn(self.value, f(self.x)))

    def map_partial(self, f: Fn) -> Seq:
        """Map, and drop what maps to null."""
        return self.map(f).non_null()

    def map_to_int(self, f: Fn = lambda x: x) -> Seq:
        return self.map(lambda x: f(x).cast("int"))

    def map_to_long(self, f: Fn = lambda x: x) -> Seq:
        return self.map(lambda x: f(x).cast("bigint"))

    def map_to_double(self, f: Fn = lambda x: x) -> Seq:
        return self.map(lambda x: f(x).cast("double"))

    def map_to_byte(self) -> Seq:
        return self.map(N.wrap_byte)

    def map_to_short(self) -> Seq:
        return self.map(N.wrap_short)

    def map_to_char(self) -> Seq:
        return self.map(N.char_code)

    def map_to_float(self) -> Seq:
        return self.map(lambda x: x.cast("float"))

    def map_to_entry(self, key: Fn, value: Fn = lambda x: x):
        from .pairs import Pairs

        return Pairs(self.df.withColumns({"key": key(self.x), "value": value(self.x)}), "key", "value", self.order, self.by)

    def map_to_entry_partial(self, key: Fn, value: Fn):
        return self.map_to_entry(key, value).non_null_values()

    def flat_map(self, f: Fn) -> Seq:
        """One row for each element of an array; null and empty arrays give none, null elements stay."""
        rest = [c for c in self.df.columns if c not in (self.value, "_sub")]
        df = self.df.select(*rest, F.posexplode(f(self.x)).alias("_sub0", self.value))
        name = f"_sub{sum(c.startswith('_sub') for c in self.order) + 1}"
        return self._with(df.withColumnRenamed("_sub0", name), order=[*self.order, name])

    flat_array = flat_collection = map_multi = flat_map

    def flat_map_to_entry(self, f: Fn):
        """One pair for each entry of a map."""
        from .pairs import Pairs

        out = self.flat_map(lambda x: F.map_entries(f(x)))
        df = out.df.withColumnRenamed(out.value, "_entry").withColumns({"key": F.col("_entry.key"), "value": F.col("_entry.value")}).drop("_entry")
        return Pairs(df, "key", "value", out.order, out.by)

    def intersperse(self, delimiter) -> Seq:
        """The delimiter between neighbours: each row but the first brings one before it."""
        near = O.with_neighbours(self.df, self.by, self.order, {"_before": F.lit(True)})
        kind = self.df.schema[self.value].dataType
        both = F.when(F.col("_before"), F.array(F.lit(delimiter).cast(kind), self.x)).otherwise(F.array(self.x))
        return self._with(near.withColumn("_both", both)).map(lambda _: F.col("_both")).flat_map(lambda x: x)._drop("_before", "_both")

    def _drop(self, *columns: str) -> Seq:
        return self._with(self.df.drop(*columns))

    # -- neighbours and running operators

    def pair_map(self, f: Fn) -> Seq:
        """f(previous, this) for all but the first."""
        near = O.with_neighbours(self.df, self.by, self.order, {"_prev": F.struct(self.x.alias("x"))})
        return self._with(near.where("_prev is not null").withColumn(self.value, f(F.col("_prev.x"), self.x)).drop("_prev"))

    def prefix(self, kind: str = "sum") -> Seq:
        """Running sum, min or max in place of the values."""
        return self._with(O.with_running(self.df, self.by, self.order, {self.value: (kind, self.x)}))

    def scan_left(self, kind: str = "sum", seed=None) -> DataFrame:
        """One array of running results for each sequence, led by the seed if there is one."""
        return self._scan(kind, seed, backward=False)

    def scan_right(self, kind: str = "sum", seed=None) -> DataFrame:
        """The same from the end: each result covers a row and all after it, and the seed stands last."""
        return self._scan(kind, seed, backward=True)

    def _scan(self, kind: str, seed, backward: bool) -> DataFrame:
        merge = {"sum": lambda a, b: a + b, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}[kind]
        rows = O.with_running(self.df, self.by, self.order, {"_run": (kind, self.x)}, backward)
        if seed is not None:
            rows = rows.withColumn("_run", F.coalesce(merge(F.lit(seed), F.col("_run")), F.lit(seed)))
        out = rows.groupBy(*self.by).agg(C.to_list(F.col("_run"), F.struct(*self.order)).alias(self.value))
        if seed is not None:
            own = F.array(F.lit(seed))
            out = out.withColumn(self.value, F.concat(self.x, own) if backward else F.concat(own, self.x))
        return out

    def scan_fold(self, seed: Column, f: Callable[[Column, Column], Column]) -> DataFrame:
        """Running results of any fold, over each sequence as an ordered array: for sequences that fit a row."""
        out = self.df.groupBy(*self.by).agg(C.to_list(self.x, self._at).alias("_all"))
        step = lambda acc, x: F.concat(acc, F.array(f(F.element_at(acc, -1), x)))
        return out.withColumn(self.value, F.aggregate("_all", F.array(seed), step)).drop("_all")

    def take_while(self, p: Fn) -> Seq:
        return self._until(p, before=False)

    def take_while_inclusive(self, p: Fn) -> Seq:
        """The first row that fails is the last that stays."""
        return self._until(p, before=True)

    def take_until_null(self) -> Seq:
        return self.take_while(lambda x: x.isNotNull())

    def _failed(self, p: Fn) -> tuple[str, Column]:
        return "max", F.when(F.coalesce(p(self.x), F.lit(False)), 0).otherwise(1)

    def _until(self, p: Fn, before: bool) -> Seq:
        rows = O.with_running(self.df, self.by, self.order, {"_failed": self._failed(p)}, before=before)
        return self._with(rows.where("coalesce(_failed, 0) = 0").drop("_failed"))

    def drop_while(self, p: Fn) -> Seq:
        rows = O.with_running(self.df, self.by, self.order, {"_failed": self._failed(p)})
        return self._with(rows.where("_failed = 1").drop("_failed"))

    def map_first(self, f: Fn) -> Seq:
        return self.map_first_or_else(f, lambda x: x)

    def map_first_or_else(self, f: Fn, g: Fn) -> Seq:
        rows = O.with_neighbours(self.df, self.by, self.order, {"_near": F.lit(True)})
        return self._with(rows.withColumn(self.value, F.when(F.col("_near").isNull(), f(self.x)).otherwise(g(self.x))).drop("_near"))

    def map_last(self, f: Fn) -> Seq:
        return self.map_last_or_else(lambda x: x, f)

    def map_last_or_else(self, g: Fn, f: Fn) -> Seq:
        rows = O.with_neighbours(self.df, self.by, self.order, {"_near": F.lit(True)}, ahead=True)
        return self._with(rows.withColumn(self.value, F.when(F.col("_near").isNull(), f(self.x)).otherwise(g(self.x))).drop("_near"))

    def with_first(self, f: Fn | None = None):
        """Pairs (first value, value), the first row included, or what f makes of both."""
        from .pairs import Pairs

        rows = O.with_edges(self.df, self.by, self.order, {"_first": self.x})
        if f is not None:
            return self._with(rows.withColumn(self.value, f(F.col("_first"), self.x)).drop("_first"))
        return Pairs(rows.withColumnsRenamed({"_first": "key", self.value: "value"}), "key", "value", self.order, self.by)

    def dominators(self, strict: bool = False) -> Seq:
        """Values that no earlier one dominates: a value dominates those at most as large (or, strictly, smaller ones)."""
        rows = O.with_running(self.df, self.by, self.order, {"_top": ("max", self.x)}, before=True)
        keep = F.col("_top").isNull() | ((self.x >= F.col("_top")) if strict else (self.x > F.col("_top")))
        return self._with(rows.where(keep).drop("_top"))

    # -- runs

    def islands(self, same: Fn, name: str = "_run") -> DataFrame:
        """Number the runs from 0: a row belongs to its predecessor's run if same(previous, this)."""
        cuts = O.cuts_of(self.df, self.by, self.order)
        near = O.with_neighbours(self.df, self.by, self.order, {"_prev": F.struct(self.x.alias("x"))}, cuts=cuts)
        new = F.when(F.col("_prev").isNull(), 0).when(F.coalesce(same(F.col("_prev.x"), self.x), F.lit(False)), 0).otherwise(1)
        return O.with_running(near, self.by, self.order, {name: ("sum", new.cast("bigint"))}, cuts=cuts).drop("_prev")

    def collapse(self, same: Fn, *aggregates: Column, name: str = "_run") -> DataFrame:
        """One row for each run, with aggregates; without any, the run's first value."""
        own = aggregates or (F.min_by(self.x, self._at).alias(self.value),)
        return self.islands(same, name).groupBy(*self.by, name).agg(*own)

    def group_runs(self, same: Fn) -> Seq:
        """Each run as one array."""
        return self._with(self.collapse(same, C.to_list(self.x, self._at).alias(self.value)), order=["_run"])

    def interval_map(self, same: Fn, f: Fn) -> Seq:
        """f(first, last) of each run."""
        ends = self.collapse(same, F.min_by(self.x, self._at).alias("_lo"), F.max_by(self.x, self._at).alias("_hi"))
        return self._with(ends.withColumn(self.value, f(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"), order=["_run"])

    def run_lengths(self):
        """Pairs (value, length) of runs of equal values; null equals null."""
        from .pairs import Pairs

        out = self.collapse(lambda a, b: a.eqNullSafe(b), F.min_by(self.x, self._at).alias("key"), F.count(F.lit(1)).alias("value"))
        return Pairs(out, "key", "value", ["_run"], self.by)

    # -- named operators for what a recursive head-and-tail definition is used for

    def every_nth(self, n: int, start: int = 0) -> Seq:
        return self.positions("_i")._with_order(self.order).filter(lambda _: (F.col("_i") >= start) & ((F.col("_i") - start) % n == 0))._drop("_i")

    def batches(self, n: int) -> Seq:
        """Arrays of n neighbours each, the last maybe shorter."""
        rows = self.positions("_i").df.withColumn("_batch", F.floor(F.col("_i") / n))
        return self._with(rows.groupBy(*self.by, "_batch").agg(C.to_list(self.x, F.col("_i")).alias(self.value)), order=["_batch"])

    def sliding(self, n: int) -> Seq:
        """All arrays of n neighbours."""
        rows = self.positions("_i").df
        spread = rows.withColumn("_window", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_i") - n + 1), F.col("_i"))))
        out = spread.groupBy(*self.by, "_window").agg(C.to_list(self.x, F.col("_i")).alias(self.value)).where(F.size(self.value) == n)
        return self._with(out, order=["_window"])

    def couples(self) -> Seq:
        """Arrays of the rows two by two."""
        return self.batches(2).filter(lambda x: F.size(x) == 2)

    def skip_last(self, n: int = 1) -> Seq:
        rows = O.with_running(self.df, self.by, self.order, {"_left": ("sum", F.lit(1).cast("bigint"))}, backward=True)
        return self._with(rows.where(F.col("_left") > n).drop("_left"))

    def move_to_end(self, p: Fn) -> Seq:
        return self._with(self.df.withColumn("_moved", F.when(F.coalesce(p(self.x), F.lit(False)), 1).otherwise(0)), order=["_moved", *self.order])

    def append_total(self, kind: str = "sum") -> Seq:
        """The sequence and, last, its aggregate."""
        total = self.df.groupBy(*self.by).agg({"sum": F.sum, "min": F.min, "max": F.max}[kind](self.x).cast(self.df.schema[self.value].dataType).alias(self.value))
        return self.append(Seq(total.withColumn("_one", F.lit(0)), self.value, "_one", self.by))

    def _with_order(self, order: list[str]) -> Seq:
        return self._with(self.df, order=order)

    # -- sort and limit

    def limit(self, n: int) -> Seq:
        if self.by:
            w = Window.partitionBy(*self.by).orderBy(*(F.col(c).asc_nulls_first() for c in self.order))
            return self._with(self.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))
        return self._with(self.df.orderBy(*(F.col(c).asc_nulls_first() for c in self.order)).limit(n))

    def skip(self, n: int) -> Seq:
        return self.positions("_i")._with_order(self.order).filter(lambda _: F.col("_i") >= n)._drop("_i")

    def sorted_by(self, f: Fn, reverse: bool = False) -> Seq:
        """Order by a key, stably; nulls are an error, as they have no natural order. Doubles have -0.0 before 0.0, and NaN above all."""
        key = f(self.x)
        kind = self.df.select(key).schema[0].dataType
        key = F.when(key.isNotNull(), key).otherwise(F.raise_error(F.lit("null has no order")).cast(kind))
        df = self.df.withColumn("_key", key)
        if kind.typeName() in ("double", "float"):
            if reverse:
                df = df.withColumn("_key", -F.col("_key"))
            # NaN is the greatest key by itself, and stays so when it changes its sign.
            df = df.withColumn("_nan", F.when(F.isnan("_key"), -1).otherwise(0)).withColumn("_sign", N.zero_sign(F.col("_key")))
            return self._with(df, order=[*(["_nan"] if reverse else []), "_key", "_sign", *self.order])
        if not reverse:
            return self._with(df, order=["_key", *self.order])
        if kind.typeName() in ("byte", "short", "integer", "long"):
            return self._with(df.withColumn("_key", -F.col("_key").cast("decimal(20,0)")), order=["_key", *self.order])
        # Keys of other types are reversed by rank, which keeps ties in their order.
        rank = df.select(*self.by, "_key").distinct()
        if not self.by:
            ranked = O.with_position(rank, [], ["_key"], "_rank")
        else:
            ranked = rank.withColumn("_rank", F.row_number().over(Window.partitionBy(*self.by).orderBy("_key")))
        joined = O.join_keys(df, ranked, [*self.by, "_key"], null_safe=self.by).withColumn("_rank", -F.col("_rank"))
        return self._with(joined.drop("_key"), order=["_rank", *self.order])

    def sorted(self) -> Seq:
        return self.sorted_by(lambda x: x)

    def reverse_sorted(self) -> Seq:
        return self.sorted_by(lambda x: x, reverse=True)

    def greatest(self, n: int, key: Fn = lambda x: x) -> Seq:
        return self._top(n, key, True)

    def least(self, n: int, key: Fn = lambda x: x) -> Seq:
        return self._top(n, key, False)

    def _top(self, n: int, key: Fn, greatest: bool) -> Seq:
        """The n first rows by key, first of ties first, ranked in ``_rank`` from 1."""
        k = key(self.x)
        by = [k.desc_nulls_last() if greatest else k.asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in self.order)]
        if self.by:
            rows = self.df.withColumn("_rank", F.row_number().over(Window.partitionBy(*self.by).orderBy(*by))).where(F.col("_rank") <= n)
        else:
            rows = self.df.orderBy(*by).limit(max(0, n))
            rows = rows.withColumn("_rank", F.row_number().over(Window.orderBy(*by)))  # n rows
        return self._with(rows, order=["_rank"])

    # -- sets and bags

    def distinct(self, f: Fn | None = None, at_least: int = 1) -> Seq:
        """The n-th row of each value (or key), where there is one; null equals null."""
        w = Window.partitionBy(*self.by, (f or (lambda x: x))(self.x)).orderBy(*(F.col(c).asc_nulls_first() for c in self.order))
        return self._with(self.df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == at_least).drop("_nth"))

    def append(self, *others: Seq) -> Seq:
        """The rows of other sequences after these."""
        parts = [self, *others]
        width = max(len(s.order) for s in parts)
        order = [f"_o{k}" for k in range(width)]
        out = None
        for k, s in enumerate(parts):
            # Orders of different kinds cannot share a column, so that each sequence's order is its own columns.
            own = {f"_s{k}_{c}": F.col(c) for c in s.order}
            df = s.df.select(*s.by, s.x.alias(self.value), F.lit(k).alias("_source"), *(c.alias(n) for n, c in own.items()))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        order = ["_source", *(c for c in out.columns if c.startswith("_s") and c != "_source")]
        return self._with(out, order=order)

    def prepend(self, *others: Seq) -> Seq:
        return others[0].append(*others[1:], self)._renamed(self.value)

    def _renamed(self, value: str) -> Seq:
        return self._with(self.df.withColumnRenamed(self.value, value), value=value)

    def if_empty(self, other: Seq) -> Seq:
        """The other sequence where this one has no rows (key by key)."""
        if self.by:
            there = other.df.join(self.df.select(*self.by).distinct(), self.by, "left_anti")
        else:
            there = other.df.join(self.df.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti")
        return self.append(other._with(there))

    # -- joins

    def cross(self, other: Seq, name: str = "other"):
        """Pairs of each value with all values of a small sequence (checked: at most 10,000 rows)."""
        from .pairs import Pairs

        right = other.df.select(other.x.alias("_right"), *(F.col(c).alias(f"_r{k}") for k, c in enumerate(other.order)))
        if right.limit(10_001).count() > 10_000:
            raise ValueError("cross is for a small second sequence")
        df = self.df.withColumnRenamed(self.value, "key").crossJoin(F.broadcast(right)).withColumnRenamed("_right", "value")
        return Pairs(df, "key", "value", [*self.order, *(f"_r{k}" for k in range(len(other.order)))], self.by)

    def zip_with(self, other: Seq, f: Fn | None = None):
        """Values paired by position, as many as the shorter sequence has."""
        from .pairs import Pairs

        left = self.positions("_i").df.select(*self.by, "_i", self.x.alias("key"))
        right = other.positions("_i").df.select(*self.by, "_i", other.x.alias("value"))
        joined = O.join_keys(left, right, [*self.by, "_i"], null_safe=self.by)
        if f is not None:
            return Seq(joined.select(*self.by, "_i", f(F.col("key"), F.col("value")).alias("value")), "value", "_i", self.by)
        return Pairs(joined, "key", "value", ["_i"], self.by)

    def zip(self, other: Seq, f: Fn | None = None):
        """The same for sequences of one length; others are an error."""
        n, m = (s.df.groupBy(*s.by).count() for s in (self, other))
        uneven = O.join_keys(n, m.withColumnRenamed("count", "_m"), self.by, "full", self.by).where("not (count <=> _m)") if self.by else n.crossJoin(m.withColumnRenamed("count", "_m")).where("count <> _m")
        if not uneven.isEmpty():
            raise ValueError("sequences of different lengths")
        return self.zip_with(other, f)

    def pairs(self):
        """All pairs (earlier, later) within each key: quadratic in a key's rows, and so meant for short sequences."""
        from .pairs import Pairs

        left = self.positions("_i").df.select(*self.by, F.col("_i").alias("_i1"), self.x.alias("key"))
        right = self.positions("_i").df.select(*self.by, F.col("_i").alias("_i2"), self.x.alias("value"))
        joined = O.join_keys(left, right, self.by, null_safe=self.by).where("_i1 < _i2") if self.by else left.join(right, F.col("_i1") < F.col("_i2"))
        return Pairs(joined, "key", "value", ["_i1", "_i2"], self.by)

    def elements(self, source: Seq) -> Seq:
        """The source's value at each position that this sequence names."""
        table = source.positions("_i").df.select("_i", source.x.alias("_element"))
        return self._with(self.df.join(table, self.x == F.col("_i")).withColumn(self.value, F.col("_element")).drop("_i", "_element"))

    # -- aggregation

    def collect(self, **aggregates: Column | Callable[[Column, Column], Column]) -> DataFrame:
        """One row for each sequence; a callable gets the value and the order as columns."""
        return C.collected(self.df, self.by, self.x, self._at, aggregates)

    def count(self, p: Fn | None = None) -> DataFrame:
        return self.collect(n=F.count(F.lit(1)) if p is None else F.count_if(p(self.x)))

    def any_match(self, p: Fn) -> DataFrame:
        return self.collect(matches=F.coalesce(F.bool_or(F.coalesce(p(self.x), F.lit(False))), F.lit(False)))

    def all_match(self, p: Fn) -> DataFrame:
        return self.collect(matches=F.coalesce(F.bool_and(F.coalesce(p(self.x), F.lit(False))), F.lit(True)))

    def none_match(self, p: Fn) -> DataFrame:
        return self.collect(matches=~F.coalesce(F.bool_or(F.coalesce(p(self.x), F.lit(False))), F.lit(False)))

    def has(self, value) -> DataFrame:
        return self.any_match(lambda x: x.eqNullSafe(F.lit(value)))

    def find_first(self, p: Fn = lambda x: F.lit(True)) -> DataFrame:
        return self.filter(p).collect(**{self.value: C.first})

    find_any = find_first

    def index_of(self, p: Fn) -> DataFrame:
        """The first position at which p holds; null if nowhere."""
        return self.positions("_i").collect(index=F.min(F.when(p(self.x), F.col("_i"))))

    def fold_left(self, seed: Column, f: Callable[[Column, Column], Column], backward: bool = False) -> DataFrame:
        """Any fold over each sequence as an ordered array: for sequences that fit a row."""
        out = self.df.groupBy(*self.by).agg(C.to_list(self.x, self._at).alias("_all"))
        return out.withColumn(self.value, F.aggregate(F.reverse("_all") if backward else F.col("_all"), seed, f)).drop("_all")

    def fold_right(self, seed: Column, f: Callable[[Column, Column], Column]) -> DataFrame:
        """f(element, accumulator), from the last element on."""
        return self.fold_left(seed, lambda acc, x: f(x, acc), backward=True)

    def reduce(self, f: Callable[[Column, Column], Column]) -> DataFrame:
        """A fold without a seed; null for an empty sequence."""
        out = self.df.groupBy(*self.by).agg(C.to_list(self.x, self._at).alias("_all"))
        rest = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(1))), F.get("_all", 0), f)
        return out.withColumn(self.value, rest).drop("_all")

    def grouping_by(self, key: Fn, **aggregates) -> DataFrame:
        """One row for each key, null keys left out; without aggregates, the values as an ordered array."""
        own = aggregates or {self.value: C.to_list}
        seq = Seq(self.df.withColumn("key", key(self.x)).where("key is not null"), self.value, self.order, [*self.by, "key"])
        return seq.collect(**own)

    def grouping_by_domain(self, key: Fn, domain: list, empty: dict | None = None, **aggregates) -> DataFrame:
        """One row for each key of the domain; keys without rows have the given values, keys beyond the domain are an error."""
        k = key(self.x)
        inside = F.when(k.isin(domain), k).otherwise(F.raise_error(F.lit("a key is not in the domain")).cast(self.df.select(k).schema[0].dataType))
        found = self.grouping_by(lambda _: inside, **aggregates)
        keys = self.df.sparkSession.createDataFrame([(d,) for d in domain], ["key"])
        if self.by:
            keys = self.df.select(*self.by).distinct().crossJoin(F.broadcast(keys))
        out = O.join_keys(keys, found, [*self.by, "key"], "left", self.by)
        return out.fillna(empty) if empty else out

    def partitioning_by(self, p: Fn, **aggregates) -> DataFrame:
        """Two rows, for true and false, also where one has no elements (its aggregates are those of nothing)."""
        flag = F.coalesce(p(self.x), F.lit(False))
        sides = self.df.select(*self.by).distinct() if self.by else self.df.sparkSession.range(1).select()
        sides = sides.withColumn("key", F.explode(F.array(F.lit(True), F.lit(False))))
        own = aggregates or {self.value: C.to_list}
        rows = self.df.withColumn("key", flag).withColumn("_row", F.lit(True))
        both = O.join_keys(sides, rows, [*self.by, "key"], "left", self.by)
        value, at = F.when(F.col("_row"), self.x), F.when(F.col("_row"), F.struct(*self.order))
        return C.collected(both, [*self.by, "key"], value, at, own)

    def sum(self) -> DataFrame:
        """The sum; whole numbers wrap at their width, and nothing sums to 0."""
        kind = dict(self.df.dtypes)[self.value]
        return self.collect(sum=N.sum_int(self.x) if kind == "int" else N.sum_long(self.x) if kind == "bigint" else F.coalesce(F.sum(self.x), F.lit(0.0)))

    def average(self) -> DataFrame:
        """The average; whole numbers are summed exactly."""
        whole = dict(self.df.dtypes)[self.value] in ("tinyint", "smallint", "int", "bigint")
        return self.collect(average=(C.averaging_long if whole else C.averaging)(self.x))

    def summary_statistics(self) -> DataFrame:
        """count, sum, min, max and average."""
        out = self.collect(_all=C.summarizing(self.x))
        return out.select(*self.by, "_all.*")

    def reverse(self) -> Seq:
        """The last row first: order columns that are numbers change their sign, others are ranked."""
        kinds = dict(self.df.dtypes)
        if all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in self.order):
            names = [f"_back_{c}" for c in self.order]
            return self._with(self.df.withColumns({n: -F.col(c).cast("decimal(20,0)") for n, c in zip(names, self.order)}), order=names)
        placed = self.positions("_place").df
        return self._with(placed.withColumn("_place", -F.col("_place")), order=["_place"])

    def partitioning_to_set(self, p: Fn) -> DataFrame:
        """The same as sets of distinct values."""
        return self.partitioning_by(p, **{self.value: C.to_set})

    def min(self) -> DataFrame:
        """The least value; NaN as soon as one is."""
        return self.collect(min=N.min_double(self.x) if dict(self.df.dtypes)[self.value] in ("double", "float") else F.min(self.x))

    def max(self) -> DataFrame:
        return self.collect(max=F.max(self.x))

    def min_by(self, f: Fn) -> DataFrame:
        return self.collect(**{self.value: C.min_by(f)})

    def max_by(self, f: Fn) -> DataFrame:
        return self.collect(**{self.value: C.max_by(f)})

    def joining(self, delimiter: str = "", prefix: str = "", suffix: str = "") -> DataFrame:
        return self.collect(joined=C.joining(delimiter, prefix, suffix))

    def reduce_with_zero(self, zero, f: Callable[[Column, Column], Column], identity) -> DataFrame:
        """A fold that stays at the zero once it gets there."""
        z = F.lit(zero)
        return self.fold_left(F.lit(identity).cast(self.df.schema[self.value].dataType), lambda acc, x: F.when(acc == z, acc).otherwise(f(acc, x)))

    def to_map(self, key: Fn, value: Fn = lambda x: x, merge: Callable[[Column], Column] | None = None) -> DataFrame:
        """A map of all values; a repeated key is an error unless ``merge`` makes one value of its ordered values."""
        return self.map_to_entry(key, value).to_map(merge)

    def to_sorted_map(self, key: Fn, value: Fn = lambda x: x, merge: Callable[[Column], Column] | None = None) -> DataFrame:
        """The same as an array of entries by key: maps have no order."""
        return self.map_to_entry(key, value).to_sorted_map(merge)

    def grouping_to_set(self, key: Fn) -> DataFrame:
        return self.grouping_by(key, **{self.value: C.to_set})

    def to_flat_list(self, f: Fn) -> DataFrame:
        return self.collect(**{self.value: C.flat_mapping(f)})

    def to_bit_set(self) -> DataFrame:
        return self.collect(**{self.value: C.to_bit_set})

    def code_points_to_string(self) -> DataFrame:
        """Code points as one string."""
        text = F.udf(lambda a: "".join(map(chr, a)), "string", useArrow=True)
        return self.collect(**{self.value: lambda x, at: text(C.to_list(x, at))})

    def chars_to_string(self) -> DataFrame:
        """16-bit units as one string; pairs of surrogates become one code point."""
        text = F.udf(lambda a: b"".join(c.to_bytes(2, "little") for c in a).decode("utf-16-le", "replace"), "string", useArrow=True)
        return self.collect(**{self.value: lambda x, at: text(C.to_list(x, at))})

    # -- sinks

    def peek_first(self, action: Callable) -> Seq:
        """Call an action with the first value, on the driver."""
        for x in self.limit(1).to_list():
            action(x)
        return self

    def peek_last(self, action: Callable) -> Seq:
        for r in self.collect(last=C.last, n=C.counting).collect():
            if r["n"]:
                action(r["last"])
        return self

    def to_bytes(self) -> bytes:
        """The lowest bytes of all values, on the driver."""
        return bytes(x & 0xFF for x in self.iterator())

    def to_list(self) -> list:
        """The values on the driver; meant for results, not for tables."""
        return [r[0] for r in self.ordered().select(self.value).collect()]

    def to_set(self) -> set:
        return {r[0] for r in self.df.select(self.value).distinct().collect()}

    def iterator(self):
        return (r[0] for r in self.ordered().select(self.value).toLocalIterator())

    def for_each(self, action: Callable) -> None:
        value = self.value
        self.df.foreach(lambda r: action(r[value]))

    def for_each_ordered(self, action: Callable) -> None:
        for x in self.iterator():
            action(x)

    def for_pairs(self, action: Callable) -> None:
        near = O.with_neighbours(self.df, self.by, self.order, {"_prev": F.struct(self.x.alias("x"))}).where("_prev is not null")
        value = self.value
        near.foreach(lambda r: action(r["_prev"]["x"], r[value]))

    def write(self, path: str, mode: str = "error", source: str = "parquet") -> None:
        self.df.write.mode(mode).format(source).save(path)

    def into(self, table: str) -> None:
        self.df.write.mode("append").saveAsTable(table)

"""Pairs: an ordered sequence of key and value columns; keys may repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import collectors as C
from ..plans import order as O
from .seq import Fn, Seq


class Pairs:
    """An ordered sequence of pairs, or one for each combination of the ``by`` columns."""

    def __init__(self, df: DataFrame, key: str = "key", value: str = "value", order: list[str] | str = "_pos", by: list[str] | str = ()):
        self.df, self.key, self.value = df, key, value
        self.order = [order] if isinstance(order, str) else list(order)
        self.by = [by] if isinstance(by, str) else list(by)

    @property
    def k(self) -> Column:
        return F.col(self.key)

    @property
    def v(self) -> Column:
        return F.col(self.value)

    @property
    def _at(self) -> Column:
        return F.struct(*self.order)

    def _with(self, df: DataFrame, order: list[str] | None = None) -> Pairs:
        return Pairs(df, self.key, self.value, order or self.order, self.by)

    def chain(self, fn: Callable):
        return fn(self)

    # -- to and from sequences

    def keys(self) -> Seq:
        return Seq(self.df, self.key, self.order, self.by)

    def values(self) -> Seq:
        return Seq(self.df, self.value, self.order, self.by)

    def invert(self) -> Pairs:
        return Pairs(self.df, self.value, self.key, self.order, self.by)

    def map_key_value(self, f: Fn, name: str = "value") -> Seq:
        return Seq(self.df.withColumn(name, f(self.k, self.v)), name, self.order, self.by)

    def map_key_value_partial(self, f: Fn, name: str = "value") -> Seq:
        return self.map_key_value(f, name).non_null()

    def flat_map_key_value(self, f: Fn) -> Seq:
        return Seq(self.df.withColumn("_flat", f(self.k, self.v)), "_flat", self.order, self.by).flat_map(lambda x: x)

    # -- projections

    def map_keys(self, f: Fn) -> Pairs:
        return self._with(self.df.withColumn(self.key, f(self.k)))

    def map_values(self, f: Fn) -> Pairs:
        return self._with(self.df.withColumn(self.value, f(self.v)))

    def map_to_key(self, f: Fn) -> Pairs:
        return self._with(self.df.withColumn(self.key, f(self.k, self.v)))

    def map_to_value(self, f: Fn) -> Pairs:
        return self._with(self.df.withColumn(self.value, f(self.k, self.v)))

    def map_keys_partial(self, f: Fn) -> Pairs:
        return self.map_keys(f).non_null_keys()

    def map_values_partial(self, f: Fn) -> Pairs:
        return self.map_values(f).non_null_values()

    def map_to_key_partial(self, f: Fn) -> Pairs:
        return self.map_to_key(f).non_null_keys()

    def map_to_value_partial(self, f: Fn) -> Pairs:
        return self.map_to_value(f).non_null_values()

    def _flat(self, column: str, arr: Column) -> Pairs:
        rest = [c for c in self.df.columns if c != column]
        name = f"_sub{sum(c.startswith('_sub') for c in self.order) + 1}"
        return self._with(self.df.select(*rest, F.posexplode(arr).alias(name, column)), order=[*self.order, name])

    def flat_map_keys(self, f: Fn) -> Pairs:
        return self._flat(self.key, f(self.k))

    def flat_map_values(self, f: Fn) -> Pairs:
        return self._flat(self.value, f(self.v))

    def flat_map_to_key(self, f: Fn) -> Pairs:
        return self._flat(self.key, f(self.k, self.v))

    def flat_map_to_value(self, f: Fn) -> Pairs:
        return self._flat(self.value, f(self.k, self.v))

    def join(self, delimiter: str, prefix: str = "", suffix: str = "") -> Seq:
        """Each pair as a string; null reads ``null``."""
        text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
        return self.map_key_value(lambda k, v: F.concat(F.lit(prefix), text(k), F.lit(delimiter), text(v), F.lit(suffix)))

    # -- filters

    def filter_keys(self, p: Fn) -> Pairs:
        return self._with(self.df.where(p(self.k)))

    def filter_values(self, p: Fn) -> Pairs:
        return self._with(self.df.where(p(self.v)))

    def filter_key_value(self, p: Fn) -> Pairs:
        return self._with(self.df.where(p(self.k, self.v)))

    def remove_keys(self, p: Fn) -> Pairs:
        return self._with(self.df.where(~F.coalesce(p(self.k), F.lit(False))))

    def remove_values(self, p: Fn) -> Pairs:
        return self._with(self.df.where(~F.coalesce(p(self.v), F.lit(False))))

    def remove_key_value(self, p: Fn) -> Pairs:
        return self._with(self.df.where(~F.coalesce(p(self.k, self.v), F.lit(False))))

    def non_null_keys(self) -> Pairs:
        return self._with(self.df.where(self.k.isNotNull()))

    def non_null_values(self) -> Pairs:
        return self._with(self.df.where(self.v.isNotNull()))

    def without_keys(self, *keys) -> Pairs:
        return self._without(self.key, keys)

    def without_values(self, *values) -> Pairs:
        return self._without(self.value, values)

    def _without(self, column: str, values: tuple) -> Pairs:
        """Drop values; a null in the column is an error, as it cannot be told from them."""
        c = F.col(column)
        checked = F.when(c.isNull(), F.raise_error(F.lit(f"null {column}")).cast("boolean")).otherwise(c.isin(list(values)))
        return self._with(self.df.where(~checked))

    def distinct_keys(self) -> Pairs:
        return self._distinct(self.k)

    def distinct_values(self) -> Pairs:
        return self._distinct(self.v)

    def _distinct(self, c: Column) -> Pairs:
        w = Window.partitionBy(*self.by, c).orderBy(*self.order)
        return self._with(self.df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth"))

    # -- runs and running operators

    def collapse_keys(self, *aggregates: Column, name: str = "_run") -> DataFrame:
        """One row for each run of equal keys (null equals null): its values in order, or aggregates."""
        own = aggregates or (C.to_list(self.v, self._at).alias(self.value),)
        return self.keys().collapse(lambda a, b: a.eqNullSafe(b), F.min_by(self.k, self._at).alias(self.key), *own, name=name)

    def prefix_keys(self, kind: str = "sum") -> Pairs:
        return self._with(O.with_running(self.df, self.by, self.order, {self.key: (kind, self.k)}))

    def prefix_values(self, kind: str = "sum") -> Pairs:
        return self._with(O.with_running(self.df, self.by, self.order, {self.value: (kind, self.v)}))

    def append(self, *others: Pairs) -> Pairs:
        packed = [Seq(p.df.withColumn("_pair", F.struct(p.k.alias("k"), p.v.alias("v"))), "_pair", p.order, p.by) for p in (self, *others)]
        out = packed[0].append(*packed[1:])
        df = out.df.withColumns({self.key: F.col("_pair.k"), self.value: F.col("_pair.v")}).drop("_pair")
        return self._with(df, order=out.order)

    def prepend(self, *others: Pairs) -> Pairs:
        out = others[0].append(*others[1:], self)
        return Pairs(out.df.withColumnsRenamed({out.key: self.key, out.value: self.value}), self.key, self.value, out.order, self.by)

    def sorted(self) -> Pairs:
        """By key, then by value."""
        return self._with(self.df, order=[self.key, self.value, *self.order])

    # -- aggregation

    def grouping(self, **aggregates) -> DataFrame:
        """One row for each key, null keys left out; without aggregates, the values in order."""
        own = aggregates or {self.value: C.to_list}
        rows = self.df.where(self.k.isNotNull())
        return Seq(rows, self.value, self.order, [*self.by, self.key]).collect(**own)

    def to_map(self, merge: Callable[[Column], Column] | None = None) -> DataFrame:
        """All pairs as one map for each sequence. A repeated key is an error, unless ``merge`` makes one value of its ordered values."""
        if merge is None:
            return self.df.groupBy(*self.by).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(self._at.alias("at"), self.k.alias("k"), self.v.alias("v")))), lambda r: F.struct(r["k"], r["v"]))).alias("map"))
        merged = self.grouping(_all=C.to_list).withColumn("_value", merge(F.col("_all")))
        return merged.groupBy(*self.by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(self.k, F.col("_value"))))).alias("map"))

    def to_sorted_map(self, merge: Callable[[Column], Column] | None = None) -> DataFrame:
        return self.to_map(merge).withColumn("map", F.array_sort(F.map_entries("map")))

    def collect(self, **aggregates: Column) -> DataFrame:
        return self.df.groupBy(*self.by).agg(*(a.alias(n) for n, a in aggregates.items()))

    def any_match(self, p: Fn) -> DataFrame:
        return self.collect(matches=F.coalesce(F.bool_or(F.coalesce(p(self.k, self.v), F.lit(False))), F.lit(False)))

    def all_match(self, p: Fn) -> DataFrame:
        return self.collect(matches=F.coalesce(F.bool_and(F.coalesce(p(self.k, self.v), F.lit(False))), F.lit(True)))

    def none_match(self, p: Fn) -> DataFrame:
        return self.collect(matches=~F.coalesce(F.bool_or(F.coalesce(p(self.k, self.v), F.lit(False))), F.lit(False)))

    # -- sinks

    def for_key_value(self, action: Callable) -> None:
        key, value = self.key, self.value
        self.df.foreach(lambda r: action(r[key], r[value]))

    def to_list(self) -> list[tuple]:
        rows = self.df.orderBy(*self.by, *(F.col(c).asc_nulls_first() for c in self.order)).select(self.key, self.value)
        return [(r[0], r[1]) for r in rows.collect()]

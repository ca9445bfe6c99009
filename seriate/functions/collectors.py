"""Aggregates over ordered values, as columns: each takes the value and the order (a column that compares) and any parameters.

They compose: ``filtering``, ``mapping``, ``flat_mapping``, ``teeing`` and ``and_then`` wrap others, and all work under groupBy. Some compare
each row with an aggregate of its group; ``collected`` adds it to the rows first, so that a group need not be gathered for it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import with_totals

Collector = Callable[[Column, Column], Column]

#: The aggregates of groups that the collectors of one ``collected`` compare rows with, by column name.
_TOTALS: ContextVar[dict[str, Column] | None] = ContextVar("totals", default=None)


def collected(df: DataFrame, keys: list[str], x: Column, at: Column, aggregates: dict[str, Column | Collector]) -> DataFrame:
    """One row for each group, with columns that aggregate, or collectors of the value and the order."""
    totals: dict[str, Column] = {}
    token = _TOTALS.set(totals)
    try:
        own = [(a(x, at) if callable(a) else a).alias(n) for n, a in aggregates.items()]
    finally:
        _TOTALS.reset(token)
    return (with_totals(df, keys, totals) if totals else df).groupBy(*keys).agg(*own)


def _total(e: Column) -> Column | None:
    """An aggregate of the group as a column of each row; none outside of ``collected``."""
    totals = _TOTALS.get()
    if totals is None:
        return None
    name = f"_total{len(totals)}"
    totals[name] = e
    return F.col(name)


def to_list(x: Column, at: Column) -> Column:
    """All values in order, nulls included; a row without a place is no element."""
    return F.transform(F.array_sort(F.collect_list(F.when(at.isNotNull(), F.struct(at.alias("at"), x.alias("x"))))), lambda r: r["x"])


def to_set(x: Column, at: Column | None = None) -> Column:
    """The distinct values in their order; one null if there is any."""
    null = x.isNull() if at is None else x.isNull() & at.isNotNull()
    return F.array_sort(F.concat(F.collect_set(x), F.when(F.bool_or(null), F.array(F.max(F.when(F.lit(False), x)))).otherwise(F.filter(F.collect_set(x), lambda _: F.lit(False)))))


def first(x: Column, at: Column) -> Column:
    return F.min_by(x, at)


def last(x: Column, at: Column) -> Column:
    return F.max_by(x, at)


def head(n: int) -> Collector:
    return lambda x, at: F.slice(to_list(x, at), 1, n) if n > 0 else F.slice(to_list(x, at), 1, 0)


def tail(n: int) -> Collector:
    return lambda x, at: F.reverse(F.slice(F.reverse(to_list(x, at)), 1, max(n, 0)))


def only_one(x: Column, at: Column) -> Column:
    """The value if there is exactly one, else null."""
    return F.when(F.count(at) == 1, F.min_by(x, at))


def counting(x: Column, at: Column | None = None) -> Column:
    return F.count(F.lit(1) if at is None else at)


def count_if(p: Callable[[Column], Column]) -> Collector:
    return lambda x, at: F.count_if(p(x))


def distinct_count(x: Column, at: Column | None = None) -> Column:
    """How many different values there are; null counts as one."""
    null = x.isNull() if at is None else x.isNull() & at.isNotNull()
    return F.count_distinct(x) + F.coalesce(F.max(null.cast("bigint")), F.lit(0))


def distinct_by(key: Callable[[Column], Column]) -> Collector:
    """The first value of each key, in order."""

    def collect(x: Column, at: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(at.alias("at"), key(x).alias("k"), x.alias("x"))))
        empty = F.filter(rows, lambda _: F.lit(False))
        kept = F.aggregate(rows, empty, lambda acc, r: F.when(F.exists(acc, lambda q: q["k"].eqNullSafe(r["k"])), acc).otherwise(F.concat(acc, F.array(r))))
        return F.transform(kept, lambda r: r["x"])

    return collect


def min_by(key: Callable[[Column], Column] = lambda x: x) -> Collector:
    """The first value with the least key; null keys don't count."""
    return lambda x, at: F.min_by(F.when(key(x).isNotNull(), x), F.when(key(x).isNotNull(), F.struct(key(x).alias("k"), at.alias("at"))))


def max_by(key: Callable[[Column], Column] = lambda x: x) -> Collector:
    """The first value with the greatest key: of equal keys the least place wins; null keys don't count."""

    def collect(x: Column, at: Column) -> Column:
        k = F.when(at.isNotNull(), key(x))
        best = F.max(k)
        top = _total(best)
        if top is not None:
            return F.min_by(F.when(k == top, x), F.when(k == top, at))
        rows = F.collect_list(F.when(k.isNotNull(), F.struct(at.alias("at"), k.alias("k"), x.alias("x"))))
        return F.array_min(F.transform(F.filter(rows, lambda r: r["k"] == best), lambda r: F.struct(r["at"], r["x"])))["x"]

    return collect


def min_max(finish: Callable[[Column, Column], Column]) -> Collector:
    return lambda x, at: finish(F.min(x), F.max(x))


def min_all(key: Callable[[Column], Column] = lambda x: x, downstream: Collector | None = None, greatest: bool = False) -> Collector:
    """All values with the least (or greatest) key, in order; null keys don't count."""

    def collect(x: Column, at: Column) -> Column:
        k = F.when(at.isNotNull(), key(x))
        best = (F.max if greatest else F.min)(k)
        top = _total(best)
        if top is not None:
            return to_list(F.when(k == top, x), F.when(k == top, at))
        rows = F.collect_list(F.when(k.isNotNull(), F.struct(at.alias("at"), k.alias("k"), x.alias("x"))))
        return F.transform(F.array_sort(F.filter(rows, lambda r: r["k"] == best)), lambda r: r["x"])

    return collect


def max_all(key: Callable[[Column], Column] = lambda x: x) -> Collector:
    return min_all(key, greatest=True)


def least(n: int, key: Callable[[Column], Column] = lambda x: x) -> Collector:
    """The n values with the least keys, stably."""
    return lambda x, at: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(key(x).alias("k"), at.alias("at"), x.alias("x")))), 1, max(n, 0)), lambda r: r["x"])


def greatest(n: int, key: Callable[[Column], Column]) -> Collector:
    """The n values with the greatest numeric keys, stably."""
    return least(n, lambda x: -key(x))


def min_index(x: Column, at: Column) -> Column:
    """The place (a dense position as the order) of the first least value."""
    return F.min_by(at, F.when(x.isNotNull(), F.struct(x.alias("x"), at.alias("at"))))


def max_index(x: Column, at: Column) -> Column:
    """The place of the first greatest value; the order must be a number."""
    return F.max_by(at, F.when(x.isNotNull(), F.struct(x.alias("x"), (-at).alias("at"))))


def bit_and(x: Column, at: Column | None = None) -> Column:
    return F.bit_and(x)


def averaging(x: Column, at: Column | None = None) -> Column:
    return F.avg(x.cast("double"))


def averaging_long(x: Column, at: Column | None = None) -> Column:
    """The average of whole numbers from their exact sum; null of nothing."""
    return F.when(F.count(x) > 0, F.sum(x.cast("decimal(38,0)")).cast("double") / F.greatest(F.count(x), F.lit(1)))


def summarizing(x: Column, at: Column | None = None) -> Column:
    """count, sum, min, max and average as one struct; min, max and average are null of nothing, the sum is 0."""
    return F.struct(F.count(x).alias("count"), F.coalesce(F.sum(x), F.lit(0)).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x.cast("double")).alias("average"))


def intersecting(x: Column, at: Column) -> Column:
    """The elements that all arrays hold; empty without arrays."""
    rows = F.collect_list(x)
    empty = F.filter(F.flatten(rows), lambda _: F.lit(False))
    return F.when(F.size(rows) == 0, empty).otherwise(F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), F.array_distinct(F.get(rows, 0)), lambda a, b: F.array_intersect(a, b)))


def common_prefix(x: Column, at: Column | None = None) -> Column:
    """The longest common beginning of strings: that of the least and the greatest."""
    lo, hi = F.coalesce(F.min(x), F.lit("")), F.coalesce(F.max(x), F.lit(""))
    sizes = F.sequence(F.lit(0), F.least(F.length(lo), F.length(hi)))
    best = F.array_max(F.filter(sizes, lambda n: F.substring(lo, F.lit(1), n) == F.substring(hi, F.lit(1), n)))
    return F.substring(lo, F.lit(1), best)


def common_suffix(x: Column, at: Column | None = None) -> Column:
    return F.reverse(common_prefix(F.reverse(x)))


def filtering(p: Callable[[Column], Column], downstream: Collector) -> Collector:
    """A collector over the values that satisfy p: the others have no value and no place."""

    def collect(x: Column, at: Column) -> Column:
        return downstream(F.when(p(x), x), F.when(p(x), at))

    return collect


def filtering_list(p: Callable[[Column], Column]) -> Collector:
    return lambda x, at: F.filter(to_list(x, at), p)


def mapping(f: Callable[[Column], Column], downstream: Collector = to_list) -> Collector:
    return lambda x, at: downstream(f(x), at)


def flat_mapping(f: Callable[[Column], Column]) -> Collector:
    """The elements of all arrays in order; null arrays count as empty."""
    return lambda x, at: F.flatten(F.filter(to_list(f(x), at), lambda a: a.isNotNull()))


def and_then(downstream: Collector, finish: Callable[[Column], Column]) -> Collector:
    return lambda x, at: finish(downstream(x, at))


def teeing(one: Collector, two: Collector, finish: Callable[[Column, Column], Column]) -> Collector:
    return lambda x, at: finish(one(x, at), two(x, at))


pairing = teeing


def if_all_match(p: Callable[[Column], Column], downstream: Collector) -> Collector:
    """What the collector gives if all values satisfy p, else null."""
    return lambda x, at: F.when(F.coalesce(F.bool_and(F.coalesce(p(x), F.lit(False))), F.lit(True)), downstream(x, at))


def dominators(x: Column, at: Column) -> Column:
    """Values greater than all before them."""
    rows = to_list(x, at)
    empty = F.filter(rows, lambda _: F.lit(False))
    return F.aggregate(rows, empty, lambda acc, v: F.when((F.size(acc) == 0) | (v > F.element_at(F.concat(acc, F.array(v)), -2)), F.concat(acc, F.array(v))).otherwise(acc))


def joining(delimiter: str = "", prefix: str = "", suffix: str = "") -> Collector:
    """The values as strings in order; null reads ``null``."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    return lambda x, at: F.concat(F.lit(prefix), F.array_join(to_list(text(x), at), delimiter), F.lit(suffix))


def to_map(key: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x) -> Collector:
    """A map; a repeated key is an error."""
    return lambda x, at: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(at.isNotNull(), F.struct(at.alias("at"), key(x).alias("k"), value(x).alias("v"))))), lambda r: F.struct(r["k"], r["v"])))


def to_sorted_map(key: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x) -> Collector:
    """The entries of a map, by key, as an array: maps have no order."""
    return lambda x, at: F.array_sort(F.map_entries(to_map(key, value)(x, at)))


def to_bit_set(x: Column, at: Column | None = None) -> Column:
    """The distinct non-negative numbers, ascending."""
    return F.array_sort(F.collect_set(x))

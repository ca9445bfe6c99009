"""Ordered columns at scale: neighbours, running aggregates and dense positions under an explicit total order.

A window without a partition would gather a whole table in one task. Where a sequence has no key, its rows are therefore dealt into ranges
of the leading order columns; windows run within a range, and what a range must know of those before it (or after it) is summed up from
one row for each range. Sequences with keys use plain windows over their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a sequence without keys is dealt into at most, and the sampled rows that their bounds are chosen from.
MOST_RANGES, SAMPLED = 256, 16_384

_RANGE = "_range"


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", null_safe: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Join by key columns; those of ``null_safe`` match null with null. Each key column stands once in the result."""
    names = {k: f"_join_{k}" for k in keys}
    same = F.lit(True)
    for k, n in names.items():
        same = same & (left[k].eqNullSafe(F.col(n)) if k in null_safe else left[k] == F.col(n))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def _same(a, b) -> bool:
    """Whether Spark orders two values as one: null equals null, and NaN equals NaN."""
    return a == b or (a != a and b != b)


def bounds(df: DataFrame, order: list[str], ranges: int) -> list[tuple]:
    """Up to ranges - 1 bounds of the order, from SAMPLED rows at most: those with the least hash of their order.

    A bound has the values of as many leading columns as tell all bounds apart, so that a column with few values makes no large range.
    Each task hands on its own least hashes only; there is no shuffle.
    """
    names = [f"v{k}" for k in range(len(order))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(order, names)), F.xxhash64(*order).alias("h")).orderBy("h").limit(SAMPLED)
    values = [tuple(r) for r in rows.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("all")).first()["all"]]
    ranges = max(1, min(ranges, len(values) // 2))
    found = [values[len(values) * k // ranges] for k in range(1, ranges)]
    for width in range(1, len(order) + 1):
        cuts = [v[:width] for v in found]
        distinct = [v for k, v in enumerate(cuts) if not k or not all(map(_same, v, cuts[k - 1]))]
        if len(distinct) == len(cuts):
            break
    return distinct


def cuts_of(df: DataFrame, keys: list[str], order: list[str]) -> list[tuple] | None:
    """The bounds of a table's ranges, for operators in a row that share them; none where there are keys."""
    if keys:
        return None
    return bounds(df, order, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))


def _number(lead: list[Column], cuts: list[tuple], low: int = 0) -> Column:
    """How many of the sorted cuts a row has reached, column by column; a null is less than all other values."""
    if not cuts or not lead:
        return F.lit(low + len(cuts))
    starts = [k for k, v in enumerate(cuts) if not k or not _same(v[0], cuts[k - 1][0])]
    groups = [(cuts[a][0], [v[1:] for v in cuts[a:b]], low + a) for a, b in zip(starts, [*starts[1:], len(cuts)])]
    null = low
    if groups[0][0] is None:
        _, rest, at = groups.pop(0)
        null, low = _number(lead[1:], rest, at), low + len(rest)
    return F.when(lead[0].isNull(), null).otherwise(_halved(lead, groups, low))


def _halved(lead: list[Column], groups: list[tuple], low: int) -> Column:
    """The same by halving, over groups of cuts with one leading value: (the value, the cuts' other values, the cuts before)."""
    if not groups:
        return F.lit(low)
    half = len(groups) // 2
    value, rest, at = groups[half]
    below, above = _halved(lead, groups[:half], low), _halved(lead, groups[half + 1 :], at + len(rest))
    found = F.when(lead[0] < F.lit(value), below)
    return (found.when(lead[0] == F.lit(value), _number(lead[1:], rest, at)) if len(lead) > 1 else found).otherwise(above)


def in_ranges(df: DataFrame, order: list[str], cuts: list[tuple] | None = None) -> DataFrame:
    """Add the number of the range of every row, so that ranges follow each other in the order; a null leads."""
    cuts = cuts_of(df, [], order) if cuts is None else cuts
    return df.withColumn(_RANGE, _number([F.col(c) for c in order[: len(cuts[0])]], cuts) if cuts else F.lit(0))


def _window(keys: list[str], order: list[str], backward: bool = False):
    columns = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order]
    return Window.partitionBy(*keys).orderBy(*columns)


#: Running aggregates: how a range's rows are aggregated, and how an aggregate is joined with those of the ranges before.
_MERGE = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def with_running(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column]], backward: bool = False, before: bool = False, cuts: list | None = None) -> DataFrame:
    """Add running aggregates: name -> (sum, min or max; expression), from the first row (or, backward, the last) to each row.

    With ``before`` a row itself is left out, and the first row's aggregate is null.
    """
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if keys:
        w = _window(keys, order, backward).rowsBetween(*frame)
        return df.withColumns({n: _MERGE[kind][0](e).over(w) for n, (kind, e) in wanted.items()})
    named = {f"_in{k}": e for k, (_, e) in enumerate(wanted.values())}
    rows = in_ranges(df.withColumns(named), order, cuts)
    kinds = [kind for kind, _ in wanted.values()]
    totals = rows.groupBy(_RANGE).agg(*(_MERGE[kind][0](F.col(n)).alias(f"_t{k}") for k, (n, kind) in enumerate(zip(named, kinds))))
    # One row for each range.
    w = Window.orderBy(F.col(_RANGE).desc() if backward else F.col(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(_RANGE, *(_MERGE[kind][0](F.col(f"_t{k}")).over(w).alias(f"_c{k}") for k, kind in enumerate(kinds)))
    local = _window([_RANGE], order, backward).rowsBetween(*frame)
    out = rows.withColumns({f"_l{k}": _MERGE[kind][0](F.col(n)).over(local) for k, (n, kind) in enumerate(zip(named, kinds))}).join(F.broadcast(carry), _RANGE, "left")
    out = out.withColumns({n: _MERGE[kind][1](F.col(f"_c{k}"), F.col(f"_l{k}")) for k, (n, kind) in enumerate(zip(wanted, kinds))})
    return out.drop(_RANGE, *named, *(f"_{x}{k}" for k in range(len(kinds)) for x in "lc"))


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, Column], ahead: bool = False, cuts: list | None = None) -> DataFrame:
    """Add expressions of the row before each row (or after it, if ahead); null for a row without such a neighbour."""
    if keys:
        w = _window(keys, order)
        move = F.lead if ahead else F.lag
        return df.withColumns({n: move(e).over(w) for n, e in wanted.items()})
    named = {f"_in{k}": e for k, e in enumerate(wanted.values())}
    rows = in_ranges(df.withColumns(named), order, cuts)
    edge = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    edges = rows.groupBy(_RANGE).agg(pick(F.struct(*named), edge).alias("_edge"))
    w = Window.orderBy(_RANGE)
    carry = edges.select(_RANGE, (F.lead if ahead else F.lag)("_edge").over(w).alias("_order_border"))
    local = _window([_RANGE], order)
    out = rows.withColumn("_order_near", (F.lead if ahead else F.lag)(F.struct(*named)).over(local)).join(F.broadcast(carry), _RANGE, "left")
    out = out.withColumns({n: F.coalesce("_order_near", "_order_border")[f"_in{k}"] for k, n in enumerate(wanted)})
    return out.drop(_RANGE, "_order_near", "_order_border", *named)


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "_pos") -> DataFrame:
    """Add the dense position, from 0, of each row in its sequence."""
    out = with_running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name) - 1)


def with_totals(df: DataFrame, keys: list[str], wanted: dict[str, Column]) -> DataFrame:
    """Add aggregates of each sequence to all its rows."""
    totals = df.groupBy(*keys).agg(*(e.alias(n) for n, e in wanted.items()))
    return join_keys(df, totals, keys, null_safe=keys) if keys else df.crossJoin(F.broadcast(totals))  # a single row


def with_edges(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, Column], last: bool = False) -> DataFrame:
    """Add expressions of the first (or last) row of each sequence to all its rows."""
    pick = F.max_by if last else F.min_by
    edge = df.groupBy(*keys).agg(pick(F.struct(*(e.alias(f"_e{k}") for k, e in enumerate(wanted.values()))), F.struct(*order)).alias("_edge"))
    if keys:
        on = [f"_key{k}" for k in range(len(keys))]
        edge = edge.select("_edge", *(F.col(c).alias(n) for c, n in zip(keys, on)))
        same = None
        for c, n in zip(keys, on):
            same = df[c].eqNullSafe(edge[n]) if same is None else same & df[c].eqNullSafe(edge[n])
        out = df.join(edge, same, "left").drop(*on)
    else:
        out = df.crossJoin(F.broadcast(edge))  # a single row
    return out.withColumns({n: F.col("_edge")[f"_e{k}"] for k, n in enumerate(wanted)}).drop("_edge")

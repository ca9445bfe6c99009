"""Fixed-width arithmetic: sums that wrap, casts that cut off, and a total order of doubles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_int(x: Column) -> Column:
    """A whole number cut to 32 bits, as an int."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 32), 32).cast("int")


def wrap_byte(x: Column) -> Column:
    """The lowest 8 bits, signed."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 56), 56).cast("tinyint")


def wrap_short(x: Column) -> Column:
    """The lowest 16 bits, signed."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 48), 48).cast("smallint")


def char_code(x: Column) -> Column:
    """The lowest 16 bits, unsigned."""
    return x.cast("bigint").bitwiseAND(F.lit(0xFFFF)).cast("int")


def wrap_long(x: Column) -> Column:
    """A decimal cut to 64 bits, as a bigint."""
    size = F.lit(Decimal(2**64)).cast("decimal(38,0)")
    low = F.pmod(x.cast("decimal(38,0)"), size)
    return F.when(low >= F.lit(Decimal(2**63)).cast("decimal(38,0)"), low - size).otherwise(low).cast("bigint")


def sum_int(x: Column) -> Column:
    """A sum of ints that wraps at 32 bits; 0 without rows."""
    return F.coalesce(wrap_int(F.sum(x.cast("bigint"))), F.lit(0))


def sum_long(x: Column) -> Column:
    """A sum of bigints that wraps at 64 bits; 0 without rows."""
    return F.coalesce(wrap_long(F.sum(x.cast("decimal(38,0)"))), F.lit(0).cast("bigint"))


def total_order(x: Column) -> Column:
    """A sort key of doubles: -0.0 before 0.0, NaN above all."""
    return F.struct(F.isnan(x).alias("nan"), x.alias("x"), zero_sign(x).alias("sign"))


def zero_sign(x: Column) -> Column:
    """-1 for -0.0, else 0: what tells both zeros apart in an order."""
    return F.when((x == 0.0) & x.cast("string").startswith("-"), -1).otherwise(0)


def min_double(x: Column) -> Column:
    """The minimum of doubles, NaN as soon as one is."""
    return F.when(F.bool_or(F.isnan(x)), F.lit(float("nan"))).otherwise(F.min(x))


def greater(x: Column, value) -> Column:
    """x > value, false for NaN."""
    return (x > F.lit(value)) & ~F.isnan(x.cast("double"))

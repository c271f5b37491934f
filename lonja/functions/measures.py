"""Aggregates whose value does not depend on the order in which rows are added.

A double is cut into its whole part, three limbs of 22 bits, and its fraction to twelve decimals,
two limbs of 20 bits. Each limb is summed as a 64-bit integer, which holds for 10^12 rows in one
group, and the sums meet in one decimal per group. What a row has beyond twelve decimals, at most
5e-13, and values from 2^62, infinities and NaN are added apart as doubles and reach the result.
Only sums of such values depend on the order, in their last digits: those of tiny rates, or of
values of that size; elsewhere the part beyond twelve decimals is far below the last digit.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

DECIMALS = 12

_WHOLE_BITS = 22
_FRACTION_BITS = 20
_LARGE = float(1 << 62)
_N_PARTS = 6


def _low(units: Column, bits: int) -> Column:
    return units.bitwiseAND(F.lit((1 << bits) - 1))


def _parts(x: Column) -> list[Column]:
    """Limbs of a row's value, highest first, and what they leave: all of a value too large.

    Only the last is NULL where the row has no value. Each part repeats ``x``, so it is kept short.
    """
    fits = F.abs(x) < _LARGE
    held = F.when(fits, x).otherwise(0.0)
    whole = held.cast("bigint")
    fraction = F.rint((held - whole) * F.lit(float(10**DECIMALS))).cast("bigint")
    return [
        F.shiftright(whole, 2 * _WHOLE_BITS),
        _low(F.shiftright(whole, _WHOLE_BITS), _WHOLE_BITS),
        _low(whole, _WHOLE_BITS),
        F.shiftright(fraction, _FRACTION_BITS),
        _low(fraction, _FRACTION_BITS),
        F.when(fits, held - whole - fraction / float(10**DECIMALS)).otherwise(x),
    ]


def _from_sums(sums: list[Column]) -> Column:
    *limbs, rest = sums
    high, middle, low, upper, lower = [limb.cast("decimal(19,0)") for limb in limbs]
    whole = high * Decimal(1 << 2 * _WHOLE_BITS) + middle * Decimal(1 << _WHOLE_BITS) + low
    units = (upper * Decimal(1 << _FRACTION_BITS) + lower).cast("decimal(25,0)")
    fraction = (units * Decimal(1).scaleb(-DECIMALS)).cast("decimal(30,12)")
    # 25 whole digits and 12 decimals fill a decimal; a larger double has no decimals
    exact = F.coalesce((whole.try_cast("decimal(25,0)") + fraction).cast("double"), whole.cast("double"))
    return exact + rest


def exact_sum(x: Column) -> Column:
    """Sum of one value per row; NULL when there is none."""
    return _from_sums([F.sum(part) for part in _parts(x)])


def exact_sum_over(x: Column, window: WindowSpec) -> Column:
    """``exact_sum`` over a window."""
    return _from_sums([F.sum(part).over(window) for part in _parts(x)])


def subtotal(x: Column, name: str) -> list[Column]:
    """The columns of a sum that ``sum_of_subtotals`` finishes over coarser groups."""
    return [F.sum(part).alias(f"{name}_{i}") for i, part in enumerate(_parts(x))]


def sum_of_subtotals(name: str) -> Column:
    return _from_sums([F.sum(f"{name}_{i}") for i in range(_N_PARTS)])


def exact_avg(x: Column) -> Column:
    """Mean of the non-null values."""
    return F.try_divide(exact_sum(x), F.count(x))


def commission_rate(commission: Column, value: Column) -> Column:
    """Commission per unit of value in one operation; NULL where the value is 0."""
    return commission / F.nullif(value, F.lit(0.0))


def mean_rate(ratio: Column) -> Column:
    """Mean of per-operation ratios, in percent."""
    return exact_avg(ratio) * 100


def operation_rate() -> Column:
    return commission_rate(F.col("commission"), F.col("business_value"))


def sum_commission() -> Column:
    return exact_sum(F.col("commission"))


def sum_value() -> Column:
    return exact_sum(F.col("business_value"))


def avg_commission() -> Column:
    return exact_avg(F.col("commission"))


def avg_rate() -> Column:
    return mean_rate(operation_rate())


def rows() -> Column:
    return F.count(F.lit(1))

"""Ordered windows per key, and the expressions over them that series work shares."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], *by) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def rolling(keys: list[str], by: list, rows: int) -> WindowSpec:
    return ordered(keys, *by).rowsBetween(1 - rows, 0)


def full(value: Column, spec: WindowSpec, rows: int, of: Column) -> Column:
    """value, but null until the frame has ``rows`` values."""
    return F.when(F.count(of).over(spec) >= rows, value)


def returns(price: str, spec: WindowSpec, periods: int = 1, log: bool = False) -> Column:
    before = F.lag(price, periods).over(spec)
    ratio = F.when(before != 0, F.col(price) / before)
    return F.ln(ratio) if log else ratio - 1


def forward_fill(col: str, spec: WindowSpec, limit: int | None = None) -> Column:
    """The last value at or before the row, at most ``limit`` rows back."""
    return F.last(col, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def backward(keys: list[str], *by: str) -> WindowSpec:
    """The order reversed: what follows a row becomes what precedes it, and a running frame takes linear time (one with an unbounded end doesn't)."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])


def back_fill(col: str, keys: list[str], by: list[str], limit: int | None = None) -> Column:
    """The next value at or after the row, at most ``limit`` rows on."""
    return forward_fill(col, backward(keys, *by), limit)


def compounded(ret: str, spec: WindowSpec) -> Column:
    """Running product of 1 + ret; exact in sign where factors are zero or negative."""
    run = spec.rowsBetween(Window.unboundedPreceding, 0)
    factor = 1 + F.col(ret)
    size = F.exp(F.sum(F.when(factor != 0, F.ln(F.abs(factor)))).over(run))
    zeros = F.sum((factor == 0).cast("int")).over(run)
    negative = F.sum((factor < 0).cast("int")).over(run)
    return F.when(zeros > 0, 0.0).otherwise(F.when(negative % 2 == 1, -size).otherwise(size))

"""Small numeric column functions with the guards the features rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate a value once and use it in a body; a lambda would otherwise recompute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_number(c: Column | str) -> Column:
    """Number or null, never an error; NaN counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def nan_to_zero(c: Column) -> Column:
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def safe_ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    r = F.when(b != 0, a / b)
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(z, -30, 30)))


def blend(a: Column, b: Column, weight: float | Column) -> Column:
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return w * a + (1.0 - w) * b


def from_epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c.cast("bigint"))


def row_total(items: list[str]) -> Column:
    """Sum of all items, null unless every item is present."""
    total = F.col(items[0])
    for c in items[1:]:
        total = total + F.col(c)
    return total

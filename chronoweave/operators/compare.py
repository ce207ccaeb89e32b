"""Comparing columns: numbers within tolerances, everything else exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StructType, VariantType

ATOL, RTOL = 1e-10, 1e-7


def is_number(a: DataType, b: DataType) -> bool:
    return all(isinstance(t, NumericType | BooleanType) for t in (a, b))


def as_number(c: Column) -> Column:
    return c.cast("double")


def as_text(c: Column, kind: DataType) -> Column:
    return F.to_json(c) if isinstance(kind, ArrayType | MapType | StructType | VariantType) else c.cast("string")


def differs(old: Column, new: Column, old_type: DataType, new_type: DataType, atol: float, rtol: float) -> Column:
    """Both known and unlike each other; ``new`` sets the scale of the relative tolerance."""
    if is_number(old_type, new_type):
        a, b = as_number(old), as_number(new)
        unlike = F.abs(a - b) > F.lit(atol) + F.lit(rtol) * F.abs(b)
    elif old_type == new_type and not isinstance(old_type, MapType):
        unlike = old != new
    else:
        unlike = as_text(old, old_type) != as_text(new, new_type)
    return F.coalesce(old.isNotNull() & new.isNotNull() & unlike, F.lit(False))


def flips(old: Column, new: Column) -> Column:
    """Null on one side only."""
    return old.isNull() != new.isNull()

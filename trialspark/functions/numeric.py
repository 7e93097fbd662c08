"""Numeric rules shared by the relational and clinical operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.functions.text import ColumnOrName, _col


def round_scaled(value: ColumnOrName, digits: int) -> Column:
    """Round a double half away from zero on its scaled binary value.

    Spark's ``round`` works on the shortest decimal text of a double
    (1.005 -> 1.01); scaling first keeps the binary value (1.005 -> 1.0).
    """
    scale = float(10**digits)
    return F.round(_col(value).cast("double") * F.lit(scale)) / F.lit(scale)


def number_from_text(value: ColumnOrName, strict: bool = False) -> Column:
    """32-bit float held in a text column; null (or an error if ``strict``) for other text."""
    column = _col(value)
    return column.cast("float") if strict else column.try_cast("float")


def percent_where(condition: Column, value: ColumnOrName) -> Column:
    """Aggregate: share of the non-null values that meet the condition, in percent."""
    present = _col(value).isNotNull()
    return F.lit(100.0) * F.avg(F.when(present & condition, 1.0).when(present, 0.0))

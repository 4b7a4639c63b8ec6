"""Compute a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections see as plain columns.

    The optimizer moves filters below projections by copying the expression into
    the filter. For a long formula used in several places that multiplies work
    and generated code. A generator with one row per input row stays where it is.
    """
    keep = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))

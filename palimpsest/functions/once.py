"""Columns computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once.

    Later filters on a plain projection are pushed below it and repeat its expressions (JSON parsing among them); they do
    not pass a generator, so the columns come from a one-element one.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

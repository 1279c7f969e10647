"""Columns that an operator carries but doesn't read, kept clear of its own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(df: DataFrame, used: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[Column]]:
    """The frame with all but the used columns under neutral names, and the columns that bring the names back, whatever
    these are: names of the operator's own columns, names with dots, or names that stand twice."""
    names = [c if c in used else f"_aside_{k}" for k, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns)]

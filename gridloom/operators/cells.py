"""Columns of a table as text or as numbers, whatever their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import num


def column(df: DataFrame, name: str) -> Column:
    """The first column of that name; ValueError if there is none."""
    if name not in df.columns:
        raise ValueError(f"Column {name} not found")
    return F.col(f"`{name}`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def as_text(df: DataFrame, name: str) -> Column:
    """The cell as text; missing cells are ''."""
    c = column(df, name)
    return F.coalesce(c if df.schema[name].dataType == T.StringType() else c.cast("string"), F.lit(""))


def as_number(df: DataFrame, name: str) -> Column:
    return column(df, name).cast("double") if is_numeric(df, name) else num(as_text(df, name))

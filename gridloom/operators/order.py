"""Row numbers, sorting, pages and distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_number, utrim
from ..sources import files
from .cells import as_number, as_text, column, is_numeric

ROW = "_row_idx"


@dataclass(frozen=True)
class SortSpec:
    column: str
    descending: bool = False
    numeric: bool | None = None  # None: by the column's type or label


#: A key of an order: what is compared, and whether it descends. Missing ones come last.
Key = tuple[Column, bool]


def number_rows(df: DataFrame, name: str = ROW, first: int = 0, scan: bool = False) -> DataFrame:
    """Adds the dense ordinal of each row in the order of the frame's partitions.

    The rows are written once with their partition and their place in it, and both the
    partitions' counts and the rows are read from there: a second run of a sort may deal
    its rows to other partitions. scan: the frame is a plain scan of files, whose
    partitions are the same each time, so nothing is written. No task sees more than a
    partition.
    """
    spark = df.sparkSession
    tagged = df.withColumn("_row_at", F.monotonically_increasing_id())
    if not scan:
        path = files.scratch(spark, "rows")
        tagged.write.parquet(path)
        tagged = spark.read.schema(tagged.schema).parquet(path)
    part = F.shiftright("_row_at", 33).cast("int")
    counts = sorted(tuple(r) for r in tagged.groupBy(part.alias("part")).count().collect())  # a row for each partition
    offsets, total = [], first
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets, "_row_part int, _row_start long")
    out = tagged.withColumn("_row_part", part).join(F.broadcast(starts), "_row_part", "left")
    return out.withColumn(name, F.col("_row_start") + F.col("_row_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row_at", "_row_part", "_row_start")


def sort_keys(df: DataFrame, specs: Sequence[SortSpec]) -> list[Key]:
    """Order by the newest spec first; older ones decide ties. Numbers come before what is none, either way round."""
    keys: list[Key] = []
    for s in specs:
        column(df, s.column)
        if s.numeric if s.numeric is not None else is_numeric(df, s.column):
            n = as_number(df, s.column)
            keys.append((F.when(is_number(n), n), s.descending))
        else:
            keys.append((F.lower(as_text(df, s.column)), s.descending))
    return keys


def ordered(df: DataFrame, keys: Sequence[Key], ties: Sequence[Column] = ()) -> tuple[DataFrame, list[Column]]:
    """The frame with its keys as columns __key0, ..., computed once a row and not at each comparison, and the order by them and then by ties."""
    names = [f"__key{i}" for i in range(len(keys))]
    out = df.withColumns({n: c for n, (c, _) in zip(names, keys, strict=True)}) if names else df
    by = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last() for n, (_, down) in zip(names, keys, strict=True)]
    return out, [*by, *ties]


def _plain(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    return df.drop(*(f"__key{i}" for i in range(len(keys))))


def positions(df: DataFrame, keys: Sequence[Key], ties: Sequence[Column] = (), name: str = "pos") -> DataFrame:
    """The frame in order, with each row's place from 1 on; keys and ties together must tell all rows apart."""
    some, by = ordered(df, keys, ties)
    return number_rows(_plain(some.orderBy(*by), keys), name, 1)


def page(df: DataFrame, keys: Sequence[Key], ties: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the order; fewer at its end."""
    some, by = ordered(df, keys, ties)
    return _plain(some.orderBy(*by).offset(offset).limit(limit), keys)


def first_rows(df: DataFrame, keys: Sequence[Column], n: int | None) -> DataFrame:
    """The first n rows in order; all for None."""
    return df if n is None else df.orderBy(*keys).limit(n)


def unique_values(df: DataFrame, name: str) -> DataFrame:
    """v: distinct trimmed values of a text column; of a column of numbers, its distinct values."""
    if is_numeric(df, name):
        return df.select(column(df, name).alias("v")).distinct()
    return df.select(utrim(as_text(df, name)).alias("v")).distinct()


def unique_keys(df: DataFrame, numeric: bool) -> list[Key]:
    """The order of distinct values: numbers ascending, then text by code point."""
    text = isinstance(df.schema["v"].dataType, T.StringType)
    if not numeric:
        return [(F.col("v"), False)]
    n = as_number(df, "v")
    return [(F.when(is_number(n), n), False), *([(F.col("v"), False)] if text else [])]


def search_values(values: DataFrame, part: str) -> DataFrame:
    """Distinct values that contain a text, in any case."""
    return values.where(F.lower(F.col("v").cast("string")).contains(F.lower(F.lit(part))))

"""Cleaning: duplicates, white space, missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, fmt_num, is_number, utrim
from ..sources import files
from .cells import as_number, as_text, column, is_numeric
from .order import first_rows

#: Rows from which a mean, median or mode is taken by default.
SAMPLE_ROWS = 10_000


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row in order for each distinct tuple of keys; unknown keys are skipped, no keys keep one row.

    Which rows these are is found from keys and order alone: each task keeps one entry for a
    key before anything is shuffled, so a frequent key costs no more than any other. The
    rows are then fetched by their order, which must tell rows apart; few of them are so
    picked out where they are, and only columns that someone asks for are read.
    """
    known = [f"`{k}`" for k in dict.fromkeys(keys) if k in df.columns]
    order = list(order)
    at = order[0] if len(order) == 1 else F.struct(*order)
    place = at.alias("_at")
    best = (F.max if last else F.min)("_at").alias("_best")
    narrow = df.select(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(known)), place)
    found = narrow.groupBy(*(f"_key{n}" for n in range(len(known)))).agg(best) if known else narrow.agg(best).where("_best is not null")
    return df.join(found.select("_best"), at.eqNullSafe(F.col("_best")), "left_semi")


def trim(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Listed text columns without Unicode white space at their ends; unknown names are ignored."""
    some = [n for n in dict.fromkeys(names) if n in df.columns]
    return df.withColumns({n: utrim(as_text(df, n)) for n in some}) if some else df


def median_of_all(numbers: DataFrame) -> DataFrame:
    """One row, v: the exact median of column n, however many values it has; null if there is none.

    The counts of distinct values are written once in order. From the partitions' sums
    it is known which one or two hold the middle, and only these are looked through.
    """
    spark = numbers.sparkSession
    path = files.scratch(spark, "median")
    counts = numbers.where("n is not null").select(F.col("n").cast("double")).groupBy("n").agg(F.count("*").alias("c"))
    counts = counts.orderBy("n").withColumn("part", F.spark_partition_id())
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    parts = sorted(tuple(r) for r in counts.groupBy("part").agg(F.sum("c")).collect())  # a row for each partition
    total = sum(n for _, n in parts)
    middle = ((total - 1) // 2, total // 2)
    weight, at, some = F.lit(0.0), 0, []
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("n"))
    for part, n in parts:
        for place in middle:
            if at <= place < at + n:
                some.append(part)
                here = (F.col("part") == part) & (F.col("upto") - F.col("c") <= place - at) & (F.col("upto") > place - at)
                weight = weight + F.when(here, 0.5).otherwise(0.0)
        at += n
    return counts.where(F.col("part").isin(some)).withColumn("upto", upto).withColumn("w", weight).where("w > 0").agg(F.sum(F.col("n") * F.col("w")).alias("v"))


def statistic(df: DataFrame, name: str, kind: str, order: Sequence[Column] = (), sample_rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """One row, v: the Mean or Median of what is a number, or the Mode of what is not blank; null if there is none.

    The most frequent value wins, of equally frequent ones the least. sample_rows: only
    so many rows of the order count; None for all.
    """
    some = first_rows(df, order, sample_rows)
    if kind in ("Mean", "Median"):
        n = as_number(df, name)
        numbers = some.select(F.when(is_number(n), n).alias("n"))
        if kind == "Median" and sample_rows is None:
            return median_of_all(numbers)
        return numbers.agg((F.avg("n") if kind == "Mean" else F.median("n")).alias("v"))
    if kind == "Mode":
        t = utrim(as_text(df, name))
        counts = some.select(t.alias("v")).where("v <> ''").groupBy("v").agg(F.count("*").alias("n"))
        return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    raise ValueError(f"Invalid fill type {kind}")


def fill_missing(df: DataFrame, name: str, kind: str, value: str = "", order: Sequence[Column] = (), sample_rows: int | None = SAMPLE_ROWS, sample: DataFrame | None = None) -> DataFrame:
    """Cells that are blank (or null) filled with a Value, the Mean, the Median or the Mode, or their rows left out (Drop).

    sample: the frame that the statistic is taken from, if not this one. In a column of
    text, a mean of nothing is 0 and numbers are written without exponent; a column of
    numbers becomes a double.
    """
    cell = column(df, name)
    numeric = is_numeric(df, name)
    missing = cell.isNull() | (F.isnan(cell.cast("double")) if numeric else blank(as_text(df, name)))
    if kind == "Drop":
        return df.where(~missing)
    if kind == "Value":
        return df.withColumn(name, F.when(missing, F.lit(value).try_cast(df.schema[name].dataType)).otherwise(cell))
    found = statistic(df if sample is None else sample, name, kind, order, sample_rows).scalar()
    if numeric and kind != "Mode":
        return df.withColumn(name, F.when(missing, found).otherwise(cell.cast("double")))
    text = F.coalesce(fmt_num(found) if kind != "Mode" else found, F.lit("" if kind == "Mode" else "0"))
    return df.withColumn(name, F.when(missing, text.try_cast(df.schema[name].dataType)).otherwise(cell))

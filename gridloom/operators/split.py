"""Splitting a table into files by row count or by a column's values."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_safe
from ..sources import files
from .cells import as_text
from .order import ROW

ROWS = 50_000
#: Parts that are put in their places at a time.
THREADS = 32


def by_rows(df: DataFrame, limit: int = ROWS) -> DataFrame:
    """Adds part, from 1 on: each limit rows of the table's order are one; a limit of 0 is one row each."""
    return df.withColumn("part", (F.floor(F.col(ROW) / F.lit(max(1, limit))) + 1).cast("long"))


def by_value(df: DataFrame, name: str) -> DataFrame:
    """Adds part: a column's value as part of a file name."""
    return df.withColumn("part", file_safe(as_text(df, name)))


def write_parts(df: DataFrame, folder: str, stem: str, delimiter: str = ",", extension: str = "csv", one_file: bool = False) -> list[str]:
    """CSV, {stem}_{part}.{extension}, for each part; returns the paths in the order of the parts' first rows. A row goes out as its cells, without part.

    df has row numbers, whose order each part keeps. one_file: a part is one file, all
    rows of which pass one task. Else it is a folder of files in order, and a part may
    hold any share of the rows.
    """
    spark = df.sparkSession
    parts = df.withColumn("__part", F.col("part").cast("string")).drop("part")
    # a row for each path that is returned
    firsts = [r[0] for r in parts.groupBy("__part").agg(F.min(ROW).alias("first")).orderBy("first").collect()]
    # by the part alone each part meets in one task; by ranges of rows within it, a large one is spread over several in order
    dealt = parts.repartition("__part") if one_file else parts.repartitionByRange("__part", ROW)
    aside = files.scratch(spark, "split")
    out_rows = dealt.sortWithinPartitions("__part", ROW).drop(ROW)
    out_rows.write.partitionBy("__part").options(header=True, sep=delimiter, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(aside)
    p, fs = files._path(spark, folder)
    fs.mkdirs(p)
    there = set(files.children(spark, folder))
    # Spark escapes what is not fit for a folder's name; a part's own name is not escaped
    made = {files.unescaped(spark, name.removeprefix("__part=")): name for name in files.children(spark, aside) if name.startswith("__part=")}

    def put(part: str) -> str:
        here, name = f"{aside}/{made[part]}", f"{stem}_{part}.{extension}"
        if one_file:
            (here,) = (f"{here}/{n}" for n in files.children(spark, here) if n.startswith("part-"))
        (files.replace if name in there else files.move)(spark, here, f"{folder.rstrip('/')}/{name}")
        return f"{folder.rstrip('/')}/{name}"

    # a part is a call or two to the file system, many at a time
    with ThreadPoolExecutor(THREADS) as pool:
        out = list(pool.map(put, firsts))
    files.delete(spark, aside)
    return out

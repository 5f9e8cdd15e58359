"""Views that are written once in their order, so that a page is read from the files that hold its rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from .order import Key, _plain, ordered

PLACE = "_place"


@dataclass(frozen=True)
class StoredView:
    """Files in order, with the place of each one's first row among all, the number it has in the file, and its rows."""

    path: str
    schema: T.StructType
    parts: tuple[tuple[str, int, int, int], ...]

    @property
    def count(self) -> int:
        return sum(n for _, _, _, n in self.parts)

    def page(self, spark: SparkSession, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit in order; fewer at the end. Other files than those of the rows are not opened, and in these the parts that hold none are left out."""
        out, end, offset = None, offset + limit, max(0, offset)
        for file, start, first, n in self.parts:
            if start < end and offset < start + n:
                low, high = first + max(0, offset - start), first + min(n, end - start)
                some = spark.read.schema(self.schema).parquet(file).where((F.col(PLACE) >= low) & (F.col(PLACE) < high))
                out = some if out is None else out.union(some)
        return (spark.createDataFrame([], self.schema) if out is None else out).drop(PLACE)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path).drop(PLACE)

    def delete(self, spark: SparkSession) -> None:
        files.delete(spark, self.path)


def store(df: DataFrame, keys: Sequence[Key], ties: Sequence[Column]) -> StoredView:
    """Writes a frame in order, one file for each partition of the sort."""
    spark = df.sparkSession
    with files.lasting():
        path = files.scratch(spark, "view")
    some, by = ordered(df, keys, ties)
    placed = _plain(some.orderBy(*by), keys).withColumn(PLACE, F.monotonically_increasing_id())
    placed.write.parquet(path)
    found = spark.read.schema(placed.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(PLACE).alias("first"), F.count("*").alias("n"))
    parts, start = [], 0
    for r in sorted(found.collect(), key=lambda r: r["first"]):  # a row for each file
        parts.append((r["file"], start, r["first"], r["n"]))
        start += r["n"]
    return StoredView(path, placed.schema, tuple(parts))

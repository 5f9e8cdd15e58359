"""Delimited files that keep arriving in a folder: filtered by rules, and without repeated keys, as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rules import Rule, passed


def read_arrivals(spark: SparkSession, folder: str, headers: Sequence[str], delimiter: str = ",") -> DataFrame:
    """Every file of a folder once, all cells as text; missing ones are ''. _arrived is when a file was last changed."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    rows = spark.readStream.schema(schema).options(header=True, sep=delimiter, quote='"', escape='"', multiLine=True).csv(folder)
    return rows.select(*(F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers), F.col("_metadata.file_modification_time").alias("_arrived"))


def filter_arrivals(stream: DataFrame, rules: Sequence[Rule], conjunction: str = "AND") -> DataFrame:
    return passed(stream, rules, conjunction)


def first_arrivals(stream: DataFrame, keys: Sequence[str], remember: str = "1 day") -> DataFrame:
    """One row for each tuple of keys; a key is remembered for a time, which bounds the state."""
    return stream.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark(list(keys))

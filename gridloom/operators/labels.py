"""Labels of columns: Numeric, Datetime, Boolean or String, by a vote of the first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, num, utrim
from .cells import as_text
from .order import first_rows

#: Rows that vote, and the order in which ties are decided.
SAMPLE_ROWS = 100
LABELS = ("Numeric", "Datetime", "Boolean", "String")


def label(c: Column) -> Column:
    """A cell's label; null for a blank one."""
    t = utrim(c)
    count = lambda sign: F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))
    date = ((count("-") == 2) | (count("/") == 2)) & (F.octet_length(t) >= 8)
    return F.when(blank(c), None).when(F.lower(t).isin("true", "false") & (F.octet_length(t) == F.length(t)), "Boolean").when(num(c).isNotNull(), "Numeric").when(date, "Datetime").otherwise("String")


def infer_labels(df: DataFrame, order: Sequence[Column], sample_rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """name, data_type of every column: the label most of its cells that are not blank have, String where all are."""
    names = df.columns
    sample = first_rows(df, order, sample_rows).select(*(as_text(df, n).alias(n) for n in names))
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("name"), label(F.col(f"`{n}`")).alias("label")) for i, n in enumerate(names))))
    votes = sample.select(pairs.alias("x")).select("x.*").groupBy("at", "name", "label").agg(F.when(F.col("label").isNotNull(), F.count("*")).otherwise(0).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.coalesce("label", F.lit("String")))
    best = votes.groupBy("at", "name").agg(F.max_by(F.coalesce("label", F.lit("String")), F.struct(F.col("n"), -rank)).alias("data_type"))
    return best.select("name", "data_type")

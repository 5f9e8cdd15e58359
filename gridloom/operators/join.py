"""Joins of two tables on one key each, as a lookup: of B's rows with a key the last one counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from .cells import column
from .clean import keep_first

#: Rows of one key of A from which on it is not shuffled: so many, and one in so many of all.
HOT_ROWS, HOT_SHARE = 10_000, 10_000
KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def lookup_join(a: DataFrame, b: DataFrame, key_a: str, key_b: str, kind: str, order_b: Sequence[Column], unique_b: bool = False) -> DataFrame:
    """A's columns, then B's but for its key, each with _b after its name.

    Keys are compared exactly, '' too; missing text keys of A read as '', rows of B
    without a key match nothing. Where one side has no row its text cells are '', others
    null, and A's key cell has the key. unique_b: B's keys are known to differ. Spark
    chooses how to join by size as it runs, and splits what has too many rows of one key;
    where it can't, as B's unmatched rows are asked for, A's frequent keys are told apart.
    """
    if kind not in KINDS:
        raise ValueError(f"Unknown join type {kind}")
    text = a.schema[key_a].dataType == T.StringType()
    key = F.coalesce(column(a, key_a), F.lit("")) if text else column(a, key_a)
    last = b.where(column(b, key_b).isNotNull())
    last = last if unique_b else keep_first(last, [key_b], order_b, last=True)
    left = a.select(F.struct(*(F.col(f"`{c}`") for c in a.columns)).alias("_a"), key.alias("_ka"))
    right = last.select(F.struct(*(F.col(f"`{c}`") for c in b.columns)).alias("_b"), F.col(f"`{key_b}`").alias("_kb"))
    both = _spread(left, right, kind) if kind in ("right", "outer") else left.join(right, F.col("_ka") == F.col("_kb"), KINDS[kind])

    def cell(side: str, frame: DataFrame, name: str) -> Column:
        c = F.col(f"{side}.`{name}`")
        return F.coalesce(c, F.lit("")) if frame.schema[name].dataType == T.StringType() else c

    out = [F.coalesce("_ka", "_kb").alias(c) if c == key_a else cell("_a", a, c).alias(c) for c in a.columns]
    return both.select(*out, *(cell("_b", b, c).alias(f"{c}_b") for c in b.columns if c != key_b))


def _spread(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """A right or outer join whose frequent keys of A meet B's rows (one for each key) without a shuffle.

    Keys that more than a ten-thousandth of A's rows share (and HOT_ROWS at least) are ten
    thousand at most. B's rows for them all have a match, so none of them is asked for as
    unmatched. A's rows without a key match nothing.
    """
    same, without = F.col("_ka") == F.col("_kb"), left.where("_ka is null")
    keyed = left.where("_ka is not null")
    path = files.scratch(left.sparkSession, "hot-keys")
    bound = max(HOT_ROWS, left.count() // HOT_SHARE)
    keyed.groupBy("_ka").count().where(F.col("count") > bound).select("_ka").write.parquet(path)
    hot = left.sparkSession.read.schema(keyed.select("_ka").schema).parquet(path)
    if hot.isEmpty():
        out = keyed.join(right, same, KINDS[kind])
    else:
        a, b = F.broadcast(hot), F.broadcast(hot.withColumnRenamed("_ka", "_kb"))
        out = keyed.join(a, "_ka", "left_anti").select(*keyed.columns).join(right.join(b, "_kb", "left_anti").select(*right.columns), same, KINDS[kind])
        frequent = keyed.join(a, "_ka", "left_semi").select(*keyed.columns)
        out = out.unionByName(frequent.join(F.broadcast(right.join(b, "_kb", "left_semi").select(*right.columns)), same, "left" if kind == "outer" else "inner"))
    if kind == "outer":
        out = out.unionByName(without.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema)))
    return out

"""Sharding by extendible hashing, with DataFrame functions only.

A row's address is a string of hash bits: 60 of md5(key), then 60 of md5(row
number), so that repeated keys can be told apart too. The directory starts as one
bucket; a bucket over the byte limit is split on its next bit, others stay whole.
Sizes are summed for up to 16 bits of address at a time, as many as the largest open
bucket needs, so 100 TB take two or three rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import shared_dir, staged

#: Address bits looked at in one round at most; the first directory has at most 2**STEP rows.
STEP = 16
WORD = 60


def _bits(value: Column) -> Column:
    """60 bits of a value's md5 as a string of 0 and 1."""
    return F.lpad(F.bin(F.conv(F.substring(F.md5(value), 1, WORD // 4), 16, 10).cast("long")), WORD, "0")


def _address(start: int, bits: int) -> Column:
    """The bits of one round as an integer."""
    return F.conv(F.substring("_bits", start + 1, bits), 2, 10).cast("int")


def with_shards(rows: DataFrame, max_bytes: int, key: str, size: Column | str) -> DataFrame:
    """Adds shard, depth, shard_bytes and shard_rows to every row, all rows kept.

    key: column to hash (null hashes as the empty string). size: a row's bytes (null
    counts 0). A shard is named by its prefix of address bits, the whole table being
    ''. Every shard holds at most max_bytes, unless it is a single larger row. Rows
    that repeat, key included, are spread by their row number. Columns of the input
    named like the new ones are replaced. An empty table gives no rows.
    """
    new = ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
    keep = [c for c in rows.columns if c not in new]
    # the row number must not change when a task runs again: it is written once
    base = staged(
        rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), F.coalesce(size if isinstance(size, Column) else F.col(size), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_key"), F.monotonically_increasing_id().alias("_n")),
        "shard-rows",
    ).withColumn("_bits", F.concat(_bits(F.col("_key")), _bits(F.col("_n").cast("string"))))

    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    if total[0] <= max_bytes or total[1] <= 1:
        one = [F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total[0]).cast("long").alias("shard_bytes"), F.lit(total[1]).cast("long").alias("shard_rows")]
        return base.select("_row.*", "n_bytes", *one)

    # the rounds see row numbers and sizes alone; each is written once, for the rows that are done and for the next one
    open_rows, path, start, largest, done = base.select("_n", "n_bytes", "_bits"), [], 0, total[0], []
    while True:
        # as many bits as the largest open bucket needs to be cut into parts that fit, and two more
        bits = min(STEP, max(1, -(-largest // max(1, max_bytes)) - 1).bit_length() + 2, 2 * WORD - start)
        last = start + bits == 2 * WORD  # only rows alike in all bits are left with more than fits
        here = f"_a{start}"
        open_rows = open_rows.withColumn(here, _address(start, bits))
        above, path = path, [*path, here]
        cells = open_rows.groupBy(*path).agg(F.sum("n_bytes").alias("_b"), F.count("*").alias("_c"))
        nodes = cells.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(bits)))).withColumn("_node", F.expr(f"shiftright({here}, {bits} - _d)"))
        fits = (F.col("_b") <= max_bytes) | (F.col("_c") == 1) | (F.lit(last) & (F.col("_d") == bits))
        nodes = staged(nodes.groupBy(*above, "_d", "_node").agg(F.sum("_b").alias("_b"), F.sum("_c").alias("_c")).withColumn("_fits", fits), "shard-nodes")
        # a bucket is a node that fits under one that does not
        split = nodes.where("not _fits").select(*above, (F.col("_d") + 1).alias("_d"), F.col("_node").alias("_parent"))
        small = nodes.where("_fits").withColumn("_parent", F.shiftright("_node", 1))
        buckets = small.where("_d = 1").unionByName(small.join(split, [*above, "_d", "_parent"], "left_semi").select(small.columns))
        leaf = F.struct((F.col("_d") + start).alias("depth"), F.col("_b").alias("shard_bytes"), F.col("_c").alias("shard_rows")).alias("_leaf")
        first = F.expr(f"shiftleft(_node, {bits} - _d)")
        directory = buckets.select(*above, F.explode(F.sequence(first, first + F.expr(f"shiftleft(1, {bits} - _d)") - 1)).alias(here), leaf)
        if start == 0:
            directory = F.broadcast(directory)  # 2**STEP rows at most, whatever the input
        joined = staged(open_rows.join(directory, path, "left"), "shard-round")
        done.append(joined.where("_leaf is not null").select("_n", F.expr("substring(_bits, 1, _leaf.depth)").alias("shard"), "_leaf.*"))
        largest = nodes.where(F.col("_d") == bits).where("not _fits").agg(F.max("_b")).first()[0]
        if largest is None:
            break
        open_rows = joined.where("_leaf is null").drop("_leaf")
        start += bits
    leaves = done[0]
    for x in done[1:]:
        leaves = leaves.unionByName(x)
    return base.join(leaves, "_n").select("_row.*", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def shard_documents(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8 bytes of the text), shard, depth, shard_bytes and shard_rows of every document.

    A null text has no bytes, a null key hashes as the empty string; repeated rows are
    rows of their own, spread by their row number; other columns are neither read nor
    returned, so none can clash. No documents give no rows.
    """
    rows = docs.select(F.col(f"`{key}`"), F.octet_length(F.col(f"`{text}`")).cast("long").alias("_size"))
    return with_shards(rows, max_bytes, key, "_size").drop("_size")


def write_shards(docs: DataFrame, path: str | None, max_bytes: int, key: str = "doc_id", text: str = "text") -> str:
    """Writes whole rows as Parquet, one folder shard=<bits> for each shard; returns the path."""
    path = path or shared_dir(docs.sparkSession, "shards")
    out = with_shards(docs, max_bytes, key, F.octet_length(F.col(f"`{text}`")))
    # each shard is bounded by the limit, so a task per shard is too; _ keeps the root's empty name a valid folder
    out = out.withColumn("shard", F.concat(F.lit("_"), "shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
    return path

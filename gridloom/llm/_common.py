"""Helpers shared by the operators: shared folders, staged tables, Arrow blocks."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Bytes of text that a Python task works on at a time.
BLOCK_BYTES = 2 << 20
#: Bytes that Spark gives a Python task at a time, about; its own bound is a number of rows, however long.
ARROW_BYTES = 8 << 20
#: Bytes of text after which a Python task gives freed memory back.
RELEASE_BYTES = 32 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it

#: Rows of a key from which on it may be told apart from others in joins.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package (a cluster ships it with --py-files), and bounds what they are given at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, which all machines share; files.scratch_scope deletes what was made within it."""
    return files.scratch(spark, label)


def mounted_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir as a path that every machine can memory-map files of."""
    path = local_path(shared_dir(spark, label))
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped arrays need spark.checkpoint.dir to be a folder that all machines have mounted")
    os.makedirs(path, exist_ok=True)
    return path


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, lost executors cost nothing. options: of the files."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, label: str) -> DataFrame:
    """The frame itself if it is a plain scan of files, which has its rows in the same places each time it is read; else written once and read back."""
    plan = df._jdf.queryExecution().optimizedPlan()
    plain = plan.deterministic()
    while plain and plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return df if plain and plan.nodeName() == "LogicalRelation" else staged(df, label)


def join_counted(rows: DataFrame, found: DataFrame, on: str, total: int, count: str = "n") -> DataFrame:
    """Rows joined to a written table with one row for each key, which also counts the key's rows; total is the number of rows.

    Keys of more than a ten-thousandth of all rows (and of HOT rows at least) are at most
    ten thousand: these are sent to every task, so that their rows meet in none. The
    others' rows are shuffled by key.
    """
    hot = max(HOT, total // 10_000)
    heavy = F.broadcast(found.where(F.col(count) > hot).drop(count))
    light = found.where(F.col(count) <= hot).drop(count)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on))


def partitions(df: DataFrame) -> int:
    """Number of input partitions, which follows the input's bytes."""
    return max(1, df.rdd.getNumPartitions())


def local_path(uri: str) -> str:
    """The path of a file: URI as the machine sees it."""
    return uri.split(":", 1)[1].replace("//", "", 1) if uri.startswith("file:") else uri


def release() -> None:
    """Gives freed memory back to the machine: Python workers stay between tasks, and idle ones must not hold what they once used."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches by rows so that each holds about `most` bytes of one string column; a longer text stands alone. Frees memory as it goes and when it ends."""
    held = 0
    for batch in batches:
        col = batch.column(column)
        n = len(col)
        if not n:
            continue
        off = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)
        held += int(off[-1] - off[0])
        if held >= RELEASE_BYTES:
            release()
            held = 0
    release()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column after another, and where each text starts and the last one ends; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


_rng = np.random.Generator(np.random.PCG64(20240607))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SALT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT[65:91] = _SALT[97:123]  # A-Z hash as a-z
#: Bytes between words: white space, or whatever is neither a letter or digit nor outside ASCII.
SPACE = _SPACE
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STEP = 0x9E3779B97F4A7C15
_POW = np.array([pow(_STEP, i, 2**64) for i in range(256)], dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POW
    while len(_POW) < n:
        _POW = np.concatenate([_POW, _POW * np.uint64(pow(_STEP, len(_POW), 2**64))])
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(raw: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than those between words, A-Z as a-z), and words per text.

    A polynomial in odd 64-bit coefficients per byte, then mixed: equal words have
    equal hashes, different ones collide about once in 2**64 pairs.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    solid = ~between[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]  # a text's first byte begins a word even if the last text ended in one
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    length = np.diff(np.append(starts, n))
    pos = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, length)
    values = np.where(between, np.uint64(0), _SALT)[raw[starts[0] :]] * powers(int(length.max()))[pos]
    h = mix(np.add.reduceat(values, starts - starts[0]))
    return h, np.diff(np.searchsorted(starts, off))

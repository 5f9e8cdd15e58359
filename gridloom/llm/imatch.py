"""I-Match fingerprints of documents.

Terms whose inverse document frequency lies in a band are kept. A document's distinct
kept terms are sorted and hashed, once over the whole lexicon and once over each of
several random parts of it. Parts of five sizes are taken, each a quarter of the one
before, so that a text of any length has parts in which it has few terms: those survive
an edit. A document with no term in the band counts all its terms.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SIGNS, blocks, hash_words, mix, mounted_dir, partitions, powers, ready, text_bytes
from .runs import RUNS, MappedArrays, cut_runs, merged_runs, save_array, summed

#: Kept terms are in at least and at most these shares of the documents (and in two at least).
LEAST, MOST = 1 / 2000, 1 / 20
#: Parts of each size, and the sizes as powers of a quarter; size 0 is the whole lexicon, once.
PARTS, SIZES = 24, 5
#: Bits of a term's hash that name it.
TERM = np.uint64(44)
#: Entries of a task's counts before it sends them on.
FLUSH = 4_000_000
_LOW = np.uint64(2**44 - 1)
_SALTS = mix(np.arange(1, 2 * (1 + PARTS * SIZES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SHARES = [2.0**64, *(2.0**64 / 4**size for size in range(1, SIZES + 1) for _ in range(PARTS))]


def distinct_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text in order, one text after another, and how many each has. A block has fewer than 2**20 texts."""
    h, n = hash_words(*text_bytes(column), SIGNS)
    own = np.repeat(np.arange(len(n), dtype=np.uint64), n) << TERM | h >> np.uint64(20)
    own.sort()
    if len(own):
        own = own[np.concatenate([[True], own[1:] != own[:-1]])]
    return own & _LOW, np.bincount((own >> TERM).astype(np.int64), minlength=len(n))


@dataclass(frozen=True)
class Lexicon:
    """A folder of sorted arrays of the kept terms, in so many buckets."""

    folder: str
    buckets: int


def _term_bucket(terms: np.ndarray, n: int) -> np.ndarray:
    return (terms * np.uint64(n)) >> TERM


@lru_cache(maxsize=2)
def _terms(lexicon: Lexicon) -> MappedArrays:
    return MappedArrays(lexicon.folder, lexicon.buckets, ("term",))


def build_lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> Lexicon:
    """Counts in how many documents each term is, over all of them, and writes those in the band. Null texts have no terms."""
    spark = ready(docs.sparkSession)
    here = mounted_dir(spark, "lexicon")
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()
    n = max(1, size // (64 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for block in blocks(batches):
            terms, _ = distinct_terms(block.column("text"))
            held.append(summed(terms, np.ones(len(terms), np.int64)))
            entries += len(held[-1][0])
            if entries > FLUSH:
                k, c = summed(*map(np.concatenate, zip(*held, strict=True)))
                yield from cut_runs(_term_bucket(k, n), n, [k, c], "run")
                held, entries = [], 0
        if entries:
            k, c = summed(*map(np.concatenate, zip(*held, strict=True)))
            yield from cut_runs(_term_bucket(k, n), n, [k, c], "run")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (k, c) in merged_runs(batches, 2):
            kept = k[(c >= max(2, least * total)) & (c <= most * total)]
            if len(kept):
                save_array(here, "term", b, kept)
            yield pa.RecordBatch.from_pydict({"n": [len(kept)]})

    rows = docs.select(F.col(f"`{text}`").alias("text"))
    rows.mapInArrow(count, RUNS).repartitionById(n, F.col("bucket")).mapInArrow(keep, "n long").agg(F.sum("n")).collect()
    return Lexicon(here, n)


def signatures(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of 32-bit hashes for each text: the whole lexicon's, then each part's; 0 where a part has no term of the text."""
    terms, n = distinct_terms(column)
    text = np.repeat(np.arange(len(n)), n)
    known, back = np.unique(terms, return_inverse=True)
    own = _terms(lexicon)
    there, _, _ = own.find(known, _term_bucket(known, own.buckets), 0)
    kept = there[back]
    # a text without kept terms counts all it has
    kept |= (np.bincount(text[kept], minlength=len(n)) == 0)[text]
    terms, text = terms[kept], text[kept]
    out = np.zeros((len(n), len(_SHARES)), np.uint32)
    for i, share in enumerate(_SHARES):
        spread = mix(terms ^ _SALTS[2 * i])
        inside = np.arange(len(terms)) if share >= 2.0**64 else np.flatnonzero(spread < np.uint64(share))
        if not len(inside):
            continue
        own = text[inside]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        # terms are in order: a polynomial of their hashes, by their places in the sorted list
        place = np.arange(len(inside)) - np.repeat(starts, np.diff(np.append(starts, len(inside))))
        whole = np.add.reduceat(mix(spread[inside] + _SALTS[2 * i + 1]) * powers(int(place.max()) + 1)[place], starts)
        out[own[starts], i] = np.maximum((mix(whole) >> np.uint64(32)).astype(np.uint32), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of equal hashes among parts that have terms of either text, from the smallest parts up until PARTS such are met; 1 for equal rows."""
    same, any_ = (a == b) & (a > 0), (a > 0) | (b > 0)
    hits, seen, done = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a), bool)
    for size in range(SIZES, -1, -1):
        cols = slice(0, 1) if size == 0 else slice(1 + (size - 1) * PARTS, 1 + size * PARTS)
        hits += np.where(done, 0, same[:, cols].sum(axis=1))
        seen += np.where(done, 0, any_[:, cols].sum(axis=1))
        done |= seen >= PARTS
    return np.where((a == b).all(axis=1), 1.0, hits / np.maximum(seen, 1))


def _hex(rows: np.ndarray) -> list[str]:
    raw = rows.astype(">u4").tobytes().hex()
    width = rows.shape[1] * 8
    return [raw[i : i + width] for i in range(0, len(raw), width)] if width else []


def fingerprints(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (8 hexadecimal digits for the lexicon and for each part) of every row; equal texts have equal ones, null is empty."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(_hex(signatures(block.column("text"), lexicon)))], names=["key", "fingerprint"])

    return rows.mapInArrow(each, T.StructType([rows.schema["key"], T.StructField("fingerprint", T.StringType())])).withColumnRenamed("key", key)


def compare_with_edits(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of code points (rounded down) replaced by the
    first as many of the next document, or all it has; the next is the one before in the
    order of keys, and after the last comes the first. Rows of equal keys are ordered by
    a hash of their texts, null keys come last; null texts are empty. A single row is its
    own next. Other columns are neither read nor returned. No rows give none.
    """
    spark = ready(docs.sparkSession)
    n = partitions(docs)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hashed = rows.select("key", F.xxhash64("text").alias("h"))
    # ranges of keys and hashes, so that rows of one key are dealt out too: one least pair for each partition
    ranged = hashed.repartitionByRange(n, "key", "h").withColumn("part", F.spark_partition_id())
    least = sorted((r.low["key"] is not None, r.low["key"], r.low["h"]) for r in ranged.groupBy("part").agg(F.min(F.struct("key", "h")).alias("low")).collect())

    def part_of(k, h: int) -> int:
        return max(0, bisect_right(least, (k is not None, k, h)) - 1)

    kind = rows.schema["key"].dataType
    fields = [T.StructField("part", T.IntegerType()), T.StructField("key", kind), T.StructField("h", T.LongType()), T.StructField("text", T.StringType())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array(list(map(part_of, batch.column(0).to_pylist(), batch.column(1).to_pylist())), pa.int32())
            yield pa.RecordBatch.from_arrays([parts, *batch.columns], names=["part", *batch.schema.names])

    greatest = hashed.mapInArrow(place, T.StructType(fields[:3])).groupBy("part").agg(F.max(F.struct("key", "h")).alias("first")).collect()  # a row for each partition
    # the first row of a partition is also what comes after the last row of the one above
    filled = sorted((r.part for r in greatest), reverse=True)
    above = dict(zip(filled, [filled[-1], *filled[:-1]] if filled else [], strict=True))
    firsts = {r.part: (r.first["key"], r.first["h"]) for r in greatest}
    schema = T.StructType([*fields, T.StructField("extra", T.BooleanType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = list(map(part_of, keys, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns, pa.array([False] * len(keys))], names=schema.names)
            more = [i for i, (p, k, h) in enumerate(zip(parts, keys, hashes, strict=True)) if firsts[p] == (k, h)]
            if more:
                some = batch.take(pa.array(more))
                yield pa.RecordBatch.from_arrays([pa.array([above[parts[i]] for i in more], pa.int32()), *some.columns, pa.array([True] * len(more))], names=schema.names)

    dealt = rows.select("key", F.xxhash64("text").alias("h"), "text").mapInArrow(deal, schema).repartitionById(max(1, len(least)), F.col("part"))
    dealt = dealt.sortWithinPartitions(F.col("part"), F.col("extra"), F.col("key").desc_nulls_last(), F.col("h").desc())

    def finish(keys: list, texts: list[str], following: str) -> pa.RecordBatch:
        edited = []
        for own, after in zip(texts, [*texts[1:], following], strict=True):
            third = len(own) // 3
            edited.append(own[: len(own) - third] + after[:third])
        prints, changed = signatures(pa.array([*texts, following], pa.large_string()), lexicon), signatures(pa.array(edited, pa.large_string()), lexicon)
        own = prints[:-1]
        cols = [pa.array(keys, arrow_kind[0]), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_hex(own)), pa.array(_hex(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, prints[1:]))]
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_schema.fields])

    names = (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))
    out_schema = T.StructType([T.StructField("key", kind), *(T.StructField(a, b) for a, b in names)])
    arrow_kind: list[pa.DataType] = []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held, closed = [], [], False
        for block in blocks(batches):
            arrow_kind[:] = [block.column("key").type]
            for k, t, extra in zip(block.column("key").to_pylist(), block.column("text").to_pylist(), block.column("extra").to_pylist(), strict=True):
                if not extra:
                    held_keys.append(k)
                    held.append(t)
                elif not closed:  # repeated rows repeat it
                    yield finish(held_keys, held, t)
                    held_keys, held, closed = [], [], True
            if len(held) > 1:
                yield finish(held_keys[:-1], held[:-1], held[-1])
                held_keys, held = held_keys[-1:], held[-1:]

    return dealt.mapInArrow(walk, out_schema).withColumnRenamed("key", key)

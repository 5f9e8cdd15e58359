"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays.

A word is its 64-bit hash. Each task counts its own words (then word pairs), sorts
them and sends one compressed run to each bucket; a bucket merges its runs into sorted
arrays and writes them as files to the shared folder. Buckets are ranges of mixed
hashes, so a frequent word or context weighs no more than any other key, and there are
more buckets the more text there is. Workers memory-map the arrays to score texts.

Files: words (hash, count, total, kinds, preceders) and pairs (word number << 32 | word
number, count), each cut into buckets. A word's number is its place in all words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import blocks, hash_words, mix, mounted_dir, ready, staged, text_bytes
from .runs import RUNS, MappedArrays, bucket_of, cut_runs, merged_runs, run, save_array, summed

#: Buckets at most; each task sends a run to each.
BUCKETS = 50_000
#: Bytes of text for each bucket, about, until there are BUCKETS, and entries of a task's counts before it sends them on.
BUCKET_BYTES, FLUSH = 16 << 20, 4_000_000
#: Bytes of text that are scored at a time.
SCORE_BYTES = 4 << 20
#: Stands for a text's end as a word; as a context it is a text's start.
EDGE = np.uint64(0x5EED0FE2D0000001)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, EDGE after each, and how many each text has."""
    h, n = hash_words(*text_bytes(column))
    ends = np.cumsum(n)
    return np.insert(h, ends, EDGE), n + 1


def _contexts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What stands before each token: a text's first word follows EDGE."""
    before = np.roll(h, 1)
    before[np.cumsum(n) - n] = EDGE
    return before


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"))


def _count(docs: DataFrame, text: str, keys: Callable, bucket: Callable, n: int) -> DataFrame:
    """Runs of (key, count), dealt to their buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, c = summed(*map(np.concatenate, zip(*held, strict=True)))
            yield from cut_runs(bucket(k), n, [k, c], "run")

        for block in blocks(batches):
            h, lens = tokens(block.column("text"))
            held.append(summed(k := keys(h, lens), np.ones(len(k), np.int64)))
            size += len(held[-1][0])
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return _texts(docs, text).mapInArrow(each, RUNS).repartitionById(n, F.col("bucket"))


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and its sums. buckets, words: of files and of words in each."""

    folder: str
    words: tuple[int, ...]
    pairs: int
    tokens: int
    mass: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    spare: float

    @property
    def distinct(self) -> int:
        return sum(self.words)


@lru_cache(maxsize=2)
def _arrays(folder: str, words: tuple[int, ...], pairs: int) -> tuple[MappedArrays, MappedArrays, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    return MappedArrays(folder, len(words), ("hash", "count", "total", "kinds", "preceders")), MappedArrays(folder, pairs, ("pair", "pair_count")), first


@lru_cache(maxsize=2)
def _hashes(folder: str, words: tuple[int, ...]) -> tuple[MappedArrays, np.ndarray]:
    return MappedArrays(folder, len(words), ("hash",)), np.concatenate([[0], np.cumsum(words)]).astype(np.int64)


def _numbers(own: MappedArrays, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Numbers of distinct words in order, -1 where unknown."""
    bucket = bucket_of(words, own.buckets)
    there, place, _ = own.find(words, bucket, 0)
    return np.where(there, first[bucket.astype(np.int64)] + place, -1)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, from the numbers of keys counted 1, 2, 3 and 4 times; 0.5 where there are too few."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d, strict=True))


def train(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts a bigram model over whole texts; a null text is empty. No rows give a model that knows nothing."""
    spark = ready(docs.sparkSession)
    here = mounted_dir(spark, "ngrams")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    n_words, n_pairs = (min(BUCKETS, max(1, size // some)) for some in (4 * bucket_bytes, bucket_bytes))

    # 1. words
    def put_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (h, c) in merged_runs(batches, 2):
            save_array(here, "hash", b, h)
            save_array(here, "count", b, c.astype(np.int64))
            yield pa.RecordBatch.from_pydict({"bucket": [b], "n": [len(h)], "total": [int(c.sum())]})

    found = _count(docs, text, lambda h, _: h, lambda k: bucket_of(k, n_words), n_words).mapInArrow(put_words, "bucket long, n long, total long").collect()  # a row for each bucket
    words = [0] * n_words
    for r in found:
        words[r.bucket] = r.n
    words, all_tokens = tuple(words), sum(r.total for r in found)
    if sum(words) >= 1 << 32:
        raise ValueError("a pair's key has 32 bits for each word's number: there are too many different words")

    # 2. pairs, and for each word what its pairs add up to
    def keys(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
        own, first = _hashes(here, words)
        known, at = np.unique(h, return_inverse=True)
        number = _numbers(own, first, known)
        edge = number[np.searchsorted(known, EDGE)]
        after = number[at]
        before = np.roll(after, 1)
        before[np.cumsum(lens) - lens] = edge
        return (before << 32 | after).astype(np.uint64)

    def put_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(2**32 - 1)
        # numbers belong to the bucket of words that their hashes are in
        starts = np.cumsum(words)
        for b, (k, c) in merged_runs(batches, 2):
            c = c.astype(np.int64)
            save_array(here, "pair", b, k)
            save_array(here, "pair_count", b, c.astype(np.min_scalar_type(int(c.max()))))
            left, right = k >> np.uint64(32), k & low
            kinds = np.minimum(c, 3)
            one, zero = np.ones(len(k), np.int64), np.zeros(len(k), np.int64)
            sums = summed(np.concatenate([left, right]), np.concatenate([c, zero]), *(np.concatenate([(kinds == i).astype(np.int64), zero]) for i in (1, 2, 3)), np.concatenate([zero, one]))
            yield from cut_runs(np.searchsorted(starts, sums[0].astype(np.int64), side="right").astype(np.uint64), n_words, sums, "sums")
            yield run(0, "counts", 0, np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(np.int64).tobytes())

    runs = staged(_count(docs, text, keys, lambda k: bucket_of(mix(k), n_pairs), n_pairs).mapInArrow(put_pairs, RUNS), "ngram-sums")
    counted = [sum(x) for x in zip(*(np.frombuffer(r.data, np.int64).tolist() for r in runs.where("kind = 'counts'").select("data").toLocalIterator()), strict=True)] or [0] * 4

    # 3. totals, kinds and preceders of words, as files beside their hashes
    discounts = _discounts(counted)

    def put_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (number, total, k1, k2, k3, before) in merged_runs(batches, 6):
            at = number.astype(np.int64) - sum(words[:b])
            spare = discounts[0] * k1 + discounts[1] * k2 + discounts[2] * k3
            for name, x, kind in (("total", total, np.int64), ("kinds", spare, np.float64), ("preceders", before, np.int64)):
                full = np.zeros(words[b], kind)
                full[at] = x
                save_array(here, name, b, full)
            n = np.bincount(np.minimum(before.astype(np.int64), 5), minlength=6)
            yield pa.RecordBatch.from_pydict({"mass": [int(before.sum())], **{f"n{i}": [int(n[i])] for i in range(1, 5)}, "many": [int(n[3:].sum())]})

    sums = runs.where("kind = 'sums'").repartitionById(n_words, F.col("bucket")).mapInArrow(put_sums, "mass long, n1 long, n2 long, n3 long, n4 long, many long").collect()  # a row for each bucket
    mass, n1, n2, n3, n4, many = (sum(x) for x in zip(*sums, strict=True)) if sums else [0] * 6
    lower = _discounts([n1, n2, n3, n4])
    return Model(here, words, n_pairs, all_tokens, mass, discounts, lower, lower[0] * n1 + lower[1] * n2 + lower[2] * many)


def log_probabilities(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and known tokens of each text, and its log10 probability by counts of words and by the model."""
    h, lens = tokens(column)
    starts = np.cumsum(lens) - lens
    by_word, by_pair, first = _arrays(model.folder, model.words, model.pairs)
    known, at = np.unique(h, return_inverse=True)
    bucket = bucket_of(known, by_word.buckets)
    own = by_word.find(known, bucket, 0)
    number = np.where(own[0], first[bucket.astype(np.int64)] + own[1], -1)
    count, total, before = (np.zeros(len(known), np.int64) for _ in range(3))
    kinds = np.zeros(len(known))
    for b in np.unique(bucket[own[0]]).tolist():
        which = np.flatnonzero(own[0] & (bucket == b))
        place, files = own[1][which], by_word[b]
        for to, x in zip((count, total, kinds, before), files[1:], strict=True):
            to[which] = x[place]
    base = np.log10((count + 1) / (model.tokens + model.distinct + 1))
    edge = int(np.searchsorted(known, EDGE))
    left = np.roll(at, 1)
    left[starts] = edge
    # how often a word follows another one, discounted; what is left over is spread evenly over all words and one unknown
    lower = np.array([0.0, *model.lower])[np.minimum(before, 3)]
    follows = (np.maximum(before - lower, 0) + model.spare / (model.distinct + 1)) / model.mass if model.mass else np.full(len(known), 1 / (model.distinct + 1))
    both = (number[left] >= 0) & (number[at] >= 0)
    pair = np.where(both, number[left] << 32 | np.maximum(number[at], 0), -1).astype(np.uint64)
    some, back = np.unique(pair, return_inverse=True)
    _, _, (seen,) = by_pair.find(some, bucket_of(mix(some), by_pair.buckets), 1)
    c = np.where(both, seen[back], 0)
    all_, spare = total[left], kinds[left]
    off = np.array([0.0, *model.discounts])[np.minimum(c, 3)]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(all_ > 0, (c - off + spare * follows[at]) / all_, follows[at])
    return lens, np.add.reduceat((count > 0)[at].astype(np.int64), starts), np.add.reduceat(base[at], starts), np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the rows where held_out is not true and scores all whole texts.
    Words are runs of other than white space with A-Z as a-z; each text has an end too.
    base_score: log10 probability by words' counts with one added; score: by the
    model; perplexity: 10 ** (-score / n_tokens). Null and empty texts are their end
    alone. If nothing is learnt, every token has probability 1. Repeated rows are
    learnt from and scored each; other columns are neither read nor returned. No rows
    give none.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = train(rows.where("not held_out"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=SCORE_BYTES):
            n, known, base, own = log_probabilities(model, block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own)], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(each, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("key", key)

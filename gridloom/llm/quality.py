"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned vector. Filters run over chunks of CHUNK bytes, a new one every
STRIDE bytes, so that chunks overlap and cover the whole document; each filter keeps its
greatest value, and these are combined into one probability. Only the chunk that gave a
filter's greatest value takes part in a training step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, ready, staged, text_bytes

CHUNK, STRIDE, WIDTH, FILTERS = 16, 8, 8, 24
#: Labelled rows of each class that the network learns from at most, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 6 << 20
#: Chunks that are looked at together.
TOGETHER = 8192


@dataclass
class ChunkNet:
    """vectors: of bytes; filters: (CHUNK * WIDTH, FILTERS); bias: of filters; out, base: the last layer."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def values(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's value for each chunk of bytes."""
        return np.concatenate([self.vectors[chunks[k : k + TOGETHER]].reshape(-1, CHUNK * WIDTH) @ self.filters for k in range(0, len(chunks), TOGETHER)]) + self.bias

    def probabilities(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        chunks, first = cut(raw, bounds)
        most = np.maximum.reduceat(self.values(chunks), first, axis=0)
        return 1 / (1 + np.exp(-(np.maximum(most, 0) @ self.out + self.base[0]).astype(np.float64)))


def cut(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, zeros after a text's end, and each text's first chunk; a text has one chunk at least."""
    lens = np.diff(bounds)
    n = np.maximum(1, -(-np.maximum(lens - (CHUNK - STRIDE), 0) // STRIDE))
    first = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    start = (np.arange(len(text)) - first[text]) * STRIDE
    place = start[:, None] + np.arange(CHUNK)
    inside = place < lens[text][:, None]
    padded = raw if len(raw) else np.zeros(1, np.uint8)
    at = np.minimum(place + bounds[:-1][text][:, None], len(padded) - 1)
    return np.where(inside, padded[at], 0).astype(np.uint8), first


def learn(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = 600, batch: int = 48, seed: int = 11) -> ChunkNet:
    """A network fitted by Adam to the weighted log loss; the texts are few enough for one machine."""
    pick = np.random.default_rng(seed)
    net = ChunkNet(pick.normal(0, 0.5, (256, WIDTH)).astype(np.float32), pick.normal(0, 0.1, (CHUNK * WIDTH, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), pick.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32))
    params = [net.vectors, net.filters, net.bias, net.out, net.base]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < batch:
            order += pick.permutation(len(texts)).tolist()
        some, order = order[:batch], order[batch:]
        # a shifted start keeps filters from learning where chunks happen to begin
        shifted = [texts[i][pick.integers(0, STRIDE) :] or texts[i] for i in some]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in shifted])])
        chunks, first = cut(np.frombuffer(b"".join(shifted), np.uint8), bounds)
        values = net.values(chunks)
        ends = [*first[1:], len(chunks)]
        best = np.array([a + values[a:b].argmax(axis=0) for a, b in zip(first, ends, strict=True)])
        most = values[best, np.arange(FILTERS)]
        on = np.maximum(most, 0)
        p = 1 / (1 + np.exp(-(on @ net.out + net.base[0])))
        slope = ((p - labels[some]) * weights[some] / len(some)).astype(np.float32)
        back = slope[:, None] * net.out * (most > 0)
        x = chunks[best]  # (texts, filters, CHUNK)
        seen = net.vectors[x].reshape(len(some), FILTERS, -1)
        by_byte = np.zeros_like(net.vectors)
        np.add.at(by_byte, x.reshape(-1), (back[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH))
        grads = [by_byte, np.einsum("tf,tfk->kf", back, seen), back.sum(axis=0), slope @ on + 1e-4 * net.out, slope.sum(keepdims=True)]
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ChunkNet | float:
    """Learns from a bounded sample: of each class at most `rows` labelled documents and `size` bytes, in the order of a hash of their keys.

    A text that no longer fits is passed over for later ones, until less than a hundredth
    of the bytes is left. Of a class without a text of at most `size` bytes, the first
    text's first `size` bytes are learnt from.
    Rows without a label count for nothing. Where one class or both have no rows, what is
    returned is the share of class 1, or 0.5 without any rows.
    """
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)").groupBy("_key").agg(F.max("y").alias("y"))
    # lengths before the join, so that no texts are shuffled and the sample is bounded in bytes too
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    heads = docs.select(F.col(f"`{key}`").alias("_key"), F.octet_length(body).alias("n")).join(known, "_key").withColumn("h", F.xxhash64(F.col("_key").cast("string"), F.col("y")))
    heads = staged(heads.groupBy("_key", "h", "y").agg(F.max("n").alias("n"), F.count("*").alias("rows")), "labelled")
    counts = {r.y: r.n for r in heads.groupBy("y").agg(F.sum("rows").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    label_of: dict = {}
    for y in sorted(counts):
        of_class = heads.where(F.col("y") == y).orderBy("h", "_key")
        taken, left, later = [], size, F.lit(True)
        while len(taken) < rows and 100 * left >= size:
            page = of_class.where(later & (F.col("n") <= left)).select("_key", "h", "n").limit(rows).collect()
            for r in page:
                if r.n <= left and len(taken) < rows:
                    taken.append(r._key)
                    left -= r.n
            if len(page) < rows:
                break
            last = page[-1]
            later = (F.col("h") > last.h) | (F.col("h") == last.h) & (F.col("_key") > F.lit(last._key))
        label_of |= dict.fromkeys(taken or [of_class.first()._key], y)
    # of rows that share a key one text is learnt from
    got = docs.where(F.col(f"`{key}`").isin(list(label_of))).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(F.substring(F.encode(body, "UTF-8"), 1, size)).alias("text")).orderBy("_key").collect()
    texts, ys = [bytes(r.text) for r in got], [label_of[r._key] for r in got]
    weights = [counts[y] / sum(counts.values()) * 2 / ys.count(y) for y in ys]
    w = np.array(weights) * len(texts) / 2
    return learn(texts, np.array(ys, np.float32), w.astype(np.float32))


def score(docs: DataFrame, net: ChunkNet | float, threshold: float = 0.7, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """One row per row of docs: all its columns, score, predicted (1 where score >= threshold, else 0).

    score: the probability of class 1, of the whole text's bytes alone; a null text is
    empty, and empty texts are scored too. Columns of docs named as the new ones (names)
    are replaced. Repeated rows get equal scores. No rows give none.
    """
    ready(docs.sparkSession)
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType())])
    place = kept.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, place):
            column = block.column(place)
            p = net.probabilities(*text_bytes(column)) if isinstance(net, ChunkNet) else np.full(len(column), net)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(p)], names=[*block.schema.names, names[0]])

    return kept.mapInArrow(each, schema).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def accepted(docs: DataFrame, net: ChunkNet | float, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose score is at least the threshold. Nulls, repeats and empty tables are as in score."""
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any name of docs
    own = (f"{free}score", f"{free}predicted")
    return score(docs, net, threshold, text, own).where(F.col(own[1]) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row; learns from labelled rows where held_out is not true."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    net = fit(rows.where("not held_out"), labels.withColumnRenamed(key, "key"), label, "key", "text")
    return score(rows, net, threshold).select(F.col("key").alias(key), "held_out", "score", "predicted")

"""Hard negatives of anchors by exact inner product, with a pivot table.

Augmented by one component, sqrt(M - |x|^2) with M the largest squared length, all vectors x
lie on a sphere, and a query q, augmented by 0, is the nearer to x the larger their inner
product is: |q - x|^2 = |q|^2 + M - 2 q.x. Pivots are augmented by 0 as well, so squared
distances from them are whole numbers for rows and queries alike.

The pivot table holds each row's distances from the pivots, in order of label, nearest pivot
and distance, so that rows that stand together are alike. By the triangle inequality these
distances bracket the distance of a query and a row, and so their inner product: first for
a whole block of rows, then for each row. Rows whose bracket may still matter are checked
exactly, in whole numbers.

Anchors are taken in batches of a bounded size, each of which is sent to all tasks that
read the table. Tasks keep the best few of each anchor; Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, ready, shared_dir, staged

#: Pivots, rows of the sample that they are chosen from, bytes of anchors in a batch.
PIVOTS, SAMPLE_ROWS, BATCH_BYTES = 8, 1024, 16 << 20
#: Rows and anchors that are compared at a time.
BLOCK_ROWS, BLOCK_ANCHORS = 1024, 2048
#: Squared lengths from which on inner products may not fit 64 bits, or are not exact in a double.
TOO_LONG, EXACT = 2**60, 2**53
#: Less than any score.
NONE = -(2**62)
_TABLE = "row long, id long, label long, v binary, d binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "query long, score long, id long, row long"


def whole_vectors(vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """row, id, label, anchor, v, n2: the rows that take part, components as floor(scale * x), and their squared length.

    Rows with a null id, label or vector, or with a component that is null or not finite,
    take no part, nor does one whose squared length reaches 2**60: it has no score that
    surely fits 64 bits. row tells repeated rows apart.
    """
    x, v = F.col(f"`{vector}`"), F.col("v")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rough = F.aggregate(x, F.lit(0.0), lambda s, e: s + (e.cast("double") * scale) ** 2)
    some = vectors.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & ~F.coalesce(odd, F.lit(True)) & (rough < TOO_LONG))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    some = some.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), whole.alias("v"))
    return some.select(F.monotonically_increasing_id().alias("row"), "*", F.aggregate(v, F.lit(0).cast("long"), lambda s, e: s + e * e).alias("n2"))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors of a sample that are far from each other: each next one is the furthest from those chosen."""
    if not len(sample):
        return sample
    some = sample.astype(np.float64)
    chosen = [int(np.argmax((some * some).sum(1)))]
    gap = ((some - some[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((some - some[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


@dataclass(frozen=True)
class Space:
    """What all tasks know: the number of components, the largest squared length, the pivots."""

    size: int
    most: int
    pivots: np.ndarray

    def matrix(self, values: list) -> np.ndarray:
        """Rows of equal length; shorter ones are filled up with zeros."""
        out = np.zeros((len(values), self.size), np.int64)
        for o, v in zip(out, values, strict=True):
            o[: len(v)] = v
        return out

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of all rows of a and b."""
        if self.most < EXACT:  # no sum on the way exceeds what a double holds exactly
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T

    def distances(self, v: np.ndarray, augmented: bool) -> np.ndarray:
        """From the pivots; of rows (augmented) or of queries."""
        square = np.float64(self.most) if augmented else (v.astype(np.float64) ** 2).sum(1)[:, None]
        p = self.pivots.astype(np.float64)
        return np.sqrt(np.maximum(0, square + (p**2).sum(1) - 2.0 * (v.astype(np.float64) @ p.T)))

    def bounds(self, queries: np.ndarray, gap_low: np.ndarray, gap_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of rows between gap_low and gap_high away from queries, widened by what rounding may do."""
        base = (queries.astype(np.float64) ** 2).sum(1).reshape(-1, *([1] * (gap_low.ndim - 1))) + self.most
        slack = 1 + 1e-9 * (base + gap_high**2)
        return (base - gap_high**2) / 2 - slack, (base - gap_low**2) / 2 + slack


def pivot_table(rows: DataFrame, n_pivots: int = PIVOTS) -> tuple[DataFrame, Space]:
    """The table of a written frame of whole vectors, written, and its space.

    Pivots come from the SAMPLE_ROWS rows of least hash; every row gets its distances.
    """
    size, most = rows.agg(F.max(F.size("v")), F.max("n2")).first()
    space = Space(size or 0, most or 0, np.zeros((0, size or 0), np.int64))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).collect()
    space = Space(space.size, space.most, choose_pivots(space.matrix([r.v for r in sample]), n_pivots))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(k, BLOCK_ROWS)
                v = space.matrix(b.column("v").to_pylist())
                d = space.distances(v, True)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("id"), b.column("label"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in d], pa.binary()), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])],
                    names=["row", "id", "label", "v", "d", "cell", "gap"],
                )

    told = rows.select("row", "id", "label", "v").mapInArrow(measure, _TABLE + ", cell int, gap double")
    order = ["label", "cell", "gap", "row"]
    return staged(told.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).drop("cell", "gap"), "pivots"), space


class Best:
    """The best k (score, id, row) of each query so far: larger scores first, then smaller ids. floor: what a score must reach to come in."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.int64).copy()
        self.score, self.id, self.row = np.full((len(floor), k), NONE), np.zeros((len(floor), k), np.int64), np.zeros((len(floor), k), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray, row: np.ndarray) -> None:
        if not len(query):
            return
        some, at = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        s, i, r = (np.concatenate([old[some].ravel(), new]) for old, new in ((self.score, score), (self.id, id), (self.row, row)))
        order = np.lexsort((r, i, -s, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        keep = order[rank < self.k]
        for mine, new in ((self.score, s), (self.id, i), (self.row, r)):
            mine[some] = new[keep].reshape(-1, self.k)
        self.floor[some] = np.maximum(self.floor[some], self.score[some, -1])

    def found(self) -> list[np.ndarray]:
        query, rank = np.nonzero(self.score > NONE)
        return [query, *(x[query, rank] for x in (self.score, self.id, self.row))]


@dataclass(frozen=True)
class Search:
    """Queries of one batch: vectors with their labels and rows; the vector each query has (in order), and the scores it asks for. alike: rows of the same label are looked for, else of others."""

    space: Space
    vectors: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    alike: bool
    k: int

    @cached_property
    def gaps(self) -> np.ndarray:
        """Each vector's distances from the pivots."""
        return self.space.distances(self.vectors, False)

    @cached_property
    def turns(self) -> list[np.ndarray]:
        """Queries, no two of one vector together; queries of a vector stand together."""
        turn = np.arange(len(self.owner)) - np.searchsorted(self.owner, self.owner)
        return [np.flatnonzero(turn == t) for t in range(int(turn.max(initial=-1)) + 1)]

    def look(self, best: Best, id: np.ndarray, label: np.ndarray, row: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        """Adds the rows of a block that belong to the best; d: their distances from the pivots."""
        for some in np.unique(label):
            here = np.flatnonzero(label == some)
            fit = np.flatnonzero((self.labels == some) == self.alike)
            for k in range(0, len(fit), BLOCK_ANCHORS):
                self._look(best, fit[k : k + BLOCK_ANCHORS], id[here], row[here], v[here], d[here])

    def _look(self, best: Best, asks: np.ndarray, id: np.ndarray, row: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        # the scores that each vector's queries still want
        low, high = np.full(len(self.vectors), 2**62), np.full(len(self.vectors), NONE)
        np.minimum.at(low, self.owner, np.maximum(self.low, best.floor))
        np.maximum.at(high, self.owner, self.high)
        asks = asks[low[asks] <= high[asks]]
        # the block as a whole
        near, far, gaps = d.min(0), d.max(0), self.gaps[asks]
        least, largest = self.space.bounds(self.vectors[asks], np.maximum(0, np.maximum(gaps - far, near - gaps)).max(1, initial=0), (gaps + far).min(1, initial=np.inf))
        asks = asks[(largest >= low[asks]) & (least <= high[asks])]
        if not len(asks):
            return
        # each row, by one pivot after another
        gap = np.zeros((len(asks), len(row)))
        for p in range(d.shape[1]):
            np.maximum(gap, np.abs(self.gaps[asks, p, None] - d[:, p]), out=gap)
        may = self.space.bounds(self.vectors[asks], gap, gap)[1] >= low[asks, None]
        asks, here = asks[may.any(1)], np.flatnonzero(may.any(0))
        if not len(asks):
            return
        score = self.space.products(self.vectors[asks], v[here])
        place = np.full(len(self.vectors), -1)
        place[asks] = np.arange(len(asks))
        for turn in self.turns:
            queries = turn[place[self.owner[turn]] >= 0]
            owner = self.owner[queries]
            s = score[place[owner]]
            a, b = np.nonzero((s >= np.maximum(self.low, best.floor)[queries, None]) & (s <= self.high[queries, None]) & (row[here] != self.rows[owner, None]))
            best.add(queries[a], s[a, b], id[here][b], row[here][b])


@contextmanager
def _searched(table: DataFrame, search: Search) -> Iterator[DataFrame]:
    """The best k rows of each query over the whole table: query, score, id, row, rank."""
    sent = table.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = sent.value
        best = Best(search.k, search.low)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                b = batch.slice(k, BLOCK_ROWS)
                id, label, row = (b.column(c).to_numpy() for c in ("id", "label", "row"))
                v, d = (np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, -1) for c, kind in (("v", np.int64), ("d", np.float64)))
                search.look(best, id, label, row, v, d)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.found()], names=["query", "score", "id", "row"])

    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "row")
    yield table.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)
    sent.destroy()


def mine(vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, share: int = 80, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the best `positives` other rows of its label. For each of
    them, the best `negatives` rows of other labels whose score is between `share`
    hundredths of the positive's and the positive's own. Scores are inner products of
    floor(256 x); the larger comes first, then the smaller id. anchors: a condition on id.
    See whole_vectors for rows that take no part. Shorter vectors count as filled up with
    zeros. Repeated rows are rows of their own: one is another's positive, and each is an
    anchor. Ids and labels are whole numbers. An empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    rows = staged(whole_vectors(vectors, anchors, id, vector, label), "vectors")
    table, space = pivot_table(rows)
    stream, out = rows.where("anchor").select("row", "id", "label", "v").toLocalIterator(), shared_dir(spark, "negatives")
    most = max(1, batch_bytes // (8 * max(1, space.size)))
    batch = list(islice(stream, most))
    while True:
        _mine_batch(table, space, batch, positives, negatives, share, out)
        if not (batch := list(islice(stream, most))):
            return spark.read.schema(RESULT).parquet(out)


def _mine_batch(table: DataFrame, space: Space, batch: list, positives: int, negatives: int, share: int, out: str) -> None:
    """Adds the result for some anchors to a folder."""
    spark = table.sparkSession
    v, id, label, row = space.matrix([r.v for r in batch]), *(np.array([r[c] for r in batch], np.int64) for c in ("id", "label", "row"))
    every = np.full(len(batch), 2**62)
    with _searched(table, Search(space, v, label, row, np.arange(len(batch)), -every, every, True, positives)) as first:
        found = sorted((r.query, r["rank"], r.id, r.score) for r in first.collect())  # at most `positives` rows for each anchor of the batch
    owner, _, _, score = (np.array([f[i] for f in found], np.int64) for i in range(4))
    least = np.array([-(-share * f[3] // 100) for f in found], np.int64)
    pairs = spark.createDataFrame([(q, int(id[o]), p, s) for q, (o, _, p, s) in enumerate(found)], "query long, anchor_id long, positive_id long, positive_score long")
    with _searched(table, Search(space, v, label, row, owner, least, score, False, negatives)) as second:
        both = second.join(F.broadcast(pairs), "query")
        both.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)

"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are grouped first. The distinct ones are dealt into tiles of equal
population count (number of one bits). Two fingerprints that differ in r bits have
population counts at most r apart, so a pair of tiles further apart is skipped; within
a pair of tiles, the same bound on the population counts of 16-bit parts skips blocks.
What is left is compared exactly, by numpy's exclusive-or and bit counts. A pair of
tiles returns a spanning forest of its links, never all of them, and components are
found by large-star and small-star rounds over written tables.

Links can be held to a least Jaccard similarity of word shingles: the fingerprints then
only find candidates, and each is compared by the whole shingle sets of both texts,
which tasks memory-map.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, hash_words, join_counted, mix, mounted_dir, ready, release, staged, text_bytes

#: Fingerprints in a tile: 1/TILES of all, between LEAST and MOST. Tiles are TILES and one more for each
#: population count at most, until they are as large as MOST; then their number grows with the input.
TILES, LEAST, MOST = 128, 8192, 1 << 20
#: Numbers of dropped rows that are sent to every task, at most; of some 30 bytes each.
BROADCAST_ROWS = 1_000_000
#: Fingerprints in a block of a tile, and blocks of the other tile compared at a time.
ROWS, COLUMNS = 128, 4096


def shingle_bits(texts: list[bytes], words: int) -> np.ndarray:
    """A fingerprint for each text, 0 for a text without words."""
    from xxhash import xxh64_intdigest as digest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII only: A-Z, and 0x20 and 0x09-0x0D
        some = text.lower().split()
        if not some:
            continue
        joined, n = b" ".join(some), max(1, len(some) - words + 1)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        starts = np.concatenate([[0], ends[: n - 1]]).tolist()
        stops = (ends[min(words, len(some)) - 1 :] - 1).tolist()
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 1 << 15):
            ones += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """key, fp (the 64-bit fingerprint as a signed long) for every row of docs; a null text has no words."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def each(batches):
        for block in blocks(batches):
            column = block.column("text")
            fp = shingle_bits(column.fill_null("").cast(pa.large_binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(each, T.StructType([rows.schema["key"], T.StructField("fp", T.LongType())]))


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a text of fewer words is one shingle, one without words has none."""
    h, n = hash_words(raw, off)
    ends = np.cumsum(n)
    # a polynomial in an odd coefficient, so that the order of the words counts
    step = np.uint64(0x9E3779B97F4A7C15)

    def joined(k: int) -> np.ndarray:
        out = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            out = out * step + h[i : i + len(out)]
        return mix(out)

    of = {k: joined(k) for k in {words, *n[(n > 0) & (n < words)].tolist()}}
    return [np.unique(of[min(words, c)][e - c : e - min(words, c) + 1]) if c else np.zeros(0, np.uint64) for c, e in zip(n.tolist(), ends.tolist(), strict=True)]


def _written_sets(rows: DataFrame, folder: str, words: int, shingle: int) -> DataFrame:
    """key, fp, node (digest of the shingle set), file, start, size (where in the folder the set is) for each row of key and text."""

    def each(batches):
        from xxhash import xxh64_intdigest as digest

        file, at = TaskContext.get().taskAttemptId(), 0
        with open(f"{folder}/{file}.u64", "wb") as f:
            for block in blocks(batches):
                column = block.column("text").fill_null("")
                fp = shingle_bits(column.cast(pa.large_binary()).to_pylist(), words)
                sets = shingle_sets(*text_bytes(column), shingle)
                size = np.array([len(x) for x in sets], np.int64)
                node = np.array([digest(x.tobytes()) for x in sets], np.uint64)
                start = at + np.cumsum(size) - size
                at += int(size.sum())
                for x in sets:
                    f.write(x.tobytes())
                columns = [block.column("key"), *map(pa.array, (fp.view(np.int64), node.view(np.int64), np.full(len(sets), file, np.int64), start, size))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp", "node", "file", "start", "size"])

    return rows.mapInArrow(each, T.StructType([rows.schema["key"], *(T.StructField(c, T.LongType()) for c in ("fp", "node", "file", "start", "size"))]))


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.memmap(path, np.uint64, "r")


_PARTS = np.array([0, 16, 32, 48], np.uint64)


def _profile(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts."""
    return np.bitwise_count((fp[:, None] >> _PARTS) & np.uint64(0xFFFF)).astype(np.int16)


class _Sorted:
    """A tile in the order of its profiles, cut into blocks with each one's least and greatest profile."""

    def __init__(self, fp: np.ndarray):
        p = _profile(fp)
        order = np.lexsort(p.T[::-1])
        self.order, self.fp, p = order, fp[order], p[order]
        self.at = np.arange(0, len(fp), ROWS)
        self.low, self.high = np.minimum.reduceat(p, self.at), np.maximum.reduceat(p, self.at)


def _pairs(one: _Sorted, two: _Sorted | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in one and in two (two None: in one) of fingerprints at most radius bits apart, some at a time."""
    other = one if two is None else two
    for n, at in enumerate(one.at):
        x = one.fp[at : at + ROWS]
        gap = np.maximum(other.low - one.high[n], one.low[n] - other.high).clip(0).sum(axis=1)
        near = gap <= radius
        if two is None:
            near[:n] = False
        where = np.flatnonzero(near)
        for k in range(0, len(where), COLUMNS // ROWS):
            some = where[k : k + COLUMNS // ROWS]
            cols = (other.at[some][:, None] + np.arange(ROWS)).ravel()
            cols = cols[cols < len(other.fp)]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ other.fp[cols]) <= radius)
            j = cols[j]
            if two is None:
                apart = i + at < j
                i, j = i[apart], j[apart]
            yield i + at, j


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or within one (b None), as a spanning forest: (fingerprint, smaller fingerprint of its tree)."""
    one, two = _Sorted(a), None if b is None else _Sorted(b)
    base = 0 if two is None else len(a)
    every = one.fp if two is None else np.concatenate([one.fp, two.fp])
    label = np.arange(len(every))

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                return
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    for i, j in _pairs(one, two, radius):
        join(i, j + base)
    # name each tree by its smallest fingerprint, as signed longs
    signed = every.view(np.int64)
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, label, signed)
    to = least[label]
    kept = to != signed
    return signed[kept], to[kept]


def link_similar(a: np.ndarray, b: np.ndarray | None, radius: int, size: np.ndarray, load: Callable[[int], np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links as in link_tiles, of those fingerprints whose sets also have the similarity, as places in a and b in line.

    Sets are not compared where links found before connect two places already.
    """
    one, two = _Sorted(a), None if b is None else _Sorted(b)
    place = one.order if two is None else np.concatenate([one.order, two.order + len(a)])
    base, size = 0 if two is None else len(a), size[place]
    label = list(range(len(place)))

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    src, dst = [], []
    for i, j in _pairs(one, two, radius):
        j = j + base
        # the Jaccard similarity is at most the lesser size by the greater
        may = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
        last, mine = -1, None
        for x, y in zip(i[may].tolist(), j[may].tolist(), strict=True):
            p, q = root(x), root(y)
            if p == q:
                continue
            if x != last:
                last, mine = x, load(int(place[x]))
            both = len(np.intersect1d(mine, load(int(place[y])), assume_unique=True))
            if both >= similarity * (size[x] + size[y] - both):
                label[max(p, q)] = min(p, q)
                src.append(int(place[x]))
                dst.append(int(place[y]))
    return src, dst


def links(distinct: DataFrame, radius: int, similarity: float | None = None, folder: str = "") -> DataFrame:
    """src, dst: links that connect all fingerprints at most radius bits apart. distinct: a written table of distinct fp.

    With a similarity they connect nodes whose sets have it, too; distinct then has node, file, start, size besides.
    """
    # a row for each population count, 65 at most: its number of tiles
    counts = {r[0]: r[1] for r in distinct.groupBy(F.bit_count("fp").alias("ones")).count().collect()}
    size = min(MOST, max(LEAST, sum(counts.values()) // TILES))
    many = {ones: max(1, -(-n // size)) for ones, n in sorted(counts.items())}
    spark = distinct.sparkSession
    tiles = F.broadcast(spark.createDataFrame(list(many.items()), "ones int, m int"))
    near = F.broadcast(spark.createDataFrame([(a, b, many[b]) for a in many for b in many if abs(a - b) <= radius], "ones int, other int, m int"))
    dealt = distinct.withColumn("ones", F.bit_count("fp").cast("int")).join(tiles, "ones").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    packed = staged(dealt.groupBy("ones", "tile").agg(F.collect_list("fp" if similarity is None else F.struct("fp", "node", "file", "start", "size")).alias("fps")), "simhash-tiles")
    # each tile meets all tiles of near population counts, itself too; a pair is named by both, the lesser first
    one = F.struct("ones", "tile")
    met = packed.join(near, "ones").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    two = F.struct(F.col("other").alias("ones"), F.col("k").alias("tile"))
    both = met.select(F.struct(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).alias("pair"), "fps")

    def compare(group: pa.Table) -> pa.Table:
        fps = [np.frombuffer(x.values.buffers()[1], np.uint64)[x.values.offset : x.values.offset + len(x.values)] for x in group.column("fps").combine_chunks()]
        src, dst = link_tiles(fps[0], fps[1] if len(fps) > 1 else None, radius)
        return pa.table({"src": src, "dst": dst})

    def compare_sets(group: pa.Table) -> pa.Table:
        tiles = [x.values for x in group.column("fps").combine_chunks()]
        fps = [x.field("fp").to_numpy(zero_copy_only=False).view(np.uint64) for x in tiles]
        node, file, start, size = (np.concatenate([x.field(c).to_numpy(zero_copy_only=False) for x in tiles]) for c in ("node", "file", "start", "size"))

        def load(i: int) -> np.ndarray:
            return _mapped(f"{folder}/{file[i]}.u64")[start[i] : start[i] + size[i]] if size[i] else np.zeros(0, np.uint64)

        src, dst = link_similar(fps[0], fps[1] if len(fps) > 1 else None, radius, size, load, similarity)
        _mapped.cache_clear()  # a worker that stays must not hold files that are deleted
        release()
        return pa.table({"src": node[np.array(src, np.int64)], "dst": node[np.array(dst, np.int64)]})

    # as many partitions as there are pairs, by the counts of tiles alone, up to 10,000
    pairs = sum(m * many.get(b, 0) if b > a else m * (m + 1) // 2 for a, m in many.items() for b in range(a, a + radius + 1))
    n = max(1, min(pairs, 4 * spark.sparkContext.defaultParallelism, 10_000))
    return both.repartition(n, "pair").groupBy("pair").applyInArrow(compare if similarity is None else compare_sets, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of a written table of edges src, dst, by large-star and small-star rounds."""
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    # the centre of a large component has very many edges: it is told by its count
    def large(e: DataFrame, total: int) -> DataFrame:
        n = both(e)
        least = staged(n.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"), F.count("*").alias("n")), "components-least")
        return join_counted(n, least, "src", 2 * total).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()

    def small(e: DataFrame, total: int) -> DataFrame:
        down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = staged(down.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("n")), "components-least")
        tied = join_counted(down, least, "src", total).select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        return tied.union(least.select("src", F.col("low").alias("dst"))).distinct()

    e, before, total = edges, None, edges.count()
    while True:
        e = staged(small(staged(large(e, total), "components-large"), total), "components")
        # a forest of stars has one edge for each node, and all edges of a round equal the last round's
        now = tuple(e.agg(F.count("*"), F.count_distinct("src"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select(F.col("dst"), F.col("dst")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hexadecimal digits), component_id (smallest key of its component).

    Documents whose fingerprints differ in at most radius bits are linked, and a
    component holds all that links reach. Null texts and texts without words have the
    fingerprint zero and are linked like any other. Null keys are not counted as
    smallest; a component of null keys alone has a null component_id. Repeated rows
    get equal results each. Other columns are neither read nor returned. An empty
    table gives no rows.
    """
    fps = staged(fingerprints(docs, key, text, words), "simhash")
    distinct = staged(fps.select("fp").distinct(), "simhash-distinct")
    # trees of different pairs of tiles may repeat each other
    found = components(staged(links(distinct, radius).distinct(), "simhash-links"))
    return _named(fps, found, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(rows: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """The rows with the smallest key of their node's component. rows: a written table."""
    total = rows.count()
    least = rows.groupBy(node).agg(F.min("key").alias("low"), F.count("*").alias("n"))
    # a node may be that of very many rows, and a component may have very many nodes
    named = staged(least.join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node)), "simhash-nodes")
    low = staged(named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes")), "simhash-components")
    ids = staged(join_counted(named.select("component", node, "n"), low, "component", total, "nodes").select(node, "component_id", "n"), "simhash-ids")
    return join_counted(rows, ids, node, total)


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 13, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, component_id (smallest key of its component).

    Documents are linked if their sets of shingles (runs of `shingle` words, A-Z as a-z)
    have at least the Jaccard similarity; equal sets are linked whatever their
    fingerprints, others are found as long as these differ in at most radius bits. Null
    texts and texts without words have the empty set. Nulls, repeats and empty tables are
    as in near_duplicates.
    """
    spark = ready(docs.sparkSession)
    folder = mounted_dir(spark, "simhash-sets")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sets = staged(_written_sets(rows, folder, words, shingle), "simhash")
    one = F.min(F.struct("fp", "file", "start", "size")).alias("one")
    distinct = staged(sets.groupBy("node").agg(one).select("node", "one.*"), "simhash-distinct")
    linked = staged(links(distinct, radius, similarity, folder).distinct(), "simhash-links")
    # the links are written: the sets, larger than the texts, are asked for no more
    shutil.rmtree(folder, ignore_errors=True)
    found = components(linked)
    return _named(sets.select("key", "node"), found, "node").select(F.col("key").alias(key), "component_id")


def representatives(docs: DataFrame, radius: int = 4, words: int = 4, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """One row of docs for each component of near_duplicates, with the columns of docs: a row of the smallest key.

    With a similarity, for each component of similar.

    Rows are told apart by a number of their own, so that of repeated rows one stays; a
    row without a key stays only where no row of its component has one. An empty table
    gives no rows.
    """
    # numbered once and written: the numbers must not change when a task runs again
    rows = staged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.monotonically_increasing_id().alias("_n")), "simhash-rows")
    texts = rows.select("_n", F.col(f"_row.`{text}`").alias("text"))
    found = near_duplicates(texts, radius, words, "_n", "text") if similarity is None else similar(texts, similarity, radius=radius, words=words, key="_n")
    keys = rows.select("_n", F.col(f"_row.`{key}`").alias("key"))
    members = found.join(keys, "_n").select("component_id", "_n", "key")
    first = members.groupBy("component_id").agg(F.min_by("_n", F.struct(F.col("key").isNull(), F.col("key"), F.col("_n"))).alias("_n"))
    # by row numbers, of which none recurs: a large component meets in no task
    dropped = staged(members.select("_n").join(first.select("_n"), "_n", "left_anti"), "simhash-dropped")
    # the texts are shuffled only if too many rows go for each task to know them
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped.hint("merge"), "_n", "left_anti").select("_row.*")

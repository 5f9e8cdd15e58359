import math
import random

import numpy as np
import pytest
from gridloom.llm import hard_negatives, queries
from pyspark.sql import functions as F


def expected(rows, anchor, positives=5, negatives=5, share=80):
    """The contract by brute force over (vec_id, embedding, label) rows."""
    real = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, v, label) in enumerate(real):
        if not anchor(i):
            continue
        each = sorted((-score(v, w), j, other, k) for k, (j, w, other) in enumerate(real) if k != n)
        for s, p, _, _ in [x for x in each if x[2] == label][:positives]:
            fit = [x for x in each if x[2] != label and share * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, p, rank, j, -s, -m) for rank, (m, j, _, _) in enumerate(fit, 1)]
    return sorted(out)


def compare(spark, rows, anchor=lambda i: i % 10 == 0, **options):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, label int, score double, row int").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == (want := expected(rows, anchor, **{k: v for k, v in options.items() if k != "batch_bytes"}))
    return want


def clustered(n, dims, seed, labels=4, spread=0.2):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(6, dims)).astype(np.float32)
    return [(i, (centres[pick.integers(6)] + spread * pick.normal(size=dims).astype(np.float32)).tolist(), int(pick.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 3, 24])
def test_equals_brute_force(spark, dims):
    assert compare(spark, clustered(500, dims, dims))


def test_batches_and_numbers(spark):
    rows = clustered(300, 4, 9)
    assert compare(spark, rows, batch_bytes=8 * 4 * 7, positives=3, negatives=2, share=50)


def test_nulls_odd_numbers_lengths_and_repeats(spark):
    pick = random.Random(1)
    odd = [(0, [1.0, None], 0), (10, [math.nan, 1.0], 0), (20, [math.inf, 1.0], 1), (30, None, 1), (40, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (50, [], 2), (60, [0.5], 2), (70, [0.0, 0.0], 2)]
    rows = odd + [(pick.randrange(40), [pick.choice([-1.0, 0.5, 0.25, 1.0, 1 / 3]) for _ in range(2)], pick.randrange(3)) for _ in range(150)]
    assert compare(spark, rows + rows[20:60])
    assert compare(spark, [(i, [-1.0, 0.001 * i], i % 2) for i in range(40)])


def test_a_third_of_all_rows_are_one_vector(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(300)] + [(300 + i, v, label) for i, v, label in clustered(400, 3, 5)]
    assert compare(spark, rows)


def test_large_numbers(spark):
    """Past what doubles hold exactly; and vectors with no score that fits are left out."""
    pick = random.Random(2)
    rows = [(i, [float(np.float32(pick.uniform(-1, 1) * 2**19)) for _ in range(3)], i % 2) for i in range(100)]
    assert compare(spark, rows)
    df = spark.createDataFrame([*rows, (100, [3e38, 1.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect())) == expected(rows, lambda i: i % 10 == 0)


def test_empty_table(spark):
    assert compare(spark, []) == []
    assert compare(spark, [(1, [1.0], 1)]) == []
    assert compare(spark, [(10 * i, [], i % 2) for i in range(9)])


def test_brackets_hold_every_score():
    pick = np.random.default_rng(4)
    for size in (3, 2**10, 2**24):
        v = pick.integers(-size, size, (200, 5))
        space = hard_negatives.Space(5, int((v**2).sum(1).max()), hard_negatives.choose_pivots(v))
        d, q = space.distances(v, True), space.distances(v, False)
        score = space.products(v, v)
        assert (score == v.astype(object) @ v.T.astype(object)).all()
        gap = np.abs(q[:, None] - d[None]).max(2)
        reach = (q[:, None] + d[None]).min(2)
        least, largest = space.bounds(v, gap, reach)
        assert (least <= score).all() and (score <= largest).all()


def test_rows_of_clusters_are_passed_over(monkeypatch):
    """Where vectors lie in clusters, most rows are never compared."""
    rows = clustered(4000, 4, 3, labels=2, spread=0.02)
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    space = hard_negatives.Space(4, int((v**2).sum(1).max()), hard_negatives.choose_pivots(v[:500]))
    d = space.distances(v, True)
    order = np.lexsort((d.min(1), d.argmin(1)))
    v, d, label = v[order], d[order], np.array([r[2] for r in rows])[order]
    looked = []
    real = hard_negatives.Space.products
    monkeypatch.setattr(hard_negatives.Space, "products", lambda self, a, b: looked.append(len(a) * len(b)) or real(self, a, b))
    search = hard_negatives.Search(space, v[:40], label[:40], np.arange(40), np.arange(40), np.full(40, -(2**62)), np.full(40, 2**62), True, 5)
    best = hard_negatives.Best(5, search.low)
    for k in range(0, 4000, 100):
        search.look(best, np.arange(k, k + 100), label[k : k + 100], np.arange(k, k + 100), v[k : k + 100], d[k : k + 100])
    assert (best.score > hard_negatives.NONE).all() and sum(looked) < 40 * 4000 / 2 / 2


def test_query_over_its_table(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.queries()["op11_hard_negatives"](spark, sf).collect()))
    assert got == expected(rows, lambda i: i % 100 == 0)

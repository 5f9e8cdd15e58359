import zlib

import numpy as np
import pytest
from gridloom.llm import quality
from pyspark.sql import functions as F

HELD = "pmod(crc32(cast(doc_id as string)), 4) = 2"


def test_cut_covers_every_byte():
    texts = [b"", b"a", bytes(range(1, 17)), bytes(range(1, 18)), bytes(range(1, 100))]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    chunks, first = quality.cut(np.frombuffer(b"".join(texts), np.uint8), bounds)
    ends = [*first[1:], len(chunks)]
    for text, a, b in zip(texts, first, ends, strict=True):
        assert b > a
        assert set(chunks[a:b].ravel().tolist()) - {0} == set(text)
        for n in range(a + 1, b):  # chunks overlap
            assert (chunks[n][: quality.CHUNK - quality.STRIDE] == chunks[n - 1][quality.STRIDE :]).all()


def test_pooling_ignores_place_and_blocks():
    pick = np.random.default_rng(2)
    net = quality.learn([b"plain words here " * 9, b"!! !! !! ## " * 9] * 4, np.array([1, 0] * 4, np.float32), np.ones(8, np.float32), steps=60, batch=4)
    texts = [bytes(pick.integers(97, 123, n, dtype=np.uint8)) for n in (3, 50, 5000)]
    alone = [net.probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(net.probabilities(np.frombuffer(b"".join(texts), np.uint8), bounds), alone)
    good, bad = (net.probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"other plain words", b"and !! then !! ## !!"))
    assert good > bad


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels, F.expr(HELD)).collect()}
    assert len(got) == docs.count()
    assert all(g.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and g.predicted == (g.score >= 0.7) for k, g in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    right = sum(g.predicted == y for g, y in held) / len(held)
    assert right > 0.93
    assert sum(g.predicted for g, y in held if y) / sum(y for _, y in held) > 0.95


def test_awkward_rows(spark, docs, none, monkeypatch):
    monkeypatch.setattr(quality.learn, "__defaults__", (30, 8, 1))
    labels = spark.createDataFrame([(1, 1, "x"), (7, 0, "y"), (3, 0, None), (2, None, None), (None, 1, None), (99, 1, None)], "doc_id long, quality int, text string")
    got = quality.classify(docs, labels, F.lit(False)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "4", "7", "None"] and all(0 <= r.score <= 1 for r in got)
    assert {round(r.score, 6) for r in got if r.doc_id == 4} == {round(r.score, 6) for r in got if r.doc_id == 1}
    assert quality.classify(none, labels, F.lit(False)).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1"), F.lit(False)).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.where("false"), F.lit(None).cast("boolean")).collect()} == {0.5}


@pytest.mark.parametrize("name", ["score", "predicted"])
def test_clashing_columns(docs, name):
    got = quality.score(docs.withColumnRenamed("digest", name), 0.25)
    assert got.columns.count(name) == 1 and {r.predicted for r in got.collect()} == {0}


def test_sample_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    keys = list(range(40))
    order = [r.k for r in spark.range(40).select(F.col("id").alias("k")).orderBy(F.xxhash64(F.col("k").cast("string"), (F.col("k") % 2).cast("int"))).collect()]
    long = {next(k for k in order if k % 2 == y) for y in (0, 1)}
    rows = [(k, f"{k:02}" * (5000 if k in long else 50)) for k in keys]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in keys], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda texts, ys, w: seen.append((texts, ys.tolist())))
    quality.fit(docs, labels, "quality", rows=8, size=1000)
    quality.fit(docs, labels, "quality", rows=100, size=1000)
    quality.fit(docs.where(F.col("doc_id").isin(list(long))), labels, "quality", rows=8, size=1000)
    assert [sorted(ys) for _, ys in seen] == [[0.0] * 8 + [1.0] * 8, [0.0] * 10 + [1.0] * 10, [0.0, 1.0]]
    assert all(len(t) == 100 for texts, _ in seen[:2] for t in texts) and [len(t) for t in seen[2][0]] == [1000, 1000]

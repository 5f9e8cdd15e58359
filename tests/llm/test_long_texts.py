"""Very long texts beside short ones, and a pipeline of awkward tables."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from gridloom.llm import html_text, imatch, ngram_lm, quality, sharding
from pyspark.sql import functions as F

LONG = "The quick brown fox, né Reineke, jumps over\n12 lazy dogs. " * 60_000  # 3.4 MB
SHORT = ["a short text", "", None, "The quick brown fox"]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(list(enumerate([LONG, *SHORT, LONG])), "doc_id long, text string")


def test_language_model(long):
    got = {r.doc_id: r for r in ngram_lm.score(long, F.col("doc_id") == 5).collect()}
    n = len(LONG.split()) + 1
    assert (got[0].n_tokens, got[0].n_known) == (n, n) == (got[5].n_tokens, got[5].n_known)
    assert got[0].score == pytest.approx(got[5].score) and got[0].score > got[0].base_score
    assert got[0].train_tokens == n + sum(len((t or "").split()) + 1 for t in SHORT)


def test_shards(long):
    rows = sharding.shard_documents(long, 1000).collect()
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t in enumerate([LONG, *SHORT, LONG])}
    for r in rows:
        assert r.shard_bytes <= 1000 or r.shard_rows == 1


def test_quality_score(long):
    net = quality.learn([b"good words in a row " * 9, b"#### $$$$ !!!!" * 9], np.array([1, 0]), np.array([1.0, 1.0]), steps=20)
    rows = {r.doc_id: r.score for r in quality.score(long, net).collect()}
    assert len(rows) == 6 and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[5]


def test_fingerprints(long):
    got = {r.doc_id: r for r in imatch.compare_with_edits(long, imatch.build_lexicon(long)).collect()}
    third = len(LONG) // 3
    assert got[0].fingerprint == got[5].fingerprint and got[0].n_chars == len(LONG)
    # in descending order of ids the long text is followed by the fourth short one, and after the last comes the first
    assert got[5].edited_sha256 == hashlib.sha256((LONG[:-third] + SHORT[3]).encode()).hexdigest()
    assert got[0].edited_sha256 == hashlib.sha256((LONG[:-third] + LONG[:third]).encode()).hexdigest()


def test_page(spark):
    page = f"<nav>menu</nav><article><h1>T</h1><p>{LONG}</p></article>"
    assert html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text == "T\n" + " ".join(LONG.split())


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None), (2, ""), (3, "words that stay, all of them")]])
def test_pipeline_of_awkward_tables(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "en", "s", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")] if rows else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not rows:
        assert got == []
    for r in got:
        text = dict(rows).get(r.doc_id) or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len({r.doc_id for r in got}) == len(got)

import hashlib

import corpus_pipeline
import pytest
from gridloom.llm import decontamination, quality, simhash
from gridloom.sources import files
from pyspark.sql import functions as F

from .test_decontamination import _brute as hits


def _shingles(text):
    some = (text or "").encode().lower().split()
    return {b" ".join(some[i : i + 5]) for i in range(max(1, len(some) - 4))} if some else set()


def groups(sets):
    """The first of each set's component; sets are linked from a Jaccard similarity of 0.8 on."""
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and len(a & b) >= 0.8 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.fixture(scope="module")
def quick():
    kept, quality.learn.__defaults__ = quality.learn.__defaults__, (200, 32, 11)
    yield
    quality.learn.__defaults__ = kept


def test_stages_against_brute_force(spark, sf, quick):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted(docs.collect())
        got = stage(spark, docs, sf)
        rows = sorted(got.collect())
        if n < 3:
            assert got.columns == docs.columns and set(rows) <= set(before)
        if n == 0:
            assert 0.7 * len(before) < len(rows) < len(before)
        elif n == 1:
            # the stage's rule is five-word shingles of similarity 0.8 or more, whatever the fingerprints; over all pairs
            roots = groups([_shingles(r.text) for r in before])
            assert rows == [before[i] for i in sorted(set(roots))] and len(rows) < len(before)
        elif n == 2:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert rows == [r for r, h in zip(before, hits([r.text for r in before], items), strict=True) if not h[4]]
        else:
            assert [(r.doc_id, r.decoded_sha256) for r in rows] == [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before]
        docs = spark.createDataFrame(rows, got.schema)


def test_run_equals_its_stages(spark, sf, quick):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 50


def test_representatives_and_clean_of_awkward_rows(spark, docs, none):
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "7", "None"]
    assert simhash.representatives(none).count() == 0
    items = spark.createDataFrame([(1, "quick brown")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontamination.clean(docs, items).collect()) == ["2", "3", "7", "None"]
    assert decontamination.clean(none, items).count() == 0
    clash = docs.withColumn("_quality_score", F.lit(2)).withColumn("_text", F.lit("t")).withColumn("_row", F.lit(3))
    assert [tuple(r)[4:] for r in quality.accepted(clash, 0.9).collect()] == [(2, "t", 3)] * 7 and quality.accepted(clash, 0.9).columns == clash.columns
    assert decontamination.clean(clash, items).columns == clash.columns and decontamination.clean(clash, items).count() == 4
    assert quality.accepted(docs, 0.9).count() == 7 and quality.accepted(docs, 0.5).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_awkward_and_empty_tables(spark, sf, docs, tmp_path, empty):
    (docs.where("false") if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = files.scratch(spark, "x").rpartition("/")[0]
    before = set(files.children(spark, base)) if files.exists(spark, base) else set()
    got = sorted((str(r.doc_id), r.n_tokens == 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == ([] if empty else [("2", True), ("7", False), ("None", False)])
    # of what stages write on their way nothing is left but their rows
    left = set(files.children(spark, base)) - before
    assert sorted(x.rpartition("-")[0] for x in left) == ["pipeline-decontamination", "pipeline-near_duplicates", "pipeline-quality"]

import hashlib

import numpy as np
import pyarrow as pa
from gridloom.llm import imatch
from pyspark.sql import functions as F


def _brute(rows):
    rows = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, after)
    return out


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    lexicon = imatch.build_lexicon(docs)
    want = _brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in imatch.compare_with_edits(docs, lexicon).collect()}
    assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == {k: w[:2] for k, w in want.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    alone = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, lexicon).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == alone

    def row(text):
        return imatch.signatures(pa.array([text]), lexicon)

    for k in sorted(got)[:40]:
        a, b, c = row(texts[k]), row(want[k][2]), row(want[k][3])
        assert got[k].edited_fingerprint == imatch._hex(b)[0]
        assert abs(got[k].near_edited - imatch.likeness(a, b)[0]) < 1e-12 and abs(got[k].near_next - imatch.likeness(a, c)[0]) < 1e-12
    assert len({alone[k] for k in texts}) <= len(set(texts.values()))


def test_edits_are_nearer_than_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = imatch.compare_with_edits(docs, imatch.build_lexicon(docs)).collect()
    edited, after = (np.array([r[c] for r in rows]) for c in ("near_edited", "near_next"))
    assert edited.mean() > 0.3 and np.median(after) < 0.1
    assert (edited > after).mean() > 0.85


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"all {'half' if i % 2 else ''} rare{i} pair{i // 2}") for i in range(100)], "doc_id long, text string")
    lexicon = imatch.build_lexicon(docs, least=0, most=0.5)
    known = lambda t: imatch._terms(lexicon).find(x := imatch.distinct_terms(pa.array([t]))[0], imatch._term_bucket(x, lexicon.buckets), 0)[0].tolist()
    assert [known(t) for t in ("all", "half", "rare7", "pair3", "HALF")] == [[False], [True], [False], [True], [True]]


def test_awkward_rows(spark, docs, none):
    lexicon = imatch.build_lexicon(docs)
    got = imatch.compare_with_edits(docs, lexicon).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "4", "7", "None"]
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[4].fingerprint and by[2].fingerprint == by[3].fingerprint
    assert by[2].near_next == 0.0 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[None].edited_sha256 == hashlib.sha256(("a text without" + "é" * 6).encode()).hexdigest()
    assert imatch.compare_with_edits(none, imatch.build_lexicon(none)).count() == 0
    one = docs.where("doc_id = 1")
    assert imatch.compare_with_edits(one, lexicon).first().near_next == 1.0


def test_hashes_are_of_the_sorted_terms(spark, docs):
    lexicon = imatch.build_lexicon(docs)
    a, b, c = (imatch.signatures(pa.array([t]), lexicon)[0] for t in ("b a c", "C, a  b b", "a b d"))
    assert a.dtype == np.uint32 and (a == b).all() and a[0] != c[0] and ((a == c) | (a == 0) | (c == 0)).sum() < len(a)


def test_one_key_of_many_rows_is_dealt_out(spark):
    docs = spark.createDataFrame([(5, f"text number {i}") for i in range(400)] + [(None, f"none {i}") for i in range(50)], "doc_id long, text string").repartition(6)
    rows = sorted(((r.doc_id is not None, r.doc_id, r.h, r.text) for r in docs.withColumn("h", F.xxhash64("text")).collect()), reverse=True)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + rows[(i + 1) % len(rows)][3][: len(t) // 3]).encode()).hexdigest() for i, (_, _, _, t) in enumerate(rows))
    got = imatch.compare_with_edits(docs, imatch.build_lexicon(docs)).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.edited_sha256 for r in got) == want and len({r.p for r in got}) > 1

import hashlib
from collections import defaultdict

from gridloom.llm import sharding


def _bits(value: str) -> str:
    return bin(int(hashlib.md5(value.encode()).hexdigest()[:15], 16))[2:].zfill(60)


def _brute(rows, most):
    def split(prefix, some):
        if sum(n for _, n in some) <= most or len(some) <= 1:
            return {k: prefix for k, _ in some}
        halves = defaultdict(list)
        for k, n in some:
            halves[_bits(k)[len(prefix)]].append((k, n))
        return {k: v for b, half in halves.items() for k, v in split(prefix + b, half).items()}

    return split("", rows)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = _brute([(str(r.doc_id), len(r.text.encode())) for r in docs.collect()], 40_000)
    got = sharding.shard_documents(docs, 40_000).collect()
    assert {str(r.doc_id): r.shard for r in got} == want
    assert len(got) == docs.count() and len({r.shard for r in got}) > 5
    assert all(r.shard_bytes <= 40_000 or r.shard_rows == 1 for r in got)
    assert all(len(r.shard) == r.depth for r in got)


def test_deep_directory_and_single_large_row(spark):
    rows = [(i, "x" * 10) for i in range(9000)] + [(9000, "y" * 500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert {str(r.doc_id): r.shard for r in got} == _brute([(str(k), len(t)) for k, t in rows], 10)
    assert len(got) == 9001 and max(r.depth for r in got) > sharding.STEP
    assert all(r.shard_rows == 1 for r in got)


def test_one_key_holds_all_rows(spark):
    got = sharding.shard_documents(spark.createDataFrame([(5, "x" * 100)] * 40, "doc_id long, text string"), 450).collect()
    assert len(got) == 40 and all(r.shard_bytes <= 450 for r in got)


def test_awkward_rows(spark, docs, none, tmp_path):
    got = sharding.shard_documents(docs, 100).collect()
    assert len(got) == 7
    assert {r.doc_id: r.n_bytes for r in got}[3] == 0
    assert sharding.shard_documents(none, 100).count() == 0
    path = sharding.write_shards(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(path)
    assert back.count() == 7 and {"text", "digest", "shard"} <= set(back.columns)

import re

import numpy as np
import xxhash
from gridloom.llm import simhash


def _fingerprint(text, words=4):
    some = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not some:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(some[i : i + words]).encode(), 42) for i in range(max(1, len(some) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute(fps, radius):
    label = {k: k for k in range(len(fps))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    fps = [_fingerprint(r.text) for r in rows]
    want = {rows[i].doc_id: (f"{fps[i]:016x}", rows[c].doc_id) for i, c in enumerate(_brute(fps, 4))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_tiles_of_random_and_near_fingerprints():
    pick = np.random.default_rng(5)
    a = np.unique(pick.integers(0, 2**64, 3000, dtype=np.uint64))
    a = np.unique(np.concatenate([a, a[:800] ^ (np.uint64(1) << pick.integers(0, 64, 800, dtype=np.uint64))]))
    for x, y in ((a, None), (a[::2].copy(), a[1::2].copy())):
        src, dst = simhash.link_tiles(x, y, 4)
        every = x if y is None else np.concatenate([x, y])
        near = np.bitwise_count(every[:, None] ^ every[None, :]) <= 4
        if y is not None:
            near[: len(x), : len(x)] = near[len(x) :, len(x) :] = False
        want = {tuple(sorted((int(every.view(np.int64)[i]), int(every.view(np.int64)[j])))) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
        up = dict(zip(src.tolist(), dst.tolist(), strict=True))
        assert all(up.get(i, i) == up.get(j, j) for i, j in want) and len(up) <= len(want)


def test_long_chain(spark):
    # each differs from the next in four bits: one component of a long path
    chain = [(1 << 4 * i) - 1 for i in range(16)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)], "src long, dst long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {x: 0 for x in chain}


def test_awkward_rows(docs, none):
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [g[0] for g in got] == ["1", "2", "3", "4", "4", "7", "None"]
    assert [g[2] for g in got] == [1, 2, 2, 1, 1, 7, None]
    assert got[1][1] == got[2][1] == "0" * 16
    assert simhash.near_duplicates(none).count() == 0


def _shingles(text, words=5):
    some = (text or "").lower().split()
    return {" ".join(some[i : i + words]) for i in range(max(1, len(some) - words + 1))} if some else set()


def _alike(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def test_representatives_of_similar_texts(spark, docs, none):
    pick = np.random.default_rng(3)
    words = pick.integers(0, 5000, (40, 120)).astype("U")
    texts = [" ".join(w) for w in words]
    texts += [" ".join([*w[:60], "another", *w[61:]]) for w in words]  # similarity 0.92
    texts += [" ".join([*w[:20], "x", *w[21:50], "y", *w[51:80], "z", *w[81:110], "v", *w[111:]]) for w in words]  # 0.71 to the first, 0.63 to the second
    texts += ["a b c d e f", "a b c d e f g", "a b c d e h", "one two", "One  TWO", "one two three"]
    for near in (f for f in (_fingerprint(a) ^ _fingerprint(b) for a, b in zip(texts[:40], texts[40:80], strict=True)) if f.bit_count() > 4):
        break
    else:
        raise AssertionError("no copy more than four bits apart")
    fps, label = [_fingerprint(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 13 and _alike(texts[i], texts[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.representatives(frame, 13, similarity=0.8).collect())
    assert got == sorted(set(label)) and len(got) < 100
    assert sorted(str(r.doc_id) for r in simhash.representatives(docs, 13, similarity=0.8).collect()) == ["1", "2", "7", "None"]
    assert simhash.representatives(none, 13, similarity=0.8).count() == 0


def test_many_tiles_and_hot_keys(spark, monkeypatch):
    # tiles of 40 fingerprints, a third of all rows in one text and components with a centre, told apart from 5 rows on
    from gridloom.llm import _common

    for name, value in (("LEAST", 40), ("MOST", 40)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(_common, "HOT", 5)
    pick = np.random.default_rng(7)
    fps = pick.integers(0, 2**63, 300, dtype=np.int64)
    fps = np.concatenate([fps, fps[0] ^ (1 << np.arange(40)), np.zeros(150, np.int64)]).tolist()
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text, words: rows.toDF("key", "fp"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    roots = _brute([f & (2**64 - 1) for f in fps], 4)
    assert got == dict(enumerate(roots))


def test_very_long_text(spark):
    long = "some words that go on " * 60_000
    docs = spark.createDataFrame([(1, long), (2, long + "end"), (3, "some words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.representatives(docs, 13, similarity=0.8).collect()) == [1, 3]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 8, 9, 10)], "doc_id long, text string, _row long, _n long, fp long")
    for some in (simhash.representatives(docs), simhash.representatives(docs, 13, similarity=0.8)):
        assert [tuple(r) for r in some.collect()] == [(1, "a b c", 5, 6, 7)] and some.columns == docs.columns

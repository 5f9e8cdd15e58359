import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gridloom.llm import ngram_lm, runs
from pyspark.sql import functions as F


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(rows):
    """(n_tokens, n_known, train_tokens, base, score) of each text."""
    uni, bi = Counter(), Counter()
    for text, held in rows:
        if not held:
            w = _words(text)
            uni.update([*w, 0])
            bi.update(zip([0, *w], [*w, 0], strict=True))
    n, v = sum(uni.values()), len(uni)
    total, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in bi.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1
        before[b] += 1
    d, e = ([0, *ngram_lm._discounts([sum(c == k for c in some.values()) for k in (1, 2, 3, 4)])] for some in (bi, before))
    mass, spare = sum(before.values()), sum(e[min(c, 3)] for c in before.values())

    def follows(b):
        return (max(before[b] - e[min(before[b], 3)], 0) + spare / (v + 1)) / mass if mass else 1 / (v + 1)

    def p(a, b):
        c = bi[a, b]
        return (c - d[min(c, 3)] + sum(d[k] * m for k, m in kinds[a].items()) * follows(b)) / total[a] if total[a] else follows(b)

    for a in [0, *list(uni)[:3], "never seen"]:  # probabilities of all words and one unknown add up to 1
        assert not n or math.isclose(sum(p(a, b) for b in [*uni, "unknown"]), 1)
    out = []
    for text, _ in rows:
        t = [*_words(text), 0]
        out.append((len(t), sum(uni[x] > 0 for x in t), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t), sum(math.log10(p(a, b)) for a, b in zip([0, *t], t, strict=False))))
    return out


HELD = "pmod(crc32(cast(doc_id as string)), 7) = 2"


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 5_000])
def test_against_brute_force(spark, sf, bucket_bytes, monkeypatch):
    monkeypatch.setattr(ngram_lm.train, "__defaults__", ("text", bucket_bytes))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = _brute([(r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows])
    got = {r.doc_id: r for r in ngram_lm.score(docs, F.expr(HELD)).collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert math.isclose(g.base_score, w[3], rel_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert held and sum(g.score for g in held) > sum(g.base_score for g in held)


def test_runs():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    back = runs.unpack(runs.pack([keys, np.arange(len(keys))]), 2)
    assert (back[0] == keys).all() and (back[1] == np.arange(len(keys))).all()


def test_awkward_rows(spark, docs, none):
    got = sorted(ngram_lm.score(docs, F.expr(HELD)).collect(), key=lambda r: str(r.doc_id))
    want = _brute([(r.text, bool(r.held_out)) for r in docs.withColumn("held_out", F.expr(HELD)).collect()])
    assert sorted((g.n_tokens, g.n_known, round(g.score, 9)) for g in got) == sorted((w[0], w[1], round(w[4], 9)) for w in want)
    assert ngram_lm.score(none, F.expr(HELD)).count() == 0
    nothing = ngram_lm.score(docs, F.lit(True)).collect()
    assert len(nothing) == 7 and all(g.score == 0 == g.n_known for g in nothing)

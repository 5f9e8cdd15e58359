import hashlib
import re
from collections import Counter

from gridloom.llm import decontamination


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(texts, items, window=10):
    out = []
    for text in texts:
        w, hit, ids = _words(text), set(), set()
        for item_id, item in items:
            v = _words(item)
            for at in range(max(1, len(v) - window + 1)) if v else ():
                part = v[at : at + window]
                for i in range(len(w) - len(part) + 1):
                    if w[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        ids.add(str(item_id) if item_id is not None else "")
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_against_brute_force(spark, sf):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = docs.orderBy("doc_id").collect()
    want = _brute([r.text for r in rows], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    got = decontamination.contamination(docs, benchmark).orderBy("doc_id").collect()
    assert [tuple(g)[1:] for g in got] == want
    assert sum(g.contaminated for g in got) >= 2


ITEMS = [(1, "A b c d e f g h i j k l"), (2, "b"), (3, "x x x y"), (4, "..."), (None, "Ünï cöde"), (10, "c d"), (2, "b"), (5, None), (6, "x x x x x x x x x x x x")]
TEXTS = ["a B, c d e f g h i j", "0 a b c d e f g h i j k l", "b", ". b . ", "x x x x y x x x y", "x " * 14, "ünï cöde", "UNI", "", None, "-", "a b c d e f g h i", "c c d d b b c d", "b c d e f g h i j k l!"]


def test_small_cases(spark):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *TEXTS])), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(docs, items).orderBy("doc_id").collect()
    assert [tuple(g)[1:] for g in got] == _brute([*TEXTS, *TEXTS], ITEMS)


def _near(texts, items, slack=3, window=10, words=4, least=3):
    """(place of the text, item) by the definition: rare words of a window, in order of count in all texts and of the words themselves."""
    split = [_words(t) for t in texts]
    cf = Counter(w for t in split for w in t)
    out = set()
    for item_id, item in items:
        v = _words(item)
        for at in range(max(1, len(v) - window + 1)) if v else ():
            first = {}
            for k, w in enumerate(v[at : at + window]):
                first.setdefault(w, at + k)
            rare = sorted((cf[w], w, p) for w, p in first.items() if cf[w])[:words]
            for n, t in enumerate(split):
                found = sorted((i - p, p, i) for _, w, p in rare for i, x in enumerate(t) if x == w)
                for b, _, _ in found:
                    some = [(p, i) for c, p, i in found if b <= c <= b + slack]
                    if min(len({p for p, _ in some}), len({i for _, i in some})) >= min(least, len(first)):
                        out.add((n, "" if item_id is None else str(item_id)))
    return out


def test_proximity(spark):
    texts = ["red green of the blue", "red green x x of the blue", "red x x x x x x green blue", "blue red", "red green of the", "x red lime of the blue"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, "red green of the blue"), (8, "violet green of the blue")], "item_id long, text string")
    got = decontamination.proximity(docs, items, slack=2).collect()
    assert {(r.doc_id, r.item_id) for r in got} == _near(texts, [tuple(r) for r in items.collect()], 2)
    # a word of each item may be another one, even if it is nowhere in the corpus
    assert {(r.doc_id, r.item_id) for r in got} >= {(0, "7"), (1, "7"), (5, "7"), (0, "8"), (4, "8")} and not any(r.doc_id in (2, 3) for r in got)


def test_proximity_of_the_tables(spark, sf):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = docs.orderBy("doc_id").collect()
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in decontamination.proximity(docs, benchmark).collect()}
    assert got == {(rows[n].doc_id, i) for n, i in _near([r.text for r in rows], items)}
    exact = {(r.doc_id, i) for r in rows for i, n in ((str(i), _brute([r.text], [(i, t)])[0][1]) for i, t in items) if n}
    assert exact and exact <= got
    assert decontamination.proximity(docs.where("false"), benchmark).count() == 0 == decontamination.proximity(docs, benchmark.where("false")).count()


def test_one_index_for_two_benchmarks(spark):
    index = decontamination.Index(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    for some in (ITEMS[:3], ITEMS[3:]):
        found = index.search(spark.createDataFrame(some, "item_id long, text string")).exact().join(index.heads, "doc").select("key").distinct()
        assert sorted(r.key for r in found.collect()) == [n for n, w in enumerate(_brute(TEXTS, some)) if w[1]]


def test_few_words_are_looked_up(spark, monkeypatch):
    """Of the pages of an index only those that hold a word's list are read."""
    docs = spark.range(0, 20_000, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 19), i -> concat('w', pmod(xxhash64(id, i), 5000)))) AS text")
    index = decontamination.Index(docs)
    terms = spark.createDataFrame([("w17",), ("w4711",), ("none",)], "term string")
    found = index.lists(terms)
    n = found.count()
    assert n == index.terms.where("term in ('w17', 'w4711')").agg({"cf": "sum"}).first()[0] > 100
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 0.2 * 400_000
    monkeypatch.setattr(decontamination, "LOOKED_UP", 2)
    assert index.lists(terms).count() == 400_000


def test_without_broadcasts(spark, sf, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, decontamination.contamination(docs, benchmark).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_very_long_text(spark):
    text = "w" + " other words" * 300_000 + " quick brown foxes"
    docs = spark.createDataFrame([(1, text), (2, "quick brown")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Quick brown foxes")], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontamination.contamination(docs, items).orderBy("doc_id").collect()] == [(1, 600_004, 3, 1), (2, 2, 0, 0)]


def test_awkward_rows(spark, docs, none):
    items = spark.createDataFrame([(1, "quick brown")], "item_id long, text string")
    got = decontamination.contamination(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in got) == [("1", 2), ("2", 0), ("3", 0), ("4", 2), ("4", 2), ("7", 0), ("None", 0)]
    assert decontamination.contamination(none, items).count() == 0
    assert {r.n_hit for r in decontamination.contamination(docs, items.where("false")).collect()} == {0}

import hashlib
import re

import numpy as np
import pytest
from gridloom.llm import fim, queries


def expected(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, read off line by line."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)
    return doc_id, n, "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def compare(df, **options):
    got = fim.digests(fim.fill_in_middle(df, **options))
    want = [expected(r.doc_id, r.text, **options) for r in df.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("gap", [1, 3, 1000, 10**9])
def test_lists_give_back_every_number(gap):
    pick = np.random.default_rng(gap)
    for n in (0, 1, 2, 511, 512, 513, 3000):
        bounds = np.cumsum(pick.integers(1, gap + 1, n))
        data = fim.encode(bounds)
        assert [fim.select(data, i) for i in range(n)] == bounds.tolist()
        with pytest.raises(IndexError):
            fim.select(data, n)


def test_line_ends_are_counted_in_code_points():
    for text in ("", "\n", "a", "a\n", "\n\n", "é\n中文\n\n😀", "a\r\nb c\x0b", "x" * 100_000 + "\n" + "y"):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert fim.line_ends(text).tolist() == np.cumsum([len(u) for u in units], dtype=int).tolist()


def test_small_documents(spark, docs, none):
    compare(docs)
    got = fim.fill_in_middle(none)
    assert got.count() == 0 and got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_marks_lines_and_long_texts(spark):
    texts = ["<P>\n", "a <S> b\n", "<M>", "<\nP>\n<P\n", "<<S\n>S>", "one\n\n\ntwo\r\nthree", "\n", "é\n" * 1000, "😀" * 300_000 + "\nend", "l\n" * 200_000]
    compare(spark.createDataFrame([(i * len(texts) + k, t) for i in range(12) for k, t in enumerate(texts[: 8 if i else None])], "doc_id long, text string"))


def test_rates(spark):
    df = spark.range(400).selectExpr("id as doc_id", "concat('a\n', id % 7, '\nb\n') as text")
    compare(df, rate=30, spm=90, seed=3)


def test_copies_of_one_text_are_dealt_out(spark, monkeypatch):
    """A third of all rows have one text, many of them one doc_id too."""
    monkeypatch.setattr(fim, "HOT", 50)
    rows = [(i if i % 2 else 0, "same\ntext\n", "key", "n") for i in range(1000)] + [(i, f"text {i % 700}\nof\nits own", "key", "n") for i in range(2000)]
    compare(spark.createDataFrame(rows, "doc_id long, text string, key string, n string"))


def test_query_over_its_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.queries()["op13_fill_in_middle"](spark, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(r.doc_id, r.text)) for r in df.collect())

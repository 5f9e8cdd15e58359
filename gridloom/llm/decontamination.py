"""Benchmark decontamination with a positional inverted index, by DataFrame functions only.

The index is cut by documents: each task writes the postings (word, document, position) of
its own documents in order of words, in small pages whose least and largest words the
files know. A search of few words so reads, of each file, the pages that hold their lists.
No word's postings are ever brought together, so a word in every document is no larger a
task than another. A dictionary has each word's number of postings.

For a benchmark, the dictionary says which word of each window is rarest and which comes
next. A posting of such a word minus its place in the item is where the item would
begin. The two lists of a window are intersected by document and beginning, and the
beginnings that are left are intersected with the postings of all the item's words.
Windows that occur are runs of words that are there. Proximity matches allow the
beginnings of several rare words to lie some words apart.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged

#: Everything that is in no word, once A-Z are a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark words or windows that are sent to every task, at most; of some 200 bytes each.
BROADCAST_ROWS = 200_000
#: Words whose lists are looked up in the files, at most; for more, all postings are read. Rows of a page.
LOOKED_UP, PAGE_ROWS = 256, 2000


def split_words(text: Column) -> Column:
    """Words as an array; its first and last entries may be empty, others never are. Null has none."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def _count(words: Column) -> Column:
    edges = (F.element_at(words, 1) == "").cast("long") + (F.element_at(words, -1) == "").cast("long")
    return F.greatest(F.size(words).cast("long") - edges, F.lit(0).cast("long"))


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    """A written table, sent to every task if it has few rows and else left to be shuffled."""
    return F.broadcast(df) if _few(df) else df


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """item (a number), item_id as a string, words; rows of equal id and words count once, rows without words not at all."""
    words = F.filter(split_words(F.col(f"`{text}`")), lambda w: w != "")
    rows = benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where("size(words) > 0").distinct()
    return staged(rows.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")


def _windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """item, at (the window's place), distinct (its different words), missing (those that the corpus lacks), rare: the others as (cf, term, p), the rarest first.

    p is the word's place in the item; of a word that a window repeats, its first.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = items.select("item", F.explode(at).alias("at"), "words").withColumn("words", F.slice("words", F.col("at") + 1, window))
    each = cut.select("item", "at", F.posexplode("words").alias("k", "term"))
    first = each.groupBy("item", "at", "term").agg((F.min("k") + F.col("at")).alias("p"))
    known = first.join(counts, "term", "left").groupBy("item", "at")
    rare = F.array_sort(F.collect_list(F.when(F.col("cf").isNotNull(), F.struct("cf", "term", "p"))))
    return known.agg(F.count("*").cast("int").alias("distinct"), F.count_if(F.col("cf").isNull()).cast("int").alias("missing"), rare.alias("rare"))


class Index:
    """The postings of a corpus, written once.

    heads: a row for each document: doc (its number), key (null without one), digest
    (md5 of the text), n_words. postings: term, doc, pos (place in the split words), in
    order of terms in each file. terms: term, cf (its postings). Documents are rows:
    copies have postings each, so that none is more frequent than another. Null texts
    have no words.
    """

    def __init__(self, docs: DataFrame, key: str | None = "doc_id", text: str = "text"):
        text_ = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        # exploded from an array of one, so that texts are split once
        rows = docs.select((F.col(f"`{key}`") if key else F.lit(None).cast("string")).alias("key"), F.monotonically_increasing_id().alias("doc"), text_.alias("text"), F.explode(F.array(split_words(text_))).alias("words"))
        rows = rows.select("doc", F.struct("key", F.md5("text").alias("digest"), _count(F.col("words")).alias("n_words")).alias("head"), "words")
        each = rows.select("doc", "head", F.posexplode("words").alias("pos", "term")).where("term <> '' or pos = 0")
        sorted_ = each.select("term", "doc", "pos", F.when(F.col("pos") == 0, F.col("head")).alias("head")).sortWithinPartitions("term")
        found = staged(sorted_, "postings", **{"parquet.page.row.count.limit": str(PAGE_ROWS)})
        self.heads = found.where("pos = 0").select("doc", "head.*")
        self.postings = found.where("term <> ''").select("term", "doc", "pos")
        self.terms = staged(self.postings.groupBy("term").agg(F.count("*").alias("cf")), "terms")

    def lists(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms, of a small frame if they are looked up; of all terms, if there are many."""
        some = [r.term for r in terms.select("term").distinct().limit(LOOKED_UP + 1).collect()]
        if len(some) > LOOKED_UP:
            return self.postings
        each = [F.col("term") == t for t in some] or [F.lit(False)]
        while len(each) > 1:  # conditions on one word each reach the files' pages; a list of words does not
            each = [reduce(or_, each[i : i + 2]) for i in range(0, len(each), 2)]
        return self.postings.where(each[0])

    def search(self, benchmark: DataFrame, window: int = 10, item_key: str = "item_id", text: str = "text") -> Search:
        return Search(self, benchmark, window, item_key, text)


class Search:
    """A benchmark's windows in a corpus."""

    def __init__(self, index: Index, benchmark: DataFrame, window: int, item_key: str, text: str):
        self.index, self.window = index, window
        self.items = _items(benchmark, item_key, text)
        vocabulary = staged(self.items.select(F.explode("words").alias("term")).distinct(), "benchmark-words")
        counts = index.terms.join(_small(vocabulary), "term")
        self.windows = staged(_windows(self.items, staged(counts, "benchmark-counts"), window), "benchmark-windows")

    def _alignments(self) -> DataFrame:
        """item, doc, begin: where the two rarest words of a window that the corpus may hold are at the right places."""
        rare = lambda i, f: F.get("rare", F.lit(i)).getField(f)
        pairs = self.windows.where("missing = 0").select("item", rare(0, "term").alias("t1"), rare(0, "p").alias("p1"), rare(1, "term").alias("t2"), rare(1, "p").alias("p2")).distinct()
        pairs = staged(pairs.withColumn("pair", F.monotonically_increasing_id()), "benchmark-pairs")
        # the roles of a pair that a posting fills are bits
        seeds = pairs.select("pair", F.explode(F.array(F.struct(F.col("t1").alias("term"), F.col("p1").alias("p"), F.when(F.col("t2").isNull(), 3).otherwise(1).alias("role")), F.struct(F.col("t2").alias("term"), F.col("p2").alias("p"), F.lit(2).alias("role")))).alias("x")).select("pair", "x.*").where("term is not null")
        seeds = staged(seeds, "benchmark-seeds")
        lists = self.index.lists(seeds).join(_small(seeds), "term").select("pair", "doc", (F.col("pos") - F.col("p")).alias("begin"), "role")
        both = lists.groupBy("pair", "doc", "begin").agg(F.bit_or("role").alias("roles")).where("roles = 3")
        return both.join(_small(pairs.select("pair", "item")), "pair").select("item", "doc", "begin").distinct()

    def exact(self) -> DataFrame:
        """doc, item, start, end: runs of words in documents that are occurrences of windows, as places in their split words."""
        found = staged(self._alignments(), "alignments")
        words = self.items.join(F.broadcast(staged(found.select("item").distinct(), "aligned-items")) if _few(self.items) else found.select("item").distinct(), "item", "left_semi")
        words = staged(words.select("item", F.size("words").alias("n"), F.posexplode("words").alias("i", "term")), "aligned-words")
        asked = found.join(_small(words), "item").select("item", "n", "doc", "begin", "i", (F.col("begin") + F.col("i")).alias("pos"), "term")
        own = self.index.lists(words).join(_small(staged(found.select("doc").distinct(), "aligned")), "doc", "left_semi")
        met = asked.join(own, ["doc", "pos", "term"])
        # words one after another have the same place minus rank
        rank = F.row_number().over(Window.partitionBy("item", "doc", "begin").orderBy("i"))
        runs = met.withColumn("run", F.col("i") - rank).groupBy("item", "doc", "begin", "n", "run").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"))
        return runs.where(F.col("b") - F.col("a") >= F.least(F.lit(self.window), F.col("n"))).select("doc", "item", (F.col("begin") + F.col("a")).alias("start"), (F.col("begin") + F.col("b")).alias("end"))

    def near(self, slack: int, words: int = 4, least: int = 3) -> DataFrame:
        """doc, item: documents near an item.

        Of a window's `words` rarest words that the corpus has, at least `least` (of fewer
        different words in the window, all) are there, in as many places of the document,
        and where the item would begin by them lies within slack words.
        """
        need = F.least(F.lit(least), F.col("distinct"))
        some = self.windows.select("item", "at", need.alias("need"), F.slice("rare", 1, words).alias("rare")).where(F.size("rare") >= F.col("need"))
        each = staged(some.select("item", "at", "need", F.explode("rare").alias("x")).select("item", "at", "need", "x.term", "x.p"), "benchmark-rare")
        places = each.groupBy("item", "term", "p").agg(F.min("need").alias("need"))
        places = staged(places, "benchmark-places")
        lists = self.index.lists(places).join(_small(places), "term").select("item", "p", "need", "doc", "pos", (F.col("pos") - F.col("p")).alias("begin"))

        def dense(by: list[str], behind: int) -> Column:
            around = Window.partitionBy(*by).orderBy("begin").rangeBetween(-behind, slack)
            return F.least(F.size(F.collect_set("p").over(around)), F.size(F.collect_set("pos").over(around)))

        # first by items, which leaves few; then by windows
        likely = lists.withColumn("met", dense(["item", "doc"], slack)).where("met >= need").select("item", "p", "doc", "pos", "begin")
        own = likely.join(_small(each.select("item", "p", "at", "need")), ["item", "p"])
        return own.withColumn("met", dense(["item", "at", "doc"], 0)).where("met >= need").select("doc", "item").distinct()


def _covered(spans: Column) -> Column:
    """Words inside any of the (start, end) of an array."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(s.end - F.greatest(s.start, acc.end), F.lit(0)).cast("long")
        return F.struct((acc.n + more).alias("n"), F.greatest(acc.end, s.end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc.n)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Words: A-Z as a-z, runs of digits, letters and whatever is not ASCII. A window is
    `window` consecutive words of an item, or the whole of a shorter item. n_hit: words
    of the document inside any occurrence of a window; n_items: items with a window that
    occurs; items_sha256: of their ids, sorted as strings and joined by commas. Null
    texts have no words; null ids are the empty string; items of equal id are one.
    Repeated documents get equal results each; other columns are neither read nor
    returned. With no documents there are no rows, with no items no hits.
    """
    index = Index(docs, key, text)
    search = index.search(benchmark, window, item_key, text)
    ids = _small(search.items.select("item", "item_id"))
    hits = search.exact().join(ids, "item").groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("item_id").alias("ids"))
    listed = F.sha2(F.concat_ws(",", F.array_sort("ids")), 256)
    hits = staged(hits.select("doc", _covered(F.col("spans")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), listed.alias("items_sha256")), "contaminated")
    none = F.lit(0).cast("long")
    out = index.heads.join(_small(hits), "doc", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of docs, with its columns, in which no window of the benchmark occurs; null texts have no words and stay."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    index = Index(docs, None, text)
    found = staged(index.search(benchmark, window, item_key, text).exact().select("doc").distinct(), "contaminated")
    # rows are known by their texts: the numbers of a second run might be others
    hit = staged(index.heads.join(_small(found), "doc", "left_semi").select("digest").distinct(), "contaminated-texts")
    return rows.join(_small(hit), F.md5(F.coalesce("_text", F.lit(""))) == F.col("digest"), "left_anti").select("_row.*")


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 3, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """key, item_id: items near a document's words, as Search.near has it; a row for each row of docs and item.

    Nulls, repeated rows and empty tables are as in contamination; a row without items
    near it is not returned.
    """
    index = Index(docs, key, text)
    search = index.search(benchmark, window, item_key, text)
    near = search.near(slack).join(_small(search.items.select("item", "item_id")), "item").select("doc", "item_id").distinct()
    return near.join(index.heads, "doc").select(F.col("key").alias(key), "item_id")

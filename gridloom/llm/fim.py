"""Fill-in-the-middle documents, cut at line ends by an index of the distinct texts.

The index has a row for each distinct text: Spark groups equal digests and keeps the set
of their texts, so that what is grouped is known to be the same text and not only to have
the same digest. A text's line ends are written once as an Elias-Fano list. Documents are
joined back to the index by digest, and the two cuts that a document's seed names are
selected from the list, without looking at the text again.

Texts cross the cluster once: the ids of a text's documents are gathered in the same
grouping as the text, which is the join for all texts of few documents. The ids of a digest
that more than a ten-thousandth of all rows share (and HOT rows at least) are not gathered:
its index row is repeated for every so many of its documents and joined to them, so no task
has them all.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import HOT, ready, staged

#: The marks of prefix, suffix and middle. They hold no sign of pattern languages.
MARKS = ("<P>", "<S>", "<M>")
#: Ones of the upper bits between two samples of their places.
SAMPLE = 512
_HEAD = struct.Struct("<QBQ")


def encode(bounds: np.ndarray) -> bytes:
    """An ascending list of numbers as an Elias-Fano list: low bits packed, high bits in unary, and the place of every SAMPLE-th one."""
    n = len(bounds)
    if not n:
        return _HEAD.pack(0, 0, 0)
    bounds = bounds.astype(np.int64)
    low = max(0, (int(bounds[-1]) // n).bit_length() - 1)
    ones = (bounds >> low) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1, np.uint8)
    upper[ones] = 1
    lower = ((bounds[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
    packed = np.packbits(upper, bitorder="little").tobytes()
    return _HEAD.pack(n, low, len(packed)) + ones[::SAMPLE].astype("<u8").tobytes() + packed + np.packbits(lower, bitorder="little").tobytes()


def select(data: bytes, i: int) -> int:
    """The i-th number of a list, from 0 on; looks at the bits between two samples alone."""
    n, low, size = _HEAD.unpack_from(data)
    if not 0 <= i < n:
        raise IndexError(i)
    samples = np.frombuffer(data, "<u8", -(-n // SAMPLE), _HEAD.size)
    at = _HEAD.size + samples.nbytes
    k, rest = divmod(i, SAMPLE)
    first = int(samples[k]) // 8
    last = int(samples[k + 1]) // 8 + 1 if k + 1 < len(samples) else size
    bits = np.unpackbits(np.frombuffer(data, np.uint8, last - first, at + first), bitorder="little")
    bits[: int(samples[k]) % 8] = 0
    high = int(np.flatnonzero(bits)[rest]) + 8 * first - i
    begin, end = i * low, (i + 1) * low
    some = np.frombuffer(data, np.uint8, -(-end // 8) - begin // 8, at + size + begin // 8) if low else b""
    return high << low | (int.from_bytes(some, "little") >> begin % 8) & ((1 << low) - 1)


def line_ends(text: str) -> np.ndarray:
    """Where each line of a text ends, in code points; a last line needs no line end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] < len(raw)):
        ends = np.append(ends, len(raw))
    if not text.isascii():
        ends = ends - np.searchsorted(np.flatnonzero(raw & 0xC0 == 0x80), ends)
    return ends


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("ends", T.BinaryType())]))
def _lines(texts: pd.Series) -> pd.DataFrame:
    found = [line_ends(t) for t in texts]
    return pd.DataFrame({"n": [len(e) for e in found], "ends": [encode(e) for e in found]})


@F.pandas_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def _cuts(ends: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    cut = lambda e, i: select(e, i - 1) if i else 0
    return pd.DataFrame({"a": [cut(e, i) for e, i in zip(ends, first, strict=True)], "b": [cut(e, i) for e, i in zip(ends, last, strict=True)]}, dtype="int64")


def build_index(texts: DataFrame, *more: Column) -> DataFrame:
    """Of a frame of (key, text): key, text, n (lines), ends (their Elias-Fano list), marked (a mark occurs in the text), for each distinct text.

    Two texts of one key are an error, which SHA-256 rules out. more: aggregates of a key's rows that come along.
    """
    one = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("string"))
    found = texts.groupBy("key").agg(F.collect_set("text").alias("texts"), *more).withColumn("text", one).drop("texts")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.col("text").contains(m)
    return found.withColumn("lines", _lines("text")).withColumns({"n": F.col("lines.n"), "ends": F.col("lines.ends"), "marked": marked}).drop("lines")


def _seed(key: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output for each row; no other columns of docs come along, so none can clash.

    A text is cut into n lines, after the smaller and after the larger of two numbers of
    lines from 0 to n, both drawn by seed and key. Of a hundred rows `rate` are turned
    over, `spm` of these suffix first. Texts that are empty or hold a mark stay plain, and
    their lengths are null. A null text is empty; a null key draws as an empty one. Each
    of repeated rows gets its own, equal row; an empty table gives none.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    texts = rows.select("id", digest.alias("key"), "text")
    ids = staged(rows.select("id", digest.alias("key")), "fim-keys").withColumn("at", F.monotonically_increasing_id())
    hot = max(HOT, ids.count() // 10_000)
    # at most ten thousand rows
    heavy = staged(ids.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).alias("shares")), "fim-heavy")
    names, columns = F.broadcast(heavy.select("key")), ["id", "text", "n", "ends", "marked"]
    # the documents of a text, of which there are no more than `hot`, go with it
    few = build_index(texts.join(names, "key", "left_anti"), F.collect_list(F.struct("id")).alias("ids"))
    light = few.withColumn("id", F.explode("ids")).withColumn("id", F.col("id.id")).select(*columns)
    shares = build_index(texts.join(names, "key", "left_semi")).join(F.broadcast(heavy), "key").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    dealt = ids.join(F.broadcast(heavy), "key").withColumn("share", F.col("at") % F.col("shares")).drop("shares")
    found = light.unionByName(dealt.join(shares, ["key", "share"]).select(*columns))

    h1, h2, h3, h4 = _seed(F.col("id"), seed)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    out = found.select("id", "text", "n", "ends", form.alias("form"), F.least(x, y).alias("first"), F.greatest(x, y).alias("last"))
    out = out.withColumn("cut", _cuts("ends", "first", "last"))
    a, b, t = F.col("cut.a").cast("int"), F.col("cut.b").cast("int"), F.col("text")
    parts = {"P": F.substring(t, F.lit(1), a), "M": F.substring(t, a + 1, b - a), "S": F.substring(t, b + 1, F.length(t))}
    joined = {name: F.concat(*(p for m in order for p in (F.lit(f"<{m}>"), parts[m]))) for name, order in (("psm", "PSM"), ("spm", "SPM"))}
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", joined["psm"]).otherwise(joined["spm"])
    real = F.col("form") != "plain"
    return out.select(F.col("id").alias(key), "n", "form", F.when(real, F.col("cut.a")).alias("prefix_chars"), F.when(real, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    join = lambda *some: F.concat(*(parts[i] for i in some))
    return F.when(form == "psm", join(1, 3, 2)).when(form == "spm", join(2, 3, 1)).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them in place of the outputs."""
    back = restored(F.col("output"), F.col("form"))
    return rows.select(*(c for c in rows.columns if c != "output"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))

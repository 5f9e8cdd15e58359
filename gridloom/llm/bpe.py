"""Byte-level BPE by a segment tree over byte positions.

Leaf i of a piece's tree holds the rank of the pair that begins at live byte i, the
inner nodes the least rank below, leftmost first; the root names the next merge. A
merge is three point updates (the pair itself, the right part that is gone, and the
live neighbour on the left). Short pieces are merged many at a time with numpy, all
trees of one size as one matrix; long ones alone, in O(n log n).
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, ready
from .pieces import PieceTable

#: Pieces of more bytes get a tree of their own.
SHORT = 64
#: Trees merged at a time.
TREES = 8192
NONE = np.int32(2**31 - 1)
# Letters and digits of Unicode 17, which the regex package may know and the tiktoken library, at Unicode 16, does not.
NEWER = (
    "\\u0558 \\u058B-\\u058C \\u088F \\u0C5C \\u0CDC \\u208F \\u209D-\\u209F \\uA7CE-\\uA7CF \\uA7D2 \\uA7D4 \\uA7DD \\uA7E2 \\uA7F1 \\uAB6C-\\uAB6D"
    " \\U000107BB-\\U000107BF \\U00010940-\\U00010959 \\U00010EC5-\\U00010EC7 \\U00010ED9-\\U00010EEE \\U00011B0A \\U00011DB0-\\U00011DDB \\U00011DE0-\\U00011DE9 \\U00011DF1"
    " \\U0001246F \\U00012475-\\U0001247F \\U00012550-\\U00012686 \\U00016EA0-\\U00016EB8 \\U00016EBB-\\U00016ED3 \\U00016FF2-\\U00016FF6 \\U000187F8-\\U000187FF \\U00018CD6-\\U00018CDA"
    " \\U00018D09-\\U00018D20 \\U00018D80-\\U00018DF2 \\U00018E00-\\U00019191 \\U000191A0-\\U000191D2 \\U0001B123-\\U0001B128 \\U0001B168 \\U0001D6A6 \\U0001DF1F-\\U0001DF24"
    " \\U0001DF2B-\\U0001DF81 \\U0001DF90-\\U0001DF96 \\U0001DFCD-\\U0001DFFF \\U0001E6C0-\\U0001E6DE \\U0001E6E0-\\U0001E6E2 \\U0001E6E4-\\U0001E6E5 \\U0001E6E7-\\U0001E6ED \\U0001E6F0-\\U0001E6F4"
    " \\U0001E6FE-\\U0001E6FF \\U0002B73A-\\U0002B73F \\U0002B81E \\U0002CEA2-\\U0002CEAD \\U000323B0-\\U00033479 \\U0003D000-\\U0003FC3F"
).replace(" ", "")


def matches(pattern: str) -> Callable[[str], list[str]]:
    """What a pattern finds in a text, with the letters and digits that the library knows."""
    import regex

    plain, newer = regex.compile(pattern).findall, regex.compile(f"[{NEWER}]").search
    # as a difference of sets, which the package knows in its newer syntax
    known = regex.compile(regex.sub(r"\\p\{([LN])\}", lambda m: f"[{m[0]}--[{NEWER}]]", pattern), regex.V1).findall
    return lambda text: plain(text) if text.isascii() or not newer(text) else known(text)


class BytePairEncoder:
    """The ranks of a .tiktoken file, of fewer than 65,536 tokens; ids are ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = matches(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        get = self.ranks.get
        found = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    found[a << 16 | b] = rank
        self.pairs = found
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.values = np.array([found[int(k)] for k in self.keys], dtype=np.int64)
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for token, rank in self.ranks.items():
            words[rank] = token
        self.word_len = np.array([len(w) for w in words], dtype=np.int64)
        self.word_at = np.cumsum(self.word_len) - self.word_len
        self.word_bytes = np.frombuffer(b"".join(words), dtype=np.uint8)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none."""
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def _short(self, pieces: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of 2 to leaves bytes, leaves a power of two: one row of each matrix for a piece. Their ids, and ids per piece."""
        n = len(pieces)
        lens = np.array([len(p) for p in pieces])
        width = leaves + 2  # column 0 and the last stand for no neighbour
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(n, leaves)
        live = np.arange(leaves) < lens[:, None]
        token = np.full((n, width), -1, dtype=np.int64)
        token[:, 1:-1] = np.where(live, self.byte[raw], -1)
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[np.arange(n), lens] = leaves + 1
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, dtype=np.int32)
        both = live[:, 1:]
        rank = np.full((n, leaves - 1), -1, dtype=np.int64)
        rank[both] = self._rank(token[:, 1:-2][both], token[:, 2:-1][both])
        place = np.arange(leaves - 1)
        tree[:, leaves : 2 * leaves - 1] = np.where(rank >= 0, rank * leaves + place, NONE)
        half = leaves
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        token, after, before, tree = (x.reshape(-1) for x in (token, after, before, tree))
        rows = np.flatnonzero(tree[1 :: 2 * leaves] < NONE)
        while len(rows):
            top = tree[rows * 2 * leaves + 1].astype(np.int64)
            base, root = rows * width, rows * 2 * leaves
            at = top % leaves + 1
            token[base + at] = top // leaves
            gone = after[base + at]
            nxt = after[base + gone]
            left = before[base + at]
            after[base + at] = nxt
            before[base + nxt] = at
            token[base + gone] = -1
            changed = []
            for x, y in ((at, nxt), (left, at)):
                a, b = token[base + x], token[base + y]
                ok = (a >= 0) & (b >= 0)
                r = np.full(len(rows), -1, dtype=np.int64)
                r[ok] = self._rank(a[ok], b[ok])
                leaf = leaves + np.maximum(x, 1) - 1
                # a missing left neighbour points at the first leaf, which is then the merged pair's own
                value = np.where(r >= 0, r * leaves + x - 1, NONE)
                keep = x >= 1
                tree[(root + leaf)[keep]] = value[keep]
                changed.append(leaf)
            leaf = leaves + gone - 1
            tree[root + leaf] = NONE
            changed.append(leaf)
            depth = leaves
            while depth > 1:
                for k, node in enumerate(changed):
                    node = node >> 1
                    tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
                    changed[k] = node
                depth >>= 1
            rows = rows[tree[root + 1] < NONE]
        token = token.reshape(n, width)[:, 1:-1]
        kept = token >= 0
        return token[kept], kept.sum(axis=1)

    def _long(self, piece: bytes) -> np.ndarray:
        """One piece of any length; a node holds rank * size + position, or `none`."""
        n, get = len(piece), self.pairs.get
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        token = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(token[i] << 16 | token[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    break
                tree[i] = value

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            nxt, left = after[gone], before[at]
            token[at], token[gone], after[at] = rank, -1, nxt
            put(gone, none)
            r = None
            if nxt < n:
                before[nxt] = at
                r = get(rank << 16 | token[nxt])
            put(at, none if r is None else r * size + at)
            if left >= 0:
                r = get(token[left] << 16 | rank)
                put(left, none if r is None else r * size + left)
        return np.array([t for t in token if t >= 0], dtype=np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and each piece's start and length in it."""
        n = len(pieces)
        starts, lens = np.zeros(n, np.int64), np.ones(n, np.int64)
        get = self.ranks.get
        whole = np.fromiter((get(p, -1) for p in pieces), dtype=np.int64, count=n)
        rest = np.flatnonzero(whole < 0)
        pool, used = [whole], n
        starts[:] = np.arange(n)
        size = np.fromiter((len(pieces[i]) for i in rest), dtype=np.int64, count=len(rest))
        for leaves in (4, 8, 16, 32, SHORT):
            some = rest[(size <= leaves) & (size > (leaves // 2 if leaves > 4 else 0))]
            for k in range(0, len(some), TREES):
                part = some[k : k + TREES]
                flat, each = self._short([pieces[i] for i in part], leaves)
                starts[part], lens[part] = used + np.cumsum(each) - each, each
                pool.append(flat)
                used += len(flat)
        for i in rest[size > SHORT]:
            ids = self._long(pieces[i])
            starts[i], lens[i] = used, len(ids)
            pool.append(ids)
            used += len(ids)
        return np.concatenate(pool), starts, lens

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each match of the pattern merged on its own, and ids per text."""
        number: dict[str, int] = {}
        new = number.setdefault
        parts = list(map(self.find, texts))
        each = np.fromiter(map(len, parts), dtype=np.int64, count=len(texts))
        which = np.fromiter((new(m, len(number)) for ms in parts for m in ms), dtype=np.int64, count=int(each.sum()))
        pool, starts, lens = self.merge([m.encode() for m in number])
        lens = lens[which]
        ends = np.cumsum(lens)
        ids = pool[np.repeat(starts[which] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each text's begin and the last one's end."""
        lens = self.word_len[ids]
        ends = np.cumsum(lens)
        raw = self.word_bytes[np.repeat(self.word_at[ids] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        return raw, np.concatenate([[0], ends])[bounds]


@lru_cache(maxsize=2)
def _table(path: str, pattern: str) -> tuple[BytePairEncoder, PieceTable]:
    own = BytePairEncoder(path, pattern)
    table = PieceTable(own.encode_pieces)
    table.check(own.find)
    return own, table


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each stretch of bytes; a block is far below 2 GB."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _run(df: DataFrame, key: str, text: str, fields: list[T.StructField], make) -> DataFrame:
    ready(df.sparkSession)
    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("key"), *make(block.column("text"))], names=["key", *(f.name for f in fields)])

    schema = T.StructType([T.StructField("key", kept.schema["key"].dataType), *fields])
    return kept.mapInArrow(each, schema).withColumnRenamed("key", key)


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: key, n_tokens, ids (little-endian unsigned 32-bit integers as binary), decoded if asked for.

    Ids are as the tiktoken library's encode_ordinary gives them. decoded: the ids turned
    back into bytes. Null and empty texts have no ids. Repeated rows get equal results
    each; other columns are neither read nor returned. No rows give none. A worker holds
    one block of texts and a bounded table of pieces. The pattern has to split texts
    where pieces begin and end (see pieces), as byte-level vocabularies' patterns do;
    ValueError if it is found not to.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        own, table = _table(ranks, pattern)
        ids, bounds = table.texts(column.to_pylist())
        out = [pa.array(np.diff(bounds)), _binary(ids.astype("<u4").view(np.uint8), bounds * 4)]
        return [*out, _binary(*own.decode(ids, bounds))] if decoded else out

    more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return _run(docs, key, text, [*more, T.StructField("decoded", T.BinaryType())] if decoded else more, make)


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of what encode(decoded=True) returns."""
    return tokens.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

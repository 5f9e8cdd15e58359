"""Token ids in Arrow files of equal-length sequences.

One Arrow IPC file for each part: batches of `ids` (fixed-size lists of unsigned
integers), `mask` (true where an id is real, false in the padding after a part's last
id) and `ends` (true at a document's end id). A document may go on in the next
sequence. Beside it an index file lists the documents' keys in the same order. Files
are memory-mapped when read, so any sequence is a view of the file.
"""

from __future__ import annotations

import gc
import os
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, local_path, partitions, ready, shared_dir
from .pieces import PieceTable

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 64
#: A byte-level vocabulary writes each byte as a visible character: itself, or one from 256 on in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: b for b in _VISIBLE} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


@lru_cache(maxsize=2)
def _tokenizer(path: str, added: bool):
    """The tokenizer's table of pieces and its number of ids. added: strings of its added tokens in a text are these tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = not added  # else their strings in a text are ordinary text

    # the tables hold very many small objects and no cycles, which a collection would walk in vain
    gc.set_threshold(1_000_000, 50, 100)
    merge, signs = own.model.tokenize, string.punctuation

    def merged(word: str) -> list[int]:
        """Ids of a word that the pattern does not split, by the library's merges alone."""
        shown = ("\u0120" + word[1:] if word[0] == " " else word) if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return [t.id for t in merge(shown)]

    after = lru_cache(maxsize=4096)(merged)  # few different signs follow words

    def plain(piece: str) -> list[int] | None:
        """Ids of a word of letters with signs after it, or without: two matches, or one. None for other pieces."""
        word = piece.rstrip(signs)
        if not (word[1:] if word[:1] == " " else word).isalpha():
            return None
        return merged(word) + after(piece[len(word) :]) if len(word) < len(piece) else merged(word)

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(plain, pieces))
        rest = [i for i, ids in enumerate(found) if ids is None]
        for k in range(0, len(rest), 4096):
            for i, e in zip(rest[k : k + 4096], own.encode_batch_fast([pieces[i] for i in rest[k : k + 4096]], add_special_tokens=False), strict=True):
                found[i] = e.ids
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lens.sum())), lens

    table = PieceTable(encode)
    table.check(lambda text: [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)])
    return table, own.get_vocab_size()


def open_file(uri: str) -> pa.ipc.RecordBatchFileReader:
    """An Arrow file, memory-mapped where it is a file of this machine or of a mounted folder."""
    path = local_path(uri)
    if "://" in path:
        where, name = fs.FileSystem.from_uri(path)
        return pa.ipc.open_file(where.open_input_file(name))
    return pa.ipc.open_file(pa.memory_map(path))


class Sequences:
    """Random access to a file's sequences without copying them."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        self.per = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        last = self.file.num_record_batches - 1
        self.count = last * self.per + self.file.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids as a view of the file, and the mask as an Arrow array."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        batch = self.file.get_batch(i // self.per)
        size, k = batch.schema.field("ids").type.list_size, i % self.per
        return batch.column("ids").values.to_numpy(zero_copy_only=True)[k * size : (k + 1) * size], batch.column("mask").values.slice(k * size, size)


class _Writer:
    """Packs ids into sequences as they come; `finish` pads the last one."""

    def __init__(self, to: pa.NativeFile, kind: pa.DataType, length: int):
        self.length = length
        lists = [pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length)), pa.field("ends", pa.list_(pa.bool_(), length))]
        self.schema, self.kind = pa.schema(lists), kind
        self.out = pa.ipc.new_file(to, self.schema)
        self.ids, self.ends = np.zeros(0, kind.to_pandas_dtype()), np.zeros(0, bool)

    def _write(self, ids: np.ndarray, real: np.ndarray, ends: np.ndarray) -> None:
        for k in range(0, len(ids), self.length * BATCH):
            each = [pa.array(x[k : k + self.length * BATCH]) for x in (ids, real, ends)]
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.length) for x in each], schema=self.schema))

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ids, self.ends = np.concatenate([self.ids, ids.astype(self.ids.dtype)]), np.concatenate([self.ends, ends])
        # only full batches, so that every batch but the last has BATCH sequences
        full = len(self.ids) // (self.length * BATCH) * self.length * BATCH
        if full:
            self._write(self.ids[:full], np.ones(full, bool), self.ends[:full])
            self.ids, self.ends = self.ids[full:], self.ends[full:]

    def finish(self) -> None:
        if n := len(self.ids):
            pad = -n % self.length
            self._write(np.pad(self.ids, (0, pad)), np.arange(n + pad) < n, np.pad(self.ends, (0, pad)))
        self.out.close()


def write_token_files(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, length: int = SEQUENCE, path: str | None = None, added: bool = True) -> list[tuple[str, str, int, int]]:
    """Writes the ids of all texts, each followed by end_id, in ascending order of key; returns (ids file, index file, ids before it, its ids) in that order.

    Null keys come first; rows of equal keys stand together in the order they are read
    in. A null text is empty: its end id alone. An empty table gives one empty file at
    most. A task that runs again writes its file anew under the same name. Strings of the
    tokenizer's added tokens in a text are these tokens, as the library has it; without
    `added` they are ordinary text.
    """
    spark = ready(docs.sparkSession)
    path = path or shared_dir(spark, "tokens")
    folder = local_path(path)
    where, name = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    where.create_dir(name, recursive=True)
    # the row number deals out a key that very many rows share
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(partitions(docs), "key", "n").sortWithinPartitions("key", "n")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = _tokenizer(tokenizer, added)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        where, name = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        # written to the shared folder under names of this run, and renamed when they are complete
        made = {x: (f"{name}/.{own}.{x}", f"part-{part:06d}.{x}.arrow") for x in ("ids", "index")}
        sinks = {x: where.open_output_stream(aside) for x, (aside, _) in made.items()}
        out, index, total, n = _Writer(sinks["ids"], pa.uint16() if size <= 1 << 16 else pa.uint32(), length), None, 0, 0
        for block in blocks(batches):
            keys = block.column("key")
            if index is None:
                index = pa.ipc.new_file(sinks["index"], pa.schema([pa.field("key", keys.type)]))
            ids, bounds = table.texts(block.column("text").to_pylist())
            at = bounds[1:] + np.arange(len(keys))  # places of the end ids
            ends = np.zeros(len(ids) + len(keys), bool)
            ends[at] = True
            all_ = np.full(len(ends), end_id, np.int32)
            all_[~ends] = ids
            out.add(all_, ends)
            index.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
            total, n = total + len(all_), n + len(keys)
        out.finish()
        if index is not None:
            index.close()
        for x, (aside, file) in made.items():
            sinks[x].close()
            if n:
                where.move(aside, f"{name}/{file}")
            else:
                where.delete_file(aside)
        if n:
            ids_to, index_to = (f"{path}/{file}" for _, file in made.values())
            yield pa.RecordBatch.from_pydict({"part": [part], "ids": [ids_to], "index": [index_to], "total": [total]})

    parts = sorted(tuple(r) for r in rows.mapInArrow(write, "part long, ids string, index string, total long").collect())  # a row for each file
    before = np.cumsum([0, *(p[3] for p in parts)]).tolist()
    return [(ids, index, at, total) for (_, ids, index, total), at in zip(parts, before, strict=False)]


def read_token_files(spark: SparkSession, files: list[tuple[str, str, int, int]], key: str = "doc_id", kind: T.DataType | None = None) -> DataFrame:
    """One row per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    ready(spark)
    fields = [T.StructField(key, kind or T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (x for b in batches for x in b.column(0).to_pylist()):
            ids_file, index_file, at, _ = files[i]
            file, index = open_file(ids_file), open_file(index_file)
            crc, done, lens, crcs = 0, 0, [], []
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                real = batch.column("mask").values.to_numpy(zero_copy_only=False)
                ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[: int(real.sum())]
                ends = np.flatnonzero(batch.column("ends").values.to_numpy(zero_copy_only=False)[: len(ids)])
                raw, last = memoryview(ids.astype("<u4")).cast("B"), 0
                for e in (ends + 1).tolist():
                    crcs.append(zlib.crc32(raw[4 * last : 4 * e], crc))
                    lens.append(done + e - last)
                    crc, done, last = 0, 0, e
                crc, done = zlib.crc32(raw[4 * last :], crc), done + len(ids) - last
            n = np.array(lens, dtype=np.int64)
            start, pos = at + np.cumsum(n) - n, 0
            for k in range(index.num_record_batches):
                keys = index.get_batch(k).column("key")
                here = slice(pos, pos + len(keys))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start[here]), pa.array(n[here]), pa.array(crcs[here], pa.int64())], names=[f.name for f in fields])
                pos += len(keys)

    count = len(files)
    return spark.range(0, count, 1, max(1, count)).mapInArrow(read, T.StructType(fields))

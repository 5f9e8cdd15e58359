"""Sorted runs of keys and values: packed by tasks, dealt to buckets, merged there, kept as memory-mapped arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What tasks send to buckets.
RUNS = "bucket int, kind string, n long, data binary"
_zstd = lambda: pa.Codec("zstd", 1)


def pack(columns: list[np.ndarray]) -> bytes:
    """Sorted keys as differences, then other columns; bytes of equal weight stand together, for compression."""
    keys, *rest = (np.ascontiguousarray(c, dtype=np.uint64) for c in columns)
    planes = [np.diff(keys, prepend=np.uint64(0)), *rest]
    raw = b"".join(p.view(np.uint8).reshape(-1, 8).T.tobytes() for p in planes)
    return len(raw).to_bytes(8, "little") + _zstd().compress(raw, asbytes=True)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = _zstd().decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of each one's values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[at], *(np.add.reduceat(v[order], at) for v in values)]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of 64-bit hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cut_runs(bucket: np.ndarray, n: int, columns: list[np.ndarray], kind: str) -> Iterator[pa.RecordBatch]:
    """A run for each bucket, of columns whose keys are in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64)).tolist()
    columns = [c[order] for c in columns]
    for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
        if j > i:
            yield run(b, kind, j - i, pack([c[i:j] for c in columns]))


def run(bucket: int, kind: str, n: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "kind", "n", "data"])


def merged_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The summed runs of each bucket of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            held.setdefault(b, []).append(unpack(data.as_buffer().to_pybytes(), columns))
    for b, runs in held.items():
        yield b, summed(*map(np.concatenate, zip(*runs, strict=True)))


def save_array(folder: str, name: str, bucket: int, array: np.ndarray) -> None:
    """Written aside and renamed, so that a task that runs again or twice does no harm."""
    to = f"{folder}/{name}-{bucket:06d}.npy"
    aside = f"{folder}/.{uuid.uuid4().hex}.npy"
    np.save(aside, array)
    os.replace(aside, to)


class MappedArrays:
    """A model's arrays as a worker maps them; nothing is read but the pages that are touched."""

    def __init__(self, folder: str, buckets: int, names: tuple[str, ...]):
        self.folder, self.buckets, self.names, self.open = folder, buckets, names, {}

    def __getitem__(self, bucket: int) -> list[np.ndarray] | None:
        if bucket not in self.open:
            paths = [f"{self.folder}/{n}-{bucket:06d}.npy" for n in self.names]
            self.open[bucket] = [np.load(p, mmap_mode="r") for p in paths] if os.path.exists(paths[0]) else None
        return self.open[bucket]

    def find(self, keys: np.ndarray, bucket: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of distinct keys in order: which are there, their places in their buckets, and their values."""
        there, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        out = [np.zeros(len(keys), np.int64) for _ in range(values)]
        order = np.argsort(bucket, kind="stable")
        met, first = np.unique(bucket[order], return_index=True)  # of all buckets those that occur
        for b, i, j in zip(met.tolist(), first.tolist(), [*first.tolist(), len(order)][1:], strict=False):
            if self[b] is None:
                continue
            own, which = self[b], order[i:j]
            at = np.minimum(np.searchsorted(own[0], keys[which]), len(own[0]) - 1)
            hit = own[0][at] == keys[which]
            there[which], place[which] = hit, at
            for o, v in zip(out, own[1:], strict=False):
                o[which] = np.where(hit, v[at], 0)
        return there, place, out

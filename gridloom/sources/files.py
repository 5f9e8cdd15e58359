"""Files by Hadoop's file systems, so that any path Spark reads will do."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

#: What the innermost scratch_scope has been given; None outside of any, and for what stays.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of a file, or of the first file in a folder."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        return head(spark, names[0], n) if names else b""
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def unescaped(spark: SparkSession, name: str) -> str:
    """The value of a partition folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    p, fs = _path(spark, path)
    if not fs.rename(p, _path(spark, to)[0]):
        raise OSError(f"{path} could not be moved to {to}")


def _journal(path: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.swap" if folder else f".{name}.swap"


def replace(spark: SparkSession, path: str, to: str) -> None:
    """Puts path in the place of what may be at `to`, which goes only once the new one is complete.

    A journal beside `to` says what is under way, for mend to finish it if this stops anywhere.
    """
    mend(spark, to)
    if not exists(spark, to):
        return move(spark, path, to)
    old = f"{to.rstrip('/')}.old-{uuid.uuid4().hex[:8]}"
    write_text(spark, _journal(to), json.dumps({"new": path, "old": old}))
    move(spark, to, old)
    move(spark, path, to)
    delete(spark, old)
    delete(spark, _journal(to))


def mend(spark: SparkSession, path: str) -> None:
    """Finishes a replacement of path that was stopped: the new content if it was complete, which it was before the old one was moved."""
    if not exists(spark, _journal(path)):
        return
    try:
        what = json.loads(head(spark, _journal(path), 1 << 20))
    except ValueError:  # stopped while the journal was written, before anything was moved
        return delete(spark, _journal(path))
    if not exists(spark, path):
        move(spark, what["new"] if exists(spark, what["new"]) else what["old"], path)
    delete(spark, what["old"])
    delete(spark, _journal(path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def version(spark: SparkSession, path: str) -> tuple | None:
    """What changes when a file, or a file of a folder, is written anew: names, lengths and times; None if there is nothing."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    status = fs.getFileStatus(p)
    some = fs.listStatus(p) if status.isDirectory() else [status]
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in some))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, after an error too, what scratch was asked for within it in this thread.

    Frames made within read these files, so whatever is wanted of them has to be written
    or collected within. Scopes nest, each deletes its own; what lasts longer than the
    call that makes it (row numbers of a table, edit logs, stored views) is kept by lasting.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


@contextmanager
def lasting() -> Iterator[None]:
    """Scratch of which no scope around it is in charge."""
    token = _made.set(None)
    try:
        yield
    finally:
        _made.reset(token)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares for checkpoints. Where none is set, a temporary folder of this machine will do only if the session runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all machines share is needed")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path

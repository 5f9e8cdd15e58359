"""Delimited files read by many tasks at once, quoted cells with line ends included.

Spark cuts a file into blocks and each block into lines. Whether a line begins a record or
goes on within quotes depends on all quotes before it, so blocks are read twice. First each
block says, for either state at its start, in which state it ends and how many records
begin in it. From these few numbers, one row for each block, it follows for each block in
which state it starts and how many records came before. Then each line gets the number of
its record. A line that is a record by itself is parsed where it is; only the lines of
records that span several are brought together, record by record.

The lines themselves never leave the JVM: Python sees three flags for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row_idx"


def _lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """value, file, start, and of each line: odd (number of quotes), opens (odd, and a quote begins a cell), blank."""
    text = spark.read.option("lineSep", "\n").text(path)
    value, quoted = F.col("value"), F.col("value").contains('"')
    # most lines have no quotes, and only an odd number of them matters
    odd = quoted & ((F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1)
    opens = value.startswith('"') | value.contains(f'{delimiter}"') | value.startswith('\ufeff"')
    blank = (F.col("value") == "") | (F.col("value") == "\r")
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), odd.alias("odd"), (odd & opens).alias("opens"), blank.alias("blank"))


def _walker() -> Callable:
    """A function on some lines in order: the state before each (true: within quotes) and after all, from that before the first."""

    def walk(state: bool, odd: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, bool]:
        # a quote that begins a cell turns the state over; any other odd one, as in 5" pipe, can only end quotes
        turns = np.cumsum(opens)
        ended = np.maximum.accumulate(np.where(odd & ~opens, turns, -1))
        after = np.where(ended >= 0, turns - ended, turns + state) % 2 == 1
        return np.concatenate([[state], after[:-1]]), bool(after[-1])

    return walk


def _blocks(lines: DataFrame) -> list[tuple]:
    """(file, start, end state, records, lines of records over several) of each block, the latter three as pairs for either state at its start."""
    walk = _walker()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, records, pieces = None, [False, True], [0, 0], [0, 0]
        names = ["file", "start", "end0", "end1", "records0", "records1", "pieces0", "pieces1"]
        told = lambda: pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (*now, *ends, *records, *pieces)), strict=True)))
        for b in batches:
            file, start, odd, opens, blank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start", "odd", "opens", "blank"))
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1 if len(file) else []
            for i, j in zip([0, *cuts], [*cuts, len(file)], strict=True):
                if i == j:
                    continue
                if now != (here := (int(file[i]), int(start[i]))):
                    if now is not None:
                        yield told()
                    now, ends, records, pieces = here, [False, True], [0, 0], [0, 0]
                for h in (0, 1):
                    before, ends[h] = walk(ends[h], odd[i:j], opens[i:j])
                    records[h] += int((~before & ~blank[i:j]).sum())
                    pieces[h] += int((before | opens[i:j]).sum())
        if now is not None:
            yield told()

    schema = "file long, start long, end0 boolean, end1 boolean, records0 long, records1 long, pieces0 long, pieces1 long"
    found = lines.select("file", "start", "odd", "opens", "blank").mapInArrow(look, schema).collect()  # a row for each block
    return [(r.file, r.start, (r.end0, r.end1), (r.records0, r.records1), (r.pieces0, r.pieces1)) for r in found]


def _ranks(spark: SparkSession, path: str) -> dict[int, int]:
    """The files by hash of their path, in order of their paths."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("p")).select("p", F.xxhash64("p").alias("h"))
    return {r.h: n for n, r in enumerate(sorted(files.collect(), key=lambda r: r.p))}  # a row for each file; their content isn't read


def _placer() -> Callable:
    """The number of each line's record in its file, and whether it is one line of several."""
    walk = _walker()

    def place(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        now, inside, seen = None, False, 0
        for some in batches:
            block, state, before, odd, opens, blank = (s.to_numpy() for s in some)
            rows, pieces = np.zeros(len(block), np.int64), np.zeros(len(block), bool)
            cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
            for i, j in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if i == j:
                    continue
                if now != block[i]:
                    now, inside, seen = block[i], bool(state[i]), int(before[i])
                within, inside = walk(inside, odd[i:j], opens[i:j])
                begins = ~within & ~blank[i:j]
                at = seen + np.cumsum(begins) - 1
                rows[i:j] = np.where(~within & blank[i:j], -1, at)
                pieces[i:j] = within | opens[i:j]
                seen = int(at[-1]) + 1
            yield pd.DataFrame({"row": rows, "piece": pieces})

    return place


def read_records(spark: SparkSession, path: str, delimiter: str, names: list[str], decode: Callable | None = None) -> tuple[DataFrame, int]:
    """All records of a file or of the files of a folder, in order of their names, as text cells with their number; and how many there are.

    The first record of each file is its header and is left out, as are blank lines between
    records. Short records are filled up with '', what is beyond the last name is dropped.
    A quote opens quotes at the start of a cell only. Quotes that are never closed make the
    rest of their file one record. decode: from a line as read (a binary column) to text, where files
    are not UTF-8; quotes, delimiters and line ends must be single ASCII bytes in them.
    """
    lines = _lines(spark, path, delimiter)
    found = _blocks(lines)
    ranks = _ranks(spark, path)
    state, before, base, total, several, starts, file = False, 0, 0, 0, 0, [], None
    for block, (f, start, ends, records, pieces) in enumerate(sorted(found, key=lambda x: (ranks[x[0]], x[1]))):
        if f != file:
            file, state, before, base = f, False, 0, total
        starts.append((f, start, block, state, before, base))
        total += records[state] - (before == 0 and records[state] > 0)  # without the header
        before, several, state = before + records[state], several + pieces[state], ends[state]
    blocks = F.broadcast(spark.createDataFrame(starts, "file long, start long, block int, state boolean, before long, base long"))
    place = F.pandas_udf(_placer(), T.StructType([T.StructField("row", T.LongType()), T.StructField("piece", T.BooleanType())]))
    # not deterministic for Spark: no filter may slip below it, as it counts the lines that it sees
    at = place.asNondeterministic()("block", "state", "before", "odd", "opens", "blank")
    placed = lines.join(blocks, ["file", "start"]).withColumn("at", at).select("value", "block", F.monotonically_increasing_id().alias("line"), "base", "at.row", "at.piece").where("row > 0")
    number = (F.col("base") + F.col("row") - 1).alias(ROW)
    value = decode(F.col("value").cast("binary")) if decode else F.col("value")
    whole = placed.where("not piece") if several else placed
    text = whole.select(number, value.alias("value"))
    if several:
        parts = placed.where("piece").select(number, F.struct("block", "line", value.alias("value")).alias("part"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]), "\n")
        text = text.unionByName(parts.groupBy(ROW).agg(joined.alias("value")))
    ended = F.when(F.col("value").endswith("\r"), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    cells = F.from_csv(ended, ", ".join(f"c{i} STRING" for i in range(len(names))), {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    parsed = text.select(ROW, cells.alias("cells"))
    return parsed.select(ROW, *(F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names))), total

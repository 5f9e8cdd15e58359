"""Edits laid over a table: a log of cells to which is only ever added, of which the last entry for a cell counts, and rows appended by editing beyond the end."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from .cells import as_text
from .order import ROW

#: Edited cells that are sent to every task, at most; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Edits that the driver holds, at most, and written pieces of a log; more are written, or merged.
RECENT, PIECES = 10_000, 8
SCHEMA = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("column", T.StringType()), T.StructField("value", T.StringType()), T.StructField("seq", T.LongType())])


@dataclass(frozen=True)
class Edit:
    row: int
    column: str
    value: str


@dataclass(frozen=True)
class Piece:
    """Written edits: their table, their number, the last row and the columns they touch."""

    frame: DataFrame
    cells: int
    last: int
    columns: frozenset[str]


def _written(edits: DataFrame) -> Piece | None:
    """A piece of a frame of (row number, column, value, seq), with the newest edit of each cell only."""
    spark = edits.sparkSession
    with files.lasting():
        path = files.scratch(spark, "edits")
    newest = edits.groupBy(ROW, "column").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    newest.write.parquet(path)
    frame = spark.read.schema(SCHEMA).parquet(path)
    cells, last, columns = frame.agg(F.count("*"), F.max(ROW), F.collect_set("column")).first()  # as many values as there are columns
    return Piece(frame, cells, last, frozenset(columns)) if cells else None


@dataclass(frozen=True)
class EditLog:
    """Written pieces, older ones first, and then the latest edits, which the driver still holds.

    Logs that come from one share the list of their latest edits; each knows how many of
    them are its own, so adding one copies nothing.
    """

    pieces: tuple[Piece, ...] = ()
    latest: list[Edit] = field(default_factory=list)
    size: int = 0

    def __bool__(self) -> bool:
        return bool(self.pieces or self.size)

    @property
    def own(self) -> list[Edit]:
        return self.latest[: self.size]

    def add(self, spark: SparkSession, edit: Edit) -> EditLog:
        log = self.flushed(spark) if self.size >= RECENT else self
        latest = log.latest if len(log.latest) == log.size else log.own
        latest.append(edit)
        return EditLog(log.pieces, latest, log.size + 1)

    def add_frame(self, edits: DataFrame, row: str, column: str, value: str, seq: str | None = None) -> EditLog:
        """Adds an edit for each row of a frame; of several for one cell the one with the largest seq counts, without seq the one that is read last.

        A null value clears the cell; rows with a null or negative row number or a null column are no edits.
        """
        order = F.col(f"`{seq}`").cast("long") if seq else F.monotonically_increasing_id()
        some = edits.select(F.col(f"`{row}`").cast("long").alias(ROW), F.col(f"`{column}`").cast("string").alias("column"), as_text(edits, value).alias("value"), order.alias("seq"))
        piece = _written(some.where(F.col(ROW) >= 0).where("column is not null"))
        return EditLog((*self.flushed(edits.sparkSession).pieces, *([piece] if piece else []))).merged(edits.sparkSession)

    def flushed(self, spark: SparkSession) -> EditLog:
        """With the latest edits as one more piece."""
        if not self.size:
            return self
        rows = [(e.row, e.column, e.value, n) for n, e in enumerate(self.own)]
        return EditLog((*self.pieces, _written(spark.createDataFrame(rows, SCHEMA)))).merged(spark)

    def merged(self, spark: SparkSession) -> EditLog:
        """With one piece in place of many."""
        return self if len(self.pieces) <= PIECES else EditLog((_written(self._all(spark)),))

    def _all(self, spark: SparkSession) -> DataFrame:
        """All edits; seq orders them."""
        out = None
        for n, p in enumerate(self.pieces):
            some = p.frame.withColumn("seq", F.struct(F.lit(n).alias("piece"), "seq"))
            out = some if out is None else out.union(some)
        if self.size:
            rows = {(e.row, e.column): (e.row, e.column, e.value, n) for n, e in enumerate(self.own)}
            some = spark.createDataFrame(list(rows.values()), SCHEMA).withColumn("seq", F.struct(F.lit(len(self.pieces)).alias("piece"), "seq"))
            out = some if out is None else out.union(some)
        ranked = out.groupBy(ROW, "column").agg(F.max_by("value", "seq").alias("value")) if self.pieces else out.drop("seq")
        return ranked.withColumn("seq", F.lit(0).cast("long"))

    @property
    def cells(self) -> int:
        """Edited cells, at most."""
        return self.size + sum(p.cells for p in self.pieces)

    @property
    def last(self) -> int:
        """The last row that is edited; -1 without edits."""
        return max([-1, *(p.last for p in self.pieces), *(e.row for e in self.own)])

    @property
    def columns(self) -> set[str]:
        return {*(e.column for e in self.own), *(c for p in self.pieces for c in p.columns)}

    def known(self, names: Iterable[str]) -> EditLog:
        """The log without edits of other columns, if it has any."""
        names = set(names) - {ROW}
        if self.columns <= names:
            return self
        pieces = []
        for p in self.pieces:
            frame = p.frame.where(F.col("column").isin(sorted(p.columns & names)))
            cells, last = frame.agg(F.count("*"), F.max(ROW)).first()
            if cells:
                pieces.append(Piece(frame, cells, last, p.columns & names))
        own = [e for e in self.own if e.column in names]
        return EditLog(tuple(pieces), own, len(own))

    def by_row(self, spark: SparkSession) -> DataFrame:
        """_row_idx, _cells: the edited cells of each row, as a map from column to value."""
        cells = F.map_from_entries(F.collect_list(F.struct("column", "value")))
        return self._all(spark).groupBy(ROW).agg(cells.alias("_cells"))


def overlay(df: DataFrame, log: EditLog, total: int | None = None) -> DataFrame:
    """The numbered table with edits in place of its cells; edits of unknown columns are ignored.

    total: the table's number of rows; with it, an edit beyond the end makes rows up to
    its own, and the rows between are blank.
    """
    log = log.known(df.columns)
    if not log:
        return df
    spark, cells = df.sparkSession, log.by_row(df.sparkSession)
    if total is not None and log.last >= total:
        blank = [F.col(ROW) if c == ROW else F.lit("").try_cast(df.schema[c].dataType).alias(c) for c in df.columns]
        df = df.unionByName(spark.range(total, log.last + 1).withColumnRenamed("id", ROW).select(*blank))
    if log.cells <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    new = {c: F.when(F.map_contains_key("_cells", F.lit(c)), F.element_at("_cells", F.lit(c)).try_cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c in df.columns if c in log.columns}
    return df.join(cells, ROW, "left").withColumns(new).select(*(F.col(f"`{c}`") for c in df.columns))

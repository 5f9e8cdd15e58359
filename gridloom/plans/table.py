"""A table under edit: rows in an order, rules, sorts and edits, all applied lazily."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, edits, join, labels, order, rules, split, views
from ..operators.cells import as_text, column, is_numeric
from ..operators.edits import Edit, EditLog
from ..operators.order import ROW, SortSpec
from ..operators.rules import Rule
from ..operators.views import StoredView
from ..sources import delimited, files


@dataclass(frozen=True)
class Metadata:
    path: str | None
    delimiter: str
    encoding: str
    headers: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    total_rows: int
    total_fields: int


class Source:
    """Where a table's rows come from, and what is known of them; shared by all tables that edits, rules and sorts make of one."""

    def __init__(self, base: DataFrame, dialect: delimited.Dialect | None = None, options: dict | None = None, numbered: DataFrame | None = None, count: int | None = None):
        self.base, self.dialect, self.options = base, dialect, options or {}
        self._numbered, self._count = numbered, count
        self.labels: dict[str, str] = {}
        self.version = files.version(base.sparkSession, dialect.path) if dialect else None
        self.generation = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Source:
        files.mend(spark, path)
        df, dialect, count = delimited.read_numbered(spark, path, **options)
        return cls(df.drop(ROW), dialect, options, None if count is None else df, count)

    def reopen(self) -> None:
        """Takes the file as it is now, written by this library, as the base."""
        new = Source.open(self.base.sparkSession, self.dialect.path, **self.options | {"delimiter": self.dialect.delimiter, "encoding": "UTF-8"})
        self.__dict__ |= new.__dict__ | {"generation": self.generation + 1, "options": self.options}

    def numbered(self, order_by: tuple[str, ...]) -> DataFrame:
        if self._numbered is None:
            scan = not order_by and self.dialect is not None
            with files.lasting():
                self._numbered = order.number_rows(self.base.orderBy(*map(F.col, order_by)) if order_by else self.base, scan=scan)
        return self._numbered

    @property
    def count(self) -> int:
        if self._count is None:
            self._count = self.base.count()
        return self._count


@dataclass(frozen=True)
class Table:
    """Immutable: each operation gives a new table, and nothing runs before its rows are asked for.

    source: the rows as they were read. order_by: column names that order and tell apart
    the rows; without them (a file) it is the order of reading, numbered on demand. store:
    the view as it was written, if it was.
    """

    source: Source
    order_by: tuple[str, ...] = ()
    log: EditLog = field(default_factory=EditLog)
    rule_list: tuple[Rule, ...] = ()
    conjunction: str = "AND"
    sorts: tuple[SortSpec, ...] = ()
    store: StoredView | None = None
    made: dict = field(default_factory=dict, compare=False, init=False)

    @classmethod
    def from_dataframe(cls, df: DataFrame, order_by: Sequence[str]) -> Table:
        """A typed table; order_by must tell its rows apart."""
        return cls(Source(df), tuple(order_by))

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Table:
        """A delimited file: delimiter and encoding are found out unless given. A replacement of it that was stopped is finished first."""
        return cls(Source.open(spark, path, **options))

    @property
    def base(self) -> DataFrame:
        return self.source.base

    @property
    def dialect(self) -> delimited.Dialect | None:
        return self.source.dialect

    @property
    def numbered(self) -> DataFrame:
        """The base rows in order, with their number; numbered once for all tables that come from one."""
        return self.source.numbered(self.order_by)

    @property
    def base_count(self) -> int:
        return self.source.count

    def _needs_numbers(self) -> bool:
        return bool(self.log) or not self.order_by

    @property
    def rows(self) -> DataFrame:
        """All rows with edits, appended ones too; numbered if there are edits or the order is the file's."""
        if not self._needs_numbers():
            return self.base
        at = self.source.generation  # a save makes the file's new content the base
        if at not in self.made:
            beyond = bool(self.log) and self.log.last >= self.base_count
            self.made[at] = edits.overlay(self.numbered, self.log, self.base_count if beyond else None)
        return self.made[at]

    def _with_numbers(self) -> DataFrame:
        return self.rows if self._needs_numbers() else self.numbered

    @property
    def order(self) -> list[Column]:
        return [F.col(ROW)] if self._needs_numbers() else [F.col(f"`{c}`") for c in self.order_by]

    @property
    def view(self) -> DataFrame:
        """Rows that the rules pass; appended rows are shown unless there are rules."""
        rows = self.rows
        if not self.rule_list:
            return rows
        if self.log and self.log.last >= self.base_count:
            rows = rows.where(F.col(ROW) < self.base_count)
        return rules.passed(rows, self.rule_list, self.conjunction)

    @property
    def keys(self) -> list[order.Key]:
        return order.sort_keys(self.view, self.sorts)

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.drop(ROW)

    def to_df(self) -> DataFrame:
        """The view's rows, in no order yet."""
        return self._plain(self.view)

    # views
    def filter(self, some: Sequence[Rule], conjunction: str = "AND") -> Table:
        """Starts from all rows again: earlier rules and sorts go."""
        return replace(self, rule_list=tuple(some), conjunction=conjunction, sorts=(), store=None)

    def clear(self) -> Table:
        return replace(self, rule_list=(), conjunction="AND", sorts=(), store=None)

    def sort(self, name: str, descending: bool = False) -> Table:
        """The newest sort comes first, older ones decide ties. A text column that is labelled Numeric sorts by number."""
        column(self.base, name)
        numeric = is_numeric(self.base, name) or self.labels([name])[name] == "Numeric"
        return replace(self, sorts=(SortSpec(name, descending, numeric), *self.sorts), store=None)

    def stored(self) -> Table:
        """The same table with its view written in order, once for all its pages; whoever asks for it deletes it (store.delete)."""
        return self if self.store else replace(self, store=views.store(self.view, self.keys, self.order))

    def count(self) -> int:
        return self.store.count if self.store else self.view.count()

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit of the view. Of a stored view only the files that hold them are read, and nothing is sorted."""
        if self.store:
            return self._plain(self.store.page(self.base.sparkSession, offset, limit))
        return self._plain(order.page(self.view, self.keys, self.order, offset, limit))

    def positions(self, name: str = "pos") -> DataFrame:
        """The view in order with each row's place from 1 on."""
        return self._plain(order.positions(self.view, self.keys, self.order, name))  # written once: scratch_scope deletes it

    def unique(self, name: str, sample_rows: int | None = 50_000) -> DataFrame:
        """v, pos: distinct values of the first rows (None: of all), whatever the rules, in their order."""
        values = self.unique_values(name, sample_rows)
        numeric = is_numeric(self.base, name) or self.labels([name])[name] == "Numeric"
        return order.positions(values, order.unique_keys(values, numeric))

    def unique_values(self, name: str, sample_rows: int | None = 50_000) -> DataFrame:
        column(self.base, name)
        return order.unique_values(order.first_rows(self.rows, self.order, sample_rows), name)

    def labels(self, names: Sequence[str] | None = None) -> dict[str, str]:
        """Labels by the first rows of the base, kept once they are known."""
        if missing := [n for n in names or self.base.columns if n not in self.source.labels]:
            firsts = order.first_rows(self.base, [F.col(f"`{c}`") for c in self.order_by], labels.SAMPLE_ROWS) if self.order_by else self.base.limit(labels.SAMPLE_ROWS)
            if not self.order_by and self.dialect:
                firsts = self.numbered.where(F.col(ROW) < labels.SAMPLE_ROWS).limit(labels.SAMPLE_ROWS)
            self.source.labels.update(tuple(r) for r in labels.infer_labels(firsts.select(*(F.col(f"`{n}`") for n in missing)), (), None).collect())
        return {n: self.source.labels.get(n, "String") for n in names or self.base.columns}

    def metadata(self) -> Metadata:
        d, n = self.dialect, self.count()
        headers = d.headers if d else tuple(self.base.columns)
        return Metadata(d.path if d else None, d.delimiter if d else ",", d.encoding if d else "UTF-8", headers, tuple(self.labels().items()), n, n * len(headers))

    # edits
    def edit(self, row: int, name: str, value: str) -> Table:
        """The cell of a row's number, whatever the view shows; a number beyond the end appends rows."""
        return replace(self, log=self.log.add(self.base.sparkSession, Edit(row, name, value)), store=None)

    def edit_many(self, cells: DataFrame, row: str = "row", name: str = "column", value: str = "value", seq: str | None = None) -> Table:
        """An edit for each row of a frame, all at once; see EditLog.add_frame."""
        return replace(self, log=self.log.add_frame(cells, row, name, value, seq), store=None)

    def discard(self) -> Table:
        return replace(self, log=EditLog(), store=None)

    def save(self, path: str | None = None, single_file: bool = False) -> str:
        """All rows with edits, in their own order and with the file's delimiter, as UTF-8; the path may be the one read from.

        If it is, all tables of this source have the new content as their base from now on.
        """
        d = self.dialect
        target = path or (d.path if d else None)
        if target is None:
            raise ValueError("a path is needed")
        rows = self.rows.orderBy(*self.order)
        delimited.write_csv(self._plain(rows), target, d.delimiter if d else ",", single_file, d.headers if d else None)
        if d and target.rstrip("/") == d.path.rstrip("/"):
            self.source.reopen()
        return target

    def saved(self, path: str | None = None, single_file: bool = False) -> Table:
        """Saves, and gives the table to go on with: over the file it was read from, the edits are in the file and no longer in the table."""
        before = self.source.generation
        self.save(path, single_file)
        return self if self.source.generation == before else self.discard()

    # whole-table jobs; each gives a DataFrame
    def dedupe(self, keys: Sequence[str]) -> DataFrame:
        return self._plain(clean.keep_first(self.rows, keys, self.order))

    def trim(self, names: Sequence[str]) -> DataFrame:
        return self._plain(clean.trim(self.rows, names))

    def fill_missing(self, name: str, kind: str, value: str = "", sample_rows: int | None = clean.SAMPLE_ROWS, use_edits: bool = False) -> DataFrame:
        """A statistic comes from the base's first rows; use_edits: from the edited ones."""
        plain = self.discard()
        sample = self if use_edits else plain
        return self._plain(clean.fill_missing(self.rows, name, kind, value, sample.order, sample_rows, sample.rows))

    def join(self, other: Table, key: str, other_key: str, kind: str = "inner", use_edits: bool = True, unique_other: bool = False) -> DataFrame:
        a, b = (self, other) if use_edits else (self.discard(), other.discard())
        right, keys = b.rows, b.order
        if unique_other or not b._needs_numbers():
            return join.lookup_join(self._plain(a.rows), right, key, other_key, kind, keys, unique_other)
        out = join.lookup_join(self._plain(a.rows), right, key, other_key, kind, keys)
        return out.drop(f"{ROW}_b")

    def split_rows(self, limit: int = split.ROWS, use_edits: bool = True) -> DataFrame:
        return split.by_rows((self if use_edits else self.discard())._with_numbers(), limit)

    def split_by(self, name: str, use_edits: bool = True) -> DataFrame:
        t = self if use_edits else self.discard()
        return split.by_value(t.rows, name)

    def write_split(self, folder: str, split_by: str, row_limit: int = split.ROWS, column_name: str | None = None, one_file: bool | None = None) -> list[str]:
        """Paths of the parts in the order in which their first rows come: by `rows` named {stem}_part_{i}, by `column` named {stem}_{value}, with the source's extension.

        one_file: each part is one file, written by one task; else a folder of files.
        Parts of row_limit rows are files unless said otherwise. A value may hold any
        share of the rows, so its part is a folder unless one_file is asked for.
        """
        name = (self.dialect.path if self.dialect else "table.csv").rstrip("/").rpartition("/")[2]
        stem, _, extension = name.rpartition(".") if "." in name else (name, "", "csv")
        d = self.dialect.delimiter if self.dialect else ","
        if split_by == "rows":
            return split.write_parts(self.split_rows(row_limit), folder, f"{stem}_part", d, extension, one_file is not False)
        if split_by == "column" and column_name:
            return split.write_parts(split.by_value(self._with_numbers(), column_name), folder, stem, d, extension, bool(one_file))
        raise ValueError(f"Invalid split type {split_by}")

    def text(self, name: str) -> Column:
        return as_text(self.base, name)


def saved(table: Table, label: str) -> str:
    """Saves a table to a new shared path."""
    return table.save(files.scratch(table.base.sparkSession, label))

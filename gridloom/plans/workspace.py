"""Open tables by id, and the editor's twelve commands on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import Rule
from ..sources import delimited, files
from .table import Metadata, Table


class Workspace:
    """Opening a path twice gives the same id, unless the file has changed in between; close forgets a table.

    What a command writes to scratch on its way is deleted once its result is there.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.ids: dict[str, str] = {}

    def __getitem__(self, file_id: str) -> Table:
        if file_id not in self.tables:
            raise ValueError(f"File {file_id} is not open")
        return self.tables[file_id]

    def open(self, path: str, **options) -> str:
        known = self.ids.get(path)
        if known and self.tables[known].source.version != files.version(self.spark, path):
            known = None  # someone else wrote it: the earlier table stays as it is, under its own id
        if not known:
            table = Table.open(self.spark, path, **options)
            known = self.ids[path] = uuid.uuid4().hex
            self.tables[known] = table
        return known

    def _put(self, file_id: str, table: Table) -> None:
        """The table of an id from now on; a view that was written for the one before goes."""
        old = self[file_id].store
        if old and old is not table.store:
            old.delete(self.spark)
        self.tables[file_id] = table

    def add(self, name: str, df: DataFrame, order_by: list[str]) -> str:
        self.tables[name] = Table.from_dataframe(df, order_by)
        return name

    def close(self, file_id: str) -> None:
        if file_id in self.tables:
            self._put(file_id, self[file_id].clear())
            del self.tables[file_id]
        self.ids = {p: i for p, i in self.ids.items() if i != file_id}

    def metadata(self, file_id: str) -> Metadata:
        return self[file_id].metadata()

    def rows(self, file_id: str, offset: int, limit: int) -> list[list[str]]:
        """A page as lists of text. A sorted or filtered view is written when its first page is asked for, and stays as it is for the others."""
        if self[file_id].sorts or self[file_id].rule_list:
            self._put(file_id, self[file_id].stored())
        page = self[file_id].page(offset, limit)
        return [["" if v is None else str(v) for v in r] for r in page.collect()]

    def update_cell(self, file_id: str, row: int, name: str, value: str) -> None:
        self._put(file_id, self[file_id].edit(row, name, value))

    def update_cells(self, file_id: str, cells: DataFrame) -> None:
        """An edit for each (row, column, value) of a frame."""
        self._put(file_id, self[file_id].edit_many(cells))

    def discard(self, file_id: str) -> None:
        self._put(file_id, self[file_id].discard())

    def apply_filter(self, file_id: str, rules: list[Rule], conjunction: str = "AND") -> int:
        self._put(file_id, self[file_id].filter(rules, conjunction))
        return self.tables[file_id].count()

    def clear_filter(self, file_id: str) -> None:
        self._put(file_id, self[file_id].clear())

    def sort(self, file_id: str, name: str, descending: bool = False) -> None:
        self._put(file_id, self[file_id].sort(name, descending))

    def unique_values(self, file_id: str, name: str) -> list[str]:
        with files.scratch_scope(self.spark):
            return [str(r.v) for r in self[file_id].unique(name).orderBy("pos").collect()]

    def save(self, file_id: str, path: str | None = None, single_file: bool = False) -> str:
        """Saves all rows; over the table's own file, the edits are in the file from then on."""
        table = self[file_id]
        target = path or (table.dialect.path if table.dialect else None)
        self._put(file_id, table.saved(path, single_file))
        return target

    def clean(self, file_id: str, kind: str, path: str, /, **params) -> str:
        """kind: deduplicate (keys), trim (names) or fill_missing (name, kind, value)."""
        table = self[file_id]
        jobs = {"deduplicate": table.dedupe, "trim": table.trim, "fill_missing": table.fill_missing}
        if kind not in jobs:
            raise ValueError(f"Unknown cleaning operation {kind}")
        with files.scratch_scope(self.spark):
            return delimited.write_csv(jobs[kind](**params), path, table.dialect.delimiter if table.dialect else ",")

    def join(self, a: str, key_a: str, b: str, key_b: str, kind: str, path: str) -> str:
        table = self[a]
        with files.scratch_scope(self.spark):
            return delimited.write_csv(table.join(self[b], key_a, key_b, kind), path, table.dialect.delimiter if table.dialect else ",")

    def split(self, file_id: str, split_by: str, folder: str, row_limit: int = 50_000, column_name: str | None = None) -> list[str]:
        with files.scratch_scope(self.spark):
            return self[file_id].write_split(folder, split_by, row_limit, column_name)

"""Delimited files as string columns, and back."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files, records, sniff


#: Characters 0x80 to 0x9F of ISO-8859-1 and what windows-1252 has there; five of them are the same.
WESTERN = tuple(bytes(range(0x80, 0xA0)).translate(None, b"\x81\x8d\x8f\x90\x9d").decode(x) for x in ("latin-1", "cp1252"))


@dataclass(frozen=True)
class Dialect:
    path: str
    delimiter: str
    encoding: str
    headers: tuple[str, ...]


def sniff_dialect(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> Dialect:
    data = files.head(spark, path, sniff.HEADER_BYTES)
    encoding = encoding or sniff.sniff_encoding(data)
    plain = data if not encoding.startswith("UTF-16") else data.decode("utf-16", errors="ignore").encode()
    delimiter = delimiter or sniff.sniff_delimiter(plain)
    return Dialect(path, delimiter, encoding, tuple(sniff.read_header(data, delimiter, encoding)))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multi_line: bool = True) -> tuple[DataFrame, Dialect]:
    """All cells as text; missing cells and blank ones are ''. Short rows are filled up, blank lines left out.

    Files are read block by block, in as many tasks as they have blocks; see records for
    quoted cells with line ends. multi_line=False: there are none, so nothing is looked
    for before reading. UTF-16 files are read by one task each.
    """
    df, dialect, _ = read_numbered(spark, path, delimiter, encoding, multi_line)
    return df.drop(records.ROW), dialect


def read_numbered(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multi_line: bool = True) -> tuple[DataFrame, Dialect, int | None]:
    """As read_csv, with row numbers and how many rows there are, if they are known from reading."""
    dialect = sniff_dialect(spark, path, delimiter, encoding)
    names = sniff.distinct_names(list(dialect.headers))
    # Spark has no windows-1252; it differs from ISO-8859-1 in the characters 0x80 to 0x9F alone
    western = dialect.encoding == "windows-1252"
    if multi_line and not dialect.encoding.startswith("UTF-16"):
        decode = (lambda c: F.translate(F.decode(c, "ISO-8859-1"), *WESTERN)) if western else None
        df, total = records.read_records(spark, path, dialect.delimiter, names, decode)
        return df, dialect, total
    encoding = "ISO-8859-1" if western else dialect.encoding
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).options(header=True, enforceSchema=True, sep=dialect.delimiter, quote='"', escape='"', multiLine=multi_line, encoding=encoding, mode="PERMISSIVE")
    df = reader.csv(path)
    cell = lambda n: F.translate(F.col(f"`{n}`"), *WESTERN) if western else F.col(f"`{n}`")
    return df.select(*(F.coalesce(cell(n), F.lit("")).alias(n) for n in names)), dialect, None


def write_csv(df: DataFrame, path: str, delimiter: str = ",", single_file: bool = False, headers: tuple[str, ...] | None = None) -> str:
    """Writes beside the target and then takes its place, so that a table may be saved over what it is read from.

    single_file: one file named path (all rows pass one task, in order); else a folder
    of files whose order is that of the rows. Repeated headers are written in a single
    file only; in a folder each file has the columns' distinct names.
    """
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:12]}"
    text = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    header = headers is None or len(set(headers)) == len(headers) or not single_file
    if headers is not None and len(set(headers)) == len(headers):
        text = text.toDF(*headers)
    out = text
    if single_file:
        rows = text.withColumn("_at", F.monotonically_increasing_id())
        if not header:  # Spark writes no repeated names: the header goes out as a row before all others
            rows = rows.union(spark.createDataFrame([(*headers, -1)], rows.schema))
        out = rows.repartition(1).sortWithinPartitions("_at").drop("_at")
    out.write.options(header=header, sep=delimiter, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(aside)
    if not single_file:
        files.replace(spark, aside, path)
        return path
    parts = [n for n in files.children(spark, aside) if n.startswith("part-")]
    if parts:
        files.replace(spark, f"{aside}/{parts[0]}", path)
    files.delete(spark, aside)
    return path

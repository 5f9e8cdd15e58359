"""Guessing a file's delimiter, encoding and header from its first bytes."""

from __future__ import annotations

import codecs
import csv
import io

#: Delimiters in the order in which ties are decided, and how many bytes are looked at.
DELIMITERS = (",", ";", "\t", "|")
DELIMITER_BYTES, ENCODING_BYTES, HEADER_BYTES = 8192, 4096, 1 << 20


def sniff_delimiter(data: bytes) -> str:
    """The delimiter found most often outside quotes; a comma where there is none."""
    outside = b"".join(data[:DELIMITER_BYTES].split(b'"')[::2])
    counts = [outside.count(d.encode()) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))]


def sniff_encoding(data: bytes) -> str:
    """By byte order mark, else UTF-8 if the bytes are, else windows-1252. A character cut off at the end does no harm."""
    data = data[:ENCODING_BYTES]
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if data.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
    except UnicodeDecodeError:
        return "windows-1252"
    return "UTF-8"


def read_header(data: bytes, delimiter: str, encoding: str) -> list[str]:
    """The first record that is not blank."""
    text = data.decode({"windows-1252": "cp1252"}.get(encoding, encoding), errors="replace").lstrip("﻿")
    for record in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if record:
            return record
    raise ValueError("the file has no header")


def distinct_names(headers: list[str]) -> list[str]:
    """Column names for headers: a repeated or reserved one gets a number, so that a lookup finds the first."""
    out: list[str] = []
    for i, h in enumerate(headers):
        name, n = h or f"_c{i}", 2
        while name.lower() in {x.lower() for x in out} or name == "_row_idx":
            name, n = f"{h}__{n}", n + 1
        out.append(name)
    return out

"""Licence scan by canonical digests, with DataFrame functions only.

A text is put into canonical form (lower case; copyright lines and `all rights reserved`
gone, behind comment signs too; one spelling of each word; punctuation and white space as
single spaces), and the md5 of the whole form is joined to the digests of known licence
texts. Beside it each line is looked up among known one-line notices.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged
from .license_texts import NOTICES, SPELLINGS, TEXTS

#: Known digests that are sent to every task, at most; of about 60 bytes each.
BROADCAST_ROWS = 50_000

#: Licences published as whole files, and the files' names.
FILES = Path(__file__).parent / "license_files"
FULL = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}

#: Lines that name a holder or reserve rights, whatever signs are before them; lines end at a line feed alone.
COPYRIGHT_LINE = r"(?md)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|:|<|\[|\{|yyyy|[0-9])[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: A line that begins with the word and stands alone between blank ones, once punctuation is gone.
COPYRIGHT_ALONE = r"(\n *\n) *copyright [^\n]*(\n *\n)"


def canonical_lines(text: Column) -> Column:
    """Canonical form in which line ends are still kept; null is the empty text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    out = F.regexp_replace(F.concat(F.lit("\n\n"), out, F.lit("\n\n")), COPYRIGHT_ALONE, "$1$2")
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), SPELLINGS, out)


def canonical(lines: Column) -> Column:
    """The whole canonical form, from the one with line ends: words with one space between."""
    # a spelling of two words may span a line end, so spellings are made equal once more
    out = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [x for x in SPELLINGS if " " in x[0].strip()], out)


def texts() -> list[tuple[str, str]]:
    """Licence and text of those built in, with and without their titles, and of those in license_files."""
    rows = [(i, x) for i, title, text in TEXTS for x in (text, f"{title}\n\n{text}")]
    return rows + [(i, (FILES / name).read_text(encoding="utf-8")) for i, name in FULL.items()]


def known_texts(spark: SparkSession) -> DataFrame:
    """license_id, text of all known licences."""
    return spark.createDataFrame(texts(), "license_id string, text string")


def known_notices(spark: SparkSession) -> DataFrame:
    """license_id, text of the one-line notices built in."""
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def _digests(known: DataFrame) -> DataFrame:
    form = canonical(canonical_lines(F.col("text")))
    out = known.select(F.md5(form).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    # sent to every task while a known table is small (its rows are counted), else shuffled
    return F.broadcast(out) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else out


def scan_licenses(docs: DataFrame, texts: DataFrame | None = None, notices: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, digest, license_id, notices.

    digest: md5 of the whole canonical text (of '' for null and empty texts).
    license_id: the licence whose whole text this is, null if none (of licences with
    equal forms the smallest name). notices: licences named by lines of the text,
    sorted, joined by commas, '' if none. Rows are told apart by a number, so repeated
    keys and rows get their own results each; other columns are neither read nor
    returned. An empty table gives no rows. A text of any length is one row's work.
    """
    spark = docs.sparkSession
    whole = _digests(texts if texts is not None else known_texts(spark))
    line = _digests(notices if notices is not None else known_notices(spark))
    # exploded from an array of one, so that the form is computed once and not once for each use
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("_row"), F.explode(F.array(canonical_lines(F.col(f"`{text}`")))).alias("_lines"))
    each = rows.select("_key", "_row", F.md5(canonical(F.col("_lines"))).alias("digest"), F.posexplode(F.split("_lines", "\n")).alias("_n", "_line"))
    # within a line the form has single spaces already: ends apart it is the canonical one
    each = each.select("_key", "_row", "digest", "_n", F.md5(F.trim("_line")).alias("_d")).join(line.toDF("_d", "_notice"), "_d", "left")
    each = staged(each.where("_n = 0 or _notice is not null").select("_key", "_row", "digest", "_n", "_notice"), "license-lines")
    found = each.where("_notice is not null").groupBy("_row").agg(F.concat_ws(",", F.sort_array(F.collect_set("_notice"))).alias("notices"))
    heads = each.where("_n = 0").select("_key", "_row", "digest")
    out = heads.join(found, "_row", "left").join(whole, "digest", "left")
    return out.select(F.col("_key").alias(key), "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))

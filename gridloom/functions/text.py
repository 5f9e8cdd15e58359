"""Text and number expressions with the table editor's rules: Unicode trimming, ASCII folding, strict numbers."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends, as a number, and as fit for a file name.
ENDS = r"(?U)^\s+|\s+$"
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"
NOT_FILE_SAFE = r"[^\p{IsAlphabetic}\p{N}]"
EPSILON = 2.220446049250313e-16


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, ENDS, "")


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z, every other character as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def blank(c: Column) -> Column:
    return utrim(c) == ""


def num(c: Column) -> Column:
    """The trimmed text as a double, null if it is not a number as a whole."""
    t = utrim(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def is_number(c: Column) -> Column:
    """Neither null nor NaN; for doubles."""
    return c.isNotNull() & ~F.isnan(c)


def file_safe(c: Column) -> Column:
    """A value as part of a file name: every sign a _, blank values `empty`."""
    named = F.regexp_replace(F.coalesce(c, F.lit("")), NOT_FILE_SAFE, "_")
    return F.when(named == "", F.lit("empty")).otherwise(named)


def fmt_num(c: Column) -> Column:
    """A double as text without exponent and without .0."""
    s = c.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(s, "^-", "")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(body, r"^([\d.]+)E", 1), r"\.0$", ""), r"\.", "")
    exponent = F.regexp_extract(body, r"E(-?\d+)$", 1).try_cast("int")
    n = F.length(digits)
    large = F.when(exponent + 1 >= n, F.rpad(digits, exponent + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    wide = F.concat(sign, F.when(exponent >= 0, large).otherwise(small))
    return F.when(c.isin(float("inf"), float("-inf")), F.concat(sign, F.lit("inf"))).when(body.contains("E"), wide).otherwise(F.regexp_replace(s, r"\.0$", ""))

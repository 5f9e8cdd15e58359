import pytest
from gridloom.functions import text
from pyspark.sql import functions as F

NUMBERS = {
    "1": 1.0, " 1.5 ": 1.5, ".5": 0.5, "5.": 5.0, "1e5": 1e5, "-2E-3": -2e-3, "+7": 7.0, "inf": float("inf"), "-Infinity": float("-inf"),
    "1d": None, "1f": None, "0x1p3": None, "1_0": None, "": None, "a": None, ".": None, "1 2": None, " 3 ": 3.0, "​3": None,
}


def test_num(spark):
    got = {r.v: r.n for r in spark.createDataFrame([(v,) for v in NUMBERS], "v string").select("v", text.num(F.col("v")).alias("n")).collect()}
    assert got == NUMBERS


def test_not_a_number(spark):
    row = spark.createDataFrame([("NaN",)], "v string").select(text.is_number(text.num(F.col("v"))).alias("n")).first()
    assert row.n is False


def test_trim_and_blank(spark):
    cells = ["\t a \n", " a　", "\u0085a ", "​a​", " ", "", "　"]
    rows = spark.createDataFrame([(c,) for c in cells], "v string").select(text.utrim(F.col("v")).alias("t"), text.blank(F.col("v")).alias("b")).collect()
    assert [r.t for r in rows] == ["a", "a", "a", "​a​", "", "", ""]
    assert [r.b for r in rows] == [False] * 4 + [True] * 3


@pytest.mark.parametrize(("value", "shown"), [(3.0, "3"), (2.5, "2.5"), (1e7, "10000000"), (1.25e10, "12500000000"), (1e-5, "0.00001"), (-1.5e-7, "-0.00000015"), (123456789.125, "123456789.125"), (-0.5, "-0.5"), (1e21, "1000000000000000000000"), (float("inf"), "inf")])
def test_fmt_num(spark, value, shown):
    assert spark.createDataFrame([(value,)], "v double").select(text.fmt_num(F.col("v")).alias("s")).first().s == shown


def test_file_safe(spark):
    rows = spark.createDataFrame([("a b",), ("a-b",), ("ß",), ("",), (None,), ("1.2",)], "v string").select(text.file_safe(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == ["a_b", "a_b", "ß", "empty", "empty", "1_2"]

import re
import statistics

import pytest
from gridloom.operators import clean, join, labels, rules
from gridloom.operators.rules import Rule
from gridloom.plans.table import Table
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(1, "1"), (2, " 2.0 "), (3, "abc"), (4, "ABC"), (5, ""), (6, None), (7, "NaN"), (8, "inf"), (9, "É"), (10, "é"), (11, "a\n"), (12, "1e0"), (13, "　")]
    return Table.from_dataframe(spark.createDataFrame(rows, "id long, v string"), ["id"])


def _ids(t):
    return sorted(r.id for r in t.to_df().collect())


@pytest.mark.parametrize(
    ("rule", "found"),
    [
        (("equals", "abc"), [3, 4]),
        (("equals", "É"), [9]),
        (("contains", "é"), [9, 10]),
        (("starts_with", "AB"), [3, 4]),
        (("ends_with", "C"), [3, 4]),
        (("is_empty", "x"), [5, 6, 13]),
        (("regex", "^[a-z]+$"), [3, 8]),
        (("regex", "("), []),
        (("regex", "a(?=b)"), []),
        (("regex", r"^\d"), [1, 12]),
        (("regex", "[[:digit:]]"), [1, 2, 12]),
        (("regex", "[[:alpha:]]+$"), [3, 4, 7, 8]),
        (("regex", r"\h"), []),
        (("eq", "1"), [1, 12]),
        (("eq", "x"), []),
        (("eq", "inf"), []),
        (("ne", "1"), [2, 3, 4, 5, 6, 8, 9, 10, 11, 13]),
        (("!=", "abc"), [1, 2, 5, 6, 7, 8, 9, 10, 11, 12, 13]),
        (("gt", "1"), [2, 8]),
        (("gt", "NaN"), []),
        (("lt", "2"), [1, 12]),
        (("in", '["ABC", "é"]'), [3, 4, 9, 10]),
        (("in", "abc, 1"), [1, 3, 4]),
        (("in", "[]"), []),
        (("no such operator", ""), []),
    ],
)
def test_rules(cells, rule, found):
    assert _ids(cells.filter([Rule("v", *rule)])) == found


def test_conjunctions_and_unknown_columns(cells):
    a, b = Rule("v", "contains", "a"), Rule("v", "gt", "0")
    assert _ids(cells.filter([a, b], "OR")) == sorted({*_ids(cells.filter([a])), *_ids(cells.filter([b]))})
    assert _ids(cells.filter([a, b], "or")) == _ids(cells.filter([a, b])) == []
    assert _ids(cells.filter([a, Rule("x", "equals", "y")])) == _ids(cells.filter([a]))
    assert len(_ids(cells.filter([]))) == 13


def test_checklist():
    some = [Rule("a", "gt", "1"), Rule("b", "equals", "x")]
    assert rules.checklist_rule(some, "a", ["1", "2"], ["2"]) == [some[1], Rule("a", "in", '["2"]')]
    assert rules.checklist_rule(some, "a", ["1", "2"], ["1", "2"]) == [some[1]]
    assert rules.without_column(some, "b") == [some[0]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([Rule("v", "contains", "a"), Rule("v", "gt", "1"), Rule("v", "is_empty"), Rule("v", "ne", "abc"), Rule("id", "lt", "9")]), min_size=1, max_size=3))
def test_and_is_intersection_or_is_union(cells, some):
    each = [set(_ids(cells.filter([r]))) for r in some]
    assert set(_ids(cells.filter(some))) == set.intersection(*each)
    assert set(_ids(cells.filter(some, "OR"))) == set.union(*each)


def test_sorting(spark):
    df = spark.createDataFrame([(1, "10", "b"), (2, "9", "A"), (3, "x", "a"), (4, "NaN", "B"), (5, "inf", "a")], "id long, n string, t string")
    t = Table.from_dataframe(df, ["id"])
    assert t.labels() == {"id": "Numeric", "n": "Numeric", "t": "String"}
    ids = lambda x: [r.id for r in x.page(0, 9).collect()]
    assert ids(t.sort("n")) == [2, 1, 5, 3, 4] and ids(t.sort("n", True)) == [5, 1, 2, 3, 4]
    assert ids(t.sort("t")) == [2, 3, 5, 1, 4]
    assert ids(t.sort("id", True).sort("t")) == [5, 3, 2, 4, 1]
    assert [(r.id, r.pos) for r in t.sort("t", True).positions().orderBy("pos").collect()] == [(1, 1), (4, 2), (2, 3), (3, 4), (5, 5)]
    assert ids(t.sort("t").filter([])) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        t.sort("none")


def test_unique_values(spark):
    rows = [(i, v) for i, v in enumerate([" b", "b ", "a", "B", "10", "9", ""])]
    t = Table.from_dataframe(spark.createDataFrame(rows, "id long, v string"), ["id"])
    assert [r.v for r in t.unique("v").orderBy("pos").collect()] == ["", "10", "9", "B", "a", "b"]
    assert sorted(r.v for r in t.unique_values("v", 3).collect()) == ["a", "b"]
    n = Table.from_dataframe(spark.createDataFrame([(i, v) for i, v in enumerate(["10", "9", "x", "9.0", "8"])], "id long, v string"), ["id"])
    assert [r.v for r in n.unique("v").orderBy("pos").collect()] in (["8", "9", "9.0", "10", "x"],)


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a|", "b"), (2, "a", "|b"), (3, "a|", "b"), (4, "A|", "b")], "id long, x string, y string")
    t = Table.from_dataframe(df, ["id"])
    assert sorted(r.id for r in t.dedupe(["x", "y"]).collect()) == [1, 2, 4]
    assert [r.id for r in t.dedupe([]).collect()] == [1] == [r.id for r in t.dedupe(["none"]).collect()]
    assert t.dedupe(["y"]).count() == Table.from_dataframe(t.dedupe(["y"]), ["id"]).dedupe(["y"]).count()
    assert Table.from_dataframe(df.where("false"), ["id"]).dedupe([]).count() == 0


def test_trim(spark):
    t = Table.from_dataframe(spark.createDataFrame([(1, " a ", " b")], "id long, x string, y string"), ["id"])
    assert [tuple(r) for r in t.trim(["x", "none"]).collect()] == [(1, "a", " b")]


@pytest.mark.parametrize(
    ("kind", "filled"),
    [("Value", ["1", "V", "3", "V", "NaN", "3", "x"]), ("Mean", ["1", "2.3333333333333335", "3", "2.3333333333333335", "NaN", "3", "x"]), ("Median", ["1", "3", "3", "3", "NaN", "3", "x"]), ("Mode", ["1", "3", "3", "3", "NaN", "3", "x"]), ("Drop", ["1", "3", "NaN", "3", "x"])],
)
def test_fill(spark, kind, filled):
    rows = [(i, v) for i, v in enumerate(["1", "", "3", "　", "NaN", "3", "x"])]
    t = Table.from_dataframe(spark.createDataFrame(rows, "id long, v string"), ["id"])
    assert [r.v for r in t.fill_missing("v", kind, "V").orderBy("id").collect()] == filled


def test_fill_of_nothing_and_caps(spark):
    t = Table.from_dataframe(spark.createDataFrame([(i, v) for i, v in enumerate(["", "5", "7"])], "id long, v string"), ["id"])
    assert t.fill_missing("v", "Mean", sample_rows=1).orderBy("id").first().v == "0"
    assert t.fill_missing("v", "Mode", sample_rows=1).orderBy("id").first().v == ""
    assert t.fill_missing("v", "Mean", sample_rows=None).orderBy("id").first().v == "6"
    assert t.edit(1, "v", "9").fill_missing("v", "Mean", use_edits=True).orderBy("id").first().v == "8"
    with pytest.raises(ValueError):
        t.fill_missing("v", "Other")
    with pytest.raises(ValueError):
        clean.fill_missing(t.base, "none", "Value")


def test_joins(spark):
    a = Table.from_dataframe(spark.createDataFrame([(1, "k", "a1"), (2, "k", "a2"), (3, "", "a3"), (4, "K", "a4")], "id long, key string, v string"), ["id"])
    b = Table.from_dataframe(spark.createDataFrame([(1, "k", "old"), (2, "k", "new"), (3, "", "blank"), (4, "z", "only b"), (5, None, "none")], "n long, key string, v string"), ["n"])
    got = lambda kind: sorted((r.id or 0, r.key, r.v, r.v_b) for r in a.join(b, "key", "key", kind).collect())
    inner = [(1, "k", "a1", "new"), (2, "k", "a2", "new"), (3, "", "a3", "blank")]
    assert got("inner") == inner and got("left") == [*inner, (4, "K", "a4", "")]
    assert got("right") == [(0, "z", "", "only b"), *inner] and got("outer") == [(0, "z", "", "only b"), *inner, (4, "K", "a4", "")]
    assert a.join(b, "key", "key").columns == ["id", "key", "v", "n_b", "v_b"]
    with pytest.raises(ValueError):
        a.join(b, "key", "key", "semi")


def test_edits(spark):
    t = Table.from_dataframe(spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "id long, v string"), ["id"])
    e = t.edit(1, "v", "x").edit(1, "v", "y").edit(0, "none", "z").edit(2, "id", "31")
    assert sorted(map(tuple, e.to_df().collect())) == [(10, "a"), (20, "y"), (31, "c")]
    assert [r.v for r in e.sort("v", True).filter([Rule("v", "equals", "Y")]).to_df().collect()] == ["y"]
    more = t.edit(5, "v", "end")
    assert more.count() == 6 and [r.v for r in more.page(2, 9).collect()] == ["c", "", "", "end"]
    assert more.filter([Rule("v", "is_empty")]).count() == 0
    assert more.discard().count() == 3
    assert {r.part: r.n for r in t.edit(0, "v", "b").split_by("v").groupBy("part").agg(F.count("*").alias("n")).collect()} == {"b": 2, "c": 1}
    assert [r.part for r in t.split_rows(0).orderBy("id").collect()] == [1, 2, 3]


def test_labels(spark):
    kinds = {"true": "Boolean", " FALSE ": "Boolean", "1": "Numeric", "1e5": "Numeric", "2024-01-02": "Datetime", "1/2/2024": "Datetime", "1-2-3": "String", "x": "String", "": None}
    got = spark.createDataFrame([(k,) for k in kinds], "v string").select("v", labels.label(F.col("v")).alias("l")).collect()
    assert {r.v: r.l for r in got} == kinds
    votes = spark.createDataFrame([(1, "1", "", "true"), (2, "x", "", "2"), (3, "", " ", "")], "id long, a string, b string, c string")
    assert dict(map(tuple, labels.infer_labels(votes, [F.col("id")]).collect())) == {"id": "Numeric", "a": "Numeric", "b": "String", "c": "Numeric"}


def test_stream_of_arrivals(spark, tmp_path):
    from gridloom.streaming import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("k,v\na,1\na,2\nb,3\n")
    (tmp_path / "in" / "2.csv").write_text("k,v\nb,4\nc,0\n")
    stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), ["k", "v"])
    some = arrivals.first_arrivals(arrivals.filter_arrivals(stream, [Rule("v", "gt", "0")]), ["k"])
    q = some.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("arrivals").collect()) == ["a", "b"]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    t = Table.from_dataframe(df, ["o_orderkey"]).filter([Rule("o_totalprice", "gt", "400000")])
    plan = t.to_df().select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "GreaterThan(o_totalprice" in plan


@pytest.fixture
def many_partitions(spark):
    """Sorts that keep many partitions, as a large table's do."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_row_numbers_over_many_partitions(many_partitions):
    spark, n = many_partitions, 1_000_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.md5(F.col("id").cast("string")).alias("s"), F.repeat(F.md5((F.col("id") + 1).cast("string")), 8).alias("wide"))
    t = Table.from_dataframe(rows, ["k"])
    assert t.numbered.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    got = t.sort("s", True).positions().agg(F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).first()
    assert tuple(got) == (n, 1, n, n)
    by = t.sort("s").positions().select("s", "pos").where("pos % 9973 = 1").orderBy("pos").collect()
    assert [r.s for r in by] == sorted(r.s for r in by) and len(by) == n // 9973 + 1
    assert [tuple(r) for r in t.edit(200_001, "s", "x").to_df().where("s = 'x'").select("k").collect()] == [(200_001,)]
    parts = {r.part: (r.n, r.a, r.b) for r in t.split_rows(50_000).groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).collect()}
    assert parts == {i + 1: (50_000, i * 50_000, i * 50_000 + 49_999) for i in range(20)}


def test_numbers_are_kept_through_edits(spark):
    t = Table.from_dataframe(spark.range(10).select(F.col("id").alias("k"), F.lit("").alias("_at")), ["k"])
    assert t.edit(1, "_at", "a").source is t.source and t.numbered is t.edit(2, "k", "3").sort("k").numbered


@pytest.mark.parametrize("values", [[], [None], [4.0], [3.0, 1.0], [2.0] * 5 + [9.0] * 5, [1.0, 1.0, 7.0, None]])
def test_median_of_few(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "n double")
    known = sorted(v for v in values if v is not None)
    assert clean.median_of_all(df).first().v == (statistics.median(known) if known else None)


@pytest.mark.parametrize("rows", [9999, 10000])
def test_median_over_many_partitions(spark, rows):
    # half of all rows have one value, and the middle lies between or inside partitions
    n = F.when(F.col("id") % 2 == 0, F.lit(1.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)) - 2500.0)
    df = spark.range(rows).select(n.alias("n"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for some in (df, df.where("n <> 1.5")):
            assert clean.median_of_all(some).first().v == statistics.median(r.n for r in some.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def _reads(df):
    """Names of the columns that each scan reads."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<(.*?)>", plan)]


def test_first_rows_are_picked_without_their_columns(spark):
    t = Table.from_dataframe(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["doc_id"])
    some = t.dedupe(["lang"])
    some.collect()
    plan = some._jdf.queryExecution().executedPlan().toString()
    shuffled = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert shuffled and all("text" not in x for x in shuffled) and "BroadcastHashJoin" in plan
    assert {"doc_id", "lang"} in _reads(some)
    orders = Table.from_dataframe(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), ["o_orderkey"])
    both = Table.from_dataframe(spark.read.parquet("/root/testdata/sf0.001/customer.parquet"), ["c_custkey"]).join(orders, "c_custkey", "o_custkey").select("c_name", "o_totalprice_b")
    assert {"o_custkey", "o_orderkey", "o_totalprice"} in _reads(both) and not any("o_orderstatus" in x for x in _reads(both))


def test_rows_without_a_key_or_an_order(spark):
    df = spark.createDataFrame([(2, None, "a"), (1, None, "b"), (None, "k", "c"), (3, "k", "d")], "id long, k string, v string")
    assert sorted(r.v for r in clean.keep_first(df, ["k"], [F.col("id")]).collect()) == ["b", "d"]
    assert sorted(r.v for r in clean.keep_first(df, ["k"], [F.col("id"), F.col("v")], last=True).collect()) == ["a", "d"]


@pytest.mark.parametrize("kind", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("text", [True, False])
def test_a_third_of_all_rows_have_one_key(spark, monkeypatch, kind, text):
    monkeypatch.setattr(join, "HOT_ROWS", 100)
    key = F.when(F.col("id") % 3 == 0, F.lit("" if text else None)).when(F.col("id") % 3 == 1, "7").otherwise((F.col("id") % 1000).cast("string"))
    a = spark.range(6000).select("id", (key if text else key.cast("int")).alias("k"), F.col("id").cast("string").alias("v"))
    b = spark.range(2000).select((F.col("id") % 1500).cast("string").alias("k"), F.col("id").alias("n"), F.lit("x").alias("w")).union(spark.createDataFrame([("", -1, "blank")]))
    b = b if text else b.where("k <> ''").withColumn("k", F.col("k").cast("int"))
    got = Table.from_dataframe(a, ["id"]).join(Table.from_dataframe(b, ["n"]), "k", "k", kind)
    last = {r.k: r for r in b.orderBy("n").collect()}
    want, met = [], set()
    for r in a.collect():
        if (m := last.get(r.k)) or kind in ("left", "outer"):
            want.append((r.id, r.k, r.v, m.n if m else None, m.w if m else ""))
        met.add(r.k)
    if kind in ("right", "outer"):
        want += [(None, k, "", m.n, m.w) for k, m in last.items() if k not in met]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))

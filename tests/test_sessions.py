import json
import random
import time

import pytest
from gridloom.operators import edits, patterns
from gridloom.operators.rules import Rule
from gridloom.plans.table import Table
from gridloom.plans.workspace import Workspace
from gridloom.sources import files
from pyspark.sql import functions as F


def _text(path):
    return sorted(path.read_text().splitlines())


def test_session_goes_on_after_saving_over_its_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n1,x\n2,y\n")
    w = Workspace(spark)
    at = w.open(str(path))
    w.update_cell(at, 3, "k", "4")
    rows = [["1", "x"], ["2", "y"], ["", ""], ["4", ""]]
    for _ in range(3):
        w.save(at, single_file=True)
        assert w.rows(at, 0, 9) == rows and w[at].count() == 4 and w.metadata(at).total_rows == 4
        assert not w[at].log and path.read_text() == "k,v\n1,x\n2,y\n,\n4,\n"
        assert w.open(str(path)) == at
    w.apply_filter(at, [Rule("k", "eq", "4")])
    w.update_cell(at, 3, "v", "w")
    w.save(at, single_file=True)
    assert w.rows(at, 0, 9) == [["4", "w"]]  # the filter stays
    w.update_cell(at, 0, "v", "z")
    w.discard(at)
    w.clear_filter(at)
    assert w.rows(at, 0, 9) == [*rows[:3], ["4", "w"]]
    other = Table.open(spark, str(path)).edit(1, "v", "other")
    assert other.saved(str(tmp_path / "copy.csv")).log is other.log and w.open(str(path)) == at


def test_tables_of_one_source_see_what_was_saved(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n1,x\n2,y\n")
    t = Table.open(spark, str(path))
    edited = t.edit(3, "k", "4")
    edited.save(None, True)
    for some in (t, edited, edited.sort("k", True)):
        assert some.count() == 4
    edited.save(None, True)
    assert path.read_text() == "k,v\n1,x\n2,y\n,\n4,\n"


def test_a_file_that_others_wrote_is_opened_anew(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n1,x\n")
    w = Workspace(spark)
    at = w.open(str(path))
    assert w.open(str(path)) == at
    path.write_text("k;v\n1;x\n2;y\n")
    again = w.open(str(path))
    assert again != at and w.rows(again, 0, 9) == [["1", "x"], ["2", "y"]] and w.open(str(path)) == again


@pytest.mark.parametrize("stop", range(6))
@pytest.mark.parametrize("single", [True, False])
def test_a_replacement_that_stops_anywhere_is_mended(spark, tmp_path, monkeypatch, stop, single):
    path = tmp_path / "t.csv"
    path.write_text("k,v\n1,x\n")
    t = Table.open(spark, str(path)).edit(0, "v", "new")
    calls = []

    def counted(f):
        def call(*a):
            calls.append(f)
            if len(calls) > stop:
                raise KeyboardInterrupt
            return f(*a)

        return call

    for name in ("move", "delete", "write_text"):
        monkeypatch.setattr(files, name, counted(getattr(files, name)))
    try:
        t.save(None, single)
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    assert [tuple(r) for r in Table.open(spark, str(path)).page(0, 9).collect()] == [("1", "new" if stop else "x")] or stop == 1
    assert not list(tmp_path.glob(".*swap*")) and not list(tmp_path.glob("*.old-*"))


def test_many_edits_from_a_frame(spark, monkeypatch):
    n = 200_000
    t = Table.from_dataframe(spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit("").alias("column")), ["k"])
    cells = spark.range(1_000_000).select((F.col("id") % n).alias("row"), F.when(F.col("id") % 2 == 0, "v").otherwise("column").alias("column"), F.col("id").cast("string").alias("value"), F.col("id").alias("seq"))
    began = time.perf_counter()
    many = t.edit_many(cells, seq="seq")
    assert many.log.cells == n and many.log.last == n - 1
    got = many.to_df().agg(F.sum((F.col("v") == F.concat((F.col("k") + 800_000).cast("string"))).cast("long")), F.sum((F.col("column") == (F.col("k") + 800_000).cast("string")).cast("long")), F.count("*")).first()
    assert tuple(got) == (n // 2, n // 2, n) and time.perf_counter() - began < 120
    more = many.edit(3, "v", "last").edit_many(spark.createDataFrame([(3, "column", None), (5, "none", "x"), (None, "v", "x"), (-1, "v", "x"), (n + 1, "v", "end")], "row long, column string, value string"))
    assert [tuple(r) for r in more.to_df().where(f"k is null or k in (3, 4) or v = 'end'").orderBy("k", "v").collect()] == [(None, "", ""), (None, "end", ""), (3, "last", ""), (4, "800004", "")]


def test_logs_are_written_and_merged(spark, monkeypatch):
    monkeypatch.setattr(edits, "RECENT", 5)
    monkeypatch.setattr(edits, "PIECES", 2)
    t = base = Table.from_dataframe(spark.range(30).select(F.col("id").alias("k"), F.lit("").alias("v")), ["k"])
    want, pick = {}, random.Random(1)
    for i in range(23):
        row = pick.randrange(8)
        t, want[row] = t.edit(row, "v", str(i)), str(i)
    assert t.log.pieces and len(t.log.pieces) <= 2 and t.log.size <= 5
    assert {r.k: r.v for r in t.to_df().where("v <> ''").collect()} == want
    a, b = t.edit(20, "v", "a"), t.edit(20, "v", "b")  # two tables of one
    assert [[r.v for r in x.to_df().where("k = 20").collect()] for x in (a, b, t, base)] == [["a"], ["b"], [""], [""]]


def test_stored_views(spark):
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("n", F.monotonically_increasing_id())
        t = Table.from_dataframe(lines, ["n"]).sort("l_extendedprice", True)
        s = t.stored()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    n = s.count()
    assert len(s.store.parts) >= 8 and n == lines.count()
    for offset, limit in ((n // 2, 100), (0, 3), (n - 5, 50), (n, 5), (s.store.parts[3][1] - 2, 4)):
        page = s.page(offset, limit)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert len(page.inputFiles()) <= 2 and "Sort" not in plan
        assert page.collect() == t.page(offset, limit).collect()
    assert s.sort("n").store is None and s.filter([]).store is None and s.edit(0, "n", "1").store is None


def test_workspace_keeps_a_view_and_deletes_it(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f"{i},{i * 7 % 10}\n" for i in range(10)))
    w = Workspace(spark)
    at = w.open(str(tmp_path / "t.csv"))
    w.sort(at, "v")
    assert [r[1] for r in w.rows(at, 0, 4)] == ["0", "1", "2", "3"]
    stored = w[at].store
    assert [r[1] for r in w.rows(at, 8, 4)] == ["8", "9"] and w[at].store is stored and files.exists(spark, stored.path)
    w.update_cell(at, 0, "v", "99")
    assert not files.exists(spark, stored.path) and [r[1] for r in w.rows(at, 8, 4)] == ["9", "99"]
    kept = w[at].store
    w.close(at)
    assert not files.exists(spark, kept.path)


def test_long_lists_are_joins(spark):
    t = Table.from_dataframe(spark.range(1000).select("id", F.concat(F.lit("É"), F.col("id") % 600).alias("v"), F.lit(1).alias("_in")), ["id"])
    values = json.dumps([f"é{i}" for i in range(0, 50_000, 2)])
    began = time.perf_counter()
    some = t.filter([Rule("v", "in", values)]).to_df()
    some._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5 and some.count() == 500
    both = [Rule("v", "in", values), Rule("id", "lt", "100"), Rule("v", "in", json.dumps([f"é{i}" for i in range(300)]))]
    assert sorted(r.id for r in t.filter(both).to_df().collect()) == list(range(0, 100, 2))
    want = [i for i in range(1000) if i % 600 % 2 == 0 or i < 100 or i % 600 < 300]
    got = t.filter(both, "OR").to_df()
    assert sorted(r.id for r in got.collect()) == want and got.columns == ["id", "v", "_in"]
    assert t.filter(both[:1], "OR").count() == 500 and t.edit(1, "v", "é2").filter(both[:1]).count() == 501


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("[[:digit:]]", ["12"], [":", "٣"]),
        ("[[:alpha:]]+$", ["ab", "1a"], [":", "a1", "a\n"]),
        ("[[:^alpha:]]", ["1"], ["ab", ""]),
        ("^a++a", ["aaa"], ["a", "ba"]),
        ("^(a*)*b", ["b", "aab"], ["cb"]),
        ("[a-z--b]", ["a"], ["b", "", "-"]),
        ("[a-z&&[^aeiou]]", ["xb"], ["aei"]),
        ("[a-g~~b-h]", ["a", "h"], ["bcdefg"]),
        ("[^[:alpha:]\\d]", ["-"], ["a1"]),
        ("[]a]", ["]", "a"], ["b"]),
        ("[-a]", ["-", "a"], ["b"]),
        ("[a-]", ["-", "a"], ["b"]),
        ("[a^]", ["^"], ["b"]),
        ("[\\w--\\d]", ["a", "é"], ["7", "٣"]),
        ("a.b", ["a\rb", "axb"], ["a\nb"]),
        ("(?s)a.b", ["a\nb"], ["ab"]),
        ("^a$", ["a"], ["a\n", "b\na"]),
        ("(?m)^a$", ["a", "b\na\nc"], ["ba"]),
        ("(?mR)^a$", ["b\r\na\r\nc"], ["ba"]),
        ("a$|b", ["a", "bc"], ["ac"]),
        ("(?i)straße[Σ]", ["STRAßEς"], ["strasse"]),
        ("(?i)a(?-i)b|c", ["Ab", "c"], ["AB", "C"]),
        ("(?i:a)b", ["Ab"], ["AB"]),
        ("(?i)[^a]", ["b"], ["A", "a"]),
        ("(?x) a b # c\n d", ["abd"], ["a b d"]),
        (r"\d\s\w", ["٣　é"], ["a b"]),
        (r"(?-u)^\w+$", ["ab_1"], ["é"]),
        (r"\bé\b", ["é", "a é b"], ["aé"]),
        (r"\Bb", ["ab"], ["b"]),
        (r"\b{start}b", ["a b"], ["ab"]),
        (r"\<b\>", ["a b"], ["ab"]),
        (r"\x41\u{e9}\n\-\/", ["Aé\n-/"], ["A"]),
        (r"\pL\p{Lu}\P{Nd}\p{Greek}", ["aBxα"], ["aB1α"]),
        (r"\p{Letter}\p{sc=Greek}\p{^L}", ["aα1"], ["aαb"]),
        (r"\p{Alphabetic}\p{White_Space}", ["a "], ["1 "]),
        ("(?P<n>a)(?<m>b)", ["ab"], ["a"]),
        ("a{2}b{1,}c{0,1}$", ["aabb", "aabc"], ["abc"]),
        ("(?U)a+?b", ["aab"], ["b"]),
        ("", ["", "x"], []),
        ("a|", ["", "x"], []),
        ("}", ["}"], ["{"]),
        ("𝄞[𝄀-𝄟]", ["𝄞𝄡𝄞𝄞"], ["𝄞"]),
    ],
)
def test_patterns(spark, pattern, yes, no):
    java = patterns.java_pattern(spark, pattern)
    assert java is not None
    df = spark.createDataFrame([(x,) for x in yes + no], "v string")
    assert [r[0] for r in df.select(F.col("v").rlike(java)).collect()] == [True] * len(yes) + [False] * len(no)


INVALID = [r"\h", r"\R", "(?>a)", r"\Qa\E", r"\Z", r"\1", r"(a)\1", r"\k<a>", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(", ")", "[", "[]", "[^]", "[a", "[b-a]", "[a-\\d]", "*a", "a|*", "a{2,1}", "a{", "a{,2}", "{1}", "a{1001}", "(?z)", "(?i-)", "(?P<1>a)", "(?P<a>x)(?P<a>y)", "(?", "\\", r"\p{Nope}", r"\xZZ", r"\x{110000}", r"\u{D800}", r"\b{", "(?)", r"\e", r"\cA", r"\07"]


def test_what_is_no_pattern_passes_nothing(spark):
    assert {p: patterns.java_pattern(spark, p) for p in INVALID} == dict.fromkeys(INVALID)


def _scratch(spark):
    base = files.scratch(spark, "x").rpartition("/")[0]
    return set(files.children(spark, base)) if files.exists(spark, base) else set()


def test_commands_leave_no_scratch(spark, tmp_path):
    path, other = tmp_path / "t.csv", tmp_path / "o.csv"
    path.write_text("k,v\n1, x\n2,\n2,y\n1,x\n3,x\n")
    other.write_text("k,w\n1,one\n4,four\n")
    w = Workspace(spark)
    at, of = w.open(str(path)), w.open(str(other))
    before = _scratch(spark)
    filled = w.open(w.clean(at, "fill_missing", str(tmp_path / "filled"), name="v", kind="Mode", sample_rows=None))
    assert w.rows(filled, 1, 1) == [["2", "x"]]
    w.clean(at, "fill_missing", str(tmp_path / "median"), name="k", kind="Median", sample_rows=None)
    w.join(at, "k", of, "k", "outer", str(tmp_path / "joined"))
    assert w.unique_values(at, "k") == ["1", "2", "3"]
    assert len(w.split(at, "column", str(tmp_path / "parts"), column_name="k")) == 3
    assert _scratch(spark) == before


def test_scratch_scopes(spark):
    rows = Table.from_dataframe(spark.range(100).selectExpr("id AS k", "cast(100 - id AS string) AS v"), ["k"])
    before = _scratch(spark)
    with files.scratch_scope(spark):
        with files.scratch_scope(spark):
            assert rows.sort("v").positions().where("pos = 1").first().v == "1"
            assert len(_scratch(spark) - before) == 1
        assert _scratch(spark) == before
        # what a table goes on with is kept: its numbers, its edits, its stored view
        edited = rows.edit_many(spark.createDataFrame([(7, "v", "new")], "row long, column string, value string"))
        view = edited.sort("k", True).stored()
    assert edited.to_df().where("v = 'new'").first().k == 7 and view.page(92, 1).first().v == "new"
    assert len(_scratch(spark) - before) == 3
    view.store.delete(spark)
    before = _scratch(spark)
    with pytest.raises(ZeroDivisionError), files.scratch_scope(spark):
        rows.positions().count()
        raise ZeroDivisionError
    assert _scratch(spark) == before

import pytest
from gridloom.plans.table import Table
from gridloom.plans.workspace import Workspace
from gridloom.sources import sniff


def _open(spark, tmp_path, data, name="t.csv", **options):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return Table.open(spark, str(path), **options)


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("data", "found"), [("a;b;c\n1,2;3;4", ";"), ("a\tb\n", "\t"), ("a|b\n", "|"), ("a,b;c\n", ","), ("a\n", ","), ('"a,b,c,d";e\n', ";")])
def test_delimiters(data, found):
    assert sniff.sniff_delimiter(data.encode()) == found


@pytest.mark.parametrize(
    ("data", "found"),
    [(b"\xef\xbb\xbfa", "UTF-8"), ("a".encode("utf-16"), "UTF-16LE"), (b"\xfe\xff\x00a", "UTF-16BE"), ("é".encode(), "UTF-8"), ("é".encode("cp1252") + b" x", "windows-1252"), (b"x" * 4095 + "é".encode(), "UTF-8")],
)
def test_encodings(data, found):
    assert sniff.sniff_encoding(data) == found


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blank_lines_anywhere_are_no_rows(spark, tmp_path, end):
    lines = ["", "k;sum", "", "", "a;1", "", '"";""', "b;=1+1", "   ", '=B2;"=""C3"""', ""]
    t = _open(spark, tmp_path, end.join(lines))
    assert t.base.columns == ["k", "sum"]
    # a line of spaces is a row, and so is one of empty cells; only lines without any sign are none
    assert _rows(t.page(0, 20)) == [("a", "1"), ("", ""), ("b", "=1+1"), ("   ", ""), ("=B2", '="C3"')]
    assert t.edit(0, "sum", "2").page(0, 1).first()["sum"] == "2"


def test_quotes_ragged_rows_and_repeated_headers(spark, tmp_path):
    t = _open(spark, tmp_path, 'a,a,b\n"x ""q"" y","1\n2", padded \nshort\nlong,1,2,3\n"v,w",,\n')
    assert t.base.columns == ["a", "a__2", "b"]
    assert _rows(t.page(0, 9)) == [('x "q" y', "1\n2", " padded "), ("short", "", ""), ("long", "1", "2"), ("v,w", "", "")]
    path = t.save(str(tmp_path / "out.csv"), single_file=True)
    assert _rows(Table.open(spark, path).page(0, 9)) == _rows(t.page(0, 9))
    assert (tmp_path / "out.csv").read_text().startswith("a,a,b\n")


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp1252", "utf-16"])
def test_other_encodings(spark, tmp_path, encoding):
    t = _open(spark, tmp_path, "näme;b\r\né;1\r\nü;2\r\n".encode(encoding))
    assert t.dialect.delimiter == ";" and _rows(t.page(0, 9)) == [("é", "1"), ("ü", "2")]


def test_signs_of_windows_1252(spark, tmp_path):
    t = _open(spark, tmp_path, "“k”;v\n€;–’\n".encode("cp1252"))
    assert t.dialect.encoding == "windows-1252" and _rows(t.page(0, 9)) == [("€", "–’")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_header_only(spark, tmp_path):
    t = _open(spark, tmp_path, "\n\na,b\n")
    assert t.count() == 0 and t.metadata().total_fields == 0
    with pytest.raises(ValueError):
        _open(spark, tmp_path, "\n\n")
    with pytest.raises(FileNotFoundError):
        Table.open(spark, str(tmp_path / "none.csv"))


def test_saving_over_the_file_that_is_read(spark, tmp_path):
    t = _open(spark, tmp_path, "a,b\n1,x\n2,y\n").edit(1, "b", "new, cell").edit(3, "a", "4")
    t.save(single_file=True)
    again = Table.open(spark, str(tmp_path / "t.csv"))
    assert _rows(again.page(0, 9)) == [("1", "x"), ("2", "new, cell"), ("", ""), ("4", "")]


def test_split_files(spark, tmp_path):
    t = _open(spark, tmp_path, "k,v\nß,3\na b,1\na-b,2\n,4\nß,5\n", "t.txt")
    for one in (True, False):
        paths = t.write_split(str(tmp_path / f"parts{one}"), "column", column_name="k", one_file=one)
        assert [p.rpartition("/")[2] for p in paths] == ["t_ß.txt", "t_a_b.txt", "t_empty.txt"]
        assert [_rows(Table.open(spark, p).page(0, 9)) for p in paths] == [[("ß", "3"), ("ß", "5")], [("a b", "1"), ("a-b", "2")], [("", "4")]]
    assert (tmp_path / "partsTrue" / "t_ß.txt").is_file() and (tmp_path / "partsFalse" / "t_ß.txt").is_dir()
    paths = t.write_split(str(tmp_path / "rows"), "rows", row_limit=2)
    assert [p.rpartition("/")[2] for p in paths] == ["t_part_1.txt", "t_part_2.txt", "t_part_3.txt"]
    assert (tmp_path / "rows" / "t_part_2.txt").read_text() == "k,v\na-b,2\n,4\n"
    with pytest.raises(ValueError):
        t.write_split(str(tmp_path / "no"), "other")


def test_many_parts(spark, tmp_path):
    t = _open(spark, tmp_path, "k,v\n" + "".join(f"{i},{i % 7}\n" for i in range(600)))
    for _ in range(2):  # parts that are there are replaced
        paths = t.write_split(str(tmp_path / "parts"), "rows", row_limit=2)
        assert [p.rpartition("_")[2] for p in paths] == [f"{i}.csv" for i in range(1, 301)]
        assert (tmp_path / "parts" / "t_part_300.csv").read_text() == "k,v\n598,3\n599,4\n"
    assert len(list((tmp_path / "parts").glob("t_part_*"))) == 300


def test_workspace_commands(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n1,x\n2,y\n2,z\n")
    (tmp_path / "b.csv").write_text("id,w\n2,old\n2,new\n3,q\n")
    w = Workspace(spark)
    a, b = w.open(str(tmp_path / "a.csv")), w.open(str(tmp_path / "b.csv"))
    assert w.open(str(tmp_path / "a.csv")) == a
    from gridloom.operators.rules import Rule

    assert w.apply_filter(a, [Rule("id", "eq", "2")]) == 2
    w.sort(a, "n", True)
    assert w.rows(a, 0, 5) == [["2", "z"], ["2", "y"]]
    w.clear_filter(a)
    assert w.unique_values(a, "id") == ["1", "2"]
    w.update_cell(a, 0, "n", "edited")
    assert w.rows(a, 0, 1) == [["1", "edited"]]
    out = w.join(a, "id", b, "id", "outer", str(tmp_path / "j"))
    assert sorted(_rows(Table.open(spark, out).to_df())) == [("1", "edited", ""), ("2", "y", "new"), ("2", "z", "new"), ("3", "", "q")]
    out = w.clean(a, "deduplicate", str(tmp_path / "d"), keys=["id"])
    assert sorted(_rows(Table.open(spark, out).to_df())) == [("1", "edited"), ("2", "y")]
    w.discard(a)
    assert w.rows(a, 0, 1) == [["1", "x"]]
    with pytest.raises(ValueError):
        w.clean(a, "other", str(tmp_path / "x"))
    w.close(a)
    with pytest.raises(ValueError):
        w.metadata(a)

import csv
import io
import random

import pytest
from gridloom.plans.table import Table
from gridloom.sources import delimited
from gridloom.sources.records import ROW


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records, quotes and line ends fall on every kind of border."""
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def numbered(spark, path):
    df, _, total = delimited.read_numbered(spark, str(path))
    rows = sorted(map(tuple, df.collect()))
    assert [r[0] for r in rows] == list(range(total))
    return [r[1:] for r in rows]


CELLS = ["", "x", "two words", "line\nend", "\n", "\n\n\n", 'a "quote"', '"', '""\n"', "a,b", ",", "é\n中", "x" * 150, "y\n" * 40, " padded ", "\r\nz"]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_a_reader_of_whole_files(small_blocks, tmp_path, seed, end):
    pick = random.Random(seed)
    rows = [[pick.choice(CELLS) for _ in range(3)] for _ in range(pick.choice([0, 1, 60]))]
    rows = [r for r in rows if any(r)] + [["last", "", ""]]
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end, quoting=pick.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerows([["a", "b\nc", "d"], *rows])
    data = out.getvalue().replace(f"{end}last", f"{end}{end}{end}last")
    (tmp_path / "t.csv").write_bytes(data.encode() if seed % 2 else data.rstrip("\r\n").encode())
    assert numbered(small_blocks, tmp_path / "t.csv") == list(map(tuple, rows))
    if end == "\r\n":  # of which Spark's own reader of whole files leaves some behind
        return
    whole = small_blocks.read.csv(str(tmp_path / "t.csv"), header=True, multiLine=True, quote='"', escape='"', schema="a string, b string, c string").fillna("")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows))


def test_many_tasks_read_one_file(small_blocks, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f'{i},"{i}\nline"\n' for i in range(300)))
    t = Table.open(small_blocks, str(tmp_path / "t.csv"))
    assert t.base.rdd.getNumPartitions() >= 8 and t.base_count == 300
    assert [tuple(r) for r in t.page(150, 2).collect()] == [("150", "150\nline"), ("151", "151\nline")]
    assert t.labels() == {"k": "Numeric", "v": "String"}
    assert [tuple(r) for r in t.edit(299, "v", "x").page(298, 9).collect()] == [("298", "298\nline"), ("299", "x")]


def test_files_of_a_folder_are_in_order_of_their_names(small_blocks, tmp_path):
    folder = tmp_path / "a folder é%20"
    folder.mkdir()
    sizes = [3, 50, 0, 1, 20]
    for n, size in enumerate(sizes):
        (folder / f"part-{n}.csv").write_text("k,v\n" + "".join(f'{n},"{i}\n"\n' for i in range(size)))
    (folder / "part-9.csv").write_text("")
    assert numbered(small_blocks, folder) == [(str(n), f"{i}\n") for n, size in enumerate(sizes) for i in range(size)]


def test_stray_quotes_and_filters(small_blocks, tmp_path):
    lines = ["size,item", '5" pipe,a', '7,24" screen', '8,"in\n""quotes"" "', "", "   ", '9,"z"', '"open,1', "2"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    assert numbered(small_blocks, tmp_path / "t.csv")[:4] == [('5" pipe', "a"), ("7", '24" screen'), ("8", 'in\n"quotes" '), ("   ", "")]
    df, _, total = delimited.read_numbered(small_blocks, str(tmp_path / "t.csv"))
    assert total == 6 and [r[ROW] for r in df.where("size = '9'").collect()] == [4]
    assert df.where("item = 'a'").select("size").count() == 1 and df.select(ROW).count() == 6


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp1252"])
def test_encodings(small_blocks, tmp_path, encoding):
    (tmp_path / "t.csv").write_bytes(('"ä ""x""";b\r\n' + "“é”;\"ü\r\n–\"\r\n" * 30).encode(encoding))
    assert numbered(small_blocks, tmp_path / "t.csv") == [("“é”", "ü\r\n–")] * 30

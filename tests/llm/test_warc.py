import base64
import gzip
import hashlib
import io
from collections import defaultdict
from pathlib import Path

import pytest
from gridloom.llm import queries, warc
from pyspark.errors import PythonException
from pyspark.sql import types as T


def expected(rows, min_bytes=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of (page_id, html) rows."""
    groups, out = defaultdict(list), []
    for n, (page_id, html) in enumerate(rows):
        groups[(html or "").encode()].append((page_id is None, page_id, n))
    for payload, some in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first, *rest = sorted(some, key=lambda x: (x[0], x[1] or 0, x[2])) if len(payload) >= min_bytes else (some[0],)
        if len(payload) < min_bytes:
            out += [(p, len(payload), digest, "response", None) for _, p, _ in some]
            continue
        out.append((first[1], len(payload), digest, "response", None))
        out += [(p, len(payload), digest, "revisit", first[1]) for _, p, _ in rest]
    return sorted(map(str, out))


def pages(spark, rows, kind="long"):
    df = spark.createDataFrame([(p, f"https://example.org/{n}\n ü", h, "x", 1) for n, (p, h) in enumerate(rows)], f"page_id {kind}, url string, html string, key string, row int")
    return df


def through(spark, df, folder, kind=None, **options):
    files = warc.write_warc(df, path=str(folder), **options)
    back = warc.page_records(warc.read_warc(spark, files), kind or T.LongType())
    return sorted(map(str, map(tuple, back.collect()))), [Path(r.file.removeprefix("file:")) for r in files.collect()]


ROWS = [(5, "<p>a</p>"), (3, "<p>a</p>"), (3, "<p>a</p>"), (None, "<p>a</p>"), (7, ""), (8, None), (1, "é中😀" * 50_000), (2, "é中😀" * 50_000), (9, "own\r\n\r\nWARC/1.1\r\n"), (None, None)]


def test_round_trip(spark, tmp_path):
    for n, least in enumerate((0, 1, 9)):
        got, files = through(spark, pages(spark, ROWS), tmp_path / str(n), min_bytes=least)
        assert got == expected(ROWS, least)
    for f in files:  # any reader of gzip and of WARC can read them
        text = gzip.decompress(f.read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\n " not in text.split(b"WARC-Target-URI: ", 1)[-1].split(b"\r\n")[0]


def test_empty_table_and_text_keys(spark, tmp_path):
    assert through(spark, pages(spark, ROWS).where("false"), tmp_path / "none") == ([], [])
    rows = [("a/b c+d%", "x"), ("<é>\n", "x"), ("", "x")]
    got, _ = through(spark, pages(spark, rows, "string"), tmp_path / "text", T.StringType())
    assert got == sorted(map(str, [("", 1, warc.base32_sha1(b"x"), "response", None), ("<é>\n", 1, warc.base32_sha1(b"x"), "revisit", ""), ("a/b c+d%", 1, warc.base32_sha1(b"x"), "revisit", "")]))


def test_a_third_of_all_rows_are_one_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridloom.llm._common.HOT", 20)
    rows = [(n, "<p>notice</p>" if n % 3 else f"<p>{n // 9}</p>") for n in range(900)]
    got, files = through(spark, pages(spark, rows).repartition(5), tmp_path, file_bytes=20_000)
    assert got == expected(rows) and len(files) > 5  # files are begun anew at their bound
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_payloads_come_back(spark, tmp_path):
    files = warc.write_warc(pages(spark, ROWS), path=str(tmp_path))
    found = {r.record_id: r for r in warc.read_warc(spark, files, payloads=True).collect()}
    assert len(found) == len(ROWS)
    for r in found.values():
        whole = r if r.record_type == "response" else found[r.refers_to]
        assert warc.base32_sha1(bytes(whole.payload)) == r.payload_digest and len(whole.payload) == r.payload_bytes
    assert sorted(bytes(r.payload) for r in found.values() if r.payload is not None) == sorted({(h or "").encode() for _, h in ROWS})


def test_damage_is_an_error(spark, tmp_path):
    files = warc.write_warc(pages(spark, ROWS[-2:]), path=str(tmp_path))
    paths = [r.file for r in files.collect()]
    data = Path(paths[0].removeprefix("file:")).read_bytes()
    assert len(list(warc.read_records(io.BytesIO(data)))) >= 2
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(data[:-3])))
    plain = [*warc.read_records(io.BytesIO(data))][-1]
    fields = {"WARC-Payload-Digest": f"sha1:{warc.base32_sha1(b'other')}"}
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(warc.record("response", fields, plain.block))))
    whole = warc.record("response", {}, b"HTTP/1.1 200 OK\r\n\r\nabc")
    for wrong, says in ((b"Content-Length: 2\r\n", "longer"), (b"Content-Length: 99\r\n", "shorter"), (b"Content-Length: x\r\n", "without")):
        text = gzip.decompress(whole).replace(b"Content-Length: 22\r\n", wrong)
        with pytest.raises(ValueError, match=says):
            list(warc.read_records(io.BytesIO(gzip.compress(text))))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.read_records(io.BytesIO(gzip.compress(b"x\r\n\r\n"))))
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(data[:-3])
    with pytest.raises(PythonException, match=r"bad\.warc\.gz"):
        warc.read_warc(spark, spark.createDataFrame([(str(bad),)], "file string")).collect()


def test_members_over_chunk_borders(monkeypatch):
    blocks = [b"", b"x", bytes(range(256)) * 5000, b"\r\n\r\n" * 50, b"y" * 3_000_000]
    data = b"".join(warc.record("resource", {"N": str(i)}, b) for i, b in enumerate(blocks))
    for chunk in (1, 7, 1000, 1 << 20):
        if chunk > 1 or len(data) < 100_000:
            monkeypatch.setattr(warc, "CHUNK", chunk)
            assert [r.block for r in warc.read_records(io.BytesIO(data))] == blocks


def test_query_over_its_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted(map(str, map(tuple, queries.queries()["op12_warc"](spark, sf).collect())))
    assert got == expected([(r.page_id, r.html) for r in df.select("page_id", "html").collect()])

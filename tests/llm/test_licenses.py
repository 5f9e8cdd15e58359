from gridloom.llm import licenses
from gridloom.llm.license_texts import TEXTS


def test_whole_texts(spark):
    mit = dict((i, x) for i, _, x in TEXTS)["MIT"]
    rows = [
        (1, "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,")),
        (2, mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(" ", "\n")),
        (3, mit + " And more."),
        (4, "(c) 1999 Me\n" + mit),
        (5, mit.replace("sublicense", "sublicence")),
    ]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: "MIT", 5: "MIT"}


def test_notices_and_awkward_rows(docs, none):
    got = licenses.scan_licenses(docs).collect()
    assert sorted((str(r.doc_id), r.notices) for r in got) == [("1", "MIT"), ("2", ""), ("3", ""), ("4", "MIT"), ("4", "MIT"), ("7", ""), ("None", "")]
    assert licenses.scan_licenses(none).count() == 0


def test_own_list_and_equal_forms(spark):
    known = spark.createDataFrame([("B", "Do what you like!"), ("A", "do WHAT you like")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "Do what, you like")], "doc_id long, text string")
    assert licenses.scan_licenses(docs, texts=known).first().license_id == "A"


def test_whole_files(spark):
    rows = [(i, (licenses.FILES / name).read_text(encoding="utf-8").replace("\n", " \n ")) for i, name in licenses.FULL.items()]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.license_id == r.doc_id for r in got)


def _variants(text):
    lines = text.split("\n")
    return [
        "Copyright (c) 2021 Some Body\nAll rights reserved.\n\n" + text,
        "\n".join("# " + x for x in ["Copyright Jane Doe and others", "", *lines]),
        "/*\n" + "\n".join(" * " + x for x in ["", "© 2003, 2004 A. Person", *lines]) + "\n */",
        "Copyright <YEAR> <COPYRIGHT HOLDER>\n\n" + text.upper().replace(",", " ,").replace("LICENSE", "LICENCE"),
    ]


def test_variants_of_every_licence(spark):
    rows = [(f"{n} {v} {i}", x) for n, (i, text) in enumerate(licenses.texts()) for v, x in enumerate(_variants(text))]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and [r.doc_id for r in got if r.doc_id.split()[2] != r.license_id] == []


def test_sentences_about_copyright_stay(spark):
    rows = [(1, "one\ncopyright notice and this\ntwo"), (2, "one\n\ntwo"), (3, "one\nall rights reserved by us\ntwo"), (4, "one\n\nCopyright Jane Doe\n\ntwo"), (5, "one\n(c) 2001 x\ntwo"), (6, "one two")]
    got = {r.doc_id: r.digest for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == got[4] == got[5] == got[6] and len({got[1], got[2], got[3]}) == 3


def test_rows_of_one_key_keep_their_own_notices(spark):
    rows = [(1, "Released under the MIT License."), (1, "// SPDX-License-Identifier: GPL-2.0-or-later"), (1, "* Licensed under the Apache License, Version 2.0 (the \"License\");\nMIT"), (1, ""), (1, "")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.notices for r in got) == ["", "", "Apache-2.0", "GPL-2.0", "MIT"]
    long = spark.createDataFrame([(1, "word " * 400_000 + "\nReleased under the MIT License.")], "doc_id long, text string")
    assert licenses.scan_licenses(long).first().notices == "MIT"

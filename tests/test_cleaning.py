import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import languages
from siltstone.functions.python_code import balanced, compiles, docstring, functions, signals
from siltstone.operators import cleaning as C
from siltstone.operators import licensing as L

MIT = "Permission is hereby granted, free of charge, to any person"
APACHE = "Apache License\n   Version 2.0, January 2004"


def frame(spark, rows):
    return spark.createDataFrame([(i, "r", p, c if isinstance(c, bytes) or c is None else c.encode()) for i, (p, c) in enumerate(rows)], "ord long, repository string, path string, content binary")


def test_reasons_in_order(spark):
    long = "x" * 5000
    rows = [
        ("node_modules/a.js", "var a = 1; // something"), ("a/package-lock.json", "{}" * 20), ("b.bin", b"\x00" * 50), ("c.py", "print(1)  # some text here".encode() + b"\xff\xfe"),
        ("d.py", "x"), ("e.min.js", "var a = 1; // something"), ("f.js", long), ("g.py", "# DO NOT EDIT by hand\nx = 1234567"), ("h.py", "def f():\n    return 12345\n"), ("i.py", None), ("", "text without any path at all"),
    ]
    got = [r.reason for r in C.clean(frame(spark, rows)).orderBy("ord").collect()]
    assert got == ["vendor", "lockfile", "binary", "encoding", "too_small", "minified", "minified", "generated", "", "encoding", ""]


def test_large_first_and_secret_policy(spark):
    text = 'api_key = "supersecretvalue123"\ntoken = "abcdefgh12345678xyz"\n'
    df = frame(spark, [("a.py", text), ("b.py", "y" * 100)])
    r = C.clean(df, max_bytes=90).orderBy("ord").collect()
    assert r[1].reason == "too_large"
    assert r[0].secrets_redacted == 2 and "REDACTED" in r[0].text and "supersecret" not in r[0].text and r[0].transformed
    assert C.clean(df, drop_secret_files=True).orderBy("ord").first().reason == "secret"


def test_notebook_outputs_are_emptied():
    book = {"cells": [{"cell_type": "code", "outputs": [1], "execution_count": 3, "source": "é"}], "nbformat": 4}
    out = json.loads(C.strip_notebook(json.dumps(book)))
    assert out["cells"][0]["outputs"] == [] and out["cells"][0]["execution_count"] is None
    assert C.strip_notebook("[1, 2]") == "[1, 2]" and C.strip_notebook("no json") == "no json"


def test_dataset_clean_first_copy_wins(spark):
    rows = [("dup.py", "x = 1\n" * 5), ("mod.py", "x = 1\n" * 5), ("empty.py", "  \n"), ("build/x.py", "x = 2"), ("p_pb2.py", "# Code generated by x"), ("n.bin", b"\x00a")]
    got = [r.reason for r in C.dataset_clean(frame(spark, rows)).orderBy("ord").collect()]
    assert got == ["", "duplicate", "empty", "vendor", "generated", "binary"]
    assert [r.reason for r in C.dataset_clean(frame(spark, rows), dedup=False).orderBy("ord").collect()][1] == ""


def test_validate(spark):
    rows = [("a.py", "def f(:\n  pass", "python"), ("b.py", "x = 12345", "python"), ("c.exe", "x = 12345", "text"), ("LICENSE", "some license text", "unknown"), ("d.py", "x", "python")]
    df = spark.createDataFrame(rows, "path string, text string, language string")
    assert [r.reason for r in C.validate(df).collect()] == ["syntax", "", "extension", "language", "size"]


def test_binary_share_counts_bytes(spark):
    text = "abc" * 10 + "é" * 5
    df = spark.createDataFrame([(text,), ("é" * 40,), ("",)], "t string")
    assert [r[0] for r in df.select(C.is_binary(F.col("t"))).collect()] == [False, True, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [(MIT, "MIT"), (APACHE, "Apache-2.0"), ("// SPDX-License-Identifier: ISC\n" + MIT, "ISC"), ("GNU General Public License\nVersion 3", "GPL-3.0-or-later"), ("nothing", "UNKNOWN"), ("", "UNKNOWN")],
)
def test_license_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(L.text_license(F.col("t"))).first()[0] == want


def test_license_policy(spark):
    df = spark.createDataFrame([("MIT",), ("GPL-3.0-only",), ("UNKNOWN",), ("Zlib",)], "s string")
    ask = lambda **k: [r[0] for r in df.select(L.is_allowed(F.col("s"), **k)).collect()]
    assert ask() == [True, False, False, False]
    assert ask(allow_copyleft=True, allow_unknown=True) == [True, True, True, False]
    assert ask(allowed=()) == [True, False, False, True]


def test_repository_license_prefers_license_files(spark):
    rows = [("a.py", "# SPDX-License-Identifier: ISC"), ("LICENSE", MIT), ("LICENSE.txt", APACHE)]
    assert L.repository_license(frame(spark, rows)).first().license == "MIT"
    assert L.repository_license(frame(spark, rows[:1])).first().license == "ISC"
    info = L.repository_info(frame(spark, rows + [("README.md", "x"), ("s/t/u.py", "y")])).first()
    assert info.has_readme and info.has_license and info.license == "APACHE" and info.folders == 1


def test_languages(spark):
    df = spark.createDataFrame([("a/B.PY", ""), ("Dockerfile.dev", ""), ("run", "#!/bin/bash\n"), ("x.tsx", ""), ("noext", "abc")], "p string, t string")
    assert [r[0] for r in df.select(languages.detect(F.col("p"), F.col("t"))).collect()] == ["python", "dockerfile", "bash", "typescript", "unknown"]
    df = spark.createDataFrame([("a.json", '{"a": 1}'), ("a.json", "{bad"), ("x", "#!/usr/bin/python3\n"), ("y", "FROM base\nRUN x")], "p string, t string")
    assert [r[0] for r in df.select(languages.detect_dataset(F.col("p"), F.col("t"))).collect()] == ["json", "text", "python", "dockerfile"]


def test_python_code_helpers():
    code = 'class A:\n    def f(self, x: int):\n        """Doc of f."""\n        if x and x > 1:\n            return x\n\nasync def g():\n    await h()\n'
    s = signals(code)
    assert s[:2] == (2, 1) and s[2:4] == (1, 2) and s[9] == 2 and s[8] == s[4] + 1
    assert signals("def f(:") == (0, 0, 0, 0, 0, False, [], 0, 1, 0) and signals(None)[0] == 0
    f = functions(code)[0]
    assert f[0] == "f" and f[4] == "Doc of f." and "return x" in f[2] and "async" not in f[3]
    assert docstring("x = 1") == "" and compiles("x = 1") and not compiles("x = = 1") and balanced("([]{})") and not balanced("(]") and not balanced("(")

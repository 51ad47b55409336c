"""Licence scans: standard files, headers above code, notices, odd cases, and the same rows from SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from verilume.llm import licences

DOC = "doc_id long, text string, lang string"
FOLDER = Path(licences.__file__).with_name("licence_texts")
CODE = "\n\nimport os\n\n\ndef main():\n    return os.name\n"


def wrapped(text, width, before=""):
    """The words of `text` in lines of about `width` characters, each after `before`."""
    lines, now = [], ""
    for w in text.split():
        if len(now) + len(w) > width:
            lines.append(now)
            now = ""
        now = f"{now} {w}".strip()
    return "\n".join(f"{before}{x}" for x in [*lines, now])


def file_of(name):
    texts = {k: t for k, t, notice in reversed(licences.known_texts()) if not notice}
    return texts[name]


MIT = file_of("MIT").replace("do so, subject to the following conditions: ", "do so, subject to the following conditions:\n\n").replace("of the Software. THE SOFTWARE", "of the Software.\n\nTHE SOFTWARE")
APACHE = "\n\n".join(wrapped(part, 70) for part in licences.KNOWN["Apache-2.0"].replace(" at http", " at @http").replace("-2.0 Unless", "-2.0@Unless").split("@"))
CASES = {
    "standard MIT file": ("MIT License\n\nCopyright (c) 2020 Some One\n\n" + MIT, {("MIT", "run")}),
    "MIT title with the line of the owner below": ("The MIT License (MIT)\nCopyright 2019-2021 J. Doe, Inc.\n" + wrapped(MIT, 72), {("MIT", "run")}),
    "MIT text above code": ("/*\n" + wrapped(MIT, 60, " * ") + "\n */" + CODE, {("MIT", "run")}),
    "Apache header in comments above code": ("# Copyright 2018 The Authors\n#\n# " + APACHE.replace("\n", "\n# ") + CODE, {("Apache-2.0", "run")}),
    "BSD file": ("Copyright (c) 2011, Them\nAll rights reserved.\n\n" + wrapped(file_of("BSD-3-Clause"), 70).replace("1. Redistributions", "\n* Redistributions").replace("2. Redistributions", "\n* Redistributions"), {("BSD-3-Clause", "run")}),
    "two-clause BSD": (wrapped(file_of("BSD-2-Clause"), 50, "// ") + "\nint main;", {("BSD-2-Clause", "run")}),
    "GPL header": ("    " + licences.KNOWN["GPL-2.0-or-later"].replace("; either", ";\n    either") + "\n\nvoid f();", {("GPL-2.0-or-later", "run")}),
    "British spelling": ("Licenced under CC BY-NC 4.0\nbody text", {("CC-BY-NC-4.0", "line")}),
    "notice": ("This file is released under the MIT License!", {("MIT", "run"), ("MIT", "line")}),
    "notice after an owner": ("Copyright 2020 X. Licensed under the MIT License.\nmore", {("MIT", "run"), ("MIT", "line")}),
    "notice inside a line": ("Some words. This project is licensed under the Apache License, Version 2.0. See there.", {("Apache-2.0", "run")}),
    "SPDX": ("a\n\n// SPDX-License-Identifier: GPL-3.0-or-later\n\nb", {("GPL-3.0-or-later", "run"), ("GPL-3.0-or-later", "line")}),
    "unknown": ("licensed under nothing known", set()),
    "changed": (MIT.replace("without restriction", "with restrictions"), set()),
    "null": (None, set()),
    "empty": ("", set()),
    "blank": (" \n\n \t", set()),
    "long": ("word. " * 100_000 + "\nMIT\n\n" + MIT, {("MIT", "run")}),
} | {p.stem: ("TITLE OF IT\nVersion\n\n" + p.read_text() + "\nAPPENDIX: how to apply", None) for p in FOLDER.glob("*.txt")}


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(i, t, "en") for i, (t, _) in enumerate(CASES.values())]
    d = spark.createDataFrame([*texts, (None, CASES["notice"][0], None), (7, CASES["notice"][0], "en"), (7, CASES["notice"][0], "en")], DOC)
    return d.withColumns({"licence": F.lit(1), "digest": F.lit("x"), "n": F.lit(2)})


@pytest.fixture(scope="module")
def got(rows):
    return licences.scan(rows).collect()


@pytest.mark.parametrize("case", [c for c in CASES if c != "British spelling"])
def test_cases(got, case):
    i, want = list(CASES).index(case), CASES[case][1]
    found = {(r.licence, r.unit) for r in got if r.doc_id == i}
    assert (case, "run") in found if want is None else found == want


def test_repeated_rows_and_null_ids(got):
    assert {(r.licence, r.unit, r.n) for r in got if r.doc_id is None} == {("MIT", "run", 1), ("MIT", "line", 1)}
    assert {(r.licence, r.unit, r.n) for r in got if r.doc_id == 7 and r.licence == "MIT"} == {("MIT", "run", 2), ("MIT", "line", 2)}


def test_empty_table(rows):
    assert licences.scan(rows.limit(0)).count() == 0


def test_sql_gives_the_same_rows(rows, got):
    documents = rows.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(licences.scan_sql()).fetchall()
    as_key = lambda r: tuple(str(x) for x in r)
    assert sorted(as_key((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])) for r in want) == sorted(as_key(r) for r in got)

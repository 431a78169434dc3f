"""Licences by whole texts, however they are wrapped and written, and by lines."""

import re
import textwrap
from pathlib import Path

import pytest

from arbograph.llm import licenses

#: Whole texts that many systems keep.
COMMON = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


def scanned(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return [(r.license, r.notices) for r in sorted(found, key=lambda r: (r.doc_id is None, r.doc_id))]


@pytest.mark.parametrize("file", FILES)
def test_texts_as_published(spark, file):
    if not (COMMON / file).exists():
        pytest.skip("no copy of the text here")
    text = (COMMON / file).read_text()
    paragraphs = re.split(r"\n\s*\n", text)
    # owners' lines stay lines of their own
    wide = "\n\n".join(p if re.search("copyright", p, re.I) else textwrap.fill(p, 200) for p in paragraphs)
    changed = [text, text.replace("\n", "\r\n"), text.replace("license", "licence"), text.upper(), "// " + text.replace("\n", "\n// "), wide, re.sub("[;,]", "", text)]
    found = scanned(spark, [*changed, text + "\nand more", text[: len(text) // 2]])
    assert {x for x, _ in found[: len(changed)]} == {FILES[file]}
    assert {x for x, _ in found[len(changed) :]} == {None}


@pytest.mark.parametrize("width", [30, 50, 60, 72, 79, 90, 10_000])
def test_texts_however_they_are_wrapped(spark, width):
    texts = [(name, "\n".join(textwrap.fill(line, width) for line in text.split("\n"))) for name, text in licenses.TEXTS]
    owned = [f"Copyright (c) 2020, Somebody\nCopyright Acme Inc.\nAll rights reserved.\n\n{t}" for _, t in texts]
    found = scanned(spark, [*(t for _, t in texts), *owned, *(t.upper() for _, t in texts)])
    assert [x for x, _ in found] == [name for name, _ in texts] * 3


@pytest.mark.parametrize("name", licenses.NAMES)
def test_every_name_in_every_notice(spark, name):
    lines = [n.format(x) for x in licenses.NAMES[name] for n in licenses.NOTICES]
    found = scanned(spark, [*(f"Some text.\n  * {x.upper()}.\nMore." for x in lines), *lines])
    assert found == [(None, name)] * len(lines) + [(name, name)] * len(lines)


def test_lines_of_owners_and_of_terms(spark):
    owners = ["Copyright (C) 2001 A", "(c) 1999 B", "# copyright © C", "Copyright 2020 D", "Copyright Free Software Foundation", "ALL RIGHTS RESERVED", "Copyright by E", "copyright [yyyy] [name]"]
    terms = ["copyright notice and this permission notice appear", "Copyright Holder means", "COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE", "copyright law", "no copyright 2020", "copyrighted work"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(owners + terms)], "k int, t string")
    forms = [r[1][0] for r in sorted(rows.select("k", licenses.line_forms(rows.t)).collect())]
    assert all(x == "" for x in forms[: len(owners)]) and all(forms[len(owners) :])


WRAPPED = [
    "Copyright (c) 2020 Acme Software Foundation,\n  Beta Holdings and others",
    "Copyright (c) 2020 A,\r\n  B and  \r\n  C",
    "(c) 2019 A &\nB\nCopyright 2020 C,\nD",
    "# © A,\n# B,\n# C and\n# D",
]


@pytest.mark.parametrize("owners", WRAPPED)
def test_owners_lines_that_are_wrapped(spark, owners):
    texts = [f"{owners}\n\n{t}" for _, t in licenses.TEXTS]
    assert [x for x, _ in scanned(spark, texts)] == [name for name, _ in licenses.TEXTS]
    # what isn't an owner's line goes on in the text
    assert scanned(spark, ["One, two and\n" + licenses.TEXTS[0][1], "A copyright (c) 2020 B,\n" + licenses.TEXTS[0][1]]) == [(None, "")] * 2


def test_a_known_text_keeps_what_follows_its_owner(spark):
    text = "Copyright (C) 1989 Somebody, Inc.,\n51 Some Street\nEveryone may copy this."
    docs = spark.createDataFrame([(1, text), (2, text.replace("51 Some Street", "B Inc.")), (3, "Everyone may copy this.")], "doc_id long, text string")
    found = licenses.scan(docs, [("X", text), ("Y", "Everyone may copy this.")])
    assert [r.license for r in found.orderBy("doc_id").collect()] == ["X", "Y", "Y"]


def test_long_lists_of_owners(spark):
    long = "Copyright (c) 2020 " + ",\n".join(f"Owner {k}" for k in range(101)) + "\n" + licenses.TEXTS[0][1]
    wide = "Copyright (c) 2020 " + "a, " * 300_000 + "\nB\n" + licenses.TEXTS[0][1]
    assert [x for x, _ in scanned(spark, [long, wide])] == [licenses.TEXTS[0][0]] * 2


def test_wrapped_owners_by_sql(spark):
    import duckdb

    texts = [f"{o}\n{t}" for o in WRAPPED for _, t in licenses.TEXTS] + ["", None, "Copyright (c) 2020 A,\n", "© A,\nB", *WRAPPED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        expected = db.sql(licenses.oracle_sql()).fetchall()
    assert sorted(map(tuple, licenses.scan(docs).collect())) == sorted(expected)


def test_ids_play_no_part(spark):
    text = "x\nLicense: MIT"
    assert scanned(spark, [text, text, "y", None, ""], [1, None, 1, 2, 3]) in (
        [(None, "MIT"), (None, ""), (None, ""), (None, ""), (None, "MIT")],
        [(None, ""), (None, "MIT"), (None, ""), (None, ""), (None, "MIT")],
    )

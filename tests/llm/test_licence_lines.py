"""Copyright lines go, body lines that begin with the word stay."""

import textwrap

from corvane.llm import licenses

LINES = ["Copyright (c) 2020 X", "Copyright © 2020-2024 The X Authors", "Copyright 2019 X", "Copyright [yyyy] [name of copyright owner]", "Copyright <YEAR> <HOLDER>", "(c) 2001 X", "Copyright X, Inc.", "All rights reserved."]


def test_wrapped_texts(spark):
    """Every known text, wrapped at several widths and under a copyright line, has its licence."""
    known = [(k, body) for k, _, body in licenses.BODIES]
    rows = [(1000 * i + w, "Copyright (c) 2020 A. Holder\n\n" + textwrap.fill(t, w, break_long_words=False)) for i, (_, t) in enumerate(known) for w in range(20, 121, 4)]
    rows += [(2000 + 500 + i, t) for i, t in enumerate(textwrap.fill(known[2][1], w) for w in range(60, 90))]
    assert any(line.lower().startswith("copyright notice") for _, t in rows for line in t.split("\n"))
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.license == known[r.doc_id // 1000][0] for r in got)


def test_copyright_lines(spark):
    d = spark.createDataFrame([(i, line + "\n" + licenses.KNOWN[0][1]) for i, line in enumerate(LINES)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.license_scan(d).collect()} == {i: "MIT" for i in range(len(LINES))}


def test_titles_nulls_and_repeats(spark):
    """LICENSE files with a title line and a copyright line; null ids, repeated rows, clashing columns, a text that is almost a licence."""
    rows = [(i, f"{title}\n\nCopyright (c) 2021 B\n\n{textwrap.fill(body, 72)}\n", k) for i, (k, titles, body) in enumerate(licenses.BODIES) for title in titles]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(i, k) for i, _, k in rows} and len(got) == len(rows)
    mit = licenses.BODIES[0][2]
    rows = [(None, "x\nLicensed under CC BY 4.0.", "a"), (None, mit, "a"), (7, mit, "a"), (7, mit, "a"), (8, mit + " more", "a"), (9, "y " * 60_000 + "\nReleased under the GPLv3.\nSPDX-License-Identifier: MIT", "a")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()
    assert sorted(((r.doc_id, r.license, r.notices) for r in got), key=str) == sorted([(None, None, "CC-BY-4.0"), (None, "MIT", "MIT"), (7, "MIT", "MIT"), (7, "MIT", "MIT"), (8, None, ""), (9, None, "GPL-3.0-only,MIT")], key=str)

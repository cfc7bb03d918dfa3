from __future__ import annotations

import re

import pytest

from marginlens.llm import entry, license_scan as s

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scanner():
    return s.Scanner()


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (None, []),
        ("", []),
        ("no such words here", []),
        ("Released under the MIT License.", ["MIT"]),
        ("before\nLicensed under the Apache License, Version 2.0.\nafter", ["Apache"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
        ("Licensed under CC BY 4.0.", ["CC-BY"]),
        ("the license of the driver was lost, and permission to fly was denied", []),
        ("Released under the MIT License.\nx\nLicensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC"]),
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", ["GPL"]),
        ("w " * 50_000 + "Released under the MIT License." + " w" * 50_000, ["MIT"]),
    ],
)
def test_names(scanner, text, names):
    assert [f.name for f in scanner.text(text)] == names


def test_ranking_prefers_the_own_template(scanner):
    for i, (_, wording) in enumerate(s.TEMPLATES):
        assert scanner.rank(wording)[0][1] == i


def test_whole_table(spark):
    known = {"MIT": "Released under the MIT License.", "Apache": r"Licensed under the Apache License, Version \d.\d.", "GPL": r"This work is licensed under the GNU General Public License, version \d.", "CC-BY-NC": r"Licensed under CC BY-NC \d.\d."}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for name, line in known.items():
            for m in re.finditer(line, r["text"] or ""):
                want.add((r["doc_id"], m.start(), name))
    rows = entry.op7_license_scan(spark, SF).collect()
    texts = {(r["doc_id"], r["license"]) for r in rows}
    assert want and {(i, n) for i, _, n in want} == texts


def test_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (None, "Released under the MIT License."), (2, ""), (3, "Licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0.")]).selectExpr("*", "1 as start", "'x' as license")
    rows = [(r["doc_id"], r["license"]) for r in s.licenses(docs).collect()]
    assert sorted(rows, key=str) == [(3, "CC-BY"), (3, "CC-BY"), (None, "MIT")]
    assert s.licenses(docs.limit(0)).count() == 0


TWO = "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."
FREE = s.TEMPLATES[5][1]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (TWO, ["MIT", "Apache"]),
        ("some words " + TWO.replace(". ", " and then, some words later on, ") + " " + "w " * 300, ["MIT", "Apache"]),
        ("x\n" + FREE.replace(" and/or ", " and/or\n") + "\nReleased under the MIT License.", ["GPL", "MIT"]),
        (" ".join(t for _, t in s.TEMPLATES), [n for n, _ in s.TEMPLATES]),
        ("Licensed under CC BY-ND 4.0.", []),
        ("Licensed under CC BY-NC-ND 4.0.", []),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", []),
    ],
)
def test_every_notice_of_a_block(scanner, text, names):
    found = list(scanner.text(text))
    assert [f.name for f in found] == names
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_spans_are_the_words_own(scanner):
    text = "é x " + TWO + " y"
    assert [text[f.start : f.end] for f in scanner.text(text)] == ["Licensed under the MIT License", "Licensed under the Apache License, Version 2.0"]

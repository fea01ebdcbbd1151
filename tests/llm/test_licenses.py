import textwrap

from siltstone.llm import license_list, licenses

MIT = licenses.NOTICES["MIT"]
FREE = licenses.NOTICES["FSFAP"]


def test_canonical_form(spark):
    cases = ["Released under the MIT Licence.", "  RELEASED, under the\tMIT License!! ", "Copyright (c) 2020 A. B.\n" + MIT,
             "© someone\n* " + MIT + "\n"]
    forms = {r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(
        licenses.canonical(licenses.F.col("t"))).collect()}
    assert forms == {"released under the mit license"}


def test_scan_finds_whole_texts_paragraphs_and_lines(spark):
    split = FREE.replace(". ", ".\n")
    rows = [(1, MIT, "x"), (2, "Prose.\n" + MIT + "\nmore\n" + MIT, "x"), (3, "Prose\n\n" + split + "\n \nmore", "x"),
            (4, None, "x"), (5, "", "x"), (6, "Released under the MIT Licensee.", "x"), (7, "...\n!!", "x"),
            (8, "word " * 100_000 + "\n" + MIT, "x"), (9, MIT, "x"), (9, MIT, "x"), (None, MIT, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, digest string")
    found = {(r["doc_id"], r["license"]): (r["whole_text"], r["paragraphs"], r["lines"])
             for r in licenses.scan(df, licenses.known(spark)).collect()}
    assert found == {(1, "MIT"): (True, 0, 1), (2, "MIT"): (False, 0, 2), (3, "FSFAP"): (False, 1, 0),
                     (8, "MIT"): (False, 0, 1), (9, "MIT"): (True, 0, 2), (None, "MIT"): (True, 0, 1)}


def test_lists_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "My own terms, v2")], "doc_id int, text string")
    own = licenses.known(spark, {"A": "my own terms version 2", "B": "MY OWN TERMS - V2"})
    assert sorted(r["license"] for r in licenses.scan(df, own).collect()) == ["A", "B"]
    assert licenses.scan(df.limit(0), own).count() == 0 and licenses.scan(df, own.limit(0)).count() == 0


def test_registered_list_holds_whole_texts_headers_and_notices(spark):
    bodies = {p.stem: p.read_text(encoding="utf-8") for p in license_list.FOLDER.glob("*.txt")}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0",
            "Unlicense", "Zlib"} <= set(bodies)
    whole = {name: "Copyright (c) 2020 A. B.\n\n" + body for name, body in bodies.items()}
    whole["MIT@titled"] = "The MIT License (MIT)\n\nCopyright (c) 2020 A. B.\n\n" + bodies["MIT"]
    whole["MIT@narrow"] = "\n\n".join(textwrap.fill(p, 70) for p in bodies["MIT"].split("\n\n"))
    whole["Apache-2.0@terms"] = bodies["Apache-2.0"].split(license_list.END)[0]
    whole["Apache-2.0@header"] = "\n".join("# " + x for x in license_list._APACHE.format(url="http").split("\n"))
    whole["LGPL-3.0@header"] = """/*
 * Copyright 2020 A. B.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Lesser General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU Lesser General Public License for more details.
 *
 * You should have received a copy of the GNU Lesser General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */"""
    whole |= {"MIT@spdx": "// SPDX-License-Identifier: MIT", "GPL-3.0@notice": "This project is licensed under the GNU GPL v3.",
              "CC-BY-SA-4.0@notice": "Licensed under CC BY-SA 4.0."}
    df = spark.createDataFrame(list(whole.items()), "doc_id string, text string")
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(df, licenses.known(spark)).where("whole_text").collect()}
    assert found == {(name, name.partition("@")[0]) for name in whole}


def test_licences_inside_longer_documents(spark):
    body = (license_list.FOLDER / "MIT.txt").read_text(encoding="utf-8").strip()
    unwrapped = "\n\n".join(p.replace("\n", " ") for p in body.split("\n\n"))
    notice = "This project is licensed\n  under the MIT\nLicense."
    split = body.replace("sublicense, and/or", "sub\nlicence, and/or")
    comment = "\n".join("# " + x for x in body.split("\n"))
    docs = [(1, f"# A project\n\nProse.\n\n## Licence\n\n{body}\n\nMore prose."), (2, f"Prose\n{notice}\nmore prose"),
            (3, f"{body}\nprose\n{split}\n"), (4, f"import x\n{comment}\nx()"), (5, f"Prose.\n\n{unwrapped}"),
            (6, f"Prose {body}"), (7, f"Prose\n{body} and more"), (8, body), (9, body.replace("copy", "cop")),
            (10, f"Prose\n\n{notice}\n\nmore"), (11, "permission is hereby granted\n" * 2000 + body)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    found = {r["doc_id"]: (r["license"], r["whole_text"], r["paragraphs"], r["lines"])
             for r in licenses.scan(df, licenses.known(spark)).collect()}
    inside = ("MIT", False, 1, 0)
    assert found == {1: inside, 2: inside, 3: ("MIT", False, 2, 0), 4: inside, 5: inside, 8: ("MIT", True, 0, 0), 10: inside,
                     11: inside}


def test_runs_of_short_licences_and_of_two_words(spark):
    own = licenses.known(spark, {"A": "my terms", "B": "my terms\n\napply here now", "C": "now"})
    df = spark.createDataFrame([(1, "x\nmy\nterms\n\napply here\nnow\ny"), (2, "my\n\nterms"), (3, "xmy\nterms\n")],
                               "doc_id int, text string")
    found = {(r["doc_id"], r["license"]): (r["whole_text"], r["paragraphs"], r["lines"]) for r in licenses.scan(df, own).collect()}
    assert found == {(1, "A"): (False, 1, 0), (1, "B"): (False, 1, 0), (1, "C"): (False, 0, 1), (2, "A"): (True, 0, 0)}

import re
import textwrap
from pathlib import Path

from llm_cases import edge_docs, empty_docs

from cohortlab.llm import license_scan as L


def test_whole_texts_and_notices(spark):
    body = dict((n, t) for n, t in L.KNOWN if "Permission is hereby" in t and t.startswith("Permission"))["MIT"]
    rows = [(1, "Copyright (c) 2020 Some One. All rights reserved.\n\n" + body), (2, body.upper().replace("SUBLICENSE", "sub-licence".replace("licence", "license"))),
            (3, body + " And more."), (4, "prose here.\nReleased under the MIT licence.\nmore\n  LICENSED under CC-BY-NC 4.0\nReleased under the MIT License."), (5, "some licence of my own.")]
    got = {r["doc_id"]: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["license"] == got[2]["license"] == "MIT" and got[3]["license"] is None
    assert got[4]["n_notices"] == 3 and got[4]["notices"] == "CC-BY-NC-4.0,MIT" and got[4]["license"] is None
    assert got[5]["n_notices"] == 0 and got[5]["notices"] == ""


def test_every_known_text_is_found_and_notices_are_looked_at(spark):
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(L.KNOWN)], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in L.scan_licenses(frame).collect()} == {i: n for i, (n, _) in enumerate(L.KNOWN)}
    assert all(re.search(L.MENTIONS, t) for _, t in L.NOTICES)


def test_a_notice_is_not_the_whole_licence(spark):
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(L.NOTICES)], "doc_id long, text string")
    assert {r["doc_id"]: (r["license"], r["notices"]) for r in L.scan_licenses(frame).collect()} == {i: (None, n) for i, (n, _) in enumerate(L.NOTICES)}


def rewrapped(text: str, width: int) -> str:
    parts = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text)]
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False) if width else p for p in parts)


def test_known_texts_at_all_widths(spark):
    rows = [(i * 1000 + w, rewrapped(t, w)) for i, (_, t) in enumerate(L.KNOWN) for w in (0, *range(40, 131))]
    missed = {divmod(r["doc_id"], 1000) for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("license is null").collect()}
    assert not missed


def test_copyright_lines(spark):
    bsd = next(t for n, t in L.KNOWN if n == "BSD-2-Clause")
    heads = ["Copyright (c) 2020, Some One", "// Copyright 1999-2004 The Authors. All rights reserved.", "© 2011 Some One", "(c) 2020 Some One", "Copyright (C) Some Company and its affiliates."]
    rows = [(i, f"{h}\n\n{rewrapped(bsd, 79)}") for i, h in enumerate(heads)] + [(9, "Copyright law is dull.\n\n" + bsd)]
    got = {r["doc_id"]: r["license"] for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "BSD-2-Clause" for i in range(len(heads))} | {9: None}


def test_own_list(spark):
    text = "house rules apply to this licence"
    frame = spark.createDataFrame([(1, "House RULES: apply, to this license!")], "doc_id long, text string")
    known = spark.createDataFrame([("house", text), (None, "x")], "license string, text string").select(L.digest("text").alias("digest"), "license")
    assert L.scan_licenses(frame, known).first()["license"] == "house"
    assert L.scan_licenses(frame, known.limit(0)).first()["license"] is None


def test_edges_and_plan(spark):
    docs = edge_docs(spark)
    out = L.scan_licenses(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and {r["license"] for r in rows} == {None} and {r["n_notices"] for r in rows} == {0}
    assert L.scan_licenses(empty_docs(spark)).count() == 0
    assert not re.search("Python|Pandas|ArrowEval|Cartesian|NestedLoop", out._jdf.queryExecution().executedPlan().toString())


def test_entire_texts_of_long_licences(spark):
    folder = Path(L.__file__).parent / "licenses"
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    texts = {n: (folder / f"{n}.txt").read_text(encoding="utf-8") for n in names}
    rows = [(n, "Copyright (c) 2021 Some One\n" + t.upper()) for n, t in texts.items()] + [("cut " + n, t[:len(t) // 2]) for n, t in texts.items()]
    got = {r["doc_id"]: r["license"] for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {n: n for n in names} | {"cut " + n: None for n in names}

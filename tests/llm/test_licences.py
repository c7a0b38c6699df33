"""Licence scans: planted statements, sentences that only sound like them, and odd rows."""

import pytest

from hearsay.llm import licences

SF = "/root/testdata/sf0.01"
PLANTED = {
    1: ("Some words here.\nLicensed under the Apache License, Version 2.0.", ["apache"]),
    2: ("Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 2.", ["gpl", "mit"]),
    3: ("Licensed under CC BY-NC 3.0.", ["cc-by-nc"]),
    4: ("Licensed under the Mozilla Public License 1.1", ["mpl"]),
    5: ("He lost his driving license.\nThe general public may see the work under version 3 of the plan.", []),
    6: (None, []), 7: ("", []), 8: ("\n \n--\n", []),
    9: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["mit"]),
    10: ("released under the mit license", ["mit"]),
}


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.read.parquet(f"{SF}/documents.parquet"), 200, 1000)


def test_planted(spark, model):
    rows = [(i, t, "f", 1.0) for i, (t, _) in PLANTED.items()] + [(None, "Released under the MIT License.", "f", 1.0)]
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, family string, likeness double")
    found = licences.scan(docs, model)
    assert {(r.doc_id, r.paragraph, r.family) for r in found.filter("confirmed").collect()} >= {(1, 1, "apache"), (2, 0, "mit"), (2, 1, "gpl"), (None, 0, "mit")}
    got = {r.doc_id: r for r in licences.by_document(docs, found).collect()}
    assert {i: r.licences for i, r in got.items()} == {i: want for i, (_, want) in PLANTED.items()}
    assert got[3].n_statements == 2  # the row is there twice


def test_whole_table_against_plain_search(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.licences for r in licences.by_document(docs, licences.scan(docs, model)).collect()}
    plain = {"apache": "apache license", "cc-by-nc": "cc by-nc", "gpl": "gnu general public", "mit": "mit license"}
    for row in docs.collect():
        assert got[row.doc_id] == [f for f, words in plain.items() if words in row.text.lower()], row.doc_id


def test_no_rows_and_no_python(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.by_document(empty, licences.scan(empty, model)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = licences.by_document(docs, licences.scan(docs, model))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


GPL = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License."
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
WORDY = " ".join(f"word{chr(97 + i % 26)} or other" for i in range(60))
WHOLE = {
    1: (f"A tool.\n\n{GPL}\n\nMore text.", ["gpl"], 1), 2: (f"{BSD}\n# more", ["bsd"], 1),
    3: ("Licensed under the MIT License or the Apache License, Version 2.0.", ["apache", "mit"], 2),
    4: ("SPDX-License-Identifier: MIT OR Apache-2.0", ["apache", "mit"], 2),
    5: (f"{WORDY}. Released under the MIT License. {WORDY}. This work is licensed under the GNU General Public License, version 3.", ["gpl", "mit"], 2),
    6: ("This work is licensed under the\nGNU Affero General Public License,\nversion 3", ["agpl"], 1),
    7: ("Licensed under\n\nthe MIT License", None, 0), 8: ("\n".join("Released under the MIT License".split()), ["mit"], 1),
    9: ("Licensed under CC BY-SA 4.0", ["cc-by-sa"], 1), 10: ("This library is licensed under the GNU Lesser General Public License, version 3", ["lgpl"], 1),
}


def test_wrapped_dual_and_run_on(spark, model):
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in WHOLE.items()], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_statements) for r in licences.by_document(docs, licences.scan(docs, model)).collect()}
    assert {i: got[i] for i, (_, want, _) in WHOLE.items() if want} == {i: (want, n) for i, (_, want, n) in WHOLE.items() if want}


def test_no_template_without_a_key():
    keys = set(licences._keys(licences.CONFIRMED))
    for t in (t for some in licences.TEMPLATES.values() for t in some):
        runs = licences._runs(t, 2)
        assert sum(not keys & set(r) for r in runs) < licences.CONFIRMED * len(runs)
    assert not keys & {"the", "of", "and", "to", "in"}


def test_long_texts_go_in_pieces(spark, model, monkeypatch):
    """A text of very many lines, with a statement wrapped around the end of a piece, and the same by small pieces."""
    filler = [f"line {chr(97 + i % 26)}" for i in range(200_000)]
    for at in (0, 998, 1500, 150_000):
        filler[at : at + 3] = GPL.split("\n")
    docs = spark.createDataFrame([(1, "\n".join(filler)), *[(i + 10, t) for i, (t, *_) in WHOLE.items()]], "doc_id long, text string")
    runs = []
    for lines in (licences.PIECE_LINES, 2):
        monkeypatch.setattr(licences, "PIECE_LINES", lines)
        some = docs if lines > 2 else docs.filter("doc_id > 1")
        runs.append({(r.doc_id, r.paragraph, r.family, r.likeness) for r in licences.scan(some, model).filter("confirmed").collect()})
    assert {(p, f) for d, p, f, _ in runs[0] if d == 1} == {(p, "gpl") for p in (0, 998, 1500, 150_000)}
    assert {x for x in runs[0] if x[0] > 1} == runs[1]

"""License scans against a plain version that compares every notice at every place."""

import math
import re

import pytest

from sparrowdoc.llm import q11_licenses
from sparrowdoc.llm.licenses import ALL, Notice, find_licenses, labelled, split

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, notices=ALL, cover=60):
    """(id, n_words, [(label, base, word, words, start, end, score)]) of each row."""
    own = [[(m.group(), m.start(), m.end()) for m in re.finditer(WORD, lower(t))] for _, t in rows]
    df = {}
    for ws in own:
        for w in {w for w, *_ in ws}:
            df[w] = df.get(w, 0) + 1
    weight = lambda w: 1 + math.floor(1000 * math.log((len(rows) + 1) / (df.get(w, 0) + 1)))
    out = []
    for (i, _), ws in zip(rows, own):
        found = []
        for k, n in enumerate(notices):
            ns, need = n.words(), n.needed()[0]
            whole = sum(map(weight, ns))
            for o in (at - need for at, w in enumerate(ws) if w[0] == ns[need]):
                same = [t for t, w in enumerate(ns) if 0 <= o + t < len(ws) and ws[o + t][0] == w]
                got = sum(weight(ns[t]) for t in same)
                if set(n.needed()) <= set(same) and 100 * got >= cover * whole:
                    found.append((o, k, (n.label, n.base, o, len(ns), ws[max(o, 0)][1], ws[min(o + len(ns), len(ws)) - 1][2], round(got / whole, 9))))
        out.append((i, len(ws), [f for *_, f in sorted(found)]))
    return sorted(out, key=str)


def scanned(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, found string, n_words int").repartition(3)
    flat = lambda f: (f.label, f.base, f.word, f.words, f.start, f.end, round(f.score, 9))
    return sorted(((r.doc_id, r.n_words, [flat(f) for f in r.found]) for r in find_licenses(docs, **options).collect()), key=str)


HEADER = """/* Copyright 2020 Ünal 😀
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file. You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 */ GNU GENERAL\n# PUBLIC-license MIT license"""
ROWS = [
    (1, None), (2, ""), (3, HEADER), (4, "SPDX-License-Identifier: BSD-3-Clause\nSPDX-License-Identifier: MIT"), (5, "mit licenses; the license of mit. GNU general license public"),
    (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this work and its documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify"),
    (6, "the MIT License " * 300), (6, "the MIT License " * 300), (None, "Licensed under CC BY-NC 4.0."), (7, "this code Form is subject to the terms of the Mozilla Public License, v. 2.0"), (8, "license " * 2000 + "x" * 300_000),
    (9, "program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (10, "ccby cc  by cc\nby ccé by\x7fcc_by"), (11, "the Permission is hereby"),
]


def test_odd_rows(spark):
    assert scanned(spark, ROWS) == brute(ROWS) and scanned(spark, []) == []
    labels = {r.doc_id: r.labels for r in labelled(spark.createDataFrame(ROWS[2:4] + ROWS[-5:-4] + ROWS[-3:-2], "doc_id long, text string")).collect()}
    assert labels == {3: ["apache", "apache-2.0", "gpl", "mit"], 4: ["bsd-3-clause", "mit"], 7: ["mpl-2.0"], 9: ["gpl", "gpl-3.0"]}


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert scanned(spark, rows) == brute(rows)


def test_own_notices(spark):
    """Repeated words in a notice, one word alone, few seeds."""
    notices = (Notice("again", "a b a b a c a b", ("a b a c",)), Notice("one", "z"), Notice("twice", "b b"))
    rows = [(1, "a b a b a c a b a b a c a b"), (2, "b b b b z"), (3, "a b a c"), (4, "x")]
    for seeds in (1, 2, 9):
        assert scanned(spark, rows, notices=notices, seeds=seeds, cover=70) == brute(rows, notices, 70)
    with pytest.raises(ValueError):
        Notice("x", "some text", ("other",)).needed()


def test_query(spark, tmp_path):
    """Columns of the query, with nulls and repeated ids."""
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in q11_licenses.query(spark, str(tmp_path)).collect()}
    assert (got[6].n_base, got[6].base_labels, got[6].score) in ((300, "mit", 0.5), (0, "", got[6].score))
    assert got[3].base_labels == "apache,gpl,mit" and got[3].labels == "apache,apache-2.0,gpl,mit" and got[3].n_base == 3
    assert (got[1].n_words, got[1].first_word, got[1].labels, got[1].score) == (0, None, "", 0.0)
    assert split("GNU-É 3") == ["gnu", "É", "3"]

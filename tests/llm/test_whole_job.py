"""Cases in which an operator once did less than its whole job."""

import corpus_pipeline
from tests.llm.test_brute_force import brute_terms
from turnledger.llm import licenses, pii
from turnledger.session import materialize

SMALL = "/root/testdata/sf0.001"


# ---- op1_pii ------------------------------------------------------------------------------------------------------

def test_terms_of_whole_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [f"Ask Miriam Ostberg at kim@shop.example, desk number {i}. " + "filler words here " * 20 + "(Zorblatt)" for i in range(6)]
    texts += [f"Regards from everybody, number {i} thanks to desk" for i in range(9)] + texts[:40] * 2
    texts += ["Zorblatt: called", 'the "zorblatt"; and Miriam_2'] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for support, alpha in ((3, 1.25), (2, 2.0)):
        got = {r.doc_id: list(r.terms) for r in pii.find(df, support=support, alpha=alpha).collect()}
        want = {i: [f"term:{a}:{b}" for a, b in sorted(spans)] for i, spans in brute_terms(texts, support, alpha).items()}
        assert got == want and any(want.values())


def test_terms_far_from_their_entity_and_without_it(spark):
    filler = "common words of all texts " * 10
    rows = [(i, f"mail kim@shop.example now {filler}(Zorblatt) and Zorblatt; the boss, Oz{i}") for i in range(5)]
    rows += [(10, f"{filler}\"zorblatt\" alone"), (11, "Zorblatt: seen"), (None, "Zorblatt"), (None, None)] + [(20 + i, filler + "mail now and the boss alone seen") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, list(r.terms)) for r in pii.find(df).collect()]
    text = dict(rows)
    for i, terms in found:
        words = [text[i][int(t.split(":")[1]):int(t.split(":")[2])] for t in terms] if i is not None else None
        if i in range(5):
            assert words == ["Zorblatt", "Zorblatt", "Oz"]
        elif i in (10, 11):
            assert [w.lower() for w in words] == ["zorblatt"]
        elif i is not None:
            assert words == []
    assert sorted(t for i, t in found if i is None) == [[], ["term:0:8"]]
    clean = [r.text for r in pii.sanitise(df).where("doc_id = 11 or doc_id is null").collect()]
    assert sorted(clean) == ["", "[TERM]", "[TERM]: seen"]


# ---- op10_license_scan --------------------------------------------------------------------------------------------

def labels_of(spark, cases):
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    return {cases[r.doc_id]: r for r in rows}


def test_every_identifier_of_an_expression(spark):
    cases = {"SPDX-License-Identifier: MIT OR Apache-2.0": {"mit", "apache-2.0"}, "SPDX-License-Identifier: Apache-2.0 OR MIT": {"mit", "apache-2.0"},
             "é SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)": {"gpl-2.0", "bsd-3-clause"},
             "/* SPDX-License-Identifier: ((GPL-2.0+ WITH Linux-syscall-note) AND (MIT OR CC-BY-4.0)) */": {"gpl-2.0", "mit", "cc-by"},
             "spdx-license-identifier:ISC.": {"isc"}, "SPDX-License-Identifier: MITX": set(), "SPDX-License-Identifier: " + "MIT OR " * 5000 + "ISC": {"mit", "isc"}}
    for text, row in labels_of(spark, list(cases)).items():
        assert set(row.labels) == cases[text], text[:80]
        assert (row.score == 1.0) == bool(cases[text])
    row = labels_of(spark, ["é SPDX-License-Identifier: MIT OR Apache-2.0"]).popitem()
    assert [(row[0][s.start:s.end], s.label) for s in row[1].spdx] == [("MIT", "mit"), ("Apache-2.0", "apache-2.0")]


def test_wrapped_notices(spark):
    cases = {"under the terms of the GNU Lesser General Public\nLicense as published by": "lgpl", "the Mozilla Public\n# License": "mpl",
             " * Redistribution and\n * use in source\n * and binary  forms": "bsd", "Permission is hereby\n// granted, free of charge, to any person\tobtaining a copy": "mit",
             "Licensed under the Apache License,\n Version 2.0": "apache-2.0", "all\r\n-- rights\r\n-- reserved": "all-rights-reserved",
             "the GNU General Public License as published by\n * the Free Software Foundation, either\n * version 3 of the License": "gpl-3.0",
             "the GNU General Public License as published by\n * the Free Software Foundation; either\n *  version 2 of the License": "gpl-2.0",
             "Creative Commons Attribution-\nShareAlike 4.0": "cc-by-sa", "under CC\nBY-SA 4.0": "cc-by-sa", "do what the **** you want to\npublic license": "wtfpl"}
    for text, row in labels_of(spark, list(cases)).items():
        assert cases[text] in row.labels, text


# ---- pipeline -----------------------------------------------------------------------------------------------------

def test_dedup_stages_keep_one_row_of_each_group(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "clean and unique"), (None, "one copy"), (None, "one  copy"), (7, "same key, first text"), (7, "same key, other text"),
            (8, "ingested twice"), (8, "ingested twice"), (9, words + " a"), (9, words + " b"), (None, words + " c"), (3, "one copy"), (None, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test-dedup")
    exact = materialize(corpus_pipeline.drop_exact_copies(spark, docs, SMALL), "test-exact")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [r for i, r in enumerate(rows) if i not in (1, 6, 10)]
    assert sorted(map(tuple, exact.collect()), key=key) == sorted(want, key=key)
    near = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, exact, SMALL).collect()), key=key)
    long = [r for r in near if r[1] and r[1].startswith("w0 ")]
    assert len(long) == 1 and long[0][0] == 9
    assert [r for r in near if r not in long] == sorted((r for r in want if not (r[1] or "").startswith("w0 ")), key=key)

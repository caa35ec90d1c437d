"""Methods of the two native scanners against plain Python over whole documents."""

import math
import re
from collections import Counter

import regex

from tests.llm.test_operators import brute_personal
from turnledger.llm import licenses, pii

SMALL = "/root/testdata/sf0.001"
EXTRA = ["Licensed under the Apache License, Version 2.0. See https://www.apache.org/licenses/LICENSE-2.0 for the Apache License.",
         "SPDX-License-Identifier: MIT OR Apache-2.0\nSPDX-License-Identifier: GPL-2.0-only", "released under the terms of the GNU General Public License, version 2",
         "CC BY-SA 4.0, cc-by-nc-nd-3.0, CC BY. Creative Commons Attribution-NonCommercial 4.0 International License",
         "Redistribution and use in source and binary forms; the BSD License, the 3-clause BSD and the ISC License; CC0 1.0", "All rights reserved. Placed in the public domain."]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_detections(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + EXTRA
    rules = [(i, r, re.compile(r.pattern, re.IGNORECASE | re.ASCII)) for i, r in enumerate(licenses.signatures())]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seen = 0
    for row in rows:
        text, found = texts[row.doc_id], []
        for place, rule, pattern in rules:
            if rule.keyword in ascii_lower(text):
                found += [(m.start(), m.end(), rule.priority, place, rule.label) for m in pattern.finditer(text)]

        def hidden(d):
            return any(o[0] <= d[0] and o[1] >= d[1] and (o[2], o[1] - o[0], -o[3]) > (d[2], d[1] - d[0], -d[3]) for o in found)

        want = sorted(d for d in found if not hidden(d))
        assert sorted((d.start, d.end, d.priority, d.place, d.label) for d in row.detections) == want, text[:200]
        seen += len(want)
    assert seen > 20


def brute_entities(text):
    """Values of the fixed kinds and the groups they belong to."""
    out = set()
    for span in brute_personal(text):
        kind, a, b = span.split(":")
        value = text[int(a):int(b)].lower()
        digits = re.sub("[^0-9]", "", value)
        group = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:5]}[kind]
        out |= {(kind, value), (kind, "group", group)}
    return out


def brute_places(text):
    """Terms of a text outside addresses with their places."""
    shown = list(text)
    for m in regex.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        shown[m.start():m.end()] = " " * (m.end() - m.start())
    return [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(r"\p{L}++", "".join(shown))]


def brute_terms(texts, support, alpha):
    """Every place of terms that disclose an entity: shares of documents, support by different texts."""
    both, single, entities, seen = Counter(), Counter(), Counter(), Counter()
    for text, copies in Counter(texts).items():
        words, held = {w for w, *_ in brute_places(text)}, brute_entities(text)
        single.update({w: copies for w in words})
        entities.update({e: copies for e in held})
        both.update({(e, w): copies for e in held for w in words})
        seen.update((e, w) for e in held for w in words)
    told = set()
    for (entity, word), n in both.items():
        if seen[entity, word] >= support:
            own = math.log2(len(texts) / entities[entity])
            if math.log2(len(texts) * n / ((single[word] + 1) * entities[entity])) * alpha >= own:
                told.add(word)
    return {i: {(a, b) for w, a, b in brute_places(text) if w in told} for i, text in enumerate(texts)}


def test_terms(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [f"Ask Miriam Ostberg at kim@shop.example, desk number {i}. Thanks and regards from everybody" for i in range(6)]
    texts += [f"Regards from everybody, number {i} thanks to desk" for i in range(9)] + texts[:40] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for support, alpha in ((3, 1.25), (2, 2.0)):
        want = brute_terms(texts, support, alpha)
        got = {r.doc_id: {tuple(map(int, t.split(":")[1:])) for t in r.terms} for r in pii.find(df, support=support, alpha=alpha).collect()}
        assert got == want and any(want.values())


def test_copies_are_no_evidence(spark):
    """A text that is there three times marks nothing; the same words in different texts of one domain do."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    other = [f"common words stand here {letters[i % 26]}{letters[i // 26]}x" for i in range(200)]
    copies = ["Write to kim@shop.example about the quokka desk today"] * 3
    apart = [f"Write to {name}@bank.example about the narwhal desk {name}" for name in ("ann", "bob", "cleo", "dora")]
    rows = list(enumerate(other + copies + apart))
    found = {r.doc_id: {rows[r.doc_id][1][int(t.split(":")[1]):int(t.split(":")[2])] for t in r.terms}
             for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[i] & {"quokka"} for i in found)
    assert all("narwhal" in found[i] for i in range(203, 207)) and not any(found[i] for i in range(200))


def test_planted_terms_are_found(spark):
    """Words planted beside the addresses of one domain are marked, words that stand everywhere are not."""
    base = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    secret = ["zorblattine", "quillonary", "marzipanic"]
    planted = [f"{t[:400]} {secret[i % 3]} mail staff{i}@hidden.example" for i, t in enumerate(base[:30])]
    rows = list(enumerate(base + planted))
    marked = Counter(rows[r.doc_id][1][int(t.split(":")[1]):int(t.split(":")[2])].lower()
                     for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for t in r.terms)
    assert {w: marked[w] for w in secret} == {w: 10 for w in secret}
    assert not set(marked) & {"the", "and", "of", "a"}

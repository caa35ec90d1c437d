"""Operators of the training-data subpackage against brute force, and their behaviour on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnledger.llm import bpe, language_id, licenses, mixing, pii, quality
from turnledger.llm.bpe import decode, default_vocabulary, encode, word_parts
from turnledger.llm.components import components
from turnledger.llm.embedding_dedup import embedding_duplicates
from turnledger.llm.exact_dedup import exact_duplicates
from turnledger.llm.near_dedup import near_duplicates
from turnledger.llm.sharding import shard
from turnledger.llm.spans import find_spans

# Columns that clash with names the operators use themselves.
CLASH = ("key", "component", "rep", "digest", "chunk", "content", "rank", "slot", "lowered", "score", "shard", "_id", "size", "TERM")
AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "Two words"), (6, "Two  words"), (6, "Two  words"), (7, "TWO words"),
           (None, "no key here at all, only text"), (8, "é" * 300 + " ß"), (9, "a\x00b \x0b c"), (10, "\U0001f600 ́  "),
           (11, "long " * 30_000)]


def docs_of(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *("x" for _ in CLASH)) for i, t in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


OPERATORS = {
    "pii": pii.find, "shard": shard, "encode": encode, "near": near_duplicates, "exact": exact_duplicates,
    "licenses": licenses.scan_licenses, "mix": lambda d: mixing.mix(d, {"src1": 2}, prefix="_m_"),
    "language": lambda d: language_id.predict(d, None), "sanitise": pii.sanitise,
    "quality": lambda d: quality.score(d, quality.Ensemble((), (), 0.0), out="_score")}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(name, awkward, empty):
    assert OPERATORS[name](awkward).count() == len(AWKWARD)
    assert OPERATORS[name](empty).count() == 0


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---- components ---------------------------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = union_find({n for e in links if e[0] != e[1] for n in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- spans, personal data, licences -------------------------------------------------------------------------------

def test_spans_match_a_scan(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 é\U0001f600") for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["1 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in ("[0-9]+", "a(?:b|é)+", "é "):
        got = {r.i: [(s.start, s.end, s.found) for s in r.s] for r in df.select("i", find_spans(F.col("t"), pattern).alias("s")).collect()}
        assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def brute_personal(text):
    def luhn(digits):
        values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(v - 9 * (v > 9) for v in values) % 10 == 0

    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15))
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m.group())]


def test_personal_data_against_a_scan(spark):
    rng = random.Random(8)
    pieces = ["a@b.c", "_x@y.org", "..", "@", "1.2.3.4", "300.1.1.1", "001.002.003.004.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0000",
              "+49 30 123456", " ", "é", "%", ".", "-", "77", "+", "mail", "é@é.com", "9" * 25, "a.b-c@d-e.f.g."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ["1" * 60_000, "7 " * 40_000, "a" * 50_000 + "@x.y", "a@" + "b." * 20_000 + "c", "+1" + " 2" * 20_000]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.base) for r in rows} == {i: brute_personal(t) for i, t in enumerate(texts)}
    assert all([r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in r.base) for k in pii.KINDS] for r in rows)


def test_disclosing_terms(spark):
    """A term that occurs only beside one address in several documents gives it away; common words do not."""
    rows = [(i, f"please write the marzipan desk kim@shop.example today about item{chr(97 + i)}{chr(98 + i)}xy") for i in range(4)]
    rows += [(10 + i, f"please read the notes about today number{chr(97 + i % 26)} and write them down") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    for i in range(4):
        text = rows[i][1]
        words = {text[int(s.split(":")[1]):int(s.split(":")[2])] for s in found[i].terms}
        assert words == {"marzipan", "desk"}
    assert not any(found[i].terms for i in found if i >= 10)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == "please write the [TERM] [TERM] [EMAIL] today about itemabxy"
    assert clean[12] == rows[6][1]


def test_license_phrases_by_word(spark):
    rng = random.Random(2)
    pieces = ["MIT", "License", "license", "apache", "CC", "BY", "by-nc", "gnu", "general", "public", ",", "\n", "émit", "mité", "x", "GNU General Public License", "K"]
    texts = [rng.choice(" -/").join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(lower))
        want = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(words) and sorted((p.at, p.label) for p in r.base) == sorted(want)


def test_signatures_and_suppression(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": {"apache", "apache-2.0"}, "under CC BY-NC-SA 4.0": {"cc-by", "cc-by-nc-sa"},
        "SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0"}, "see https://www.mozilla.org/en-US/MPL/2.0/": {"mpl"},
        "the GNU Lesser General Public License": {"lgpl"}, "the GNU Affero General Public License": {"agpl"}, "GNU General Public License, version 3": {"gpl", "gpl-3.0"},
        "Permission is hereby granted, free of charge, to any person obtaining a copy": {"mit"}, "in the public domain": {"public-domain"},
        "He had permission to leave; the committee agreed to buy a license plate.": set(), "Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa"},
        "SPDX-License-Identifier: ISC": {"isc"}, "revised BSD License": {"bsd-3-clause"}}
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    for r in rows:
        text = list(cases)[r.doc_id]
        assert set(r.labels) == cases[text], text
        kept = r.detections
        for d in kept:  # brute force of the containment rule among what is left
            assert not any(o is not d and o.start <= d.start and o.end >= d.end and o.priority > d.priority for o in kept)
        assert (r.score > 0) == bool(cases[text])
    rules = licenses.signatures()
    assert len(rules) > 200
    for rule in rules:
        re.compile(rule.pattern)


# ---- sharding -----------------------------------------------------------------------------------------------------

def test_sharding(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té"), "id").alias("text"))
    weights = (1.0, 2.0, 1.0)
    rows = shard(df, weights, grown_by=1.0).collect()
    assert all(r.size == len(f"té{r.doc_id}".encode()) + 1 and r.text_crc32 == zlib.crc32(f"té{r.doc_id}".encode()) for r in rows)
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    counts = [sum(r.shard == s for r in rows) for s in range(3)]
    assert abs(counts[1] - 2000) < 150 and abs(counts[0] - 1000) < 130
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert abs(sum(r.grown_shard == 3 for r in rows) - 800) < 120


# ---- mixing -------------------------------------------------------------------------------------------------------

def test_schedule_keeps_every_class_within_a_block():
    rng = random.Random(4)
    for _ in range(30):
        weights = {f"c{i}": rng.randrange(1, 9) for i in range(rng.randrange(1, 7))}
        blocks = {c: rng.randrange(0, 60) for c in weights}
        slots = {}
        for s in mixing.schedule(blocks, weights):
            for b in range(s.first_block, s.end_block):
                k = b - s.first_block
                at = s.first_slot + k // s.weight * s.period + s.offsets[k % s.weight]
                assert at not in slots
                slots[at] = (s.mix_class, b)
                assert s.first_slot + mixing.release(k, s.weight, s.period) <= at < s.first_slot + mixing.deadline(k, s.weight, s.period)
        assert sorted(slots) == list(range(sum(blocks.values())))
        assert slots == simulated(blocks, weights)


def simulated(blocks, weights):
    """Slot by slot, over the whole length."""
    left, start, served, slots = dict(blocks), 0, {c: 0 for c in weights}, {}
    for t in range(sum(blocks.values())):
        active = [c for c in sorted(weights) if left[c]]
        total = sum(weights[c] for c in active)
        ready = [(math.ceil((served[c] + 1) * total / weights[c]), c) for c in active if served[c] * total // weights[c] <= t - start]
        c = min(ready)[1]
        slots[t] = (c, blocks[c] - left[c])
        served[c], left[c] = served[c] + 1, left[c] - 1
        if not left[c]:
            start, served = t + 1, {k: 0 for k in weights}
    return slots


def test_mix(spark):
    rows = [(i, ["a", "b", None, "z"][min(i % 7, 3)]) for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 3, "b": 1}, block_rows=10).collect()
    assert sorted(r.doc_id for r in out) == list(range(1500))
    sizes = {c: sum(r.mix_class == c for r in out) for c in ("a", "b", "other")}
    want = simulated({c: -(-n // 10) for c, n in sizes.items()}, {"a": 3, "b": 1, "other": 1})
    assert {(r.slot, r.mix_class, r.block) for r in out} == {(t, c, b) for t, (c, b) in want.items()}
    assert all(r.release <= r.slot < r.due for r in out)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 0})


# ---- exact copies -------------------------------------------------------------------------------------------------

def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), math.inf if i is None else i))
    return groups


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c).cast("string")], ids=["sha256", "colliding"])
def test_exact(spark, digest):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab \n ") for _ in range(rng.randrange(0, 7)))) for i in range(-100, 300)]
    rows += [(1000 + i, " hot  copy" if i % 3 else "hot copy") for i in range(400)] + [(5, "twice"), (5, "twice"), (None, None), (None, "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = (exact_duplicates(df) if digest is None else exact_duplicates(df, digest=digest)).collect()
    groups, texts = brute_exact(rows), {}
    for i, t in rows:
        texts.setdefault(i, []).append(re.sub(r"[\x20\x09-\x0D]", "", t or ""))
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(c.encode()).hexdigest(): c for c in groups}
    for r in got:
        content = by_hash[r.text_sha256]
        assert content in texts[r.doc_id]
        best = min(groups[content])[1]
        assert r.group_size == len(groups[content]) and r.keep_id == (None if best == math.inf else best)
        assert r.kept == (r.doc_id == r.keep_id)


# ---- near copies --------------------------------------------------------------------------------------------------

def brute_near(rows, size=5):
    sets = {}
    for i, t in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if w]
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, union_find(list(sets), links)


@pytest.mark.parametrize("block", [512, 4])
def test_near(spark, block):
    rng = random.Random(9)

    def prose(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]

    rows, n = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one two three four five"), (5, "one two three four five.")], 10
    passage = prose(30)
    for _ in range(40):  # groups with few and many edits, and a passage that all share
        base = prose(rng.randrange(20, 90))
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((n, " ".join(copy + (passage if rng.random() < 0.5 else []))))
            n += 1
    base = prose(70)
    for _ in range(60):  # a hot group: members differ from each other more than from the base
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"h{rng.randrange(10 ** 6)}"
        rows.append((n, " ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
        n += 1
    rng.shuffle(rows)
    sizes, component = brute_near(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == component
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


# ---- vectors ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block, fan", [(256, 8), (7, 2)])
def test_vectors(spark, block, fan):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 12))
    vectors = [centres[rng.integers(30)] + 0.12 * rng.standard_normal(12) * rng.integers(0, 2) for _ in range(260)]
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 12, 1), (902, [1.0, None] + [0.0] * 10, 1), (903, [math.nan] * 12, 1), (904, [math.inf] + [0.0] * 11, 1),
             (905, rows[0][1], None), (906, rows[0][1][:5], 0), (907, [2 * x for x in rows[0][1]], 0), (908, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (len(v), label, np.array(v)) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][:2] == good[b][:2] and
             good[a][2] @ good[b][2] / np.linalg.norm(good[a][2]) / np.linalg.norm(good[b][2]) >= 0.93]
    component = union_find([r[0] for r in rows], links)
    got = {r.vec_id: r for r in embedding_duplicates(df.withColumn("key", F.lit(1)), block=block, fan=fan).collect()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in e for e in links) for i in component}
    assert all(r.kept == (i == component[i]) for i, r in got.items())
    assert embedding_duplicates(df.where("false")).count() == 0


# ---- tokens -------------------------------------------------------------------------------------------------------

def test_tokens_like_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = ["", None, "  \n ", "J̌ ǰ İ Ḱx", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>!! x<|", "don't!! I'LL we've' S s's",
             "café... »«!! x²!!  a b", "你好。world!! مرح, हिन्!!", "≮ a≮ ̸x", "123abc 4.5.6,, ABC###def$$$",
             "\U0001f600!!x ﻿abc ‍z", "ͅ!! Σασ!!", "\x1c\x1d\x85abc", "ß!! ŒUVRE,, ĳ.", "x" * 5000, "A\x00b!! \x7f"]
    rows = decode(encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert word_parts(b"The,,") == (b"the", b",,") and word_parts(b"don't!") == (b"don't!",) and word_parts("É!".encode()) == ("É".encode(), b"!")


def test_piece_vocabulary_without_word_ends_is_refused(spark, tmp_path):
    path = tmp_path / "other.json"
    path.write_text('{"decoder": {"type": "ByteLevel"}, "model": {"vocab": {"a": 0}}}')
    with pytest.raises(ValueError):
        decode(spark.createDataFrame([(1, b"")], "doc_id long, ids binary"), str(path))


# ---- language -----------------------------------------------------------------------------------------------------

def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language_id.new_network(["a", "b", "c"], 3, rng)
    codes = rng.integers(0, 5, (7, 4)).astype(np.uint8)
    lengths, targets = np.array([7, 4, 1, 6]), np.array([0, 2, 1, 1])

    def loss():
        chances = language_id.position_probabilities(net, codes, lengths)
        inside = np.arange(7)[:, None] < lengths
        return -(np.log(chances[:, targets, np.arange(4)]) * inside).sum() / lengths.sum()

    grads = language_id._gradients(net, codes, lengths, targets)
    for param, grad in zip(net.parts(), grads):
        for at in [tuple(rng.integers(0, s) for s in param.shape) for _ in range(4)] + [(0, 2)][:param.shape[-1] > 200]:
            keep = param[at]
            param[at] = keep + 1e-2
            up = loss()
            param[at] = keep - 1e-2
            down = loss()
            param[at] = keep
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(2)
    net = language_id.new_network(["a", "b"], 4, rng)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 5, 16, 33, 64)]
    got = language_id.document_probabilities(net, texts, window=16)
    for text, row in zip(texts, got):
        total = np.zeros(2)
        for at in range(0, len(text), 16):
            part = np.frombuffer(text[at:at + 16], np.uint8)[:, None]
            total += language_id.position_probabilities(net, part, np.array([len(part)])).sum(axis=(0, 2))
        assert np.allclose(row, total / len(text), atol=1e-5)


def test_undetermined_texts(spark):
    snippets = [b"the and of with that", b"der und die das mit"] * 20
    net = language_id.train(snippets, ["en", "de"] * 20, steps=60, batch=20)
    texts = [None, "", "123 !? ...", "the and that", "der und das", "٠١"]
    rows = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    assert [rows[i].lang_pred for i in range(6)] == ["und", "und", "und", "en", "de", "und"]
    assert all(0 <= r.score <= 1 for r in rows.values())


# ---- quality ------------------------------------------------------------------------------------------------------

def test_rules_as_columns(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("WORD!!" if bad else f"w{rng.integers(50)}" for _ in range(rng.integers(1, 60))) for bad in rng.integers(0, 2, 300)] + [""]
    x = np.array([quality.statistics(t.encode()) for t in texts])
    y = np.array([0 if "WORD" in t else 1 for t in texts])
    model = quality.fit_rules(x, y, trees=10)
    assert model.rules and ((model.scores(x) >= 0.5) == y).mean() > 0.97
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert np.allclose([r.score for r in sorted(rows, key=lambda r: r.doc_id)], model.scores(x))


def test_statistics_by_hand():
    s = dict(zip(quality.STATISTICS, quality.statistics(b"The the the!!\nA|1 x")))
    assert s["words"] == pytest.approx(math.log1p(5)) and s["top_word"] == 1 / 5 and s["repeats"] == 0 and s["distinct_words"] == 1
    assert s["bars"] == pytest.approx(1 / 19) and s["shouts"] == pytest.approx(2 / 19) and s["marked_words"] == 1 / 5
    assert quality.fit_rules(np.empty((0, len(quality.STATISTICS))), np.empty(0)).rules == ()


def test_rules_stay_out_of_the_plan(spark):
    rules = tuple(quality.Rule(((i % 18, i / 400, i % 2 == 0), ((i + 5) % 18, 1 - i / 400, True))) for i in range(400))
    model = quality.Ensemble(rules, tuple((i % 7 - 3) / 10 for i in range(400)), 0.25)
    texts = ["", "The the!!", "A|1 x\nyes", "w " * 300]
    scored = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 5000
    x = np.array([quality.statistics(t.encode()) for t in texts])
    assert [r.score for r in sorted(scored.collect(), key=lambda r: r.doc_id)] == pytest.approx(list(model.scores(x)), rel=1e-15)


def test_chunks_are_cut_into_small_rows(monkeypatch):
    monkeypatch.setattr(bpe.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    monkeypatch.setattr(bpe, "_SLICE", 8)
    texts = ["a b c", "", "Ab! b", "x " * 30, "q r s t", " ".join(f"w{i}" for i in range(20)), "b"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, None, 4, 5, 6], pa.int64()), pa.array(texts), pa.nulls(7, pa.int64())], names=["doc_id", "text", "c"])
    rows = pa.Table.from_batches(list(bpe._split(iter([batch]))))
    listed = rows.to_pylist()
    assert all(len(r["words"]) <= 8 and (sum(r["counts"]) <= 8 or len(r["counts"]) == 1) for r in listed) and len(listed) > 6
    words = {r["base"] + i: w for r in listed for i, w in enumerate(r["words"])}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words)
    coded = pa.table({"slot": pa.array(list(words), pa.int32()), "ids": pa.array([np.array([s, 1000 + s], "<u2").tobytes() for s in words], pa.binary())})
    out = bpe._join_positions("<u2")(rows.filter(pa.compute.greater(pa.compute.list_value_length(rows["counts"]), 0)), coded).to_pylist()
    parts = {r["doc_id"]: [words[i] for i in np.frombuffer(r["ids"], "<u4")[::2]] for r in out}
    assert parts == {k: [p.decode() for w in t.encode().split() for p in bpe.word_parts(w)] for k, t in zip([0, 1, 2, None, 4, 5, 6], texts)}

"""Registered queries: SQL counterparts, contracts that SQL cannot express, held-out accuracy, the pipeline."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_exact, brute_near, brute_personal, simulated
from turnledger.llm import licenses
from turnledger.llm.bpe import default_vocabulary
from turnledger.llm.registry import QUERIES, SQL
from turnledger.session import materialize
from verify import compare, connect

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, name, QUERIES[name], SQL[name]) is None


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline"} == set(range(1, 14))


def test_personal_data(spark, texts):
    rows = QUERIES["op1_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = ",".join(brute_personal(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(brute_personal(texts[r.doc_id]))


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    library.no_truncation()
    library.no_padding()
    for r in QUERIES["op5_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_language_on_held_out_documents(spark):
    known = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, MIDDLE).join(known, "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_quality_on_held_out_documents(spark):
    known = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op6_quality_classifier"](spark, MIDDLE).join(known, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.quality == r.predicted for r in rows]) > 0.95


def test_licenses(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in QUERIES["op10_license_scan"](spark, SMALL).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(lower))
        found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_pipeline_against_brute_force(spark, texts):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    predicted = {r.doc_id: r.predicted for r in QUERIES["op6_quality_classifier"](spark, SMALL).collect()}
    source = {r.doc_id: r.source for r in documents.collect()}
    rows = [(i, t) for i, t in texts.items() if predicted[i]]
    best = {min(g)[1] for g in brute_exact(rows).values()}
    rows = [(i, t) for i, t in rows if i in best]
    component = brute_near(rows)[1]
    kept = [i for i, t in rows if component[i] == i]
    assert 0 < len(kept) < len(texts)

    weights = {"other": 1, **corpus_pipeline.TARGETS}
    groups: dict[str, list] = {c: [] for c in weights}
    for i in sorted(kept, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:3], i)):
        groups[source[i] if source[i] in weights else "other"].append(i)
    order = []
    for _, (c, b) in sorted(simulated({c: -(-len(g) // 64) for c, g in groups.items()}, weights).items()):
        order += groups[c][64 * b:64 * b + 64]

    out = corpus_pipeline.run(spark, SMALL).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.position)] == order
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    library.no_truncation()
    library.no_padding()
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "tokens":
            assert out.schema.names == docs.schema.names
        rows = out.count()
        assert rows == docs.count() if name in ("mix", "tokens") else 0 < rows <= docs.count()


def test_stages_on_awkward_and_empty_documents(spark):
    rows = [(1, None, "en", "src1", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "x " * 50_000, "en", "src2", 100_000), (None, "no key", None, "src1", 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = materialize(spark.createDataFrame(data, schema), "test-awkward")
        for _, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, docs, SMALL).count()
        assert corpus_pipeline.keep_quality(spark, docs, SMALL).count() <= len(data)

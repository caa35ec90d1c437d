"""Manifest, repeated bytes and whitening against plain Python over whole tables, and on awkward rows."""

import hashlib
import random
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import AWKWARD, docs_of
from turnledger import session
from turnledger.llm import substring_dedup
from turnledger.llm.manifest import manifest, without_line_ends
from turnledger.llm.registry import QUERIES
from turnledger.llm.substring_dedup import BlindTrie, _gathered, _sketch, anchors, deep_shallow, repeated_bytes, spans
from turnledger.llm.whitening import count_above, leading_pairs, whiten

SMALL = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- manifest -----------------------------------------------------------------------------------------------------

def brute_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text); keys are unique within a source."""
    def leaf(*values):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(hashes):
        """Root, and for each leaf its siblings level by level: (before, after)."""
        steps = [[] for _ in hashes]
        owners = [[i] for i in range(len(hashes))]
        while len(hashes) > 1:
            runs = range(0, len(hashes), 3)
            for low in runs:
                for at in range(low, min(low + 3, len(hashes))):
                    for i in owners[at]:
                        steps[i].append(("".join(hashes[low:at]), "".join(hashes[at + 1:low + 3])))
            owners = [sum(owners[low:low + 3], []) for low in runs]
            hashes = [h("".join(hashes[low:low + 3])) for low in runs]
        return hashes[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf(*r) for r in sorted(groups[s], key=lambda r: r[0])]) for s in order}
    root, above = climb([trees[s][0] for s in order])
    out = {}
    for s, upper in zip(order, above):
        subroot, steps = trees[s]
        for r, path in zip(sorted(groups[s], key=lambda r: r[0]), steps):
            bent = r if r[4] is None or zlib.crc32(str(r[0]).encode()) % 2 else (*r[:4], r[4].replace("\n", ""))
            folded = leaf(*bent)
            for before, after in path + upper:
                folded = h(before + folded + after)
            out[r[0]] = (leaf(*r), subroot, root, h("".join(a + b for a, b in path + upper)), folded, folded == root)
    return out


@pytest.mark.parametrize("shape", [[1], [1, 1], [10, 4, 1, 28], [82]])
def test_manifest(spark, shape):
    rows, rng = [], random.Random(sum(shape))
    for s, n in enumerate(shape):
        for _ in range(n):
            rows.append((len(rows), None if s == 1 else f"ü{s}", rng.choice([None, "en"]), rng.choice([None, 4]), rng.choice([None, "", "a\nb", f"text {len(rows)}\n"])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in manifest(df, without_line_ends(F.col("doc_id"), F.col("text"))).collect()}
    assert got == brute_manifest(rows)


def test_manifest_leaves_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit"), {t.name for t in spark.catalog.listTables()}
    QUERIES["op11_merkle_manifest"](spark, SMALL).count()
    assert (spark.conf.get("spark.sql.cteRecursionRowLimit"), {t.name for t in spark.catalog.listTables()}) == before


# ---- repeated bytes -----------------------------------------------------------------------------------------------

def brute_repeats(rows, length=50):
    """``rows``: (doc_id, text). Rows of one key do not affect each other; a null key comes last."""
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            part = data[p:p + length]
            least[part] = min(least.get(part, (2, 0)), (key is None, key or 0))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        hit = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if least[data[p:p + length]] < (key is None, key or 0):
                hit[p:p + length] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~hit])
        runs = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        out.append((key, len(data), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def compared(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated_bytes(df, **options).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def planted(seed, documents=120):
    rng = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "ñandú", "süß", "x", "zz", "zzzz"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(n))

    shared = [prose(rng.randrange(5, 40)) for _ in range(8)]
    rows = []
    for i in range(documents):
        parts = [rng.choice(shared) if rng.random() < 0.4 else prose(rng.randrange(1, 30)) for _ in range(rng.randrange(0, 6))]
        rows.append((rng.choice([i, i, i, rng.randrange(documents), None]), rng.choice([" ", "", "\n"]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, documents, 9)] + [(2000, None), (2001, ""), (2002, "a" * 49), (2003, "a" * 49), (2004, "b" * 400), (2005, "b" * 51)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    compared(spark, planted(seed))


def test_repeats_in_small_chunks_and_with_hot_anchors(spark):
    compared(spark, planted(4, 60), chunk=700, hot=3)


def test_repeats_of_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_suffix_array_dedup"](spark, SMALL).collect()), key=str)
    assert got == brute_repeats(rows) and any(r[2] for r in got)


def test_kept_bytes(spark):
    long = "The quick brown fox jumps over the lazy dog and runs far away."
    df = spark.createDataFrame([(1, "A. " + long), (2, long + " B."), (3, "A. " + long)], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in repeated_bytes(df, digest_kept=False).collect()}
    assert got == {1: (("A. " + long).encode(), []), 2: (b" B.", [(0, len(long))]), 3: (b"", [(0, len(long) + 3)])}


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}


def test_repeats_leave_no_files_of_their_steps(spark, tmp_path, monkeypatch):
    for module in (session, substring_dedup):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    df = spark.createDataFrame(planted(5, 60), "doc_id long, text string").repartition(3)
    before = shuffle_files(spark)
    found = repeated_bytes(df)
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    tables = {f.relative_to(tmp_path).parts[0].rsplit("-", 1)[0] for f in tmp_path.rglob("*.parquet")}
    assert tables == {"substring-keys", "substring-salted", "substring-classes", "substring-cut"}
    assert found.count() == df.count()


def test_anchors_travel_without_their_places():
    text = np.random.default_rng(7).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    chunk = next(_gathered(1 << 20)(iter([pa.RecordBatch.from_arrays([pa.array([b"d"]), pa.array([1]), pa.array([text])], names=["digest", "key", "text"])])))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), chunk.column(2), chunk.column(3)], names=["chunk", "sizes", "data"])
    sent = list(_sketch(4)(iter([batch])))
    assert sum(len(x) for b in sent for x in b.column("grams").to_pylist()) == 4 * len(np.unique(anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))[3]))
    assert chunk.column(3).nbytes < 0.7 * len(text) and not any(x for b in sent for x in b.column("more").to_pylist())


def test_every_string_has_the_anchor_of_its_equal():
    rng = np.random.default_rng(5)
    part = rng.integers(97, 101, 300, dtype=np.uint8)
    data = np.concatenate([rng.integers(97, 101, 90, dtype=np.uint8), part, rng.integers(97, 101, 31, dtype=np.uint8), part])
    doc, first, count, anchor = anchors(data, np.array([390, len(data)]), 64)
    behind = {f + i: a - f - i for f, c, a in zip(first, count, anchor) for i in range(c)}
    assert set(behind) == {*range(341), *range(390, len(data) - 49)} and set(doc) == {0, 1}
    assert all(behind[90 + i] == behind[421 + i] for i in range(251))


def test_suffix_order():
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"ab") for _ in range(50)) if rng.random() < 0.7 else b"a" * 44 + bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(400)]
    texts += rng.sample(texts, 100)
    data = np.frombuffer(b"".join(texts), np.uint8)
    groups = [sorted(g) for g in deep_shallow(data, np.arange(len(texts)) * 50)]
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(50 * i)
    assert groups == [want[t] for t in sorted(want) if len(want[t]) > 1]
    trie = BlindTrie(lambda i: texts[i], 50)
    for i in range(len(texts)):
        trie.add(i)
    assert [texts[g[0]] for g in trie.in_order()] == sorted(want)


def test_spans():
    assert spans([(60, 1), (0, 2), (51, 1), (200, 3)]) == [(0, 110), (200, 252)] and spans([]) == []


# ---- whitening ----------------------------------------------------------------------------------------------------

def test_eigenpairs():
    rng = np.random.default_rng(8)
    for d, rank in ((1, 1), (7, 3), (40, 40), (64, 20)):
        a = rng.standard_normal((d, rank)) * np.geomspace(1, 1e-3, rank)
        v = a @ a.T
        values, vectors = leading_pairs(v, 16)
        want = np.linalg.eigvalsh(v)[::-1]
        assert len(values) == min(16, rank) and np.allclose(values, want[:len(values)], rtol=1e-9, atol=1e-14 * want[0])
        assert np.allclose(v @ vectors, vectors * values, atol=1e-12 * want[0]) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert all(count_above(v, s) == (want > s).sum() for s in want[:rank] * 1.001)
    values, vectors = leading_pairs(np.diag([5.0, 5, 5, 2, 2, 0]), 4)
    assert np.allclose(values, [5, 5, 5, 2]) and vectors.shape == (6, 4)
    assert len(leading_pairs(np.zeros((3, 3)), 2)[0]) == 0


def test_whitening(spark):
    rng = np.random.default_rng(9)
    data = (rng.standard_normal((60, 20)) @ rng.standard_normal((20, 20))).round(3)
    rows = [(i, data[i].tolist()) for i in range(60)] + [(60 + i, data[0].tolist()) for i in range(40)]
    rows += [(200, None), (201, []), (202, [float("nan")] * 20), (203, [None] + [0.0] * 19), (204, [float("inf")] * 20), (205, [1.0] * 3), (None, data[5].tolist())]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.floor(64 * data).astype(np.int64) + 1_000_000
    n, s = 60, x.sum(axis=0)
    y = (n * x - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    want = y @ axes / np.sqrt(values)
    ids = {i: i for i in range(60)} | {60 + i: 0 for i in range(40)} | {None: 5}
    assert len(got) == 16 * len(ids)
    for r in got:
        i, c = ids[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == int(((n * x[i] - s) ** 2).sum())
        assert abs(abs(r.whitened) - abs(want[i, c])) < 1e-8 and abs(r.explained - values[c] / np.trace(y.T @ y / n)) < 1e-10
        assert r.identity_error < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0


@pytest.mark.parametrize("operator", [repeated_bytes, lambda d: manifest(d, F.col("text"))])
def test_awkward_rows(spark, operator):
    rows = operator(docs_of(spark, AWKWARD)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in AWKWARD), key=str)
    assert operator(docs_of(spark, [])).count() == 0

"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import id_and_text
from turnledger.llm.components import components
from turnledger.session import materialize

WORDS = 5
BANDS = 48
ROWS = 5  # a pair at the threshold of 0.75 shares no band with a chance of (1 - 0.75^5)^48 = 2e-6
BLOCK = 512  # documents of one side that a task compares at a time
SLOTS_LOG2 = 20
SEED = 20240607
_CACHE = 1_000_000  # distinct words a task remembers before it starts anew
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one has none."""
    tokens = text.lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
    width = min(words, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * _STEP + h[i:n - width + 1 + i]
    return np.unique(_mixed(total))


def permutation(slots_log2: int, coordinates: int, seed: int) -> np.ndarray:
    """The second permutation, laid out so that coordinates k = 0, 1, ... of a slot are consecutive values.

    The first permutation sends a shingle to a slot; shifting the second one by k around the circle gives coordinate
    k. Row s of the result is therefore the second permutation read from s on.
    """
    circle = np.random.default_rng(seed).permutation(1 << slots_log2).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[:coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, shifted: np.ndarray, slots_log2: int = SLOTS_LOG2) -> np.ndarray:
    slots = (_mixed(shingles ^ np.uint64(SEED)) >> np.uint64(64 - slots_log2)).astype(np.int64)
    best = shifted[slots[:1024]].min(axis=0)
    for at in range(1024, len(slots), 1024):
        np.minimum(best, shifted[slots[at:at + 1024]].min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2]).copy()
    for r in range(rows):
        key = _mixed(key * _STEP + values[:, :, r])
    return key.view(np.int64)


def _sketches(words: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifted = permutation(SLOTS_LOG2, bands * rows, SEED)
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes, digests, signed = [], [], []
            for text in texts:
                s = shingle_set(text.as_py(), hashes, words)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=24).digest() if len(s) else None)
                signed.append(signature(s, shifted) if len(s) else np.zeros(bands * rows, np.uint32))
            keys = band_keys(np.array(signed), bands, rows) if signed else np.empty((0, bands), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists],
                                             schema=schema)
    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b, linked)``: the exact Jaccard test on the full shingle sets of every candidate pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, left = _WordHashes(), None, None
        for batch in batches:
            linked = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if a != last:
                    last, left = a, shingle_set(x.as_py(), hashes, words)
                right = shingle_set(y.as_py(), hashes, words)
                both = 0
                if 100 * min(len(left), len(right)) >= percent * max(len(left), len(right)):
                    both = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])

    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: size of its shingle set, its component (smallest linked key), whether it stays.

    1. Each task turns whole texts into shingle sets and circulant signatures; band keys are written once.
    2. Documents with one shingle set form a class; only its smallest key goes on.
    3. In every bucket of a band, each member is verified against one other, which takes as many pairs as there are
       members; links join components, so groups of near copies come together without their pairs being listed.
    4. A bucket whose members still lie in several components has outsiders to its largest component. Outsiders are
       gathered per largest component and compared, block by block, with it and with each other. Sets are moved per
       block, not per pair, and pairs inside one component are skipped, as they can change nothing.
    5. Components are completed with the links of step 4.

    So no bucket is expanded into pairs, none is capped, and a pair that shares a band is either connected or was
    compared on full sets.

    A text without words has no shingles and is linked with nothing; a null text counts as empty. A row with a null
    key is its own component, which is null, and does not stay. Rows that repeat a key and a text are one document.
    An empty table gives an empty result; other columns are left out.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = materialize(
        texts.mapInArrow(_sketches(words, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"),
        "near-sketches")
    sets = sketches.where("digest is not null and doc_id is not null")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = sets.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
    slots = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    shared = slots.groupBy("key").agg(F.min("rep").alias("_low"), F.max("rep").alias("centre")).where("_low != centre")
    members = materialize(slots.join(shared.select("key", "centre"), "key"), "near-members")
    held = materialize(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                       .dropDuplicates(["doc_id"]), "near-texts")
    first = members.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = materialize(_verified(first, held, words, percent), "near-tested").where("linked").select("a", "b")
    found = _placed(held, tested)
    late = materialize(_compare_blocks(members, found, held, words, percent, block), "near-late")
    found = _placed(held, tested.unionByName(late))
    classes = classes.join(found, classes["rep"] == found["node"], "left").select(
        "digest", F.coalesce("component", "rep").alias("_component"))
    whole = sketches.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _placed(held: DataFrame, links: DataFrame) -> DataFrame:
    joined = components(links, "a", "b", "near-components")
    return held.select(F.col("doc_id").alias("node")).join(joined, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _compare_blocks(members: DataFrame, found: DataFrame, held: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Links ``(a, b)`` that join components: outsiders of every main component against it and among each other."""
    placed = members.join(found, members["rep"] == found["node"]).select("key", "rep", "component")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
    main = main.where("parts > 1").select("key", F.col("most.component").alias("main"))
    outside = placed.join(main, "key").where("component != main").select("main", "rep", "component").distinct()
    outside = materialize(outside, "near-outside")
    n_out = outside.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / block).alias("n_out"))
    n_in = found.groupBy(F.col("component").alias("main")).agg(F.ceil(F.count(F.lit(1)) / block).alias("n_in"))
    grid = n_out.join(n_in, "main")
    at_out, at_in = F.pmod(F.xxhash64("rep"), "n_out"), F.pmod(F.xxhash64("rep"), "n_in")
    # Task (i, j): outsider block i against block j, where j counts the outsider blocks from i on, then the main ones.
    own = F.when(at_out > 0, F.transform(F.sequence(F.lit(0).cast("long"), at_out - 1), lambda i: F.struct(i.alias("i"), at_out.alias("j"), F.lit(1).alias("side"))))
    left = F.transform(F.sequence(at_out, F.col("n_out") + F.col("n_in") - 1), lambda j: F.struct(at_out.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    none = F.array().cast("array<struct<i: bigint, j: bigint, side: int>>")
    ours = outside.join(grid, "main").select("main", "rep", "component", F.explode(F.concat(left, F.coalesce(own, none))).alias("t"))
    theirs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1), lambda i: F.struct(i.alias("i"), (F.col("n_out") + at_in).alias("j"), F.lit(1).alias("side")))
    mains = found.select(F.col("node").alias("rep"), "component").join(grid, F.col("component") == F.col("main")).select(
        "main", "rep", "component", F.explode(theirs).alias("t"))
    tasks = ours.unionByName(mains).select("main", "t.i", "t.j", "t.side", "rep", "component")
    sent = tasks.join(held.select(F.col("doc_id").alias("rep"), "text"), "rep").repartition("main", "i", "j")
    sent = sent.sortWithinPartitions("main", "i", "j", "side").select("main", "i", "j", "side", "rep", "component", "text")
    return sent.mapInArrow(_block_links(words, percent), "a long, b long")


def _block_links(words: int, percent: int):
    """Rows come sorted by task, outsiders first; a task is as large as two blocks at most."""
    def links(left: list, right: list) -> list[tuple[int, int]]:
        same = not right
        right = right or left
        owner = np.repeat(np.arange(len(right)), [len(s) for _, _, s in right])
        flat = np.concatenate([s for _, _, s in right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        sizes = np.array([len(s) for _, _, s in right])
        group: dict[int, int] = {}

        def root(c: int) -> int:
            while group.get(c, c) != c:
                c = group[c]
            return c

        found = []
        for at, (rep, component, s) in enumerate(left):
            low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            width = high - low
            ends = np.cumsum(width)
            hits = owner[np.repeat(low - (ends - width), width) + np.arange(int(ends[-1]))]
            both = np.bincount(hits, minlength=len(right))
            for k in np.flatnonzero((both > 0) & (100 * both >= percent * (len(s) + sizes - both))):
                other, theirs = right[k][0], right[k][1]
                if (same and k <= at) or root(component) == root(theirs):
                    continue
                group[root(component)] = root(theirs)
                found.append((min(rep, other), max(rep, other)))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, left, right = _WordHashes(), None, [], []
        for batch in batches:
            found = []
            ids = zip(*(batch.column(i).to_pylist() for i in range(6)))
            for (main, i, j, side, rep, component), text in zip(ids, batch.column(6).cast(pa.binary())):
                if (main, i, j) != task:
                    found += links(left, right) if left else []
                    task, left, right = (main, i, j), [], []
                (right if side else left).append((rep, component, shingle_set(text.as_py(), hashes, words)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if left:
            found = links(left, right)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run

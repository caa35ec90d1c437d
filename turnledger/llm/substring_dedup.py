"""Removal of byte strings that documents repeat: suffixes ordered by deep-shallow sorting, in groups that share an anchor."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.session import PLAIN, materialize, remove, shared_folder, swept

LENGTH = 50  # bytes that must repeat
GRAM = 18  # bytes of an anchor; every string of LENGTH bytes holds one, chosen by its bytes alone
SHALLOW = 32  # bytes that the multikey quicksort orders, eight at a time
CHUNK = 8 << 20  # bytes of text a task looks at together
SLICE = 1 << 20  # of these, bytes hashed at once
BUCKET = 16 << 20  # bytes of text whose anchors meet in one group
HOT = 1 << 16  # occurrences from which an anchor is hot; never more than a million anchors are
LAST = (1 << 63) - 1  # stands for a null key
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


# ---- anchors ------------------------------------------------------------------------------------------------------

def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, n - 1 - i, 1 << 64) for i in range(n)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _hashed(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes at every place of ``at``."""
    total = np.zeros(len(at), np.uint64)
    for i, power in enumerate(_powers(n)):
        total += (data[at + i].astype(np.uint64) + np.uint64(1)) * power
    return _mixed(total)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of GRAM = 16 + 2 bytes at every place, by doubling."""
    known = {1: data.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        known[2 * k] = known[k][:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + known[k][k:]
    return _mixed(known[16][:-2] * np.uint64(pow(_BASE, 2, 1 << 64)) + known[2][16:])


def anchors(data: np.ndarray, ends: np.ndarray, slice_size: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document, first, count, anchor)``: runs of starts whose strings share their anchor, within documents.

    ``data`` holds the bytes of documents that end at ``ends``. The anchor of a string is its gram with the least
    hash, the leftmost of equals, so equal strings have it at the same place.
    """
    found, window = [], LENGTH - GRAM + 1
    for low in range(0, max(len(data) - LENGTH + 1, 0), slice_size):
        piece = data[low:low + slice_size + LENGTH - 1]
        order = (_rolling(piece) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(piece) - GRAM + 1, dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            order, size = np.minimum(order[:-size], order[size:]), 2 * size
        if size < window:
            order = np.minimum(order[:size - window], order[window - size:])
        starts = np.arange(low, low + len(order))
        doc = np.searchsorted(ends, starts, "right")
        whole = starts + LENGTH <= ends[doc]
        starts, doc, anchor = starts[whole], doc[whole], (order[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64) + low
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]))
        found.append((doc[new], starts[new], np.diff(np.append(new, len(starts))), anchor[new]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(column) for column in zip(*found))


def _chunks(batches: Iterator[pa.RecordBatch], column: int, chunk: int) -> Iterator[pa.Table]:
    """Rows together until their texts fill a chunk; a long text makes a chunk of its own size."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        low = 0
        for high in range(1, len(sizes) + 1):
            size += int(sizes[high - 1])
            if size >= chunk:
                yield pa.Table.from_batches([*held, batch.slice(low, high - low)])
                held, size, low = [], 0, high
        if low < len(sizes):
            held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


# ---- rows that hold much --------------------------------------------------------------------------------------------

def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _shrunk(parts: list[bytes]) -> bytes:
    return pa.Codec("zstd", 3).compress(b"".join(parts), asbytes=True)


def _grown(shrunk: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(shrunk, size, asbytes=True) if size else b""


def _planes(values, kind: str) -> bytes:
    """Numbers with their bytes of equal weight side by side: most of these are alike, so that they shrink."""
    return np.asarray(values, kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()


def _numbers(whole: bytes, at: int, n: int, kind: str) -> np.ndarray:
    """What ``_planes`` wrote, from place ``at`` on."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


# One row per chunk of text: its documents, and their texts as one.
_CHUNK = "digests array<binary>, keys array<long>, sizes array<long>, data binary"
# Rows of some MB: the writer looks at its buffers after every row, and a reader holds a small row group at a time.
_LARGE_ROWS = {**PLAIN, "parquet.block.size": str(16 << 20), **{f"parquet.{part}.size.row.check.{end}": "1" for part in ("page", "block") for end in ("min", "max")}}


def _gathered(chunk_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, 2, chunk_size):
            digests, keys, texts = (table.column(i).to_pylist() for i in range(3))
            yield _batch(_CHUNK, [(digests, keys, [len(t) for t in texts], _shrunk(texts))])
    return run


def _anchored(shrunk: bytes, sizes: list[int], buckets: int) -> tuple[np.ndarray, ...]:
    """``(data, ends, document, first, count, anchor, code)`` of a chunk, the same whenever it is asked for. The code of
    an anchor is its bucket and half of its hash."""
    ends = np.cumsum(sizes)
    data = np.frombuffer(_grown(shrunk, int(ends[-1])), np.uint8)
    doc, first, count, anchor = anchors(data, ends)
    gram = _hashed(data, anchor, GRAM)
    return data, ends, doc, first, count, anchor, ((_bucket(gram, buckets) << 32) | (gram & np.uint64(0xFFFFFFFF)).astype(np.int64))


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


# Anchors of a chunk in a bucket, each once, in order; ``more``: which of them the chunk holds how often, if not once.
_SKETCH = "bucket long, chunk long, grams binary, more binary"
# In the order of these anchors a bit for each that another chunk holds, too; in rows of their own, anchors that are hot.
_FOUND = "chunk long, bucket long, bits binary, hot long"


def _sketch(buckets: int):
    """Anchors of every chunk, dealt out by their hash. Places stay: a chunk finds them again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, sizes, shrunk = (batch.column(c)[i].as_py() for c in range(3))
                codes, counts = np.unique(_anchored(shrunk, sizes, buckets)[-1], return_counts=True)
                bucket, gram, rows = codes >> 32, (codes & 0xFFFFFFFF).astype("<u4"), []
                for low, high in pairwise(np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()):
                    more = np.flatnonzero(counts[low:high] > 1)
                    rows.append((int(bucket[low]), chunk, gram[low:high].tobytes(), np.stack([more, counts[low:high][more]]).astype("<u4").tobytes()))
                yield _batch(_SKETCH, rows)
    return run


def _repeated(hot: int):
    """The anchors of a bucket that lie in two chunks at least; those that are hot. Two anchors that agree in half of
    their hashes only cost work: bytes decide."""
    def run(table: pa.Table) -> pa.Table:
        bucket, chunks, grams, more = (table.column(i).to_pylist() for i in range(4))
        sizes = [len(g) // 4 for g in grams]
        ends = np.cumsum(sizes)
        counts = np.ones(ends[-1], np.int64)
        for m, low in zip(more, (ends - sizes).tolist()):
            at, n = np.frombuffer(m, "<u4").reshape(2, -1).astype(np.int64)
            counts[low + at] = n
        gram, of, holders = np.unique(np.frombuffer(b"".join(grams), "<u4"), return_inverse=True, return_counts=True)
        flags = holders[of] > 1
        rows = [(c, b, np.packbits(flags[end - n:end]).tobytes(), None) for c, b, n, end in zip(chunks, bucket, sizes, ends.tolist())]
        total = np.zeros(len(gram), np.int64)
        np.add.at(total, of, counts)
        rows += [(None, None, None, (bucket[0] << 32) | g) for g in gram[total > hot].tolist()]
        return pa.Table.from_batches([_batch(_FOUND, rows)])
    return run


# ---- segments -----------------------------------------------------------------------------------------------------

# Segments of a chunk in a bucket, shrunk: sizes, anchors, documents (key), places of each; their places (text, first);
# their bytes. ``segments`` 0: runs of starts that are known to repeat (text, first, count).
_SEGMENTS = "bucket long, segments long, places long, size long, packed binary"


def _merged(runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, first, count) with those that follow each other as one."""
    text, first, count = np.array(sorted(runs), np.int64).reshape(-1, 3).T
    end = first + count
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] != end[:-1])]))
    return text[new], first[new], end[np.append(new[1:], len(end)) - 1] - first[new]


def _segments(buckets: int, hot: np.ndarray):
    """The bytes around every repeated anchor, cut to the strings that hold it, dealt out by the anchor.

    Strings of a hot anchor go one by one, dealt out by all their bytes. Of equal segments of a chunk, one of the
    smallest document goes on; those of larger documents repeat it and are marked.
    """
    def rows(chunk: int, keys: list[int], sizes: list[int], shrunk: bytes, judged: list[dict], replies: list[dict]) -> Iterator[tuple]:
        data, ends, doc, first, count, anchor, code = _anchored(shrunk, sizes, buckets)
        if not len(code):
            return
        numbers = np.full(len(keys), -1, np.int64)
        numbers[[j["doc"] for j in judged]] = [j["number"] for j in judged]
        by = np.argsort(code, kind="stable")  # documents of an anchor stay in order
        lead = np.flatnonzero(np.concatenate([[True], np.diff(code[by]) != 0]))
        last = np.append(lead[1:], len(by)) - 1
        found, bucket = doc[by[lead]] != doc[by[last]], code[by[lead]] >> 32
        for reply in replies or ():
            low, high = np.searchsorted(bucket, [reply["bucket"], reply["bucket"] + 1])
            found[low:high] |= np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=int(high - low)).astype(bool)
        by = by[np.repeat(found, last - lead + 1)]
        by = by[numbers[doc[by]] >= 0]
        doc, first, count, behind, code = doc[by], first[by], count[by], (anchor - first)[by], code[by]
        bucket, common = code >> 32, np.isin(code, hot)
        if common.any():
            n = count[common]
            single = np.repeat(first[common], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, count = np.concatenate([first[~common], single]), np.concatenate([count[~common], np.ones(len(single), np.int64)])
            behind = np.concatenate([behind[~common], np.full(len(single), -1)])
            doc = np.concatenate([doc[~common], np.repeat(doc[common], n)])
            bucket = np.concatenate([bucket[~common], _bucket(_hashed(data, single, LENGTH), buckets)])
            by = np.argsort(bucket, kind="stable")
            doc, first, count, behind, bucket = doc[by], first[by], count[by], behind[by], bucket[by]
        whole, begins, names = data.tobytes(), [0, *ends.tolist()], numbers.tolist()
        known: list[tuple[int, int, int]] = []
        for low, high in pairwise(np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()):
            best: dict[tuple[int, bytes], list] = {}
            for d, at, a, c in zip(*(x[low:high].tolist() for x in (doc, first, behind, count))):
                _add(best, known, (a, whole[at:at + c + LENGTH - 1]), keys[d], [(names[d], at - begins[d])])
            held = list(best.values())
            places = [p for _, own in held for p in own]
            text, start = zip(*places)
            contents = b"".join(content for _, content in best)
            columns = [_planes([len(content) for _, content in best], "<u4"), _planes([a for a, _ in best], "<i1"), _planes([k for k, _ in held], "<i8"),
                       _planes([len(own) for _, own in held], "<u4"), _planes(text, "<i8"), _planes(start, "<i8"), contents]
            yield int(bucket[low]), len(best), len(places), len(contents), _shrunk(columns)
        if known:
            text, start, n = _merged(known)
            yield chunk % buckets, 0, len(text), 0, _shrunk([_planes(column, "<i8") for column in (text, start, n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _batch(_SEGMENTS, list(rows(*(column[i].as_py() for column in batch.columns))))
    return run


def _add(best: dict, known: list, segment: tuple[int, bytes], key: int, places: list[tuple[int, int]]) -> None:
    """Keep the places of a segment (anchor, bytes) in its smallest document; those in larger ones are known to repeat."""
    held, count = best.get(segment), len(segment[1]) - LENGTH + 1
    if held is None:
        best[segment] = [key, places]
    elif held[0] == key:
        held[1].extend(places)
    elif key < held[0]:
        known += [(n, f, count) for n, f in held[1]]
        best[segment] = [key, places]
    else:
        known += [(n, f, count) for n, f in places]


def _unpacked(segments: int, places: int, size: int, packed: bytes) -> Iterator[tuple[int, bytes, int, list[tuple[int, int]]]]:
    """Segments of a row: anchor, bytes, document, places."""
    whole, at, columns = _grown(packed, 17 * segments + 16 * places + size), 0, []
    for kind, n in (("<u4", segments), ("<i1", segments), ("<i8", segments), ("<u4", segments), ("<i8", places), ("<i8", places)):
        columns.append(_numbers(whole, at, n, kind).tolist())
        at += n * np.dtype(kind).itemsize
    own, low = list(zip(*columns[4:])), 0
    for length, anchor, key, n in zip(*columns[:4]):
        yield anchor, whole[at:at + length], key, own[low:low + n]
        at, low = at + length, low + n


class BlindTrie:
    """Orders strings of one length: inner nodes know only the place of the first difference below them and the bytes
    there, so a string is led down blindly, compared once with the leaf it reaches, and hung in where they part."""

    def __init__(self, read, length: int):
        self.read, self.length, self.root = read, length, None

    def add(self, item: int) -> None:
        if self.root is None:
            self.root = [item]
            return
        own, node = self.read(item), self.root
        while isinstance(node, tuple):
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        other = self.read(node[0])
        if own == other:
            node.append(item)
            return
        apart = next(i for i in range(self.length) if own[i] != other[i])
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < apart:
            parent, node = node, node[1][own[node[0]]]
        if isinstance(node, tuple) and node[0] == apart:
            node[1][own[apart]] = [item]
            return
        split = (apart, {own[apart]: [item], other[apart]: node})
        if parent is None:
            self.root = split
        else:
            parent[1][own[parent[0]]] = split

    def in_order(self) -> Iterator[list[int]]:
        """Groups of equal strings in the order of the strings."""
        waiting = [self.root] if self.root is not None else []
        while waiting:
            node = waiting.pop()
            if isinstance(node, tuple):
                waiting += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def deep_shallow(data: np.ndarray, suffixes: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Groups of suffixes of ``data`` that agree in ``length`` bytes, in suffix order; groups of one are left out.

    Multikey quicksort, with eight bytes as one key, orders the first ``shallow`` bytes: what is alone after a key has
    its place. Groups with a longer common prefix are ordered by blind tries.
    """
    words = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        words = (words[:-k] << np.uint64(8 * k)) | words[k:]
    group = np.zeros(len(suffixes), np.int64)
    for depth in range(0, shallow, 8):
        if not len(suffixes):
            return
        key = words[suffixes + depth]
        by = np.lexsort((key, group)) if depth else np.argsort(key, kind="quicksort")
        suffixes, group, key = suffixes[by], group[by], key[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        suffixes, group = suffixes[tied], group[tied]
    text, deep = data.tobytes(), length - shallow

    def rest(suffix: int) -> bytes:
        return text[suffix + shallow:suffix + length]

    cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    order = suffixes.tolist()
    for low, high in pairwise(cuts.tolist()):
        trie = BlindTrie(rest, deep)
        for suffix in order[low:high]:
            trie.add(suffix)
        yield from (same for same in trie.in_order() if len(same) > 1)


_MARK = "text long, first long, count int"


def _marked(table: pa.Table) -> pa.Table:
    """Runs of starts whose string also starts in a smaller document, from all segments of a bucket."""
    marks: list[tuple[int, int, int]] = []
    best: dict[tuple[int, bytes], list] = {}
    for segments, places, size, packed in zip(*(table.column(c).to_pylist() for c in ("segments", "places", "size", "packed"))):
        if not segments:
            whole = _grown(packed, 24 * places)
            marks += zip(*(_numbers(whole, 8 * i * places, places, "<i8").tolist() for i in range(3)))
            continue
        for anchor, content, key, own in _unpacked(segments, places, size, packed):
            _add(best, marks, (anchor, content), key, own)
    # Only anchors with several different segments are left to compare.
    parts = list(best)
    if parts:
        data, ends = _joined([content for _, content in parts])
        begin = np.concatenate([[0], ends[:-1]])
        behind = np.array([a for a, _ in parts])
        gram = np.where(behind < 0, np.uint64(0), _hashed(data, begin + np.maximum(behind, 0), GRAM))
        _, group, sizes = np.unique(gram, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero((behind >= 0) & (sizes[group] > 1))
        size = ends - begin - LENGTH + 1
        part = np.repeat(chosen, size[chosen])
        offset = np.arange(len(part)) - np.repeat(np.cumsum(size[chosen]) - size[chosen], size[chosen])
        owner = np.repeat(np.arange(len(parts)), ends - begin)
        keys = np.array([best[p][0] for p in parts])
        flat: list[int] = []
        starts: list[int] = []
        for same in deep_shallow(data, begin[part] + offset):
            starts.append(len(flat))
            flat += same
        if flat:
            suffix = np.array(flat)
            least = np.repeat(np.minimum.reduceat(keys[owner[suffix]], starts), np.diff([*starts, len(flat)]))
            found = np.sort(suffix[keys[owner[suffix]] > least])
        else:
            found = np.empty(0, np.int64)
        if len(found):
            of = owner[found]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (of[1:] != of[:-1])]))
            for low, high in pairwise(np.append(new, len(found)).tolist()):
                p = int(of[low])
                start = int(found[low] - begin[p])
                marks += [(n, f + start, high - low) for n, f in best[parts[p]][1]]
    columns = list(zip(*marks)) or [[], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=["text", "first", "count"])


# ---- removal ------------------------------------------------------------------------------------------------------

def spans(runs: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes covered by strings that start in the given runs, as maximal spans."""
    out: list[list[int]] = []
    for first, count in sorted(runs):
        end = first + count - 1 + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


_CUT = "text long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, shrunk, runs = (column[i].as_py() for column in batch.columns)
            whole, begins = _grown(shrunk, sum(sizes)), [0, *np.cumsum(sizes).tolist()]
            texts = [whole[begins[r["doc"]]:begins[r["doc"] + 1]] for r in runs]
            removed = [spans(list(zip(r["firsts"], r["counts"]))) for r in runs]
            kept = [b"".join(t[a:b] for a, b in zip([0, *(e for _, e in s)], [*(a for a, _ in s), len(t)])) for t, s in zip(texts, removed)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["number"] for r in runs], pa.int64()), pa.array([sum(b - a for a, b in s) for s in removed], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in removed], kind), pa.array(kept, pa.binary())],
                names=["text", "n_removed", "spans", "kept"])


def _sha(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_kept: bool = True,
                   chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """One row per document: its bytes without those that repeat a string of LENGTH bytes of a smaller document.

    Columns: doc_id, n_bytes, n_removed, spans (removed bytes as maximal runs), and ``kept_sha256``, or the bytes
    ``kept`` themselves without ``digest_kept``. ``chunk`` (bytes a task looks at together) and ``hot`` (occurrences that
    make an anchor hot) decide memory and traffic, never results.

    1. Equal texts form a class; its smallest document is judged, and larger copies lose all their strings. Texts are
       stored compressed, a chunk a row.
    2. Every string holds an anchor that its bytes choose. Anchors of one document alone cannot repeat; hashes tell. Only
       they are sent, and a bit for each comes back: a chunk finds the places of its anchors again.
    3. Around the others, bytes are dealt out by anchor. Each group orders its suffixes by deep-shallow sorting, and a
       string that also starts in a smaller document is marked. Bytes decide, never hashes.
    4. Marked runs return to their chunk and are cut out.

    What only these steps read is removed after the last, and the shuffle files of a step with the step.

    Hot anchors are split: within a chunk of text equal segments are merged, and strings of an anchor with many
    occurrences are dealt out one by one, by all their bytes.

    A null text counts as empty and texts below LENGTH bytes lose nothing. A null key is larger than all others.
    Rows that share a key do not affect each other. An empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    scratch = f"{shared_folder(spark)}/substring-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
        return materialize(df, name, scratch, sweep=True, **options)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("digest", _sha(F.col("text")))
    keys = materialize(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"),
                                   F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
                       .select("doc_id", "key", _sha(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "substring-keys", sweep=True)
    salt = F.pmod(F.xxhash64("key"), F.lit(64))
    salted = keys.groupBy("digest", salt.alias("salt")).agg(F.min("key").alias("key"), F.max("n_bytes").alias("n_bytes"))
    salted = materialize(salted, "substring-salted", sweep=True)
    classes = salted.groupBy("digest").agg(F.min("key").alias("least"), F.max("n_bytes").alias("n_bytes"))
    classes = materialize(classes.withColumn("text", F.monotonically_increasing_id()), "substring-classes", sweep=True)
    with swept(spark):
        total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(128, total // BUCKET)

    long_rows = rows.where(F.octet_length("text") >= LENGTH).select("digest", "key", "text")
    chunks = stored(long_rows.mapInArrow(_gathered(chunk), _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks", **_LARGE_ROWS)
    found = stored(chunks.select("chunk", "sizes", "data").mapInArrow(_sketch(buckets), _SKETCH)
                   .groupBy("bucket").applyInArrow(_repeated(max(hot, total // 1_000_000)), _FOUND), "anchors", **PLAIN)
    common = np.array([r[0] for r in found.where("hot IS NOT NULL").select("hot").collect()], np.int64)
    judged = chunks.select("chunk", F.posexplode(F.arrays_zip("digests", "keys")).alias("doc", "own")).join(
        classes.select(F.col("digest").alias("of"), "least", F.col("text").alias("number")), (F.col("own.digests") == F.col("of")) & (F.col("own.keys") == F.col("least")))
    judged = stored(judged.select("chunk", "doc", "number").dropDuplicates(["number"]), "judged")

    def of_chunk(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias(name))

    asked = of_chunk(judged, "judged", "doc", "number").join(of_chunk(found.where("bits IS NOT NULL"), "replies", "bucket", "bits"), "chunk", "left")
    segments = chunks.join(asked, "chunk").select("chunk", "keys", "sizes", "data", "judged", "replies").mapInArrow(_segments(buckets, common), _SEGMENTS)
    marks = stored(segments.groupBy("bucket").applyInArrow(_marked, _MARK), "marks")

    runs = marks.groupBy("text").agg(F.collect_list("first").alias("firsts"), F.collect_list("count").alias("counts"))
    runs = of_chunk(runs.withColumnRenamed("text", "number").join(judged, "number"), "runs", "doc", "number", "firsts", "counts")
    cut = chunks.join(runs, "chunk").select("sizes", "data", "runs").mapInArrow(_cut, _CUT)
    out = F.sha2("kept", 256) if digest_kept else F.col("kept")
    cut = materialize(cut.select("text", "n_removed", "spans", out.alias("kept")), "substring-cut", sweep=True)
    remove(spark, scratch)

    judged = classes.join(cut, "text", "left").select("digest", "least", "n_removed", "spans", "kept")
    asked = salted.select("digest", "salt").join(judged, "digest")
    name = "kept_sha256" if digest_kept else "kept"
    copy = (F.col("key") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    joined = keys.withColumn("salt", salt).join(asked, ["digest", "salt"])
    if digest_kept:
        whole, nothing = F.lower(F.hex("digest")), F.lit(hashlib.sha256(b"").hexdigest())
    else:
        texts = rows.select(F.col("digest").alias("_digest"), F.col("key").alias("_key"), F.col("text").alias("_text"))
        joined = joined.join(texts.dropDuplicates(["_digest", "_key"]), (F.col("digest") == F.col("_digest")) & (F.col("key") == F.col("_key")))
        whole, nothing = F.col("_text"), F.lit(b"")
    return joined.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", whole)).alias(name))

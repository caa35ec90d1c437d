"""BPE encoding through a table of distinct words, decoding through the table of pieces."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from turnledger.llm.common import give_back, id_and_text
from turnledger.session import shared_folder

CHUNK_WORDS = 6_000_000
_SLICE = 1 << 16  # words of a row: what a chunk's words and positions are cut into, as large rows fill an executor's heap
_DECODED_ROWS = 256  # texts that a task holds decoded
# A word of letters and then marks. The tokenizer never joins the two; an apostrophe it may.
_LETTERS_MARKS = re.compile(rb"([^\x00-\x40\x5b-\x60\x7b-\x7f]+)([!-&(-/:;=?@\[-`{}~]+)")
_TOKENIZERS: dict = {}  # of a Python worker, by vocabulary


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbering(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_parts(word: bytes) -> tuple[bytes, ...]:
    """What is encoded in the place of a word: letters and marks apart, ASCII letters in lower case.

    The tokenizer lower-cases and splits there as well. A word with a character that could combine with its
    neighbour, or with the beginning of a special token, stays as it is.
    """
    found = _LETTERS_MARKS.fullmatch(word)
    if found:
        letters, marks = found.groups()
        if letters.isascii():
            return letters.lower(), marks
        if letters.decode()[-1].isalpha():
            return letters, marks
    return (word.lower() if word.isascii() and b"<|" not in word else word,)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24 as three compressed planes of bytes."""
    planes = np.empty((3, len(numbers)), np.uint8)
    for i in range(3):
        planes[i] = numbers >> 8 * i & 255
    return pa.compress(pa.py_buffer(planes), "zstd", asbytes=True)


def _unpacked(planes: np.ndarray) -> np.ndarray:
    """Numbers from their three planes of bytes."""
    numbers = planes[2].astype(np.uint32)
    for i in (1, 0):
        numbers <<= 8
        numbers |= planes[i]
    return numbers


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts: keys, parts per text, the number of the part at each position, and the distinct parts.
    Rows of a chunk hold a slice of its texts, or a slice of its distinct parts with the number of the first.

    Words are split at ASCII white space only. The tokenizer drops white space and forms no token across it, and no
    normalisation joins characters across it, so the tokens of a text are those of its words, one after another.
    """
    chunk = TaskContext.get().partitionId() << 24
    words, keys, carried, numbers, total = _Numbering(), [], [], [], 0

    def flush():
        parts, first, second = _Numbering(), np.empty(len(words), np.int32), np.full(len(words), -1, np.int32)
        for i, word in enumerate(words):
            found = word_parts(word)
            first[i] = parts[found[0]]
            if len(found) > 1:
                second[i] = parts[found[1]]
        counts, at = [], 0  # text by text, so that no array but the result is as long as the chunk
        width_of = (1 + (second >= 0)).astype(np.int8)
        placed = np.empty(sum(int(width_of[n].sum()) for n in numbers), np.int32)
        for n in numbers:
            width = width_of[n]
            ends = np.cumsum(width, dtype=np.int64)
            out = placed[at:at + (int(ends[-1]) if len(ends) else 0)]
            out[ends - width] = first[n]
            double = width == 2
            out[ends[double] - 1] = second[n[double]]
            counts.append(len(out))
            at += len(out)
        order = np.argsort(-np.bincount(placed, minlength=len(parts)), kind="stable")  # small numbers for frequent parts
        rank = np.empty(len(parts), np.int32)
        rank[order] = np.arange(len(parts))
        listed = list(parts)
        placed = rank[placed]
        edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        begin = 0
        while begin < len(counts):  # as many whole texts as fit a slice, at least one
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + _SLICE, side="right")) - 1)
            yield row(keys[begin:end], carried[begin:end], counts[begin:end], _packed(placed[edges[begin]:edges[end]]), 0, [])
            begin = end
        for base in range(0, len(listed), _SLICE):
            yield row([], [], [], _packed(placed[:0]), base, [listed[i] for i in order[base:base + _SLICE]])

    def row(keys: list, carried: list, counts: list, numbers: bytes, base: int, words: list) -> pa.RecordBatch:
        text = pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([carried], pa.list_(pa.int64())),
             pa.array([counts], pa.list_(pa.int64())), pa.array([numbers], pa.binary()), pa.array([base], pa.int32()), text],
            names=["chunk", "keys", "carried", "counts", "numbers", "base", "words"])

    for batch in batches:
        for key, place, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).cast(pa.binary())):
            found = text.as_py().split()
            keys.append(key)
            carried.append(place)
            numbers.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            total += len(found)
            if total >= CHUNK_WORDS:
                yield from flush()
                chunk += 1
                words, keys, carried, numbers, total = _Numbering(), [], [], [], 0
                give_back()
    if keys:
        yield from flush()
    words, keys, carried, numbers = _Numbering(), [], [], []
    give_back()


def _tokenizer(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if vocabulary not in _TOKENIZERS:
        found = Tokenizer.from_str(vocabulary)
        found.no_truncation()
        found.no_padding()
        _TOKENIZERS.clear()
        _TOKENIZERS[vocabulary] = found
    return _TOKENIZERS[vocabulary]


def _encoder(vocabulary: str, id_type: str):
    """Rows come sorted by word, so every distinct word is encoded once and its ids go to all its chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, last_ids = _tokenizer(vocabulary), None, b""
        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column(2), run_end_type=pa.int32())
            distinct = runs.values.to_pylist()
            fresh = distinct[1:] if distinct and distinct[0] == last else distinct
            coded = [np.array(e.ids, id_type).tobytes() for e in tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            if len(fresh) < len(distinct):
                coded.insert(0, last_ids)
            if distinct:
                last, last_ids = distinct[-1], coded[-1]
            lengths = np.diff(np.asarray(runs.run_ends), prepend=0)
            ids = pa.array(coded, pa.binary()).take(pa.array(np.repeat(np.arange(len(coded)), lengths)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["chunk", "slot", "ids"])
        give_back()
    return run


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _join_positions(id_type: str):
    size = np.dtype(id_type).itemsize
    schema = pa.schema([("doc_id", pa.int64()), ("carried", pa.int64()), ("ids", pa.binary())])

    def run(chunk: pa.Table, coded: pa.Table) -> pa.Table:
        """Put the ids of a chunk's words back at the positions of its texts, slice by slice; each slice is a batch of its own."""
        give_back()
        words = coded.column("ids").combine_chunks().take(pa.array(np.argsort(coded.column("slot").to_numpy()))) if coded.num_rows else pa.array([], pa.binary())
        flat = np.frombuffer(words.buffers()[2] or b"", id_type) if len(words) else np.empty(0, id_type)
        lengths = pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // size
        starts = np.cumsum(lengths) - lengths
        batches = []
        for row in range(chunk.num_rows):
            keys, carried, counts = (chunk.column(c)[row].values for c in ("keys", "carried", "counts"))
            counts = counts.to_numpy(zero_copy_only=False).astype(np.int64)
            total = int(counts.sum())
            planes = np.frombuffer(pa.decompress(chunk.column("numbers")[row].as_buffer(), 3 * total, "zstd"), np.uint8).reshape(3, total)
            part = _unpacked(planes)
            tokens = flat[_ragged(starts[part], lengths[part])].astype("<u4")
            at = 4 * np.concatenate([[0], np.cumsum(lengths[part])])[np.concatenate([[0], np.cumsum(counts)])]
            ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(tokens)])
            batches.append(pa.RecordBatch.from_arrays([keys, carried, ids], schema=schema))
        return pa.Table.from_batches(batches, schema)

    return run


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table in the shared folder, bucketed by ``key``, so that later joins on the key do not move it again."""
    spark = df.sparkSession
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}")
     .bucketBy(buckets, key).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog only; the files belong to the shared folder
    return table


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None,
           carry: Column | None = None) -> DataFrame:
    """``(doc_id, ids)``: token ids of every whole text as little-endian unsigned 32-bit integers.

    ``carry`` is a number that goes along with each text, as column ``carried``, so that no join has to bring it back.

    1. Tasks split texts into words and write, for each chunk of up to ``CHUNK_WORDS`` words (and one text more), the
       distinct words and the number of the word at each position, both cut into rows of up to ``_SLICE`` words.
    2. Distinct words of the chunks are dealt out by word. A word appears once per chunk at most, so a frequent word
       is no hot key. Each is encoded once.
    3. Ids go back to their chunks and are joined by position. The chunks are bucketed, so neither texts nor positions
       are shuffled.

    A null or empty text has no ids. Null keys and repeated rows are kept as they are. An empty table gives an empty
    result; other columns are left out. The vocabulary is a file of the ``tokenizers`` library.
    """
    vocabulary = Path(vocabulary_path or default_vocabulary()).read_text(encoding="utf-8")
    id_type = "<u2" if len(pieces(vocabulary_path)) <= 1 << 16 else "<u4"
    place = (carry if carry is not None else F.lit(None)).cast("long").alias("_carried")
    texts = id_and_text(docs, id_col, text_col, place).withColumn("doc_id", F.col("doc_id").cast("long"))
    chunks = _bucketed(texts.mapInArrow(
        _split, "chunk long, keys array<long>, carried array<long>, counts array<long>, numbers binary, base int, words array<string>"), "chunk")
    words = chunks.select("chunk", "base", F.posexplode("words").alias("at", "word"))
    words = words.select("chunk", (F.col("base") + F.col("at")).alias("slot"), "word").repartition("word").sortWithinPartitions("word")
    coded = words.mapInArrow(_encoder(vocabulary, id_type), "chunk long, slot int, ids binary")
    places = chunks.where(F.size("counts") > 0).select("chunk", "keys", "carried", "counts", "numbers")
    coded = (places.groupBy("chunk").cogroup(coded.groupBy("chunk"))
            .applyInArrow(_join_positions(id_type), "doc_id long, carried long, ids binary"))
    return coded if carry is not None else coded.drop("carried")


def pieces(vocabulary_path: str | None = None) -> list[str]:
    """The piece of every id; its size is fixed by the vocabulary file (49,408 for the default one)."""
    content = json.loads(Path(vocabulary_path or default_vocabulary()).read_text(encoding="utf-8"))
    table = dict(content["model"]["vocab"])
    table.update({t["content"]: t["id"] for t in content.get("added_tokens") or []})
    listed = [""] * (max(table.values()) + 1)
    for piece, number in table.items():
        listed[number] = piece
    return listed


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: join ids to their pieces; a vocabulary without a decoder puts spaces between them.

    The piece table has a fixed size, so each task holds it and joins whole batches of ids by position in the table.
    """
    content = json.loads(Path(vocabulary_path or default_vocabulary()).read_text(encoding="utf-8"))
    if content.get("decoder"):
        raise ValueError("only vocabularies without a decoder of their own are supported")
    table = pieces(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("ids")
            for first in range(0, whole.num_rows, _DECODED_ROWS):
                batch = whole.slice(first, _DECODED_ROWS)
                texts = [" ".join([table[i] for i in np.frombuffer(ids.as_py(), "<u4").tolist()]) for ids in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
            del whole, batch, texts
            give_back()

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))

"""Skew-safe exact deduplication: local, salted and global merges that compare whole contents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import id_and_text
from turnledger.session import materialize

SALTS = 32
_WIDE = "decimal(38,0)"
_SPAN = Decimal(2 ** 64)
_HALF = Decimal(2 ** 63)


def squeezed(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _rank(length: Column, key: Column) -> Column:
    """One number that orders rows by length, then by falling key, so that a plain maximum finds the row that stays.

    A number of fixed width keeps the merges in hash aggregation, which a struct would not.
    """
    last = F.coalesce(key.cast(_WIDE), F.lit(_HALF).cast(_WIDE))
    return (length.cast("decimal(10,0)") * F.lit(_SPAN).cast("decimal(20,0)") - last).cast(_WIDE)


def _key_of(rank: Column) -> Column:
    """The key inside a rank: the distance to the next multiple of the span, signed."""
    half = F.lit(_HALF).cast(_WIDE)
    span = F.lit(_SPAN).cast(_WIDE)
    shifted = F.pmod((half - rank).cast(_WIDE), span).cast(_WIDE)
    key = (shifted - half).cast(_WIDE)
    return F.when(key != -half, key.cast("long"))


def merged(rows: DataFrame, salts: int) -> DataFrame:
    """``(digest, content, rank, group_size)`` of every content, merged in three steps that compare whole contents.

    The partial aggregation of the first grouping is the local merge: a task sends a content once per salt, however
    often it holds it. The second grouping meets at most ``salts`` winners of a content.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = rows.groupBy("digest", "content", salt).agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("group_size").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                     digest=sha256) -> DataFrame:
    """One row per document: the document that stays for its text, the size of its group, whether it stays.

    Texts are equal when they are identical without ASCII white space. Of equal texts the one with the most code
    points in the original stays, then the smallest key. Digests deal the rows out; contents decide:

    1. every task merges equal contents of its own rows before anything is shuffled,
    2. digest, content and salt are merged, so a text that a third of all rows hold meets in ``salts`` places,
    3. the salt winners are merged by digest and content.

    Rows find their class by digest and salt, so rows of one text are dealt over ``salts`` places here too; a class is
    repeated only for the salts its rows have. Where one digest covers several contents, rows find it by content.

    A null text counts as empty; empty texts are equal to each other. A null key is the last of its group and gives a
    null ``keep_id``. Rows that repeat a key and a text are one document and get the same answer; ``group_size``
    counts them all. An empty table gives an empty result; other columns are left out.
    """
    rows = id_and_text(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("length"), squeezed(F.col("text")).alias("content"))
    rows = rows.select("doc_id", "content", digest(F.col("content")).alias("digest"), _rank(F.col("length"), F.col("doc_id")).alias("rank"))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("salt")
    keys = materialize(rows.select("doc_id", "digest", sha256(F.col("content")).alias("text_sha256"), place), "exact-keys")
    classes = materialize(merged(rows, salts).select("digest", _key_of(F.col("rank")).alias("keep_id"), "group_size"), "exact-classes")
    shared = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    if shared.isEmpty():
        found = _by_digest(keys, classes)
    else:
        found = _by_digest(keys.join(shared, "digest", "left_anti"), classes.join(shared, "digest", "left_anti")).unionByName(
            _by_content(rows.join(shared, "digest", "left_semi"), salts))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256")


def _by_digest(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the class of their digest, which has one content; dealt by digest and salt."""
    places = keys.select("digest", "salt").distinct().join(classes, "digest")
    return keys.join(places, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")


def _by_content(rows: DataFrame, salts: int) -> DataFrame:
    """Rows whose digest covers several contents, matched on the contents themselves; dealt by content and salt."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    named = merged(rows, salts).select("digest", "content", every, _key_of(F.col("rank")).alias("keep_id"), "group_size")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    return dealt.join(named, ["digest", "content", "salt"]).select(
        "doc_id", "keep_id", "group_size", sha256(F.col("content")).alias("text_sha256"))

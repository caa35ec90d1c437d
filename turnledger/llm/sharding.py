"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import id_and_text, number_bucket, number_rows

_BITS = 52  # of an md5, so that the value is exact in a double


def race_time(key: Column, shard: int, weight: float) -> Column:
    """Exponential arrival time of a shard for a key; a shard wins with a chance in proportion to its weight."""
    seed = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))
    hashed = F.conv(F.substring(F.md5(seed.cast("binary")), 1, _BITS // 4), 16, 10).cast("double")
    return -F.log((hashed + 0.5) / float(2 ** _BITS)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that arrives first; of equal times, the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    runners = [F.struct(race_time(key, i, w).alias("time"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*runners))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_by: float = 1.0, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Shard of every record, its gapless slot in the shard, and its shard after one more is added.

    The shard depends on the record key and the shard weights alone, so each row is placed without a shuffle, and a
    further shard takes rows only into itself. Slots number the rows of a shard by (md5 bucket, key, checksum, size).

    A null key is a key of its own; a null text has size 1 and the checksum of the empty text. Repeated rows get the
    same shard and different slots. An empty table gives an empty result; other columns are left out.
    """
    key = F.col("doc_id")
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_by]).alias("grown_shard"), number_bucket(key).alias("_bucket"))
    numbered = number_rows(rows, "shard", "_bucket", ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"),
                           "grown_shard")

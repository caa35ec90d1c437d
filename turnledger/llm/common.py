"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.session import materialize

NUMBER_BUCKETS = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The key and the text (null: empty) under fixed names; other columns of ``docs`` cannot clash afterwards."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is among ``keys.doc_id``; a null key matches a null key."""
    wanted = keys.select(F.col("doc_id").alias("_wanted_key"))
    return docs.join(wanted, docs[id_col].eqNullSafe(wanted["_wanted_key"]), "left_semi")


def number_bucket(key: Column) -> Column:
    """One of 4096 buckets by the md5 of a key; also expressible in other SQL engines."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 3)


def number_rows(df: DataFrame, group: str, bucket: str, order: list, out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order (bucket, *order).

    A group may hold most rows: it is numbered bucket by bucket in different tasks. The offsets come from a table of
    one count per group and bucket, so the only window over a whole group sees at most 4096 rows.
    """
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(group, bucket, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, bucket).orderBy(*order)
    numbered = df.withColumn("_number", F.row_number().over(within))
    return (numbered.join(offsets, [group, bucket], "left")
            .withColumn(out, F.col("_offset") + F.col("_number") - 1).drop("_offset", "_number"))


def number_in_order(df: DataFrame, order: list[str], out: str, name: str) -> DataFrame:
    """``df`` with its place from 0 in the order of ``order`` as ``out``, sorted by range in many tasks.

    Written once with the number of the range, so that places cannot change. The only window over all ranges sees
    one count for each. The column ``_part`` (the range) stays.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = materialize(spread.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
                        .withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    return parts.withColumn("_row", F.row_number().over(inside)).join(offsets, "_part").withColumn(
        out, F.col("_offset") + F.col("_row") - 1).drop("_row", "_offset", "_tie")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a lambda variable is not inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Hand the memory that a Python worker holds but no longer uses back to the system.

    Workers are kept for later stages, and a stage may need two of them for each core.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)

"""Incremental ingest of transcripts: every micro-batch rewrites the sessions that it touches, and only those.

Two tables grow side by side, both cut into buckets by the hash of the session:

* ``lines``: every line once, parsed, with the file and batch that brought it first;
* ``entries``: the finished entries of the sessions, as a scan of all files at once would give them.

A batch reads the buckets of its sessions, works the new lines into them and replaces these buckets. Readers of
``entries`` aggregate nothing. A replayed batch finds its lines already there and writes the same rows again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from turnledger.session import PLAIN, materialize, remove, shared_folder, swept
from turnledger.sources.transcripts import _with_provenance, line_order, merge_streamed, parse_entries

BUCKETS = 64
PACKED = {**PLAIN, "compression": "zstd"}  # every line is stored several times
LINE_KEY = ("session_id", "file_stem", "line_key", "nth")


def ingest_lines(spark: SparkSession, path: str, source: str, source_rank: int = 0) -> DataFrame:
    """New transcript files as a stream of bronze lines with their split offset."""
    text = (spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
            .select("value", F.col("_metadata.file_path").alias("file_path"),
                    F.col("_metadata.file_size").alias("file_size"),
                    F.col("_metadata.file_block_start").alias("block_start")))
    return _with_provenance(text, source_rank, source, F.col("file_path"))


def bucket_of(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def new_lines(batch: DataFrame, batch_id: int, buckets: int = BUCKETS) -> DataFrame:
    """Parsed lines of a batch with the key by which copies know each other.

    Positions are taken directly on the scan (``block_start``) unless the lines bring their own ``ord``. A line is
    known by its file stem, its text and its number among equal lines of its file, so a longer copy of a file adds
    only what is new, and equal lines of one file count each. Files arrive whole, as Spark's file source hands them out.
    """
    if "ord" not in batch.columns:
        batch = batch.withColumn("ord", line_order(F.col("block_start"), F.monotonically_increasing_id())).drop("block_start")
    keyed = batch.where(F.trim("value") != "").withColumn("line_key", F.sha2(F.col("value").cast("binary"), 256))
    same = Window.partitionBy("source_rank", "file_path", "line_key").orderBy("ord")
    rows = parse_entries(keyed.withColumn("nth", F.row_number().over(same)))
    return rows.withColumn("batch", F.lit(batch_id).cast("long")).withColumn("bucket", bucket_of(F.col("session_id"), buckets))


def first_copies(lines: DataFrame) -> DataFrame:
    """Every line once: as the earliest batch brought it, of one batch the first source and path. Whole lines are sorted
    once, after they were dealt out."""
    first = Window.partitionBy(*LINE_KEY).orderBy("batch", "source_rank", "file_path")
    return lines.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def finished(lines: DataFrame) -> DataFrame:
    """Entries of whole sessions from their lines.

    The files of a session follow each other by source and path, as in a scan; the lines that later copies of a file
    added follow it in the order in which the copies came. Parts of one response become one entry.

    All this is worked out on the list of files, which lines meet once. As in ``session_positions``, the place of a file
    goes above the 48 bits of a position in a file.
    """
    key = ["session_id", "file_stem", "batch", "source_rank", "file_path"]
    first = Window.partitionBy("session_id", "file_stem").orderBy("batch", "source_rank", "file_path")
    place = Window.partitionBy("session_id").orderBy("stem_rank", "stem_path", "batch", "file_path")
    files = lines.select(*key).distinct()
    files = files.select(*key, F.first("source_rank").over(first).alias("stem_rank"), F.first("file_path").over(first).alias("stem_path"))
    files = files.withColumn("_place", (F.dense_rank().over(place) - 1).cast("long"))
    placed = lines.join(files.hint("shuffle_hash"), key).withColumn("ord", F.shiftleft("_place", 48) + F.col("ord"))
    as_one = placed.withColumn("source_rank", F.col("stem_rank")).withColumn("file_path", F.col("stem_path"))
    return merge_streamed(as_one.drop("stem_rank", "stem_path", "_place", "batch", "line_key", "nth"))


def _stored(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame | None:
    """The given buckets of a table, or nothing before the first batch."""
    try:
        return spark.read.parquet(path).where(F.col("bucket").isin(buckets))
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _replace(rows: DataFrame, path: str) -> None:
    """Replace the buckets that ``rows`` hold. Dealt by range, so that a session of many rows spreads over tasks."""
    with swept(rows.sparkSession):
        (rows.repartitionByRange("bucket", "session_id", "ord").sortWithinPartitions("bucket", "session_id", "ord")
         .write.mode("overwrite").options(partitionOverwriteMode="dynamic", **PACKED).partitionBy("bucket").parquet(path))


def absorb(batch: DataFrame, batch_id: int, table_path: str, buckets: int = BUCKETS) -> None:
    """Work one batch into the tables. Only the numbers of the touched buckets reach the driver, at most ``buckets``.

    What the batch changes is written to the shared folder first. Other sessions of its buckets go straight from the old
    files to the new ones: a dynamic overwrite writes beside the table and swaps the folders when all tasks have ended.
    What is written on the way is removed as soon as the next step has used it.
    """
    spark = batch.sparkSession
    scratch = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, folder=f"{scratch}/{name}", sweep=True, **PACKED)

    new = stored(new_lines(batch, batch_id, buckets), "ingest-new")
    with swept(spark):
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
    if touched:
        old_lines = _stored(spark, f"{table_path}/lines", touched)
        old_entries = _stored(spark, f"{table_path}/entries", touched)
        sessions = new.select("session_id").distinct()
        together = new if old_lines is None else new.unionByName(old_lines.join(sessions, "session_id", "left_semi").select(new.columns))
        lines = stored(first_copies(together), "ingest-lines")
        remove(spark, f"{scratch}/ingest-new")
        entries = stored(finished(lines), "ingest-entries")
        sessions = lines.select("session_id").distinct()  # the same
        for rows, old, name in ((entries, old_entries, "entries"), (lines, old_lines, "lines")):
            if old is not None:
                rows = rows.unionByName(old.join(sessions, "session_id", "left_anti").select(rows.columns))
            _replace(rows, f"{table_path}/{name}")
            remove(spark, f"{scratch}/ingest-{name}")
    remove(spark, scratch)


def ingest(lines: DataFrame, table_path: str, checkpoint: str, buckets: int = BUCKETS):
    """Stream of bronze lines into the tables below ``table_path``; ``start()`` takes what has arrived and ends."""
    return (lines.writeStream.foreachBatch(lambda batch, batch_id: absorb(batch, batch_id, table_path, buckets))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def stored_entries(spark: SparkSession, table_path: str) -> DataFrame:
    """Entries over all batches, read as they were written."""
    return spark.read.parquet(f"{table_path}/entries").drop("bucket")

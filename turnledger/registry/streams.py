"""Streaming queries: the table is written as stream input once, run with ``availableNow``, and read back.

A sentinel row far in the future moves the watermark past all data; it is removed from the results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnledger.operators import limits
from turnledger.registry.usage import ledger, one_account
from turnledger.session import move, remove, shared_folder, swept
from turnledger.sources import tables
from turnledger.streaming import ingest, jobs

SENTINEL_MS = 4102444800000  # 2100-01-01
CALLS = ("account", "session_id", "ord", "ts_ms", "model", "input_tokens", "output_tokens", "cache_read",
         "cache_creation", "cache_1h", "event_type")


def _stream(spark, rows):
    """Rows as files of one stream; the sentinel comes in a later file and thus in a later batch."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    later = rows.limit(1).withColumn("ts_ms", F.lit(SENTINEL_MS)).withColumn("account", F.lit("~sentinel"))
    later.withColumn("output_tokens", F.lit(1).cast("long")).write.mode("append").parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    return base, spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in")


def _run(spark, base, out):
    query = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _calls(spark, sf, account=None):
    rows = ledger(spark, sf).select(*CALLS).withColumn("account", F.col("account").cast("string"))
    return one_account(rows) if account else rows


def _kept(df, column="window_start"):
    return df.where(F.col(column) < F.timestamp_millis(F.lit(SENTINEL_MS - 10 * 86400000)))


def stream_daily_cost(spark, sf):
    base, rows = _stream(spark, _calls(spark, sf))
    out = _kept(_run(spark, base, jobs.daily_cost(rows)))
    return out.select(F.to_date("window_start").cast("string").alias("day"), "display", "cost_nusd", "calls")


def stream_weekly_cost(spark, sf):
    base, rows = _stream(spark, _calls(spark, sf))
    out = _kept(_run(spark, base, jobs.weekly_cost(rows, 1)))
    return out.select(F.to_date("window_start").cast("string").alias("week"), "account", "cost_nusd", "calls")


def stream_usage_rate(spark, sf):
    base, rows = _stream(spark, _calls(spark, sf, "all"))
    out = _kept(_run(spark, base, jobs.usage_rate(rows)))
    return out.select(F.unix_millis("window_start").alias("start_ms"), "cost_nusd", "calls")


def stream_limit_clusters(spark, sf):
    rows = _calls(spark, sf, "all").where(F.col("event_type") == "error")
    base, stream = _stream(spark, rows)
    return _run(spark, base, jobs.limit_clusters(stream)).where(F.col("account") == "all")


def stream_windows_5h(spark, sf):
    jobs.use_rocksdb(spark)
    base, rows = _stream(spark, _calls(spark, sf))
    return _run(spark, base, jobs.windows_5h(rows)).where(F.col("account") != "~sentinel")


def _arrivals(spark, sf):
    """Derived transcript lines in three arrivals: first files; resumed sessions and most sub-agents; the other
    sub-agents, and a copy of every tenth user's files under another path."""
    lines = tables.transcript_lines(spark, sf)
    user = F.regexp_extract("file_stem", "^u([0-9]+)_", 1).cast("long")
    turn = (F.when(F.col("file_stem").endswith("_b"), 1).when(F.col("is_subagent") & (user % 10 == 4), 2)
            .when(F.col("is_subagent"), 1).otherwise(0))
    copies = lines.where(user % 10 == 0).withColumn("file_path", F.concat(F.lit("/later"), "file_path"))
    return lines.withColumn("arrival", turn).unionByName(copies.withColumn("arrival", F.lit(2)))


def stream_ingest(spark, sf):
    """Entries after three runs of the ingest, each with the files that arrived since the last one. Files are written
    once, moved to where they arrive, and removed when they were taken in."""
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = _arrivals(spark, sf)
    with swept(spark):
        rows.write.partitionBy("arrival").options(**ingest.PACKED).parquet(f"{base}/all")
    schema = rows.drop("arrival").schema
    for arrival in range(3):
        move(spark, f"{base}/all/arrival={arrival}", f"{base}/in/{arrival}")
        arrived = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        ingest.ingest(arrived, f"{base}/out", f"{base}/ck", 8).start().awaitTermination()
        remove(spark, f"{base}/in/{arrival}")
    stored = ingest.stored_entries(spark, f"{base}/out")
    return stored.select("session_id", "ord", "type", "n_lines", F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"),
                         F.coalesce("usage.output_tokens", F.lit(0)).alias("output_tokens"))


QUERIES = {f.__name__: f for f in (stream_daily_cost, stream_weekly_cost, stream_usage_rate, stream_limit_clusters,
                                   stream_windows_5h, stream_ingest)}

"""Cache flushes, idle gaps and long-context use per session."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.scalars import half_even, safe_ratio
from turnledger.operators.ordering import with_previous

# Fixed values.
LONG_CONTEXT_TOKENS = 200_000
CACHE_TTL_MS = 300_000
CACHE_TTL_1H_MS = 3_600_000
COMPACTION_NEAR_MS = 120_000
REWRITE_FLOOR_TOKENS = 100
SHORT_GAP_MS = 300_000
MID_GAP_MS = 3_600_000
REWRITE_USD_PER_M = 3.75


def context_size() -> Column:
    return F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")


def long_context(turns: DataFrame) -> DataFrame:
    """Peak context per session, whether it left the standard window, and when it first did."""
    over = context_size() > LONG_CONTEXT_TOKENS
    return (turns.where((F.col("output_tokens") > 0) & F.col("ts_ms").isNotNull()).groupBy("session_id")
            .agg(F.max(context_size()).alias("peak_context_tokens"),
                 F.min(F.when(over, F.col("ts_ms"))).alias("first_long_ms"))
            .withColumn("used_long_context", F.col("peak_context_tokens") > LONG_CONTEXT_TOKENS))


def _running_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Median and number of the earlier positive rewrites of each session, kept in two heaps.

    Rows come sorted by session and time; the heaps go on from batch to batch, so no session is held as a frame.
    """
    session, low, high = None, [], []
    for batch in batches:
        medians, seen = [], []
        for name, value in zip(batch.column("session_id").to_pylist(), batch.column("cache_creation").to_pylist()):
            if name != session:
                session, low, high = name, [], []
            n = len(low) + len(high)
            seen.append(n)
            if n == 0:
                medians.append(None)
            else:
                medians.append(float(-low[0]) if n % 2 else (high[0] - low[0]) / 2.0)
            if value > 0:
                heapq.heappush(high, -heapq.heappushpop(low, -value))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(medians, pa.float64()), pa.array(seen, pa.int64())],
                                         names=[*batch.schema.names, "median", "earlier"])


def _with_running_median(rows: DataFrame) -> DataFrame:
    """Add ``median`` and ``earlier`` (count) over the earlier positive rewrites of the session, in one sorted pass."""
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "ord")
    schema = T.StructType([*rows.schema.fields, T.StructField("median", T.DoubleType()), T.StructField("earlier", T.LongType())])
    return ordered.mapInArrow(_running_medians, schema)


def flush_events(turns: DataFrame, session_ttl: DataFrame | None = None, compactions: DataFrame | None = None) -> DataFrame:
    """Turns that rewrote the cache: one row each with ``kind`` gap / nogap.

    ``session_ttl`` (session_id, has_1h) overrides the per-session TTL choice, as needed after sub-agent spend has
    been added; ``compactions`` (session_id, ts_ms) excuses nearby rewrites.
    """
    calls = turns.where((F.col("output_tokens") > 0) & F.col("ts_ms").isNotNull()).select(
        "session_id", "ord", "ts_ms", "cache_read", "cache_creation", "cache_1h")
    marked = with_previous(calls, ["session_id"], "ts_ms", ["ord"], ["ts_ms", "cache_read"])
    warm = (F.col("cache_read") > F.col("cache_creation")) & (F.col("cache_read") > 0)
    facts = (calls.groupBy("session_id")
             .agg(F.count(F.lit(1)).alias("n_turns"), (F.max("cache_1h") > 0).alias("has_1h"),
                  F.min(F.when(warm, F.struct("ts_ms", "ord"))).alias("built")))
    if session_ttl is not None:
        facts = (facts.drop("has_1h").join(session_ttl.select("session_id", "has_1h"), "session_id", "left")
                 .withColumn("has_1h", F.coalesce("has_1h", F.lit(False))))
    rows = (marked.join(facts.where((F.col("n_turns") >= 3) & F.col("built").isNotNull()), "session_id")
            .where(F.struct("ts_ms", "ord") > F.col("built")))
    gap = F.col("ts_ms") - F.col("prev.ts_ms")
    rows = _with_running_median(rows.select("session_id", "ts_ms", "ord", "cache_read", "cache_creation", "has_1h", gap.alias("gap"),
                                            F.col("prev.cache_read").alias("read_before")))

    enough = F.col("earlier") + F.when(F.col("cache_creation") > 0, 1).otherwise(0) >= 3
    rewrite = F.col("cache_creation") > 2 * F.greatest(F.coalesce("median", F.lit(0.0)),
                                                      F.lit(float(REWRITE_FLOOR_TOKENS)))
    ttl = F.when(F.col("has_1h"), CACHE_TTL_1H_MS).otherwise(CACHE_TTL_MS)
    collapse = (F.col("read_before") > 0) & (F.col("cache_read") < 0.5 * F.col("read_before"))
    events = rows.where(enough & rewrite).select(
        "session_id", "ts_ms", "ord", "cache_creation",
        F.when(F.col("gap") >= ttl, "gap").when(collapse, "nogap").alias("kind")).where(F.col("kind").isNotNull())
    if compactions is None:
        return events
    # A compaction excuses rewrites less than two minutes away: join on the minute-pair cell and its neighbours.
    width = COMPACTION_NEAR_MS
    marks = compactions.select("session_id", F.col("ts_ms").alias("_c"), F.explode(F.array(
        *[F.floor(F.col("ts_ms") / width) + d for d in (-1, 0, 1)])).alias("_cell"))
    near = (events.where(F.col("kind") == "nogap").withColumn("_cell", F.floor(F.col("ts_ms") / width))
            .join(marks, ["session_id", "_cell"]).where(F.abs(F.col("ts_ms") - F.col("_c")) < width)
            .select("session_id", "ord").distinct())
    return events.join(near.withColumn("_near", F.lit(True)), ["session_id", "ord"], "left").where(
        F.col("_near").isNull() | (F.col("kind") == "gap")).drop("_near")


def cache_flushes(turns: DataFrame, **options) -> DataFrame:
    """Gap flushes, no-gap flushes and rewritten tokens per session that has any turn."""
    is_nogap = F.col("kind") == "nogap"
    counts = flush_events(turns, **options).groupBy("session_id").agg(
        F.count_if(F.col("kind") == "gap").alias("gap_flushes"), F.count_if(is_nogap).alias("nogap_flushes"),
        F.sum(F.when(is_nogap, F.col("cache_creation")).otherwise(0)).alias("nogap_rewrite_tokens"))
    sessions = turns.select("session_id").distinct()
    names = ("gap_flushes", "nogap_flushes", "nogap_rewrite_tokens")
    return sessions.join(counts, "session_id", "left").select(
        "session_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def idle_gaps(turns: DataFrame) -> DataFrame:
    """Gap classes and the cache rewrites that long idle times cost; sessions with at least two turns.

    The baseline is a median per session over token counts; equal counts are merged map-side first, so a
    session's value table is bounded by the context size and not by its number of turns.
    """
    calls = turns.where((F.col("output_tokens") > 0) & F.col("ts_ms").isNotNull()).select(
        "session_id", "ord", "ts_ms", F.col("cache_creation").alias("cc"))
    gap = F.col("ts_ms") - F.col("prev.ts_ms")
    kind = (F.when(gap.isNull(), "first").when(gap < SHORT_GAP_MS, "short")
            .when(gap < MID_GAP_MS, "mid").otherwise("long"))
    values = (with_previous(calls, ["session_id"], "ts_ms", ["ord"], ["ts_ms"])
              .groupBy("session_id", kind.alias("kind"), "cc").agg(F.count(F.lit(1)).alias("c")))

    short_cc = F.when(F.col("kind") == "short", F.col("cc"))
    positive_cc = F.when(F.col("cc") > 0, F.col("cc"))
    stats = values.groupBy("session_id").agg(
        F.sum("c").alias("n"), F.sum(F.col("cc") * F.col("c")).alias("total_cc"),
        F.percentile(short_cc, F.lit(0.5), F.col("c")).alias("short_median"),
        F.percentile(positive_cc, F.lit(0.5), F.col("c")).alias("positive_median"))
    baseline = F.floor(F.coalesce("short_median", "positive_median", F.lit(0.0))).cast("long")
    stats = stats.where(F.col("n") >= 2).withColumn("baseline_tokens", baseline)
    joined = values.join(stats.select("session_id", "baseline_tokens", "total_cc"), "session_id")

    def over(kind_name: str, expr: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind_name, expr).otherwise(0))

    excess = F.greatest(F.lit(0), F.col("cc") - F.col("baseline_tokens")) * F.col("c")
    out = joined.groupBy("session_id").agg(
        *[over(k, F.col("c")).alias(f"{k}_count") for k in ("short", "mid", "long")],
        *[over(k, F.col("cc") * F.col("c")).alias(f"{k}_tokens") for k in ("short", "mid", "long")],
        F.sum(F.when(F.col("kind").isin("mid", "long"), excess).otherwise(0)).alias("overspend_tokens"),
        F.max("baseline_tokens").alias("baseline_tokens"), F.max("total_cc").alias("_total"))
    pct = F.rint(safe_ratio(F.col("overspend_tokens") * 100, F.col("_total"))).cast("long")
    return out.withColumn("overspend_pct", pct).drop("_total")


def idle_gap_aggregate(gaps: DataFrame, flushes: DataFrame) -> DataFrame:
    """Overspend and no-gap rewrites over the selected sessions, in tokens and USD."""
    joined = gaps.select("session_id", "overspend_tokens").join(
        flushes.select("session_id", "nogap_flushes", "nogap_rewrite_tokens"), "session_id", "full")
    totals = joined.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                          for c in ("overspend_tokens", "nogap_flushes", "nogap_rewrite_tokens")],
                        F.count_if(F.col("overspend_tokens") > 0).alias("sessions_with_overspend"))

    def money(tokens: str) -> Column:
        return half_even(F.col(tokens) * REWRITE_USD_PER_M / 1e6, 2)

    return totals.select("overspend_tokens", money("overspend_tokens").alias("overspend_usd"),
                         "sessions_with_overspend", "nogap_flushes", "nogap_rewrite_tokens",
                         money("nogap_rewrite_tokens").alias("nogap_rewrite_usd"))


def cache_efficiency(totals: DataFrame) -> DataFrame:
    """Cache-read share in percent with a band; NULL without input."""
    into = F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")
    pct = safe_ratio(F.col("cache_read"), into, None) * 100
    band = F.when(pct.isNull(), "none").when(pct >= 80, "good").when(pct >= 50, "fair").otherwise("poor")
    return totals.withColumn("cache_eff", half_even(pct, 1)).withColumn("band", band)


def task_counts(tasks: DataFrame, sessions: DataFrame, cutoff=None) -> DataFrame:
    """Task status counts. Tasks are dated by their session; undated ones count in the all-time view only."""
    dated = tasks.join(sessions.select("session_id", "date"), "session_id", "left")
    if cutoff is not None:
        dated = dated.where(F.col("date") >= F.lit(cutoff))
    return dated.agg(F.count(F.lit(1)).alias("total"),
                     *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "in_progress", "pending")])

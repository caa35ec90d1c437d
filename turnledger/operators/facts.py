"""Per-session and per-session-day facts.

The grain ``session x day x model`` (``slices``) is computed once with a map-side-combined aggregation; time series,
roll-ups, filters and plan facts all re-aggregate it. Prices are joined after aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.config import EngineConfig
from turnledger.functions.pricing import clamped_1h, cost_nano, with_prices
from turnledger.functions.scalars import day_text, local_hour, local_weekday, utc_day

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "write_1h", "cache_1h")
SESSION_KEYS = ("session_id", "source", "project")


def _slice_aggregates():
    is_call = F.col("output_tokens") > 0
    sums = [F.coalesce(F.sum(F.when(is_call, F.col(c))), F.lit(0)).alias(c) for c in TOKEN_COLUMNS]
    return [F.count(F.lit(1)).alias("messages"), F.count_if(is_call).alias("calls"), *sums]


def row_slices(turns: DataFrame) -> DataFrame:
    """Dated turns in the shape of slices without grouping, for facts below which no session is needed."""
    is_call = F.col("output_tokens") > 0
    t = turns.where(F.col("ts_ms").isNotNull()).withColumn("write_1h", clamped_1h())
    return t.select(*SESSION_KEYS, utc_day("ts_ms").alias("day"), "model", F.lit(1).cast("long").alias("messages"),
                    is_call.cast("long").alias("calls"),
                    *[F.when(is_call, F.col(c)).otherwise(0).cast("long").alias(c) for c in TOKEN_COLUMNS])


def slices(turns: DataFrame, has_undated: bool = False) -> DataFrame:
    """Messages, calls and token sums per session, day and raw model.

    A call counts towards usage only with output tokens; every row counts as a message. Rows without a parseable
    timestamp go to the start day of their session, so day values add up to session totals by construction.
    """
    turns = turns.withColumn("write_1h", clamped_1h())
    dated = turns.where(F.col("ts_ms").isNotNull()).withColumn("day", utc_day("ts_ms"))
    rows = dated
    if has_undated:
        starts = (turns.groupBy("session_id").agg(F.min("ts_ms").alias("_start"))
                  .where(F.col("_start").isNotNull()).select("session_id", utc_day("_start").alias("day")))
        rows = dated.unionByName(turns.where(F.col("ts_ms").isNull()).join(starts, "session_id"))
    return rows.groupBy(*SESSION_KEYS, "day", "model").agg(*_slice_aggregates())


def priced(df: DataFrame) -> DataFrame:
    """Attach display name and exact cost to rows that hold token sums of one raw model."""
    return with_prices(df).withColumn("cost_nusd", cost_nano())


def session_day_split(day_slices: DataFrame) -> DataFrame:
    """Spend, tokens and messages of each session on each of its active days."""
    return (priced(day_slices).groupBy("session_id", "day")
            .agg(F.sum("messages").alias("messages"), F.sum("calls").alias("calls"),
                 F.sum("cost_nusd").alias("cost_nusd"), F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read").alias("cache_read"),
                 F.sum("cache_creation").alias("cache_creation")))


def session_spans(turns: DataFrame) -> DataFrame:
    """Start, end and duration; sessions without any timestamp drop out."""
    return (turns.where(F.col("ts_ms").isNotNull()).groupBy("session_id")
            .agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
            .withColumn("date", utc_day("start_ms"))
            .withColumn("duration_min", F.rint((F.col("end_ms") - F.col("start_ms")) / 6000.0) / 10.0))


def session_models(turns: DataFrame) -> DataFrame:
    """Usage totals per session and raw model, with the position of the model's first call."""
    turns = turns.withColumn("write_1h", clamped_1h()).where(F.col("output_tokens") > 0)
    return (turns.groupBy("session_id", "model")
            .agg(F.count(F.lit(1)).alias("calls"), F.min("ord").alias("first_ord"),
                 *[F.sum(c).alias(c) for c in TOKEN_COLUMNS]))


def primary_models(model_totals: DataFrame) -> DataFrame:
    """Raw model with the most output tokens per session; the first one used wins ties."""
    best = F.max_by("model", F.struct(F.col("output_tokens"), -F.col("first_ord")))
    chosen = (model_totals.groupBy("session_id").agg(best.alias("model"),
                                                     F.max("output_tokens").alias("output_tokens")))
    return with_prices(chosen).select("session_id", F.col("display").alias("primary_model"), "output_tokens")


def session_facts(turns: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per session from two aggregations: (session, day, model), then session.

    Both are combined map-side, so a hot session is spread over its days and models before its own group forms.
    """
    keyed = turns.withColumn("write_1h", clamped_1h()).withColumn("day", utc_day("ts_ms"))
    fine = keyed.groupBy(*SESSION_KEYS, "day", "model").agg(
        *_slice_aggregates(), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
        F.sum(F.when(F.col("output_tokens") > 0, F.size("tools"))).alias("tool_calls"),
        F.min(F.when(F.col("output_tokens") > 0, F.col("ord"))).alias("first_ord"))
    by_model = priced(fine).groupBy(*SESSION_KEYS, "display").agg(
        *[F.sum(c).alias(c) for c in ("messages", "calls", "cost_nusd", "input_tokens", "output_tokens",
                                      "cache_read", "cache_creation", "cache_1h", "tool_calls")],
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("first_ord").alias("first_ord"),
        F.collect_set("day").alias("days"))
    best = F.max_by(F.when(F.col("output_tokens") > 0, F.col("display")),
                    F.struct(F.col("output_tokens"), -F.col("first_ord")))
    out = by_model.groupBy(*SESSION_KEYS).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        *[F.sum(c).alias(c) for c in ("messages", "calls", "cost_nusd", "input_tokens", "output_tokens",
                                      "cache_read", "cache_creation", "cache_1h")],
        F.coalesce(F.sum("tool_calls"), F.lit(0)).alias("tool_calls"),
        F.coalesce(best, F.lit("Unknown")).alias("primary_model"),
        F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("active_days"))
    return (out.where(F.col("start_ms").isNotNull())
            .withColumn("date", utc_day("start_ms"))
            .withColumn("end_date", utc_day("end_ms"))
            .withColumn("duration_min", F.rint((F.col("end_ms") - F.col("start_ms")) / 6000.0) / 10.0))


def hour_weekday_histograms(messages: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Messages per session, local hour and local weekday."""
    return (messages.where(F.col("ts_ms").isNotNull())
            .groupBy("session_id", local_hour("ts_ms", cfg.local_tz).alias("hour"),
                     local_weekday("ts_ms", cfg.local_tz).alias("weekday"))
            .agg(F.count(F.lit(1)).alias("messages")))


def per_day_maps(day_slices: DataFrame) -> DataFrame:
    """Serving form of the day split: a map per session, only for sessions active on more than one day."""
    split = session_day_split(day_slices)
    entry = F.struct(day_text("day").alias("key"),
                     F.struct("messages", "cost_nusd", "input_tokens", "output_tokens").alias("value"))
    return (split.groupBy("session_id").agg(F.count(F.lit(1)).alias("active_days"),
                                            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_day"))
            .where(F.col("active_days") > 1))

"""Ledger queries: series, roll-ups, sessions, anomalies, limit windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnledger.config import EngineConfig
from turnledger.functions import classify
from turnledger.functions.pricing import price_calls, pricing_warnings
from turnledger.functions.scalars import day_text, half_even, iso_utc, usd, utc_day
from turnledger.operators import anomalies, attribution, facts, limits, series
from turnledger.session import materialize
from turnledger.sources import tables

AS_OF = dt.date(2024, 1, 31)
CFG = EngineConfig(as_of=AS_OF)
MODELS = ["Haiku 4.5", "Nova 9", "Opus 4.8", "Sonnet 4.6"]


def ledger(spark, sf):
    return tables.usage_ledger(spark, sf)


def busy_ledger(spark, sf):
    return tables.usage_ledger(spark, sf, busy=True)


def day_slices(spark, sf):
    return facts.slices(ledger(spark, sf))


def day_rows(spark, sf):
    """Slices at row level, for facts by day and model."""
    return facts.row_slices(ledger(spark, sf))


def one_account(df):
    """The single-account case: one constant key for the whole series."""
    return df.withColumn("account", F.lit("all"))


def texted(df, *columns):
    """Dates as text, so that result hashes do not depend on a driver's date type."""
    return df.select(*[day_text(c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def daily_cost_by_model(spark, sf):
    return texted(series.daily_cost_by_model(day_rows(spark, sf), MODELS), "day")


def daily_tokens_by_model(spark, sf):
    return texted(series.daily_tokens_by_model(day_rows(spark, sf), MODELS), "day")


def cumulative_cost(spark, sf):
    return texted(series.cumulative_cost(day_rows(spark, sf)), "day")


def daily_messages_sessions(spark, sf):
    return texted(series.daily_messages_sessions(day_slices(spark, sf)), "day")


def cache_efficiency_boxplot(spark, sf):
    return texted(series.cache_efficiency_boxplot(day_slices(spark, sf), CFG), "day")


def cache_efficiency_outliers(spark, sf):
    return texted(series.cache_efficiency_outliers(day_slices(spark, sf), CFG), "day")


def hourly_distribution(spark, sf):
    return series.hourly_distribution(ledger(spark, sf), CFG)


def weekday_distribution(spark, sf):
    return series.weekday_distribution(ledger(spark, sf), CFG)


def session_histograms(spark, sf):
    return facts.hour_weekday_histograms(ledger(spark, sf), CFG)


def project_rollup(spark, sf):
    return series.project_rollup(day_slices(spark, sf))


def model_rollup(spark, sf):
    return series.model_rollup(day_rows(spark, sf))


def cost_by_token_type(spark, sf):
    return series.cost_by_token_type(day_rows(spark, sf))


def cache_savings(spark, sf):
    return series.cache_savings(day_rows(spark, sf))


def pricing_warning_list(spark, sf):
    return pricing_warnings(ledger(spark, sf))


def kpi_totals(spark, sf):
    return series.kpi_totals(day_slices(spark, sf))


def kpi_derived(spark, sf):
    return series.kpi_derived(series.session_totals(day_slices(spark, sf)), F.lit(2640.0))


def rollup_sets(spark, sf):
    return series.rollup_sets(day_slices(spark, sf))


def tool_ranking(spark, sf):
    names = ledger(spark, sf).select(F.explode("tools").alias("name"))
    return series.name_ranking(names)


def top_n_tools(spark, sf):
    turns = price_calls(busy_ledger(spark, sf))
    return series.top_tools_with_reasoning(attribution.tool_tokens(turns), attribution.reasoning_totals(turns), 3)


def _classified_errors(spark, sf):
    errors = tables.tool_errors(spark, sf)
    out = errors.withColumn("c", classify.tool_error_class(F.col("message"), F.col("tool")))
    return out.select("event_id", "account", "ts_ms", "tool", "message", "c.source", "c.category",
                      classify.error_account(F.col("c.source"), F.col("c.category")).alias("counted_as"))


def tool_error_classification(spark, sf):
    return _classified_errors(spark, sf).select("event_id", "tool", "source", "category",
                                                F.coalesce("counted_as", F.lit("")).alias("counted_as"))


def error_summary(spark, sf):
    """Counts by source, tool and category of everything that counts as an error."""
    errors = _classified_errors(spark, sf).where(F.col("counted_as").isNotNull())
    grouped = (errors.groupingSets([["counted_as"], ["tool"], ["category"]], "counted_as", "tool", "category")
               .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("count")))
    kind = F.when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "tool").otherwise("category")
    return grouped.select(kind.alias("dimension"), F.coalesce("counted_as", "tool", "category").alias("name"), "count")


def error_totals(spark, sf):
    errors = _classified_errors(spark, sf).agg(
        F.count("counted_as").alias("total_errors"), F.count_if(F.col("category") == "cancelled").alias("cancelled"),
        F.count_if(F.col("category") == "rejected").alias("rejected"), F.lit(1).alias("one"))
    calls = ledger(spark, sf).agg(F.sum(F.size("tools")).alias("tool_calls"), F.lit(1).alias("one"))
    rate = half_even(F.col("total_errors") / F.greatest(F.col("tool_calls"), F.lit(1)) * 100, 2)
    return errors.join(calls, "one").select("total_errors", "tool_calls", "cancelled", "rejected",
                                            rate.alias("error_rate"))


def daily_error_rate(spark, sf):
    errors = (_classified_errors(spark, sf).where(F.col("counted_as").isNotNull())
              .groupBy(utc_day("ts_ms").alias("day")).agg(F.count(F.lit(1)).alias("errors")))
    calls = ledger(spark, sf).groupBy(utc_day("ts_ms").alias("day")).agg(F.sum(F.size("tools")).alias("calls"))
    return texted(series.daily_rate(errors, calls), "day")


def activity_calendar(spark, sf):
    daily = series.daily_messages_sessions(day_slices(spark, sf))
    return texted(series.activity_calendar(daily, AS_OF), "day")


def session_facts(spark, sf):
    out = facts.session_facts(ledger(spark, sf), CFG)
    return texted(out.withColumn("cost", usd("cost_nusd", 4)), "date", "end_date")


def session_primary_model(spark, sf):
    return facts.primary_models(facts.session_models(ledger(spark, sf)))


def session_model_breakdown(spark, sf):
    by_model = facts.priced(facts.session_models(ledger(spark, sf)))
    sums = ("calls", "input_tokens", "output_tokens", "cache_read", "cost_nusd")
    return by_model.groupBy("session_id", F.col("display").alias("model")).agg(*[F.sum(c).alias(c) for c in sums])


def session_day_split(spark, sf):
    return texted(facts.session_day_split(day_slices(spark, sf)), "day")


def session_spans(spark, sf):
    return texted(facts.session_spans(ledger(spark, sf)), "date")


def entry_classification(spark, sf):
    entries = tables.chat_entries(spark, sf).where(F.col("type") == "user")
    category = classify.user_entry_category(F.col("text"), F.lit(False), F.col("is_meta"), F.lit(False))
    return entries.select("session_id", "ord", category.alias("category"))


def message_counters(spark, sf):
    category = classify.user_entry_category(F.col("text"), F.lit(False), F.col("is_meta"), F.lit(False))
    e = tables.chat_entries(spark, sf).withColumn(
        "category", F.when(F.col("type") == "assistant", "assistant").otherwise(category))
    names = ("prompt", "command", "interrupt", "meta", "assistant")
    return e.groupBy("session_id").agg(
        *[F.count_if(F.col("category") == n).alias(n) for n in names],
        F.count_if(F.col("category").isin("prompt", "assistant")).alias("messages"))


def first_prompts(spark, sf):
    e = tables.chat_entries(spark, sf).where((F.col("type") == "user") & (F.col("text") != ""))
    plain = ~classify.is_command_text(F.col("text")) & ~F.col("text").startswith(classify.INTERRUPT_PREFIX)
    return (e.where(plain).groupBy("session_id")
            .agg(F.min_by(F.substring("text", 1, 200), "ord").alias("first_prompt")))


def command_label(spark, sf):
    e = tables.chat_entries(spark, sf).where(F.col("type") == "user")
    return e.select("session_id", "ord", classify.command_label(F.col("text")).alias("label")).where(
        F.col("label") != "")


def api_error_classification(spark, sf):
    e = tables.backend_errors(spark, sf)
    return e.select("event_id", classify.backend_error_category(F.col("text")).alias("category"),
                    classify.plan_limit_text(F.col("text")).alias("is_plan_limit"))


def error_text_clean(spark, sf):
    docs = tables.spread(tables.table(spark, sf, "documents").select("doc_id", "text"))
    raw = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\r\n \t"))
    clean = classify.clean_error_text(raw)
    return docs.select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest"),
                       F.substring(clean, 1, 200).alias("message"))


def model_display(spark, sf):
    from turnledger.functions.pricing import with_prices

    ids = ledger(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    return with_prices(ids).select("model", "display", "priced", "p_input", "p_output", "p_read", "p_write_5m",
                                   "p_write_1h", "calls")


def call_costs(spark, sf):
    return price_calls(busy_ledger(spark, sf)).select("ord", "display", "cost_nusd")


def tool_token_attribution(spark, sf):
    turns = price_calls(busy_ledger(spark, sf))
    return attribution.tool_tokens(turns)


def session_tool_tokens(spark, sf):
    turns = price_calls(busy_ledger(spark, sf))
    return attribution.tool_tokens(turns, ["session_id"])


def reasoning_totals(spark, sf):
    turns = price_calls(ledger(spark, sf))
    return attribution.reasoning_totals(turns, ["project"])


def cache_flushes(spark, sf):
    return anomalies.cache_flushes(ledger(spark, sf))


def daily_flushes(spark, sf):
    turns = ledger(spark, sf)
    starts = facts.session_spans(turns).select("session_id", "date")
    counts = anomalies.cache_flushes(turns).where((F.col("gap_flushes") > 0) | (F.col("nogap_flushes") > 0))
    out = counts.join(starts, "session_id").groupBy("date").agg(
        F.sum("gap_flushes").alias("gap"), F.sum("nogap_flushes").alias("nogap"))
    return texted(out, "date")


def idle_gaps(spark, sf):
    return anomalies.idle_gaps(ledger(spark, sf))


def idle_gap_aggregate(spark, sf):
    turns = ledger(spark, sf)
    return anomalies.idle_gap_aggregate(anomalies.idle_gaps(turns), anomalies.cache_flushes(turns))


def long_context(spark, sf):
    out = anomalies.long_context(ledger(spark, sf))
    return out.select("session_id", "peak_context_tokens", "used_long_context",
                      F.coalesce(iso_utc("first_long_ms"), F.lit("")).alias("first_long_at"))


def turn_context_flags(spark, sf):
    size = anomalies.context_size()
    return ledger(spark, sf).select("ord", size.alias("context_tokens"),
                                    (size > anomalies.LONG_CONTEXT_TOKENS).alias("is_long"))


def cache_efficiency_bands(spark, sf):
    out = anomalies.cache_efficiency(series.session_totals(day_slices(spark, sf)))
    return out.select("session_id", F.coalesce("cache_eff", F.lit(-1.0)).alias("cache_eff"), "band")


def task_counts(spark, sf):
    """Error and purchase events stand for tasks of the session they fall into."""
    turns = ledger(spark, sf)
    status = F.when(F.col("k") % 3 == 0, "completed").when(F.col("k") % 3 == 1, "in_progress").otherwise("pending")
    tasks = turns.where(F.col("event_type").isin("error", "purchase")).select("session_id", status.alias("status"))
    return anomalies.task_counts(tasks, facts.session_spans(turns), dt.date(2024, 1, 16))


def windows_5h(spark, sf):
    return limits.windows_5h(busy_ledger(spark, sf))


def windows_5h_single_account(spark, sf):
    return limits.windows_5h(one_account(busy_ledger(spark, sf)))


def weekly_buckets(spark, sf):
    return texted(limits.weekly_buckets(busy_ledger(spark, sf), 1), "week")


def _limit_events(spark, sf):
    turns = one_account(ledger(spark, sf))
    none = F.lit(None).cast("long")
    explicit = turns.where(F.col("event_type") == "error").select(
        "account", "session_id", "ord", "ts_ms", none.alias("gap_start_ms"), none.alias("gap_end_ms"),
        F.lit("explicit").alias("type"), F.lit("user_plan_limit").alias("subtype"), F.lit("high").alias("confidence"))
    return explicit


def limit_event_clusters(spark, sf):
    out = limits.cluster_events(_limit_events(spark, sf), ["session_id", "ord", "ts_ms", "subtype"], ["ord"])
    return out.drop("cluster_ms")


def limit_fingerprints(spark, sf):
    out = limits.fingerprints(ledger(spark, sf), CFG.local_tz)
    return out.select("account", "session_id", "ts_ms", "gap_start_ms", "confidence")


def _windows_with_hits(spark, sf, plan_history):
    from turnledger.plans import accounts

    clusters = limits.cluster_events(_limit_events(spark, sf), ["session_id", "ord", "ts_ms", "gap_start_ms",
                                                               "gap_end_ms", "type", "subtype"], ["ord"])
    return accounts.windows_with_hits(one_account(busy_ledger(spark, sf)), clusters.drop("cluster_ms", "last_ms"), plan_history)


def limit_event_window_match(spark, sf):
    turns = one_account(ledger(spark, sf))
    clusters = limits.cluster_events(_limit_events(spark, sf), ["session_id", "ord", "ts_ms", "gap_start_ms",
                                                               "subtype"], ["ord"])
    out = limits.event_windows(clusters, limits.window_starts(turns))
    return out.select("ord", "ts_ms", F.coalesce("start_ms", F.lit(-1)).alias("start_ms"))


QUERIES = {f.__name__: f for f in (
    daily_cost_by_model, daily_tokens_by_model, cumulative_cost, daily_messages_sessions, cache_efficiency_boxplot,
    cache_efficiency_outliers, hourly_distribution, weekday_distribution, session_histograms, project_rollup,
    model_rollup, cost_by_token_type, cache_savings, kpi_totals, kpi_derived, rollup_sets, tool_ranking, top_n_tools,
    tool_error_classification, error_summary, error_totals, daily_error_rate, activity_calendar, session_facts,
    session_primary_model, session_model_breakdown, session_day_split, session_spans, entry_classification,
    message_counters, first_prompts, command_label, api_error_classification, error_text_clean, model_display,
    call_costs, tool_token_attribution, session_tool_tokens, reasoning_totals, cache_flushes, daily_flushes,
    idle_gaps, idle_gap_aggregate, long_context, turn_context_flags, cache_efficiency_bands, task_counts, windows_5h,
    windows_5h_single_account, weekly_buckets, limit_event_clusters, limit_fingerprints, limit_event_window_match)}
QUERIES["pricing_warnings"] = pricing_warning_list

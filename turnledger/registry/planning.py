"""Plan, filter and table queries over the ledger and the orders table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnledger.config import EngineConfig, PlanPeriod
from turnledger.functions.scalars import usd, utc_day
from turnledger.operators import facts, filters, limits, series
from turnledger.plans import accounts, billing
from turnledger.registry import usage
from turnledger.registry.transcripts import silver
from turnledger.registry.usage import AS_OF, MODELS, ledger, one_account, texted
from turnledger.sources import tables

PLAN_HISTORY = (
    PlanPeriod("Pro", dt.date(2023, 12, 31), dt.date(2024, 1, 9), 20.0, 18.0, "€", 31, "monthly"),
    PlanPeriod("Max 5x", dt.date(2024, 1, 10), dt.date(2024, 1, 19), 100.0, 92.0, "€", 10, "monthly"),
    PlanPeriod("Max 20x", dt.date(2024, 1, 20), None, 2400.0, None, None, 20, "annual"),
)
CFG = EngineConfig(as_of=AS_OF, plan_history=PLAN_HISTORY)
ORDERS_AS_OF = dt.date(2001, 1, 1)


# ---- plan history per customer, from the orders table -------------------------------------------------------------

def _orders(spark, sf):
    return tables.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day"), "o_totalprice")


def _customer_plans(spark, sf):
    """One plan period per customer: from the first to the last order, open for every fourth customer."""
    c = F.col("account")
    spans = _orders(spark, sf).groupBy("account").agg(F.min("day").alias("start"), F.max("day").alias("last"))
    return spans.select(
        "account", F.lit(0).alias("plan_ord"), F.concat(F.lit("Plan "), (c % 3).cast("string")).alias("plan"), "start",
        F.when(c % 4 != 0, F.col("last")).alias("end"), (c % 50 + 10).cast("double").alias("cost_usd"),
        F.when(c % 2 == 0, (c % 50 + 10) * 0.9).alias("cost_local"), F.lit("€").alias("currency_symbol"),
        F.when(c % 11 != 0, (c % 7 + 25).cast("int")).alias("billing_day"),
        F.when(c % 5 == 0, "annual").otherwise("monthly").alias("billing_cycle"))


def billing_cycles(spark, sf):
    out = billing.billing_cycles(_customer_plans(spark, sf), ORDERS_AS_OF)
    out = out.withColumn("cost_usd", F.rint(F.col("cost_usd") * 1e4) / 1e4)
    return texted(out.drop("plan_ord", "cost_local", "currency_symbol"), "cycle_start", "cycle_end")


def customer_plan_periods(spark, sf):
    daily = _orders(spark, sf).groupBy("account", "day").agg(
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("long") * 10_000_000).alias("cost_nusd"),
        F.count(F.lit(1)).alias("sessions"))
    use = daily.select("account", "day", "sessions", (F.col("sessions") * 3).alias("messages"))
    cycles = billing.billing_cycles(_customer_plans(spark, sf), ORDERS_AS_OF)
    out = billing.plan_periods(cycles, daily.select("account", "day", "cost_nusd"), use,
                               EngineConfig(as_of=ORDERS_AS_OF))
    keep = ("account", "cycle_ord", "plan", "cycle_start", "cycle_end", "total_days", "days_active", "sessions",
            "messages", "api_cost", "savings", "roi_factor", "cost_per_day")
    return texted(out.select(*keep), "cycle_start", "cycle_end")


# ---- the single-account plan history over the ledger --------------------------------------------------------------

def _daily_cost(spark, sf):
    return one_account(series.daily_cost(usage.day_rows(spark, sf)))


def _session_days(spark, sf):
    totals = series.session_totals(usage.day_slices(spark, sf))
    return one_account(totals.groupBy(F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("sessions"),
                                                                     F.sum("messages").alias("messages")))


def _cycles(spark):
    return billing.billing_cycles(billing.plan_table(spark, PLAN_HISTORY), AS_OF)


def _clusters(spark, sf):
    out = limits.cluster_events(usage._limit_events(spark, sf), ["session_id", "ord", "ts_ms", "gap_start_ms",
                                                               "gap_end_ms", "type", "subtype"], ["ord"])
    return out.withColumn("day", utc_day("ts_ms"))


def _periods(spark, sf):
    return billing.plan_periods(_cycles(spark), _daily_cost(spark, sf), _session_days(spark, sf), CFG,
                                _clusters(spark, sf).select("account", "day"))


def _current(spark, sf):
    return billing.current_billing(_daily_cost(spark, sf), _session_days(spark, sf), CFG)


def _filled(df):
    """Absent values as -1 or empty text, the same way in both engines."""
    cols = []
    for name, kind in df.dtypes:
        if kind == "double":
            cols.append(F.coalesce(name, F.lit(-1.0)).alias(name))
        elif kind in ("int", "bigint"):
            cols.append(F.coalesce(name, F.lit(-1)).cast("long").alias(name))
        elif kind == "date":
            cols.append(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name))
        elif kind == "string":
            cols.append(F.coalesce(name, F.lit("")).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


def plan_periods(spark, sf):
    return _filled(billing.framed_periods(_periods(spark, sf), _current(spark, sf)).drop("plan_ord", "cycle_ord"))


def current_billing(spark, sf):
    return _filled(_current(spark, sf))


def plan_totals(spark, sf):
    return _filled(billing.plan_totals(_periods(spark, sf), PLAN_HISTORY))


def _windows(spark, sf):
    return usage._windows_with_hits(spark, sf, PLAN_HISTORY)


def tier_caps(spark, sf):
    return limits.tier_caps(_windows(spark, sf))


def tier_caps_override(spark, sf):
    return limits.tier_caps(_windows(spark, sf), 7.5)


def _hits(spark, sf):
    return accounts.hits_on_cycles(_windows(spark, sf), one_account(ledger(spark, sf)), _cycles(spark), CFG.anchor_weekday)


def tier_hits_by_cycle(spark, sf):
    by_window, by_week = _hits(spark, sf)
    return by_window.join(by_week, billing.CYCLE_KEYS, "left")


def _rec_cycles(spark, sf):
    return billing.recommendation_cycles(_periods(spark, sf), *_hits(spark, sf))


def plan_recommendation(spark, sf):
    out = billing.recommend_tier(_rec_cycles(spark, sf))
    return _filled(out.withColumn("current_tier", billing.current_tier(PLAN_HISTORY)))


def switch_hints(spark, sf):
    cycles = _rec_cycles(spark, sf)
    out = billing.switch_hints(cycles, billing.recommend_tier(cycles))
    out = out.withColumn("severity_pro", billing.severity(F.col("hits_pro")))
    keep = ("cycle_start", "label", "active_tier", "recommended_tier", "switch_hint", "severity_pro", "windows", "weeks")
    return _filled(out.select(*keep))


def plan_display_facts(spark, sf):
    return billing.display_facts(_periods(spark, sf), _current(spark, sf))


def limit_event_positions(spark, sf):
    events = _clusters(spark, sf).select("account", "ord", "ts_ms", "day")
    out = billing.event_positions(events, _cycles(spark))
    return texted(out.select("ord", "cycle_start", "position_pct"), "cycle_start")


def _spans(spark, sf):
    return billing.paid_spans(_periods(spark, sf), _current(spark, sf))


def plan_cost_prorated(spark, sf):
    days = _daily_cost(spark, sf).where(F.col("day") >= F.lit(filters.Filters(days=17).cutoff(AS_OF)))
    ranges = days.groupBy("account").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"))
    return billing.prorated_cost(_spans(spark, sf), ranges)


def fx_converted_cumulative(spark, sf):
    out = billing.cumulative_local(_daily_cost(spark, sf), _spans(spark, sf))
    return texted(out, "day")


# ---- the same from transcripts ------------------------------------------------------------------------------------

def _account(spark, sf):
    return accounts.account_usage(silver(spark, sf), F.lit("all"))


def _account_windows(use):
    return accounts.windows_with_hits(use.turns, use.events.drop("cluster_ms", "last_ms"), PLAN_HISTORY)


def transcript_tier_caps(spark, sf):
    return limits.tier_caps(_account_windows(_account(spark, sf)))


def transcript_tier_hits(spark, sf):
    use = _account(spark, sf)
    by_window, by_week = accounts.hits_on_cycles(_account_windows(use), use.turns, _cycles(spark), CFG.anchor_weekday)
    return by_window.join(by_week, billing.CYCLE_KEYS, "left")


def _account_periods(spark, use):
    return billing.plan_periods(_cycles(spark), use.daily_cost, use.session_days, CFG, use.events.select("account", "day"))


def transcript_plan_periods(spark, sf):
    use = _account(spark, sf)
    current = billing.current_billing(use.daily_cost, use.session_days, CFG)
    return _filled(billing.framed_periods(_account_periods(spark, use), current).drop("plan_ord", "cycle_ord"))


def transcript_current_billing(spark, sf):
    use = _account(spark, sf)
    return _filled(billing.current_billing(use.daily_cost, use.session_days, CFG))


def transcript_plan_recommendation(spark, sf):
    use = _account(spark, sf)
    hits = accounts.hits_on_cycles(_account_windows(use), use.turns, _cycles(spark), CFG.anchor_weekday)
    out = billing.recommend_tier(billing.recommendation_cycles(_account_periods(spark, use), *hits))
    return _filled(out.withColumn("current_tier", billing.current_tier(PLAN_HISTORY)))


# ---- filters ------------------------------------------------------------------------------------------------------

def session_table(spark, sf):
    """Session facts with the columns the filters and the table use."""
    turns = ledger(spark, sf)
    errors = turns.where(F.col("event_type") == "error").groupBy("session_id").agg(F.count(F.lit(1)).alias("errors"))
    base = facts.session_facts(turns, CFG).join(errors, "session_id", "left")
    return (base.withColumn("errors", F.coalesce("errors", F.lit(0))).withColumn("cost", usd("cost_nusd", 4))
            .withColumn("user_messages", F.col("messages") - F.col("calls"))
            .withColumn("agent_dispatches", F.lit(0).cast("long"))
            .withColumn("first_prompt", F.concat(F.lit("Work on "), "project")))


RANGE = filters.Filters(days=7, project="PROJ1")


def _filtered(spark, sf, f=RANGE):
    sessions = filters.select_sessions(session_table(spark, sf), f, AS_OF)
    return sessions, filters.select_slices(usage.day_slices(spark, sf), sessions, f, AS_OF)


def range_filtered_kpis(spark, sf):
    """Cost on the day-slice basis, counts over the selected sessions."""
    sessions, slices = _filtered(spark, sf)
    cost = facts.priced(slices).agg(usd(F.sum("cost_nusd"), 2).alias("total_cost"), F.lit(1).alias("one"))
    counts = sessions.agg(F.count(F.lit(1)).alias("total_sessions"), F.sum("messages").alias("total_messages"),
                          F.sum("output_tokens").alias("total_output_tokens"),
                          F.sum("input_tokens").alias("total_input_tokens"),
                          F.min("date").cast("string").alias("first_day"),
                          F.max("date").cast("string").alias("last_day"), F.lit(1).alias("one"))
    return cost.join(counts, "one").drop("one")


def range_filtered_daily(spark, sf):
    return texted(series.daily_cost_by_model(_filtered(spark, sf)[1], MODELS), "day")


def range_filtered_messages(spark, sf):
    return texted(series.daily_messages_sessions(_filtered(spark, sf)[1]), "day")


def range_filtered_models(spark, sf):
    sessions, _ = _filtered(spark, sf)
    whole = usage.day_slices(spark, sf).join(sessions.select("session_id"), "session_id", "left_semi")
    return series.model_rollup(whole)


def range_filtered_token_cost(spark, sf):
    """Exact cost by token type of the selected sessions (no scaling by a ratio)."""
    sessions, _ = _filtered(spark, sf)
    whole = usage.day_slices(spark, sf).join(sessions.select("session_id"), "session_id", "left_semi")
    return series.cost_by_token_type(whole)


def range_filtered_hours(spark, sf):
    sessions, _ = _filtered(spark, sf)
    return series.hourly_distribution(
        ledger(spark, sf).join(sessions.select("session_id"), "session_id", "left_semi"), CFG)


def attribute_filter(spark, sf):
    f = filters.Filters(source="src1", text="PROJ", ranges={"cost": (0.5, 30.0), "messages": (8, None),
                                                          "cache_eff": (90, 100)})
    out = filters.select_sessions(session_table(spark, sf), f, AS_OF)
    return out.select("session_id", "project", "messages", "cost_nusd")


def attribute_ranges(spark, sf):
    return filters.attribute_domains(session_table(spark, sf))


def sorted_page(spark, sf):
    out = filters.sorted_page(session_table(spark, sf), "tool_calls", 1, 50)
    return out.select("session_id", "tool_calls", "start_ms")


def sorted_page_cache_eff(spark, sf):
    out = filters.sorted_page(session_table(spark, sf), "cache_eff", 0, 25, True)
    return out.select("session_id", "cache_read", "start_ms")


def anonymized_projects(spark, sf):
    out = filters.anonymized(session_table(spark, sf))
    return out.groupBy("project", "source").agg(F.count(F.lit(1)).alias("sessions"),
                                                F.sum("cost_nusd").alias("cost_nusd"))


def storage_top(spark, sf):
    """Characters per document source and language stand for folder sizes."""
    docs = tables.table(spark, sf, "documents").groupBy(
        F.concat_ws("/", "source", "lang").alias("name")).agg((F.sum("n_chars") / 1000.0).alias("size_mb"))
    return filters.top_with_other(docs.withColumn("size_mb", F.rint(F.col("size_mb") * 100) / 100), "name", "size_mb")


QUERIES = {f.__name__: f for f in (
    billing_cycles, customer_plan_periods, plan_periods, current_billing, plan_totals, tier_caps, tier_caps_override,
    tier_hits_by_cycle, plan_recommendation, switch_hints, plan_display_facts, limit_event_positions,
    transcript_tier_caps, transcript_tier_hits, transcript_plan_periods, transcript_current_billing,
    transcript_plan_recommendation, plan_cost_prorated, fx_converted_cumulative, session_table, range_filtered_kpis, range_filtered_daily,
    range_filtered_messages, range_filtered_models, range_filtered_token_cost, range_filtered_hours, attribute_filter,
    attribute_ranges, sorted_page, sorted_page_cache_eff, anonymized_projects, storage_top)}


def _session_table_text(spark, sf):
    return texted(session_table(spark, sf), "date", "end_date")


QUERIES["session_table"] = _session_table_text

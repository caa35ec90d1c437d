"""What an account used, from transcripts: the turns, limit events and day facts that caps, hits and plans are made of."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.config import PlanPeriod
from turnledger.functions.scalars import utc_day
from turnledger.operators import facts, limits, sessions
from turnledger.plans import billing
from turnledger.session import materialize


@dataclass(frozen=True)
class AccountUsage:
    """``turns`` feed windows and weeks, ``events`` are clustered limit events (with ``day``), ``daily_cost`` (account,
    day, cost_nusd) and ``session_days`` (account, day, sessions, messages) feed plan periods."""

    turns: DataFrame
    events: DataFrame
    daily_cost: DataFrame
    session_days: DataFrame


def account_usage(classified_entries: DataFrame, account: Column, tz: str = "UTC", include_subagents: bool = False) -> AccountUsage:
    """Usage of all sessions by account; ``account`` is an expression over ``source``.

    Turns, prompts and banners of all sessions count, those without a start included. Sub-agents that a parent absorbed
    bring neither, unless ``include_subagents``; their spend is part of the parent's days either way.
    """
    attributes = materialize(sessions.session_attributes(classified_entries), "account-sessions")
    owners = sessions.owner_table(attributes)
    seen = classified_entries if include_subagents else sessions.visible(classified_entries, owners)
    slices = sessions.day_slices(classified_entries, attributes).withColumn("account", account)
    counters = sessions.visible(sessions.message_counters(classified_entries).where(F.col("start_ms").isNotNull()), owners)
    started = counters.join(attributes.select("session_id", "source"), "session_id").withColumn("account", account)
    return AccountUsage(
        sessions.turns(seen).withColumn("account", account),
        limits.transcript_events(seen, account, tz).withColumn("day", utc_day("ts_ms")),
        facts.priced(slices).groupBy("account", "day").agg(F.sum("cost_nusd").alias("cost_nusd")),
        started.groupBy("account", utc_day("start_ms").alias("day")).agg(
            F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages")))


def windows_with_hits(turns: DataFrame, events: DataFrame, plan_history: Sequence[PlanPeriod]) -> DataFrame:
    """Five-hour windows with ``hit`` (holds a limit event) and ``tier`` (plan in force at their start).

    Caps and hits both read the result, whose size elapsed time bounds: starts and windows are written once.
    """
    starts = materialize(limits.window_starts(turns), "starts")
    matched = (limits.event_windows(events, starts).where("start_ms IS NOT NULL")
               .select("account", "start_ms").distinct().withColumn("hit", F.lit(True)))
    windows = limits.windows_5h(turns, starts).join(matched, ["account", "start_ms"], "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False)))
    return materialize(windows.withColumn("tier", billing.active_tier(plan_history, utc_day("start_ms"))), "windows")


def hits_on_cycles(windows: DataFrame, turns: DataFrame, cycles: DataFrame, anchor_weekday: int) -> tuple[DataFrame, DataFrame]:
    """Windows and weeks of every cycle that each tier's cap would have stopped."""
    caps = limits.tier_caps(windows)
    dated = windows.withColumn("day", utc_day("start_ms"))
    weeks = limits.weekly_buckets(turns, anchor_weekday)
    return (limits.tier_hits(billing.on_cycles(dated, cycles, "day"), caps, billing.CYCLE_KEYS),
            limits.weekly_hits(billing.on_cycles(weeks, cycles, "week"), caps, billing.CYCLE_KEYS))

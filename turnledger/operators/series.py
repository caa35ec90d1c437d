"""Daily series, roll-ups, rankings and KPIs over session-day-model slices.

Operators that need days and models only also take ``facts.row_slices``, which skips the session-level shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnledger.config import EngineConfig
from turnledger.functions.pricing import cost_nano, with_prices
from turnledger.functions.scalars import (HOUR_MS, half_even, local_hour, local_weekday, safe_ratio, usd, utc_day)
from turnledger.operators.facts import TOKEN_COLUMNS, priced
from turnledger.operators.ordering import grouped_quantiles


def _sums(*names: str):
    return [F.sum(n).alias(n) for n in names]


def by_model_day(day_slices: DataFrame) -> DataFrame:
    """Day x display: tokens are summed per raw model first, so pricing touches a few rows per day.

    Days on which a model only has messages without output appear with zero cost.
    """
    sums = day_slices.groupBy("day", "model").agg(*_sums("messages", "calls", *TOKEN_COLUMNS))
    return (priced(sums).groupBy("day", "display")
            .agg(*_sums("cost_nusd", "calls", "input_tokens", "output_tokens", "cache_read", "cache_creation")))


def pivot_by_model(day_slices: DataFrame, value: Column, models: list[str], finish=None) -> DataFrame:
    """One column per model (0-filled) and ``total``; ``finish`` is applied to the exact sums."""
    finish = finish or (lambda c: c)
    wide = by_model_day(day_slices).groupBy("day").agg(
        *[F.sum(F.when(F.col("display") == m, value)).alias(m) for m in models], F.sum(value).alias("total"))
    return wide.select("day", *[finish(F.coalesce(F.col(f"`{m}`"), F.lit(0))).alias(m) for m in [*models, "total"]])


def model_names(day_slices: DataFrame) -> list[str]:
    """Display names in use. Bounded by the number of model generations, so the driver may hold them."""
    ids = day_slices.where(F.col("calls") > 0).select("model").distinct()
    return sorted({r.display for r in with_prices(ids).select("display").collect()})


def daily_cost_by_model(day_slices: DataFrame, models: list[str] | None = None) -> DataFrame:
    models = models if models is not None else model_names(day_slices)
    return pivot_by_model(day_slices, F.col("cost_nusd"), models, lambda c: usd(c, 4))


def daily_tokens_by_model(day_slices: DataFrame, models: list[str] | None = None) -> DataFrame:
    models = models if models is not None else model_names(day_slices)
    return pivot_by_model(day_slices, F.col("input_tokens") + F.col("output_tokens"), models,
                          lambda c: c.cast("long"))


def daily_cost(day_slices: DataFrame) -> DataFrame:
    """Exact cost per active day (days with messages only have cost 0)."""
    return by_model_day(day_slices).groupBy("day").agg(*_sums("cost_nusd"))


def cumulative_cost(day_slices: DataFrame) -> DataFrame:
    """Running total; the window runs over one row per calendar day."""
    running = F.sum("cost_nusd").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return daily_cost(day_slices).select("day", usd(running, 2).alias("cost"))


def daily_messages_sessions(day_slices: DataFrame) -> DataFrame:
    """Two steps instead of a distinct count: fold to (session, day), then count."""
    return (day_slices.groupBy("session_id", "day").agg(*_sums("messages"))
            .groupBy("day").agg(F.sum("messages").alias("messages"), F.count(F.lit(1)).alias("sessions")))


def cache_efficiency_points(day_slices: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Cache-read share in percent per session-day slice that has enough messages."""
    per = day_slices.groupBy("session_id", "day").agg(*_sums("messages", "input_tokens", "cache_read",
                                                             "cache_creation"))
    total = F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")
    return (per.where((total > 0) & (F.col("messages") >= cfg.cache_eff_min_messages))
            .select("session_id", "day", (F.col("cache_read") / total * 100).alias("eff")))


def _fences(points: DataFrame) -> DataFrame:
    quantiles = grouped_quantiles(points, ["day"], "eff", {"q1": 0.25, "median": 0.5, "q3": 0.75},
                                  F.floor(F.col("eff") * 100).cast("int"))
    spread = (F.col("q3") - F.col("q1")) * 1.5
    return quantiles.withColumn("lo", F.col("q1") - spread).withColumn("hi", F.col("q3") + spread)


def cache_efficiency_boxplot(day_slices: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Box plot per day: exact quartiles, whiskers at the outermost values inside 1.5 IQR, outlier count."""
    points = cache_efficiency_points(day_slices, cfg)
    fences = _fences(points)
    inside = F.col("eff").between(F.col("lo"), F.col("hi"))
    stats = (points.join(fences.select("day", "lo", "hi"), "day").groupBy("day")
             .agg(F.count(F.lit(1)).alias("sessions"), F.avg("eff").alias("mean"),
                  F.min(F.when(inside, F.col("eff"))).alias("whisker_low"),
                  F.max(F.when(inside, F.col("eff"))).alias("whisker_high"),
                  F.min("eff").alias("min"), F.max("eff").alias("max"), F.count_if(~inside).alias("outliers")))
    out = stats.join(fences.select("day", "q1", "median", "q3"), "day")
    shown = ("mean", "median", "q1", "q3", "whisker_low", "whisker_high", "min", "max")
    return out.select("day", "sessions", *[half_even(F.col(c), 2).alias(c) for c in shown], "outliers")


def cache_efficiency_outliers(day_slices: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The outliers themselves, one row each, so that no day has to fit into one array."""
    points = cache_efficiency_points(day_slices, cfg)
    outside = points.join(_fences(points).select("day", "lo", "hi"), "day").where(
        ~F.col("eff").between(F.col("lo"), F.col("hi")))
    return outside.select("day", "session_id", half_even(F.col("eff"), 2).alias("eff"))


def hourly_distribution(messages: DataFrame, cfg: EngineConfig) -> DataFrame:
    spine = messages.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = (messages.where(F.col("ts_ms").isNotNull())
              .groupBy(local_hour("ts_ms", cfg.local_tz).alias("hour")).agg(F.count(F.lit(1)).alias("n")))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("messages"))


def weekday_distribution(messages: DataFrame, cfg: EngineConfig) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in cfg.weekday_labels])
    spine = messages.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    counts = (messages.where(F.col("ts_ms").isNotNull())
              .groupBy(local_weekday("ts_ms", cfg.local_tz).alias("weekday")).agg(F.count(F.lit(1)).alias("n")))
    return spine.join(counts, "weekday", "left").select(
        "weekday", F.element_at(labels, F.col("weekday") + 1).alias("day"),
        F.coalesce("n", F.lit(0)).alias("messages"))


def session_totals(day_slices: DataFrame) -> DataFrame:
    """Per session totals with cost; the base of project, KPI and filter facts."""
    sums = ("messages", "calls", "input_tokens", "output_tokens", "cache_read", "cache_creation", "cost_nusd")
    return (priced(day_slices).groupBy("session_id", "source", "project")
            .agg(*_sums(*sums), F.min("day").alias("date"), F.max("day").alias("end_date")))


def project_rollup(day_slices: DataFrame) -> DataFrame:
    """Sources per project are few (job parameters), so their set fits a row; rows fold in two steps."""
    sums = ("messages", "input_tokens", "output_tokens", "cache_read", "cache_creation")
    by_source = (session_totals(day_slices).groupBy("project", "source")
                 .agg(F.count(F.lit(1)).alias("sessions"), *_sums(*sums, "cost_nusd")))
    return (by_source.groupBy("project")
            .agg(*_sums("sessions", *sums), F.sum("cost_nusd").alias("cost_nusd"),
                 F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
            .select("project", "sessions", *sums, usd("cost_nusd", 2).alias("cost"), "sources")
            .orderBy(F.desc("cost"), "project"))


def model_rollup(day_slices: DataFrame) -> DataFrame:
    sums = ("calls", "input_tokens", "output_tokens", "cache_read", "cache_creation")
    return (by_model_day(day_slices).where(F.col("calls") > 0).groupBy("display").agg(*_sums(*sums, "cost_nusd"))
            .select(F.col("display").alias("model"), *sums, usd("cost_nusd", 2).alias("cost"))
            .orderBy(F.desc("cost"), "model"))


def model_totals(day_slices: DataFrame) -> DataFrame:
    """Token sums per display name with its rates; the 1-hour share is limited at this level."""
    sums = day_slices.groupBy("model").agg(*_sums("calls", *TOKEN_COLUMNS)).where(F.col("calls") > 0)
    rates = ("p_input", "p_output", "p_read", "p_write_5m", "p_write_1h")
    return (with_prices(sums).groupBy("display", *rates)
            .agg(*_sums("input_tokens", "output_tokens", "cache_read", "cache_creation", "cache_1h"))
            .withColumn("w1h", F.least("cache_1h", "cache_creation")))


def cost_by_token_type(day_slices: DataFrame) -> DataFrame:
    m = model_totals(day_slices)
    nano = {
        "input": F.sum(F.col("input_tokens") * F.col("p_input")),
        "output": F.sum(F.col("output_tokens") * F.col("p_output")),
        "cache_read": F.sum(F.col("cache_read") * F.col("p_read")),
        "cache_write": F.sum((F.col("cache_creation") - F.col("w1h")) * F.col("p_write_5m")
                             + F.col("w1h") * F.col("p_write_1h")),
        "cache_savings": F.sum(F.col("cache_read") * (F.col("p_input") - F.col("p_read"))),
    }
    return m.agg(*[usd(v, 2).alias(k) for k, v in nano.items()])


def cache_savings(day_slices: DataFrame) -> DataFrame:
    """Per model: what cache reads would have cost more as fresh input."""
    saved = F.col("cache_read") * (F.col("p_input") - F.col("p_read"))
    return model_totals(day_slices).select(F.col("display").alias("model"), "cache_read",
                                           usd(saved, 2).alias("savings"))


def kpi_totals(day_slices: DataFrame) -> DataFrame:
    tokens = ("output_tokens", "input_tokens", "cache_read", "cache_creation")
    return session_totals(day_slices).agg(
        usd(F.sum("cost_nusd"), 2).alias("total_cost"), F.count(F.lit(1)).alias("total_sessions"),
        F.sum("messages").alias("total_messages"), *[F.sum(t).alias(f"total_{t}") for t in tokens],
        F.min("date").cast("string").alias("first_day"), F.max("end_date").cast("string").alias("last_day"),
        F.countDistinct("project").alias("total_projects"))


def rollup_sets(day_slices: DataFrame) -> DataFrame:
    """Totals by project, by source and overall in one pass (grouping sets over priced slices)."""
    p = priced(day_slices)
    grouped = (p.groupBy("project", "source", "day").agg(*_sums("messages", "cost_nusd", "output_tokens"))
               .groupingSets([[], ["project"], ["source"], ["day"]], "project", "source", "day")
               .agg(F.grouping_id().alias("gid"), *_sums("messages", "cost_nusd", "output_tokens")))
    label = F.coalesce("project", "source", F.col("day").cast("string"), F.lit("all"))
    return grouped.select(F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "project")
                          .when(F.col("gid") == 5, "source").otherwise("day").alias("grain"),
                          label.alias("name"), "messages", "output_tokens", "cost_nusd")


def kpi_derived(totals: DataFrame, paid_usd: Column | None = None) -> DataFrame:
    """Cache-hit share, sessions per day of the active span, messages per session, savings share."""
    t = totals.agg(F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last"),
                   *_sums("messages", "input_tokens", "cache_read", "cache_creation", "cost_nusd"))
    span = F.datediff("last", "first") + 1
    into = F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")
    cost = F.col("cost_nusd") / 1e9
    paid = paid_usd if paid_usd is not None else F.lit(0.0)
    return t.select("sessions", half_even(F.col("sessions") / F.greatest(F.lit(1), span), 1).alias("sessions_per_day"),
                    F.rint(safe_ratio(F.col("messages"), F.col("sessions"))).alias("messages_per_session"),
                    half_even(safe_ratio(F.col("cache_read"), into) * 100, 1).alias("cache_hit_pct"),
                    half_even(safe_ratio(cost - paid, cost) * 100, 1).alias("savings_pct"))


def name_ranking(names: DataFrame, name: str = "name", limit: int | None = None) -> DataFrame:
    """Count per name, largest first, name as tie-break; ``limit`` for top-k reports."""
    out = (names.where(F.col(name) != "").groupBy(F.col(name).alias("name"))
           .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name"))
    return out.limit(limit) if limit else out


def daily_rate(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Errors per 100 tool calls and day. Inputs: (day, errors) and (day, calls), already aggregated."""
    return (events.join(calls, "day", "full")
            .select("day", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("calls", F.lit(0)).alias("calls"))
            .withColumn("error_rate", half_even(safe_ratio(F.col("errors"), F.col("calls")) * 100, 1)))


def activity_calendar(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """52-week day spine that starts on a Monday, messages per day and intensity m / max."""
    start = as_of - dt.timedelta(days=52 * 7 - 1)
    start -= dt.timedelta(days=start.weekday())
    spine = daily.sparkSession.range((as_of - start).days + 1).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    rows = spine.join(daily.select("day", "messages"), "day", "left").select(
        "day", F.coalesce("messages", F.lit(0)).alias("messages"))
    top = F.max("messages").over(Window.partitionBy())
    return rows.select("day", "messages", half_even(safe_ratio(F.col("messages"), top), 2).alias("intensity"))


def top_tools_with_reasoning(tool_tokens: DataFrame, reasoning: DataFrame, limit: int = 12) -> DataFrame:
    """Top tools by output tokens plus one row for turns without tools."""
    top = tool_tokens.orderBy(F.desc("output_tokens"), "tool").limit(limit).select(
        F.col("tool").alias("label"), "output_tokens")
    extra = reasoning.where(F.col("output_tokens") > 0).select(F.lit("Reasoning").alias("label"), "output_tokens")
    return top.unionByName(extra)

"""Plan periods, billing cycles, cost comparison and tier recommendation.

Plan periods of one job are a parameter (a handful of rows); a table with one history per account works the same
way. Usage is folded to one row per account and day before it meets a cycle.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.config import EngineConfig, PlanPeriod
from turnledger.functions.classify import tier_name
from turnledger.operators.limits import TIER_FACTORS, tier_factor

# Fixed values.
RECENT_CYCLES = 3
WINDOW_HIT_QUOTA = 0.05
WEEKLY_HIT_ALLOWANCE = 1
FALLBACK_TIER = "Max 5x"
TIERS = tuple(t for t, _ in TIER_FACTORS)
CYCLE_KEYS = ["account", "plan_ord", "cycle_ord"]


def _key(tier: str) -> str:
    return tier.lower().replace(" ", "_")


def _r(x: Column, places: int = 2) -> Column:
    scale = float(10 ** places)
    return F.rint(x * scale) / scale


def plan_table(spark: SparkSession, history: Sequence[PlanPeriod], account: str = "all") -> DataFrame:
    """The configured history as an inline relation."""
    def lit(v, kind):
        if v is None:
            return f"CAST(NULL AS {kind})"
        if kind == "DATE":
            return f"DATE '{v.isoformat()}'"
        return "'%s'" % v.replace("'", "\\'") if kind == "STRING" else f"CAST({v} AS {kind})"

    rows = ", ".join(
        "('%s', %d, %s)" % (account, i, ", ".join([
            lit(p.plan, "STRING"), lit(p.start, "DATE"), lit(p.end, "DATE"), lit(p.cost_usd, "DOUBLE"),
            lit(p.local_cost, "DOUBLE"), lit(p.symbol, "STRING"), lit(p.billing_day, "INT"),
            lit(p.billing_cycle, "STRING")])) for i, p in enumerate(history))
    return spark.sql("SELECT * FROM VALUES " + rows + " AS t(account, plan_ord, plan, start, end, cost_usd, cost_local,"
                     " currency_symbol, billing_day, billing_cycle)")


def _month_day(month_start: Column, day: Column) -> Column:
    """``day`` of a month, limited to the month's length."""
    return F.date_add(month_start, F.least(day, F.dayofmonth(F.last_day(month_start))) - 1)


def billing_cycles(plans: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per accounting cycle; annual plans get monthly cycles at a twelfth of the price.

    The anchor day is applied to every month anew, so day 31 survives short months.
    """
    last = F.coalesce("end", F.lit(as_of))
    months = F.when(F.col("billing_day").isNull(), 0).otherwise(
        (F.year(last) - F.year("start")) * 12 + F.month(last) - F.month("start"))
    k = F.explode(F.sequence(F.lit(0), F.greatest(months.cast("int"), F.lit(0)))).alias("cycle_ord")
    rows = plans.select("*", last.alias("_last"), k)
    month = F.trunc("start", "MM")
    begins = F.when(F.col("cycle_ord") == 0, F.col("start")).otherwise(
        _month_day(F.add_months(month, F.col("cycle_ord")), F.col("billing_day")))
    following = _month_day(F.add_months(month, F.col("cycle_ord") + 1), F.col("billing_day"))
    ends = F.when(F.col("billing_day").isNull(), F.col("_last")).otherwise(
        F.least(F.date_sub(following, 1), F.col("_last")))
    parts = F.when(F.col("billing_cycle") == "annual", 12).otherwise(1)
    label = F.when(F.col("billing_cycle") == "annual", F.concat("plan", F.lit(" (annual)"))).otherwise(F.col("plan"))
    open_plan = F.col("end").isNull()
    local = F.when(F.coalesce("cost_local", F.lit(0.0)) != 0, F.col("cost_local") / parts).otherwise(
        F.when(parts == 1, F.col("cost_local")))
    out = rows.select("account", "plan_ord", "cycle_ord", label.alias("plan"), begins.alias("cycle_start"),
                      ends.alias("cycle_end"), (F.col("cost_usd") / parts).alias("cost_usd"),
                      local.alias("cost_local"), "currency_symbol", open_plan.alias("_open"))
    return (out.where(F.col("cycle_start") <= F.col("cycle_end"))
            .withColumn("is_current", F.col("_open") & (F.col("cycle_end") == F.lit(as_of))).drop("_open"))


def on_cycles(facts: DataFrame, cycles: DataFrame, day: str) -> DataFrame:
    """Join dated rows to the cycles that contain them, through months as an equality key."""
    spans = cycles.select(*CYCLE_KEYS, "cycle_start", "cycle_end", F.explode(F.sequence(
        F.trunc("cycle_start", "MM"), F.trunc("cycle_end", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    return (facts.withColumn("_month", F.trunc(day, "MM")).join(spans, ["account", "_month"])
            .where(F.col(day).between(F.col("cycle_start"), F.col("cycle_end"))))


def plan_periods(cycles: DataFrame, daily_cost: DataFrame, session_days: DataFrame, cfg: EngineConfig,
                 events: DataFrame | None = None) -> DataFrame:
    """Cycles compared with usage.

    ``daily_cost`` (account, day, cost_nusd) and ``session_days`` (account, day, sessions, messages) are summed per
    cycle separately and then joined, so no side multiplies the other. Cycles that start on the report day and
    cycles before the first use are left out.
    """
    first = daily_cost.groupBy("account").agg(F.min("day").alias("_first"))
    shown = (cycles.join(first, "account", "left")
             .where((F.col("cycle_start") != F.lit(cfg.as_of))
                    & (F.col("_first").isNull() | (F.col("cycle_end") >= F.col("_first")))).drop("_first"))
    cost = on_cycles(daily_cost, shown, "day").groupBy(*CYCLE_KEYS).agg(F.sum("cost_nusd").alias("api_nusd"))
    use = on_cycles(session_days, shown, "day").groupBy(*CYCLE_KEYS).agg(
        F.sum("sessions").alias("sessions"), F.sum("messages").alias("messages"),
        F.count(F.lit(1)).alias("days_active"))
    out = shown.join(cost, CYCLE_KEYS, "left").join(use, CYCLE_KEYS, "left")
    if events is not None:
        hits = on_cycles(events, shown, "day").groupBy(*CYCLE_KEYS).agg(
            F.count(F.lit(1)).alias("limit_event_count"))
        out = out.join(hits, CYCLE_KEYS, "left")
    else:
        out = out.withColumn("limit_event_count", F.lit(0))
    api = F.coalesce("api_nusd", F.lit(0)) / 1e9
    days = F.datediff("cycle_end", "cycle_start") + 1
    savings = api - F.col("cost_usd")
    fx = F.when((F.coalesce("cost_local", F.lit(0.0)) != 0) & (F.col("cost_usd") != 0),
                F.col("cost_local") / F.col("cost_usd"))
    zero = F.lit(0).cast("long")
    return out.select(
        *CYCLE_KEYS, "plan", "cycle_start", "cycle_end", days.alias("total_days"),
        F.coalesce("days_active", zero).alias("days_active"), _r(F.col("cost_usd")).alias("plan_cost_usd"),
        _r(F.col("cost_local")).alias("plan_cost_local"), "currency_symbol", fx.alias("fx"),
        _r(api).alias("api_cost"), _r(savings).alias("savings"),
        F.when(F.col("cost_usd") > 0, _r(api / F.col("cost_usd"), 1)).otherwise(0.0).alias("roi_factor"),
        F.coalesce("sessions", zero).alias("sessions"), F.coalesce("messages", zero).alias("messages"),
        _r(api / days).alias("cost_per_day"), _r(api * fx).alias("api_cost_local"),
        _r(savings * fx).alias("savings_local"), _r(api / days * fx).alias("cost_per_day_local"),
        "is_current", F.coalesce("limit_event_count", zero).alias("limit_event_count"))


def _clamp(year: int, month: int, day: int) -> dt.date:
    return dt.date(year, month, min(day, calendar.monthrange(year, month)[1]))


def billing_bounds(plan: PlanPeriod, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """First day of the running billing period and first day of the next one."""
    if plan.billing_cycle == "annual":
        def anniversary(year: int) -> dt.date:
            return _clamp(year, plan.start.month, plan.start.day)

        year = as_of.year if anniversary(as_of.year) <= as_of else as_of.year - 1
        return anniversary(year), anniversary(year + 1)
    anchor = plan.billing_day or 1

    def month(offset: int) -> dt.date:
        index = as_of.year * 12 + as_of.month - 1 + offset
        return _clamp(index // 12, index % 12 + 1, anchor)

    offset = 0 if month(0) <= as_of else -1
    return month(offset), month(offset + 1)


def current_billing(daily_cost: DataFrame, session_days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The running billing period with a projection to its end; its dates come from the parameters."""
    plan = cfg.plan_history[-1]
    start, end = billing_bounds(plan, cfg.as_of)
    elapsed, total = (cfg.as_of - start).days + 1, (end - start).days
    inside = F.col("day").between(F.lit(start), F.lit(cfg.as_of))
    cost = daily_cost.where(inside).groupBy("account").agg(F.sum("cost_nusd").alias("nusd"))
    use = session_days.where(inside).groupBy("account").agg(F.sum("sessions").alias("sessions"),
                                                           F.sum("messages").alias("messages"))
    api = F.coalesce("nusd", F.lit(0)) / 1e9
    projected = api / elapsed * total
    usd, local = float(plan.cost_usd), plan.local_cost
    fx = local / usd if local and usd else None

    def in_local(x: Column) -> Column:
        return _r(x * fx) if fx is not None else F.lit(None).cast("double")

    return daily_cost.select("account").distinct().join(cost, "account", "left").join(use, "account", "left").select(
        "account", F.lit(plan.plan).alias("plan"), F.lit(start).alias("period_start"), F.lit(end).alias("period_end"),
        F.lit(elapsed).alias("days_elapsed"), F.lit(total).alias("days_total"),
        F.lit(max(0, total - elapsed)).alias("days_remaining"), F.lit(usd).alias("plan_cost_usd"),
        F.lit(local).cast("double").alias("plan_cost_local"), F.lit(plan.symbol).cast("string").alias("currency_symbol"),
        _r(api).alias("api_cost"), _r(projected).alias("projected_cost"), _r(api - usd).alias("savings"),
        (_r(api / usd, 1) if usd > 0 else F.lit(0.0)).alias("roi_factor"),
        (_r(projected / usd, 1) if usd > 0 else F.lit(0.0)).alias("projected_roi"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("messages", F.lit(0)).alias("messages"),
        _r(api / elapsed).alias("cost_per_day"), in_local(api).alias("api_cost_local"),
        in_local(projected).alias("projected_cost_local"), in_local(api - usd).alias("savings_local"),
        in_local(api / elapsed).alias("cost_per_day_local"))


def framed_periods(periods: DataFrame, current: DataFrame) -> DataFrame:
    """Full-period context on the in-progress row: real end, elapsed and total days, projected ROI."""
    frame = current.select("account", F.date_sub("period_end", 1).alias("period_end_full"),
                           F.col("days_total").alias("days_total_full"), "days_elapsed", "projected_roi")
    out = periods.join(frame, "account", "left")
    names = ("period_end_full", "days_total_full", "days_elapsed", "projected_roi")
    return out.select(*periods.columns, *[F.when(F.col("is_current"), F.col(n)).alias(n) for n in names])


def plan_totals(periods: DataFrame, history: Sequence[PlanPeriod]) -> DataFrame:
    """Totals over all periods and the symbol of the latest plan that has one."""
    symbol = next((p.symbol for p in reversed(history) if p.symbol), None)
    t = periods.groupBy("account").agg(
        F.sum("api_cost").alias("a"), F.sum("plan_cost_usd").alias("p"),
        F.sum(F.coalesce("api_cost_local", F.lit(0.0))).alias("al"),
        F.sum(F.coalesce("plan_cost_local", F.lit(0.0))).alias("pl"),
        F.count("api_cost_local").alias("locals"))
    has_local = F.col("locals") > 0
    return t.select("account", _r(F.col("a")).alias("total_api_cost"), _r(F.col("p")).alias("total_plan_cost"),
                    _r(F.col("a") - F.col("p")).alias("total_savings"),
                    F.when(F.col("p") > 0, _r(F.col("a") / F.col("p"), 1)).otherwise(0.0).alias("overall_roi"),
                    F.when(has_local, _r(F.col("al"))).alias("total_api_cost_local"),
                    F.when(has_local, _r(F.col("pl"))).alias("total_plan_cost_local"),
                    F.when(has_local, _r(F.col("al") - F.col("pl"))).alias("total_savings_local"),
                    F.lit(symbol).cast("string").alias("currency_symbol"))


def active_tier(history: Sequence[PlanPeriod], day: Column) -> Column:
    """Tier of the first plan period that contains ``day``: an expression over the parameters, no join."""
    out = None
    for p in history:
        inside = (day >= F.lit(p.start)) & (day <= F.lit(p.end or dt.date(9999, 12, 31)))
        tier = tier_name(F.lit(p.plan))
        out = F.when(inside, tier) if out is None else out.when(inside, tier)
    return out if out is not None else F.lit(None).cast("string")


def recommendation_cycles(periods: DataFrame, window_hits: DataFrame, week_hits: DataFrame) -> DataFrame:
    """Cycles with their window, week and per-tier hit counts."""
    out = periods.select(*CYCLE_KEYS, "plan", "cycle_start", "cycle_end", "api_cost", "limit_event_count")
    out = out.join(window_hits, CYCLE_KEYS, "left").join(week_hits, CYCLE_KEYS, "left")
    counts = ["windows", *[f"hits_{_key(t)}" for t in TIERS], "weeks", *[f"weekly_{_key(t)}" for t in TIERS]]
    label = F.concat(F.date_format("cycle_start", "yyyy-MM"), F.lit(" · "), F.col("plan"))
    return out.select(*CYCLE_KEYS, label.alias("label"), "cycle_start", "cycle_end",
                      tier_name(F.col("plan")).alias("active_tier"), "api_cost", "limit_event_count",
                      *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def recommend_tier(cycles: DataFrame) -> DataFrame:
    """Cheapest tier whose hits over the last cycles stay inside the tolerance, with the numbers behind it."""
    recent = cycles.withColumn("_rn", F.row_number().over(
        Window.partitionBy("account").orderBy(F.desc("plan_ord"), F.desc("cycle_ord"))))
    is_recent = F.col("_rn") <= RECENT_CYCLES
    sums = [c for c in cycles.columns if c.startswith(("hits_", "weekly_"))]
    t = recent.groupBy("account").agg(
        F.count(F.lit(1)).alias("total_cycles"), F.count_if(is_recent).alias("recent_cycles"),
        F.sum(F.when(is_recent, F.col("windows")).otherwise(0)).alias("recent_windows"),
        *[F.sum(F.when(is_recent, F.col(c)).otherwise(0)).alias(f"recent_{c}") for c in sums],
        *[F.sum(c).alias(f"total_{c}") for c in sums])
    best = None
    for tier in TIERS:
        holds = ((F.col(f"recent_hits_{_key(tier)}") <= WINDOW_HIT_QUOTA * F.col("recent_windows"))
                 & (F.col(f"recent_weekly_{_key(tier)}") <= WEEKLY_HIT_ALLOWANCE))
        best = F.when(holds, tier) if best is None else best.when(holds, tier)
    return t.withColumn("recommended_tier", best)


def current_tier(history: Sequence[PlanPeriod]) -> Column:
    return F.coalesce(tier_name(F.lit(history[-1].plan)), F.lit(FALLBACK_TIER))


def switch_hints(cycles: DataFrame, recommendation: DataFrame) -> DataFrame:
    """Per cycle: ``down`` when the cheaper recommended tier held, ``up`` when the active tier did not hold."""
    def holds(tier: Column) -> Column:
        hits, weekly = F.lit(None).cast("long"), F.lit(None).cast("long")
        for t in TIERS:
            hits = F.when(tier == t, F.col(f"hits_{_key(t)}")).otherwise(hits)
            weekly = F.when(tier == t, F.col(f"weekly_{_key(t)}")).otherwise(weekly)
        return (hits <= WINDOW_HIT_QUOTA * F.col("windows")) & (weekly <= WEEKLY_HIT_ALLOWANCE)

    out = cycles.join(recommendation.select("account", "recommended_tier"), "account", "left")
    active, rec = F.col("active_tier"), F.col("recommended_tier")
    cheaper, dearer = tier_factor(rec) < tier_factor(active), tier_factor(rec) > tier_factor(active)
    hint = F.when(cheaper & holds(rec), "down").when(dearer & ~holds(active), "up")
    return out.withColumn("switch_hint", hint)


def severity(hits: Column) -> Column:
    """Heat-map bucket: 0, 1-2, 3-9, 10 and more."""
    return F.when(hits <= 0, "h0").when(hits <= 2, "h1").when(hits <= 9, "h2").otherwise("h3")


def display_facts(periods: DataFrame, current: DataFrame) -> DataFrame:
    """Savings share over all periods and progress of the running period, in percent."""
    t = periods.groupBy("account").agg(F.sum("savings").alias("s"), F.sum("api_cost").alias("a"))
    pct = F.least(F.lit(100.0), F.rint(F.col("days_elapsed") / F.col("days_total") * 100))
    return t.join(current, "account").select(
        "account", F.when(F.col("a") > 0, F.rint(F.col("s") / F.col("a") * 1000) / 10).otherwise(0.0)
        .alias("savings_pct"), pct.alias("progress_pct"))


def event_positions(events: DataFrame, cycles: DataFrame) -> DataFrame:
    """Where in its cycle an event falls, in percent of the cycle's days (0-100)."""
    joined = on_cycles(events, cycles, "day")
    start_ms = F.unix_date("cycle_start").cast("long") * 86_400_000
    length = F.greatest(F.lit(1), F.datediff("cycle_end", "cycle_start").cast("long") * 86_400_000)
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("ts_ms") - start_ms) * 100 / length))
    return joined.withColumn("position_pct", F.rint(pct * 100) / 100)


def paid_spans(periods: DataFrame, current: DataFrame) -> DataFrame:
    """Periods and the running billing period as one list of paid spans, in order."""
    rows = periods.select("account", (F.col("plan_ord") * 100000 + F.col("cycle_ord")).alias("span_ord"),
                          F.col("cycle_start").alias("start"), F.col("cycle_end").alias("end"), "total_days",
                          "plan_cost_usd", "plan_cost_local", F.lit(False).alias("is_running"))
    running = current.select("account", F.lit(2_000_000_000).alias("span_ord"), F.col("period_start").alias("start"),
                             F.col("period_end").alias("end"), F.col("days_total").alias("total_days"),
                             "plan_cost_usd", "plan_cost_local", F.lit(True).alias("is_running"))
    return rows.unionByName(running)


def prorated_cost(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Plan cost within a range (account, from_day, to_day): each span at its overlap, at most 100 %."""
    fx_now = default_rate(spans)
    overlap = F.datediff(F.least("end", "to_day"), F.greatest("start", "from_day")) + 1
    fraction = F.least(F.lit(1.0), overlap / F.col("total_days"))
    local = F.coalesce("plan_cost_local", F.col("plan_cost_usd") * F.coalesce("fx_now", F.lit(0.0)))
    joined = (ranges.join(spans, "account", "left").join(fx_now, "account", "left"))
    met = (F.col("end") >= F.col("from_day")) & (F.col("start") <= F.col("to_day"))
    return joined.groupBy("account").agg(
        _r(F.sum(F.when(met, F.col("plan_cost_usd") * fraction).otherwise(0.0))).alias("plan_cost_usd"),
        _r(F.sum(F.when(met, local * fraction).otherwise(0.0))).alias("plan_cost_local"))


def _rate() -> Column:
    usable = (F.coalesce("plan_cost_local", F.lit(0.0)) != 0) & (F.col("plan_cost_usd") != 0)
    return F.when(usable, F.col("plan_cost_local") / F.col("plan_cost_usd"))


def default_rate(spans: DataFrame) -> DataFrame:
    """Rate of the running period, else of the latest span that has one."""
    rated = spans.withColumn("_fx", _rate()).where(F.col("_fx").isNotNull())
    return rated.groupBy("account").agg(F.max_by("_fx", "span_ord").alias("fx_now"))


def rate_by_day(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Exchange rate for each (account, day): of the first span that contains it, else the default rate."""
    months = spans.select("account", "span_ord", "start", "end", _rate().alias("_fx"), F.explode(F.sequence(
        F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    hit = (days.withColumn("_month", F.trunc("day", "MM")).join(months, ["account", "_month"])
           .where(F.col("day").between(F.col("start"), F.col("end")))
           .groupBy("account", "day").agg(F.min_by(F.struct("_fx"), "span_ord").alias("_hit")))
    return (days.join(hit, ["account", "day"], "left").join(default_rate(spans), "account", "left")
            .withColumn("fx", F.coalesce("_hit._fx", "fx_now")).drop("_hit", "fx_now"))


def cumulative_local(daily_cost: DataFrame, spans: DataFrame) -> DataFrame:
    """Running total in local currency: every day at its own rate first, then accumulated over the daily table."""
    days = rate_by_day(daily_cost, spans)
    running = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    local = F.col("cost_nusd") / 1e9 * F.coalesce("fx", F.lit(0.0))
    return days.select("account", "day", _r(F.sum(local).over(running)).alias("cost_local"))

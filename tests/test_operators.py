import calendar
import datetime as dt
import random
import statistics

import pytest
from conftest import turn_rows
from pyspark.sql import functions as F

from turnledger.config import EngineConfig, PlanPeriod
from turnledger.operators import anomalies, attribution, calibration, facts, filters, limits, ordering, series
from turnledger.plans import billing
from turnledger.sources import tables

H = 3_600_000
SF = "/root/testdata/sf0.001"


# ---- splits -------------------------------------------------------------------------------------------------------

def test_tool_split_absorbs_remainder(spark):
    """1003 over seven calls: 286.57 per two calls, so the tool met last takes what rounding leaves (1003 - 574)."""
    called = ["Grep", "Bash", "Grep", "Write", "Write", "Bash", "Write"]
    t = turn_rows(spark, [dict(ts_ms=0, output_tokens=1003, tools=called)]).withColumn("cost_nusd", F.lit(5000))
    got = {r.tool: (r.calls, r.output_tokens, r.cost_nusd) for r in attribution.tool_tokens(t).collect()}
    assert got == {"Grep": (2, 287, 1429), "Bash": (2, 287, 1429), "Write": (3, 429, 2142)}


def test_tool_split_adds_up(spark):
    rng = random.Random(3)
    rows = [dict(ts_ms=i, session_id=str(i), output_tokens=rng.randint(1, 999),
                 tools=[rng.choice("ABCDE") for _ in range(rng.randint(1, 9))]) for i in range(200)]
    t = turn_rows(spark, rows).withColumn("cost_nusd", F.col("output_tokens") * 7919)
    per = attribution.tool_tokens(t, ["session_id"]).groupBy("session_id").agg(F.sum("output_tokens").alias("o"), F.sum("cost_nusd").alias("c"))
    bad = t.join(per, "session_id").where("o <> output_tokens OR c <> cost_nusd")
    assert bad.count() == 0


BLOCKS = "array<struct<btype:string,text:string,thinking:string,name:string,input:string>>"


def test_write_split(spark):
    rows = [(1, 100, [("text", "abcd", None, None, None), ("tool_use", None, None, "Bash", '{"a":1}')]),
            (2, 50, [("text", "", None, None, None)]), (3, 0, [("text", "x", None, None, None)]),
            (4, 30, [("thinking", None, "aaaa", None, None), ("text", "bb", None, None, None)])]
    t = spark.createDataFrame(rows, f"ord int, output_tokens long, blocks {BLOCKS}")
    got = {r.ord: [(w.category, w.tokens) for w in r.writes] if r.writes else None for r in attribution.write_parts(t).collect()}
    assert got[1] == [("screen_text_narration", 27), ("bash_commands", 73)]
    assert got[2] == [("screen_text", 50)] and got[3] is None
    assert got[4] == [("thinking", 20), ("screen_text", 10)]


def test_narration_needs_a_following_assistant_entry(spark):
    rows = [("s", 1, "assistant"), ("s", 2, "progress"), ("s", 3, "assistant"), ("s", 4, "user"), ("s", 5, "assistant")]
    e = spark.createDataFrame(rows, "session_id string, ord long, type string")
    for spread_out in (1, 1 << 21):  # within one cell and over several
        wide = e.withColumn("ord", F.col("ord") * spread_out)
        got = {r.ord // spread_out: r.is_narration for r in attribution.narration_tokens(wide).collect()}
        assert got == {1: True, 3: False, 4: False, 5: False}


# ---- day split ----------------------------------------------------------------------------------------------------

def test_undated_rows_go_to_the_start_day(spark):
    day = 86_400_000
    t = turn_rows(spark, [dict(ts_ms=day * 10 + 5, output_tokens=5), dict(ts_ms=day * 11, output_tokens=7), dict(ts_ms=None, output_tokens=11)])
    got = {str(r.day): (r.output_tokens, r.messages) for r in facts.session_day_split(facts.slices(t, has_undated=True)).collect()}
    assert got == {"1970-01-11": (16, 2), "1970-01-12": (7, 1)}


def test_per_day_map_only_for_multi_day_sessions(spark):
    t = turn_rows(spark, [dict(session_id="a", ts_ms=0), dict(session_id="a", ts_ms=86_400_000), dict(session_id="b", ts_ms=0)])
    rows = facts.per_day_maps(facts.slices(t)).collect()
    assert [(r.session_id, sorted(r.per_day)) for r in rows] == [("a", ["1970-01-01", "1970-01-02"])]


# ---- anomalies ----------------------------------------------------------------------------------------------------

def warmed(turns=9, pace=45_000, rewrite=740):
    """A cold first turn, then turns that mostly read the cache; the running median of rewrites stays near ``rewrite``."""
    rows = [dict(ts_ms=1_000_000, cache_read=0, cache_creation=31_000)]
    rows += [dict(ts_ms=1_000_000 + k * pace, cache_read=62_000 + 10 * k, cache_creation=rewrite + k) for k in range(1, turns)]
    return rows, rows[-1]["ts_ms"]


def flush_counts(spark, rows, **options):
    r = anomalies.cache_flushes(turn_rows(spark, rows), **options).first()
    return r.gap_flushes, r.nogap_flushes, r.nogap_rewrite_tokens


def test_gap_and_nogap_flush(spark):
    rows, t = warmed()
    assert flush_counts(spark, rows) == (0, 0, 0)
    late = rows + [dict(ts_ms=t + 300_000, cache_read=11, cache_creation=7_321)]
    soon = rows + [dict(ts_ms=t + 299_999, cache_read=11, cache_creation=7_321)]
    assert flush_counts(spark, late) == (1, 0, 0)
    assert flush_counts(spark, soon) == (0, 1, 7_321)
    assert flush_counts(spark, [{**r, "cache_1h": 3} for r in late]) == (0, 1, 7_321)
    assert flush_counts(spark, rows + [dict(ts_ms=t + 299_999, cache_read=31_050, cache_creation=7_321)]) == (0, 0, 0)  # half the cache is still read
    for distance, kept in ((119_999, 0), (120_000, 1)):
        near = spark.createDataFrame([("s", t + 299_999 - distance)], "session_id string, ts_ms long")
        assert flush_counts(spark, soon, compactions=near) == (0, kept, kept * 7_321)


def test_flushes_match_a_sequential_fold(spark):
    turns = tables.usage_ledger(spark, SF)
    rows = turns.where("output_tokens > 0").select("session_id", "ts_ms", "ord", "cache_read", "cache_creation", "cache_1h").collect()
    want = {}
    for sid in {r.session_id for r in rows}:
        ts = sorted((r for r in rows if r.session_id == sid), key=lambda r: (r.ts_ms, r.ord))
        ttl = 3_600_000 if any(r.cache_1h > 0 for r in ts) else 300_000
        warm = next((i for i, r in enumerate(ts) if r.cache_read > r.cache_creation and r.cache_read > 0), None)
        seen, gaps, nogaps = [], 0, 0
        if len(ts) >= 3 and warm is not None:
            for prev, r in zip(ts[warm:], ts[warm + 1:]):
                if r.cache_creation > 0 and len(seen) >= 2 and r.cache_creation > 2 * max(statistics.median(seen), 100):
                    if r.ts_ms - prev.ts_ms >= ttl:
                        gaps += 1
                    elif prev.cache_read > 0 and r.cache_read < 0.5 * prev.cache_read:
                        nogaps += 1
                if r.cache_creation > 0:
                    seen.append(r.cache_creation)
        want[sid] = (gaps, nogaps)
    got = {r.session_id: (r.gap_flushes, r.nogap_flushes) for r in anomalies.cache_flushes(turns).collect()}
    assert got == {sid: want.get(sid, (0, 0)) for sid in got}


def test_idle_gaps(spark):
    r = anomalies.idle_gaps(turn_rows(spark, [dict(ts_ms=0, cache_creation=10), dict(ts_ms=100_000, cache_creation=200),
                                              dict(ts_ms=400_000, cache_creation=900), dict(ts_ms=400_000 + H, cache_creation=500)])).first()
    assert (r.short_count, r.mid_count, r.long_count, r.baseline_tokens, r.overspend_tokens) == (1, 1, 1, 200, 1000)
    assert r.overspend_pct == 62
    assert anomalies.idle_gaps(turn_rows(spark, [dict(ts_ms=0)])).count() == 0


def test_long_context_boundary(spark):
    rows = [dict(session_id="a", ts_ms=1, input_tokens=200_000), dict(session_id="b", ts_ms=9, input_tokens=150_000, cache_read=50_001),
            dict(session_id="b", ts_ms=5, input_tokens=200_001)]
    got = {r.session_id: (r.peak_context_tokens, r.used_long_context, r.first_long_ms) for r in anomalies.long_context(turn_rows(spark, rows)).collect()}
    assert got == {"a": (200_000, False, None), "b": (200_001, True, 5)}


# ---- windows and events -------------------------------------------------------------------------------------------

def brute_windows(times):
    starts, last = [], None
    for t in sorted(set(times)):
        if last is None or t >= last + 5 * H:
            starts.append(t)
            last = t
    return starts


def test_window_boundary(spark):
    rows = [dict(ts_ms=t, session_id=s) for t, s in ((0, "x"), (5 * H - 1, "y"), (5 * H, "x"), (6 * H, "x"))]
    got = sorted((r.start_ms, r.end_ms, r.turn_count, r.session_ids) for r in limits.windows_5h(turn_rows(spark, rows), with_sessions=True).collect())
    assert got == [(0, 5 * H - 1, 2, ["x", "y"]), (5 * H, 6 * H, 2, ["x"])]


@pytest.mark.parametrize("array_points", [10**6, 0])
def test_window_paths_match_brute_force(spark, array_points):
    rng = random.Random(11)
    rows, want = [], {}
    for a in range(12):
        t, times = rng.randint(0, H), []
        for _ in range(120):
            t += rng.choice([1, 5_000, H // 2, 2 * H, 3 * H, 5 * H, 5 * H - 1, 9 * H])
            times.append(t)
        rows += [dict(account=f"a{a}", ts_ms=x) for x in times]
        want[f"a{a}"] = brute_windows(times)
    starts = limits.window_starts(turn_rows(spark, rows), array_points).collect()
    got = {a: sorted(r.start_ms for r in starts if r.account == a) for a in want}
    assert got == want


@pytest.mark.parametrize("anchor", range(7))
def test_week_anchor(spark, anchor):
    days = [dt.date(2027, 2, 26) + dt.timedelta(days=k) for k in range(9)]
    for day in days[::4]:
        ts = int(dt.datetime(day.year, day.month, day.day, 23, 59, tzinfo=dt.timezone.utc).timestamp() * 1000)
        start = day
        while start.weekday() != anchor:
            start -= dt.timedelta(days=1)
        assert str(limits.weekly_buckets(turn_rows(spark, [dict(ts_ms=ts)]), anchor).first().week) == str(start)


EVENT = "account string, session_id string, ord long, ts_ms long"


def test_clusters_match_brute_force(spark):
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(400):
        t += rng.choice([0, 1000, 600_000, 900_000, 900_001, 3_000_000])
        rows.append(("a", f"s{i % 7}", i, t))
    want, last = [], None
    for _, s, i, ts in rows:
        if last is not None and ts - last <= 900_000:
            want[-1][2] += 1
        else:
            want.append([i, ts, 1])
        last = ts
    rows.append(("a", "s", 999, None))
    out = limits.cluster_events(spark.createDataFrame(rows, EVENT), ["session_id", "ord", "ts_ms"], ["ord"]).collect()
    got = sorted([r.ord, r.ts_ms, r.merged_count] for r in out if r.ts_ms is not None)
    assert got == sorted(want) and [r.ord for r in out if r.ts_ms is None] == [999]


def test_fingerprint(spark):
    base = int(dt.datetime(2024, 3, 4, 9, tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = [("a", "s", 0, base - H), ("a", "s", 1, base), ("a", "s", 2, base + 5 * H + 60_000),
            ("b", "s", 3, base), ("b", "s", 4, base + 5 * H), ("c", "s", 5, base - 2 * H), ("c", "s", 6, base),
            ("c", "t", 7, base + 5 * H + 1_800_000), ("d", "s", 8, base - 1), ("d", "s", 9, base), ("d", "s", 10, base + 5 * H + 1_800_001)]
    got = {r.account: (r.session_id, r.gap_start_ms, r.confidence) for r in limits.fingerprints(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"a": ("s", base, "high"), "c": ("t", base, "medium")}


WIN = "account string, start_ms long, cost_nusd long, tier string, hit boolean"


def caps(spark, rows, override=None):
    df = spark.createDataFrame([("a", i, int(c * 1e9), t, h) for i, (c, t, h) in enumerate(rows)], WIN)
    return limits.tier_caps(df, override).first()


def test_caps(spark):
    """Per Pro: 8.4, 3.25 and 7.7 at a limit (median 7.7); the dearest without one is 6.2, then 9.05."""
    hit = [(42.0, "Max 5x", True), (65.0, "Max 20x", True), (7.7, "Pro", True)]
    r = caps(spark, [*hit, (31.0, "Max 5x", False)])
    assert (r.cap_pro, r.cap_max_5x, r.cap_max_20x, r.cap_source, r.anchor_windows, r.floor_applied) == (7.7, 38.5, 154.0, "empirical", 3, False)
    r = caps(spark, [*hit, (181.0, "Max 20x", False)])
    assert (r.cap_pro, r.floor_applied, r.floor_pro_usd) == (9.05, True, 9.05)
    r = caps(spark, [(3.5, "Pro", False), (0, "Max 5x", True), (12, None, True)])
    assert (r.cap_pro, r.cap_source, r.anchor_windows) == (100.0, "default", 0)
    r = caps(spark, [*hit, (181.0, "Pro", False)], 11.25)
    assert (r.cap_pro, r.cap_source, r.floor_applied) == (11.25, "config_override", False)


def test_anchored_window_counts_for_cheaper_tiers_only(spark):
    w = spark.createDataFrame([("a", 0, int(1e9), "Max 5x", True)], WIN)
    r = limits.tier_hits(w, limits.tier_caps(w, 50.0), ["account"]).first()
    assert (r.hits_pro, r.hits_max_5x, r.hits_max_20x) == (1, 1, 0)


# ---- billing ------------------------------------------------------------------------------------------------------

def cycles(spark, *periods, as_of=dt.date(2026, 6, 15)):
    out = billing.billing_cycles(billing.plan_table(spark, periods), as_of).orderBy("plan_ord", "cycle_ord")
    return [(str(r.cycle_start), str(r.cycle_end), r.cost_usd) for r in out.collect()]


@pytest.mark.parametrize("day", [29, 30, 31])
def test_billing_day_survives_short_months(spark, day):
    got = cycles(spark, PlanPeriod("Max 5x", dt.date(2027, 10, day), dt.date(2028, 5, 20), 100.0, billing_day=day), as_of=dt.date(2028, 5, 20))
    months = [(2027, m) for m in (10, 11, 12)] + [(2028, m) for m in (1, 2, 3, 4)]
    assert [c[0] for c in got] == [str(dt.date(y, m, min(day, calendar.monthrange(y, m)[1]))) for y, m in months]


def test_cycles_leave_no_gap(spark):
    for day in (1, 15, 29, 30, 31):
        got = cycles(spark, PlanPeriod("Pro", dt.date(2024, 1, 17), None, 120.0, billing_day=day, billing_cycle="annual"))
        assert all(c[2] == 10.0 for c in got) and got[-1][1] == "2026-06-15"
        for a, b in zip(got, got[1:]):
            assert dt.date.fromisoformat(a[1]) + dt.timedelta(days=1) == dt.date.fromisoformat(b[0])
    assert cycles(spark, PlanPeriod("Pro", dt.date(2026, 1, 1), None, 20.0)) == [("2026-01-01", "2026-06-15", 20.0)]


def test_billing_bounds():
    def bounds(plan, day):
        return tuple(map(str, billing.billing_bounds(plan, day)))

    monthly = PlanPeriod("Pro", dt.date(2024, 1, 31), None, 20.0, billing_day=31)
    assert bounds(monthly, dt.date(2024, 2, 10)) == ("2024-01-31", "2024-02-29")
    assert bounds(monthly, dt.date(2024, 2, 29)) == ("2024-02-29", "2024-03-31")
    leap = PlanPeriod("Pro", dt.date(2024, 2, 29), None, 240.0, billing_cycle="annual")
    assert bounds(leap, dt.date(2025, 6, 1)) == ("2025-02-28", "2026-02-28")


def rec_rows(spark, rows):
    names = "account string, plan_ord int, cycle_ord int, active_tier string, windows long, hits_pro long, hits_max_5x long, hits_max_20x long, weekly_pro long, weekly_max_5x long, weekly_max_20x long"
    return spark.createDataFrame([("a", 0, i, *r) for i, r in enumerate(rows)], names)


def test_recommendation_looks_at_recent_cycles(spark):
    df = rec_rows(spark, [("Max 5x", 100, 90, 90, 90, 9, 9, 9), ("Max 5x", 100, 5, 0, 0, 1, 0, 0), ("Max 5x", 100, 5, 0, 0, 0, 0, 0),
                          ("Max 5x", 100, 5, 0, 0, 0, 0, 0)])
    r = billing.recommend_tier(df).first()
    assert (r.recommended_tier, r.recent_cycles, r.recent_windows, r.total_hits_pro) == ("Pro", 3, 300, 105)
    hints = {h.cycle_ord: h.switch_hint for h in billing.switch_hints(df, billing.recommend_tier(df)).collect()}
    assert hints == {0: None, 1: "down", 2: "down", 3: "down"}


def test_recommendation_without_usage_is_the_cheapest(spark):
    assert billing.recommend_tier(rec_rows(spark, [("Max 5x", 0, 0, 0, 0, 0, 0, 0)])).first().recommended_tier == "Pro"
    none = rec_rows(spark, [("Pro", 10, 10, 10, 10, 9, 9, 9)])
    assert billing.recommend_tier(none).first().recommended_tier is None


def test_upgrade_hint(spark):
    df = rec_rows(spark, [("Pro", 100, 50, 2, 0, 0, 0, 0)])
    assert billing.switch_hints(df, billing.recommend_tier(df)).first().switch_hint == "up"


# ---- filters, ordering, calibration -------------------------------------------------------------------------------

def test_quantiles_match_percentile(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random() * 100, 50.0, 0.0])) for k in range(5) for _ in range(rng.randint(1, 300))]
    df = spark.createDataFrame(rows, "k int, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.k: [r.a, r.b, r.c, r.d, r.e] for r in ordering.grouped_quantiles(df, ["k"], "v", probs, F.floor("v").cast("int")).collect()}
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("p")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_previous_row_across_cells(spark):
    rows = [("h" if i % 3 else f"k{i}", i * 600_000 + (i % 2), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts long, ord long")
    want, last = [], {}
    for k, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want.append((k, i, last.get(k)))
        last[k] = i
    for cell_ms in (1000, 3_600_000, 1 << 40):
        got = [(r.k, r.ord, r.prev.ord if r.prev else None) for r in ordering.with_previous(df, ["k"], "ts", ["ord"], ["ord"], cell_ms).collect()]
        assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_filters_and_presets(spark):
    rows = [("a", "Alpha", "s1", 5, 10, dt.date(2024, 1, 5), 3, 2.0), ("b", "beta", "s2", 0, 0, dt.date(2024, 1, 30), 0, 0.0),
            ("c", "Beta", "s1", 1, 4, dt.date(2024, 1, 29), 1, 0.2)]
    df = spark.createDataFrame(rows, "session_id string, project string, source string, messages long, output_tokens long, end_date date, user_messages long, cost double")
    day = dt.date(2024, 1, 31)

    def ids(f):
        return sorted(r.session_id for r in filters.select_sessions(df, f, day).collect())

    assert ids(filters.Filters()) == ["a", "c"] and ids(filters.Filters(hide_empty=False)) == ["a", "b", "c"]
    assert ids(filters.Filters(days=7)) == ["c"] and ids(filters.Filters(project=" bet ")) == ["c"]


def test_top_with_other(spark):
    df = spark.createDataFrame([(f"n{i}", float(i)) for i in range(12)], "name string, size double")
    got = {r.name: r["size"] for r in filters.top_with_other(df, "name", "size").collect()}
    assert got["Other (3)"] == 6.0 and len(got) == 9
    few = df.where("size < 10 AND size > 0")
    assert filters.top_with_other(few, "name", "size").count() == 9


def test_calendar_starts_on_a_monday(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, 30), 4), (dt.date(2024, 1, 31), 8)], "day date, messages long")
    rows = {str(r.day): r.intensity for r in series.activity_calendar(daily, dt.date(2024, 1, 31)).collect()}
    assert min(rows) == "2023-01-30" and rows["2024-01-31"] == 1.0 and rows["2024-01-30"] == 0.5


def test_degraded_blocks_stay_out_of_the_model_table(spark):
    df = spark.createDataFrame([("screen_text", "m", "x" * 40, 10, False), ("screen_text", "m", "x" * 40, 5, True)],
                               "category string, model string, payload string, tokens long, degraded boolean")
    assert calibration.chars_per_token(df).first().n == 2
    assert calibration.chars_per_token_by_model(df).first().weighted == 4.0


def test_empty_plan_history_has_no_tier(spark):
    assert spark.range(1).select(billing.active_tier((), F.current_date()).alias("t")).first().t is None
    assert EngineConfig().plan_history == ()


def test_running_total_over_cells(spark):
    """Sums follow the order of the rows whatever the width of a cell is; ties are ordered, negative places count."""
    from turnledger.operators.ordering import running_total

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), rng.randint(-40, 40), i, rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, tie long, v long")
    want, total = {}, {"a": 0, "b": 0}
    for k, at, tie, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] += v
        want[tie] = total[k]
    for width in (1, 7, 1000):
        got = running_total(df, ["k"], "at", ["tie"], F.col("v"), "total", width)
        assert got.columns == ["k", "at", "tie", "v", "total"]
        assert {r.tie: r.total for r in got.collect()} == want


def test_category_percent(spark):
    from turnledger.operators import replay

    df = spark.createDataFrame([("s", "thinking", 1), ("s", "screen_text", 7), ("z", "thinking", 0)], "session_id string, category string, output_tokens long")
    got = {(r.session_id, r.category): r.share_pct for r in replay.category_percent(df).collect()}
    assert got == {("s", "thinking"): 13, ("s", "screen_text"): 88, ("z", "thinking"): 0}


def test_names_by_project_and_choice(spark):
    """A session without a project row is left out; repeated names count, and a session counts once."""
    from turnledger.operators import projects

    uses = spark.createDataFrame([("s", "Bash"), ("s", "Bash"), ("t", "Bash"), ("t", "Read"), ("x", "Read")], "session_id string, tool string")
    types = spark.createDataFrame([("s", "explorer"), ("t", None)], "session_id string, type string")
    names = projects.named({"tool": (uses, "tool"), "agent": (types, "type")})
    attributes = spark.createDataFrame([("s", "p"), ("t", "p")], "session_id string, project string")
    got = {tuple(r) for r in projects.name_counts(names, attributes).collect()}
    assert got == {("p", "tool", "Bash", 3), ("p", "tool", "Read", 1), ("p", "agent", "explorer", 1), ("p", "agent", None, 1)}
    got = {tuple(r) for r in projects.selected_names(names, attributes.where("session_id = 's'")).collect()}
    assert got == {("tool", "Bash", 2, 1), ("agent", "explorer", 1, 1)}

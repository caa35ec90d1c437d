"""SQL counterparts of the plan and filter queries (DuckDB dialect)."""

from __future__ import annotations

from turnledger.registry.transcripts_sql import ENTRIES, USAGE
from turnledger.registry.usage_sql import (ALL_CALLS, CLUSTERS, LEDGER, ON, SES_MODEL, SESSION, chain, w, wide)

CUSTOMER_CYCLES = """WITH o AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
pl AS (SELECT account, min(day) AS s, CASE WHEN account % 4 <> 0 THEN max(day) END AS e, account % 50 + 10 AS usd,
  CASE WHEN account % 11 <> 0 THEN account % 7 + 25 END AS bd,
  CASE WHEN account % 5 = 0 THEN 'annual' ELSE 'monthly' END AS cyc FROM o GROUP BY account),
k AS (SELECT *, coalesce(e, DATE '2001-01-01') AS le, unnest(range(CASE WHEN bd IS NULL THEN 1 ELSE CAST(
   date_diff('month', date_trunc('month', s), date_trunc('month', coalesce(e, DATE '2001-01-01'))) AS BIGINT) + 1 END)) AS i FROM pl),
m AS (SELECT *, CAST(date_trunc('month', s) + to_months(CAST(i AS INT)) AS DATE) AS m0,
  CAST(date_trunc('month', s) + to_months(CAST(i + 1 AS INT)) AS DATE) AS m1 FROM k),
b AS (SELECT *, CASE WHEN i = 0 THEN s ELSE m0 + CAST(least(bd, day(last_day(m0))) - 1 AS INT) END AS cs,
  CASE WHEN bd IS NULL THEN le ELSE least(m1 + CAST(least(bd, day(last_day(m1))) - 1 AS INT) - 1, le) END AS ce FROM m),
c AS (SELECT account, CAST(i AS INT) AS cycle_ord, 'Plan ' || (account % 3) || CASE WHEN cyc = 'annual' THEN ' (annual)' ELSE '' END AS plan,
  cs AS cycle_start, ce AS cycle_end, usd / CASE WHEN cyc = 'annual' THEN 12 ELSE 1 END AS cost_usd,
  e IS NULL AND ce = DATE '2001-01-01' AS is_current FROM b WHERE cs <= ce)
"""

PERIODS = """, cyc(i, plan, tier, s, e, usd, loc, sym, cur) AS (VALUES
 (0, 'Pro', 'Pro', DATE '2023-12-31', DATE '2024-01-09', 20.0::DOUBLE, 18.0::DOUBLE, '€', false),
 (1, 'Max 5x', 'Max 5x', DATE '2024-01-10', DATE '2024-01-19', 100.0, 92.0, '€', false),
 (2, 'Max 20x (annual)', 'Max 20x', DATE '2024-01-20', DATE '2024-01-31', 200.0, NULL, NULL, true)),
pr AS (SELECT cyc.*, date_diff('day', s, e) + 1 AS days,
  coalesce((SELECT sum(c) FROM dc WHERE day BETWEEN s AND e), 0) / 1e9 AS api,
  coalesce((SELECT sum(n) FROM sd WHERE date BETWEEN s AND e), 0) AS n,
  coalesce((SELECT sum(m) FROM sd WHERE date BETWEEN s AND e), 0) AS m,
  (SELECT count(*) FROM sd WHERE date BETWEEN s AND e) AS da,
  (SELECT count(*) FROM cl WHERE CAST(DATE '1970-01-01' + CAST(ts_ms // 86400000 AS INT) AS DATE) BETWEEN s AND e) AS ev,
  loc / usd AS fx FROM cyc),
cb AS (SELECT 12 AS el, 366 AS tot, coalesce((SELECT sum(c) FROM dc WHERE day BETWEEN DATE '2024-01-20' AND DATE '2024-01-31'), 0) / 1e9 AS api,
  coalesce((SELECT sum(n) FROM sd WHERE date BETWEEN DATE '2024-01-20' AND DATE '2024-01-31'), 0) AS n,
  coalesce((SELECT sum(m) FROM sd WHERE date BETWEEN DATE '2024-01-20' AND DATE '2024-01-31'), 0) AS m)"""

SESSION_DAYS = """, sd AS (SELECT date, count(*) AS n, sum(messages) AS m FROM ses GROUP BY date),
dc AS (SELECT day, coalesce(sum(cost_nusd) FILTER (output_tokens > 0), 0) AS c FROM led GROUP BY day)""" + PERIODS


def _windows(calls: str, at: str) -> str:
    return chain(calls) + f""", nxt AS (SELECT start_ms, lead(start_ms) OVER (ORDER BY start_ms) AS e FROM win),
wn AS (SELECT n.start_ms, sum(t.cost_nusd) AS cost FROM ({calls}) t JOIN nxt n ON t.ts_ms >= n.start_ms
  AND (n.e IS NULL OR t.ts_ms < n.e) GROUP BY n.start_ms),
wh AS (SELECT *, CAST(DATE '1970-01-01' + CAST(start_ms // 86400000 AS INT) AS DATE) AS d,
  EXISTS (SELECT 1 FROM cl WHERE cl.{at} >= wn.start_ms AND cl.{at} < wn.start_ms + 18000000) AS hit FROM wn),
wf AS (SELECT *, CASE WHEN d <= DATE '2024-01-09' THEN 1.0::DOUBLE WHEN d <= DATE '2024-01-19' THEN 5.0 ELSE 20.0 END AS f FROM wh),
ap AS (SELECT median(cost / 1e9 / f) FILTER (hit AND cost > 0) AS med, count(*) FILTER (hit AND cost > 0) AS n,
  coalesce(max(cost / 1e9 / f) FILTER (NOT hit AND cost > 0), 0) AS fl FROM wf),
cp AS (SELECT greatest(coalesce(med, 100.0), fl) AS b, * FROM ap),
caps AS (SELECT round_even(b * 1.0 * 100, 0) / 100 AS c1, round_even(b * 5.0 * 100, 0) / 100 AS c5,
  round_even(b * 20.0 * 100, 0) / 100 AS c20 FROM cp)"""

WINDOWS = CLUSTERS + _windows(ALL_CALLS, "ts_ms")

HITS = """, wk AS (SELECT CAST(day - CAST((isodow(day) - 1) AS INT) AS DATE) AS d, sum(cost_nusd) AS cost FROM calls GROUP BY 1),
hw AS (SELECT i, count(*) AS windows,
  count(*) FILTER ((hit AND 1.0 <= f) OR (c1 > 0 AND cost / 1e9 > c1)) AS hits_pro,
  count(*) FILTER ((hit AND 5.0 <= f) OR (c5 > 0 AND cost / 1e9 > c5)) AS hits_max_5x,
  count(*) FILTER ((hit AND 20.0 <= f) OR (c20 > 0 AND cost / 1e9 > c20)) AS hits_max_20x
  FROM wf JOIN cyc ON d BETWEEN s AND e, caps GROUP BY i),
hk AS (SELECT i, count(*) AS weeks, count(*) FILTER (cost / 1e9 > round_even(c1 * 7 * 100, 0) / 100) AS weekly_pro,
  count(*) FILTER (cost / 1e9 > round_even(c5 * 7 * 100, 0) / 100) AS weekly_max_5x,
  count(*) FILTER (cost / 1e9 > round_even(c20 * 7 * 100, 0) / 100) AS weekly_max_20x
  FROM wk JOIN cyc ON d BETWEEN s AND e, caps GROUP BY i),
hh AS (SELECT cyc.i, cyc.s, cyc.plan, cyc.tier, coalesce(windows, 0) AS windows, coalesce(hits_pro, 0) AS hits_pro,
  coalesce(hits_max_5x, 0) AS hits_max_5x, coalesce(hits_max_20x, 0) AS hits_max_20x, coalesce(weeks, 0) AS weeks,
  coalesce(weekly_pro, 0) AS weekly_pro, coalesce(weekly_max_5x, 0) AS weekly_max_5x,
  coalesce(weekly_max_20x, 0) AS weekly_max_20x FROM cyc LEFT JOIN hw USING (i) LEFT JOIN hk USING (i)),
rc AS (SELECT count(*) AS total_cycles, count(*) AS recent_cycles, CAST(sum(windows) AS BIGINT) AS recent_windows,
  CAST(sum(hits_pro) AS BIGINT) AS hp, CAST(sum(hits_max_5x) AS BIGINT) AS h5, CAST(sum(hits_max_20x) AS BIGINT) AS h20,
  CAST(sum(weekly_pro) AS BIGINT) AS wp, CAST(sum(weekly_max_5x) AS BIGINT) AS w5, CAST(sum(weekly_max_20x) AS BIGINT) AS w20 FROM hh),
rr AS (SELECT *, CASE WHEN hp <= 0.05 * recent_windows AND wp <= 1 THEN 'Pro'
  WHEN h5 <= 0.05 * recent_windows AND w5 <= 1 THEN 'Max 5x'
  WHEN h20 <= 0.05 * recent_windows AND w20 <= 1 THEN 'Max 20x' END AS rec FROM rc)"""


def r(body: str, *extra: str) -> str:
    return "WITH RECURSIVE " + LEDGER + "".join(extra) + "\n" + body


def m2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def m1(x: str) -> str:
    return f"round_even(({x}) * 10, 0) / 10"


PLAN = (CLUSTERS, SESSION, SESSION_DAYS)
FULL = (SESSION, WINDOWS, SESSION_DAYS, HITS)

TABLE = f""", st AS (SELECT ses.*, round_even(ses.cost_nusd / 1e5, 0) / 1e4 AS cost,
  round_even((end_ms - start_ms) / 6000.0, 0) / 10 AS duration_min, coalesce(pm, 'Unknown') AS primary_model,
  messages - calls AS user_messages, coalesce(er, 0) AS errors,
  CASE WHEN input_tokens + cache_read + cache_creation > 0
   THEN floor(cache_read / (input_tokens + cache_read + cache_creation) * 100 + 0.5) ELSE 0 END AS eff
  FROM ses LEFT JOIN (SELECT session_id, first(display ORDER BY o DESC, f) AS pm FROM
    (SELECT session_id, display, sum(o) AS o, min(first_ord) AS f FROM sm GROUP BY ALL) GROUP BY session_id) USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS er FROM led WHERE event_type = 'error' GROUP BY session_id) USING (session_id)),
fs AS (SELECT * FROM st WHERE (messages > 0 OR output_tokens > 0) AND end_date >= DATE '2024-01-24' AND contains(lower(project), 'proj1')),
fl AS (SELECT led.* FROM led SEMI JOIN fs USING (session_id) WHERE day >= DATE '2024-01-24'),
fw AS (SELECT led.* FROM led SEMI JOIN fs USING (session_id))"""
TAB = (SESSION, SES_MODEL, TABLE)

# Transcripts: sub-agents that a parent absorbed bring no turns, prompts or banners; their spend is on the parent's days.
SEEN = """SELECT 'all' AS account, sid AS session_id, ts AS ts_ms, cost_nusd,
 CAST(DATE '1970-01-01' + CAST(ts // 86400000 AS INT) AS DATE) AS day FROM turn JOIN own USING (sid) WHERE ts IS NOT NULL AND owner = sid"""
SEEN_EVENTS = """, prm AS (SELECT sid, ord, ts FROM usr JOIN own USING (sid) WHERE category = 'prompt' AND ts IS NOT NULL AND owner = sid),
le AS (SELECT sid, ts, NULL::BIGINT AS g, 'explicit' AS type FROM resp JOIN own USING (sid) WHERE et = 'purchase' AND k % 10 = 0 AND k % 9 IN (0, 7) AND owner = sid
  UNION ALL SELECT sid, ts, g, 'heuristic' FROM (SELECT *, lag(ts) OVER (ORDER BY ts, ord, sid) AS g FROM prm) p
   WHERE ts - g BETWEEN 17100000 AND 19800000 AND EXISTS (SELECT 1 FROM prm x WHERE x.ts >= p.g - 7200000 AND x.ts < p.g)),
lc AS (SELECT *, sum(opens) OVER (ORDER BY ts, type, sid) AS c FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, type, sid) <= 900000 THEN 0 ELSE 1 END AS opens FROM le)),
cl AS (SELECT min(ts) AS ts_ms, coalesce(nullif(arg_min(coalesce(g, -1), (ts, type, sid)), -1), min(ts)) AS at_ms FROM lc GROUP BY c)"""
SEEN_DAYS = """, sd AS (SELECT CAST(DATE '1970-01-01' + CAST(start_ms // 86400000 AS INT) AS DATE) AS date, count(*) AS n, sum(messages) AS m
  FROM cnt JOIN own USING (sid) WHERE owner = sid AND start_ms >= 0 GROUP BY 1),
dc AS (SELECT day, sum(cost) AS c FROM md WHERE messages > 0 OR calls > 0 GROUP BY day)""" + PERIODS
SEEN_PLAN = (ENTRIES, SEEN_EVENTS, USAGE.format(own="owner"), SEEN_DAYS)
SEEN_FULL = (ENTRIES, SEEN_EVENTS, _windows(SEEN, "at_ms"), USAGE.format(own="owner"), SEEN_DAYS, HITS.replace("FROM calls", f"FROM ({SEEN})"))

SQL = {
    "billing_cycles": CUSTOMER_CYCLES + """SELECT account, cycle_ord, plan, CAST(cycle_start AS VARCHAR) AS cycle_start,
     CAST(cycle_end AS VARCHAR) AS cycle_end, round_even(cost_usd * 1e4, 0) / 1e4 AS cost_usd, is_current FROM c""",
    "customer_plan_periods": CUSTOMER_CYCLES + f""", d AS (SELECT account, day,
      sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) * 10000000) AS nusd, count(*) AS n FROM o GROUP BY account, day),
     j AS (SELECT c.account, c.cycle_ord, any_value(plan) AS plan, any_value(cycle_start) AS cs, any_value(cycle_end) AS ce,
      any_value(cost_usd) AS usd, date_diff('day', any_value(cycle_start), any_value(cycle_end)) + 1 AS days,
      count(day) AS da, coalesce(sum(n), 0) AS n, coalesce(sum(nusd), 0) / 1e9 AS api
      FROM c LEFT JOIN d ON c.account = d.account AND day BETWEEN cycle_start AND cycle_end
      WHERE cycle_start <> DATE '2001-01-01' GROUP BY c.account, c.cycle_ord)
     SELECT account, cycle_ord, plan, CAST(cs AS VARCHAR) AS cycle_start, CAST(ce AS VARCHAR) AS cycle_end,
      CAST(days AS INT) AS total_days, da AS days_active, CAST(n AS BIGINT) AS sessions, CAST(n * 3 AS BIGINT) AS messages,
      {m2('api')} AS api_cost, {m2('api - usd')} AS savings, {m1('api / usd')} AS roi_factor, {m2('api / days')} AS cost_per_day
     FROM j""",
    "plan_periods": r(f"""SELECT 'all' AS account, plan, CAST(s AS VARCHAR) AS cycle_start, CAST(e AS VARCHAR) AS cycle_end,
     days AS total_days, da AS days_active, usd AS plan_cost_usd, coalesce(loc, -1.0) AS plan_cost_local,
     coalesce(sym, '') AS currency_symbol, coalesce(pr.fx, -1.0) AS fx, {m2('pr.api')} AS api_cost, {m2('pr.api - usd')} AS savings,
     {m1('pr.api / usd')} AS roi_factor, CAST(pr.n AS BIGINT) AS sessions, CAST(pr.m AS BIGINT) AS messages,
     {m2('pr.api / days')} AS cost_per_day, coalesce({m2('pr.api * fx')}, -1.0) AS api_cost_local,
     coalesce({m2('(pr.api - usd) * fx')}, -1.0) AS savings_local, coalesce({m2('pr.api / days * fx')}, -1.0) AS cost_per_day_local,
     cur AS is_current, ev AS limit_event_count, CASE WHEN cur THEN '2025-01-19' ELSE '' END AS period_end_full,
     CAST(CASE WHEN cur THEN 366 ELSE -1 END AS BIGINT) AS days_total_full, CAST(CASE WHEN cur THEN 12 ELSE -1 END AS BIGINT) AS days_elapsed,
     CASE WHEN cur THEN {m1('cb.api / el * tot / 2400.0')} ELSE -1.0 END AS projected_roi FROM pr, cb""", *PLAN),
    "current_billing": r(f"""SELECT 'all' AS account, 'Max 20x' AS plan, '2024-01-20' AS period_start, '2025-01-20' AS period_end,
     CAST(el AS BIGINT) AS days_elapsed, CAST(tot AS BIGINT) AS days_total, CAST(tot - el AS BIGINT) AS days_remaining,
     2400.0::DOUBLE AS plan_cost_usd, -1.0::DOUBLE AS plan_cost_local, '' AS currency_symbol, {m2('api')} AS api_cost,
     {m2('api / el * tot')} AS projected_cost, {m2('api - 2400.0')} AS savings, {m1('api / 2400.0')} AS roi_factor,
     {m1('api / el * tot / 2400.0')} AS projected_roi, CAST(n AS BIGINT) AS sessions, CAST(m AS BIGINT) AS messages,
     {m2('api / el')} AS cost_per_day, -1.0::DOUBLE AS api_cost_local, -1.0::DOUBLE AS projected_cost_local,
     -1.0::DOUBLE AS savings_local, -1.0::DOUBLE AS cost_per_day_local FROM cb""", *PLAN),
    "plan_totals": r(f"""SELECT 'all' AS account, {m2('a')} AS total_api_cost, {m2('p')} AS total_plan_cost, {m2('a - p')} AS total_savings,
     {m1('a / p')} AS overall_roi, {m2('al')} AS total_api_cost_local, {m2('pl')} AS total_plan_cost_local,
     {m2('al - pl')} AS total_savings_local, '€' AS currency_symbol FROM
     (SELECT sum({m2('api')}) AS a, sum(usd) AS p, sum(coalesce({m2('api * fx')}, 0)) AS al, sum(coalesce(loc, 0)) AS pl FROM pr)""", *PLAN),
    "tier_caps": r(f"""SELECT 'all' AS account, c1 AS cap_pro, c5 AS cap_max_5x, c20 AS cap_max_20x, {m2('b')} AS base_pro_usd,
     n AS anchor_windows, CASE WHEN n > 0 THEN 'empirical' ELSE 'default' END AS cap_source, {m2('fl')} AS floor_pro_usd,
     fl > coalesce(med, 100.0) AS floor_applied FROM cp, caps""", WINDOWS),
    "tier_caps_override": r(f"""SELECT 'all' AS account, 7.5::DOUBLE AS cap_pro, 37.5::DOUBLE AS cap_max_5x, 150.0::DOUBLE AS cap_max_20x,
     7.5::DOUBLE AS base_pro_usd, CAST(0 AS BIGINT) AS anchor_windows, 'config_override' AS cap_source, {m2('fl')} AS floor_pro_usd,
     false AS floor_applied FROM cp""", WINDOWS),
    "tier_hits_by_cycle": r("""SELECT 'all' AS account, i AS plan_ord, 0 AS cycle_ord, windows, hits_pro, hits_max_5x, hits_max_20x,
     weeks, weekly_pro, weekly_max_5x, weekly_max_20x FROM hh WHERE windows > 0""", *FULL),
    "plan_recommendation": r("""SELECT 'all' AS account, total_cycles, recent_cycles, recent_windows, hp AS recent_hits_pro,
     h5 AS recent_hits_max_5x, h20 AS recent_hits_max_20x, wp AS recent_weekly_pro, w5 AS recent_weekly_max_5x,
     w20 AS recent_weekly_max_20x, hp AS total_hits_pro, h5 AS total_hits_max_5x, h20 AS total_hits_max_20x,
     wp AS total_weekly_pro, w5 AS total_weekly_max_5x, w20 AS total_weekly_max_20x, coalesce(rec, '') AS recommended_tier,
     'Max 20x' AS current_tier FROM rr""", *FULL),
    "switch_hints": r("""SELECT CAST(s AS VARCHAR) AS cycle_start, strftime(s, '%Y-%m') || ' · ' || plan AS label, tier AS active_tier,
     coalesce(rec, '') AS recommended_tier, windows, weeks,
     CASE WHEN hits_pro <= 0 THEN 'h0' WHEN hits_pro <= 2 THEN 'h1' WHEN hits_pro <= 9 THEN 'h2' ELSE 'h3' END AS severity_pro,
     CASE WHEN rec IS NULL OR rec = tier THEN ''
      WHEN list_position(['Pro', 'Max 5x', 'Max 20x'], rec) < list_position(['Pro', 'Max 5x', 'Max 20x'], tier)
       THEN CASE WHEN CASE rec WHEN 'Pro' THEN hits_pro WHEN 'Max 5x' THEN hits_max_5x ELSE hits_max_20x END <= 0.05 * windows
         AND CASE rec WHEN 'Pro' THEN weekly_pro WHEN 'Max 5x' THEN weekly_max_5x ELSE weekly_max_20x END <= 1 THEN 'down' ELSE '' END
      ELSE CASE WHEN CASE tier WHEN 'Pro' THEN hits_pro WHEN 'Max 5x' THEN hits_max_5x ELSE hits_max_20x END <= 0.05 * windows
         AND CASE tier WHEN 'Pro' THEN weekly_pro WHEN 'Max 5x' THEN weekly_max_5x ELSE weekly_max_20x END <= 1 THEN '' ELSE 'up' END
      END AS switch_hint FROM hh, rr""", *FULL),
    "plan_display_facts": r(f"""SELECT 'all' AS account, round_even(s / a * 1000, 0) / 10 AS savings_pct,
     least(100.0, round_even(12 / 366 * 100, 0)) AS progress_pct FROM (SELECT sum({m2('api - usd')}) AS s, sum({m2('api')}) AS a FROM pr)""", *PLAN),
    "limit_event_positions": r("""SELECT ord, CAST(s AS VARCHAR) AS cycle_start, round_even(greatest(0.0, least(100.0,
     (ts_ms - date_diff('day', DATE '1970-01-01', s) * 86400000) * 100 / greatest(1, date_diff('day', s, e) * 86400000))) * 100, 0) / 100
     AS position_pct FROM cl JOIN cyc ON CAST(DATE '1970-01-01' + CAST(ts_ms // 86400000 AS INT) AS DATE) BETWEEN s AND e""", *PLAN),
    "plan_cost_prorated": r(f"""SELECT 'all' AS account, {m2('sum(usd * f)')} AS plan_cost_usd, {m2('sum(coalesce(loc, usd * 0.92) * f)')} AS plan_cost_local
     FROM (SELECT usd, loc, least(1.0, (date_diff('day', greatest(s, lo), least(e, hi)) + 1) / td) AS f FROM
      (SELECT s, e, usd, loc, days AS td FROM pr UNION ALL SELECT DATE '2024-01-20', DATE '2025-01-20', 2400.0, NULL, 366),
      (SELECT min(day) AS lo, max(day) AS hi FROM dc WHERE day >= DATE '2024-01-14') WHERE e >= lo AND s <= hi)""", *PLAN),
    "fx_converted_cumulative": r("""SELECT 'all' AS account, CAST(day AS VARCHAR) AS day, round_even(sum(c / 1e9 *
     CASE WHEN day <= DATE '2024-01-09' THEN 0.9 ELSE 0.92 END) OVER (ORDER BY day) * 100, 0) / 100 AS cost_local FROM dc""", *PLAN),
    "session_table": w("""SELECT session_id, source, project, start_ms, end_ms, messages, calls, CAST(cost_nusd AS BIGINT) AS cost_nusd,
     CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(cache_read AS BIGINT) AS cache_read,
     CAST(cache_creation AS BIGINT) AS cache_creation, CAST(cache_1h AS BIGINT) AS cache_1h, CAST(tool_calls AS BIGINT) AS tool_calls,
     primary_model, CAST(active_days AS INT) AS active_days, CAST(date AS VARCHAR) AS date, CAST(end_date AS VARCHAR) AS end_date,
     duration_min, errors, cost, user_messages, CAST(0 AS BIGINT) AS agent_dispatches, 'Work on ' || project AS first_prompt FROM st""", *TAB),
    "range_filtered_kpis": w("""SELECT (SELECT round_even(sum(cost_nusd) FILTER (output_tokens > 0) / 1e7, 0) / 100 FROM fl) AS total_cost,
     count(*) AS total_sessions, CAST(sum(messages) AS BIGINT) AS total_messages, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
     CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(min(date) AS VARCHAR) AS first_day, CAST(max(date) AS VARCHAR) AS last_day FROM fs""", *TAB),
    "range_filtered_daily": wide("cost_nusd", "round_even({} / 1e5, 0) / 1e4").replace("FROM led GROUP BY day", "FROM fl GROUP BY day")
        .replace(LEDGER, LEDGER + "".join(TAB)),
    "range_filtered_messages": w("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS messages, count(DISTINCT session_id) AS sessions
     FROM fl GROUP BY day""", *TAB),
    "range_filtered_models": w("""SELECT display AS model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
     CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
     CAST(sum(cache_creation) AS BIGINT) AS cache_creation, round_even(sum(cost_nusd) / 1e7, 0) / 100 AS cost
     FROM fw WHERE output_tokens > 0 GROUP BY display""", *TAB),
    "range_filtered_token_cost": w("""SELECT round_even(sum(i * p_in) / 1e7, 0) / 100 AS input,
     round_even(sum(o * p_out) / 1e7, 0) / 100 AS output, round_even(sum(r * p_rd) / 1e7, 0) / 100 AS cache_read,
     round_even(sum((c - least(h, c)) * p_5m + least(h, c) * p_1h) / 1e7, 0) / 100 AS cache_write,
     round_even(sum(r * (p_in - p_rd)) / 1e7, 0) / 100 AS cache_savings
     FROM (SELECT display, p_in, p_out, p_rd, p_5m, p_1h, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read) AS r,
       sum(cache_creation) AS c, sum(cache_1h) AS h FROM fw WHERE output_tokens > 0 GROUP BY ALL)""", *TAB),
    "range_filtered_hours": w("""SELECT CAST(h AS INT) AS hour, count(ord) AS messages FROM range(24) x(h)
     LEFT JOIN fw ON (ts_ms // 3600000) % 24 = h GROUP BY h""", *TAB),
    "attribute_filter": w("""SELECT session_id, project, messages, CAST(cost_nusd AS BIGINT) AS cost_nusd FROM st
     WHERE source = 'src1' AND contains(lower(first_prompt), 'proj') AND cost BETWEEN 0.5 AND 30.0 AND messages >= 8 AND eff BETWEEN 90 AND 100
    """.replace("contains(lower(first_prompt), 'proj')", "contains(lower(project), 'proj')"), *TAB),
    "attribute_ranges": w("""SELECT a AS attribute, 0.0::DOUBLE AS low, CAST(CASE WHEN a = 'cache_eff' THEN 100.0
      WHEN a = 'cost' AND greatest(1.0, ceil(p * 100) / 100) <= 1 THEN 1.0
      ELSE (SELECT min(s) FROM (VALUES (1), (2), (5), (10), (20), (50), (100), (200), (500), (1000), (2000), (5000), (10000), (20000), (50000),
       (100000), (200000), (500000), (1000000), (2000000), (5000000), (10000000)) v(s)
       WHERE s >= CASE WHEN a = 'cost' THEN ceil(p * 100) / 100 WHEN p = 0 THEN 1.0 ELSE p END) END AS DOUBLE) AS high
     FROM (SELECT a, quantile_cont(v, 0.99) AS p FROM (
      SELECT unnest(['user_messages', 'messages', 'duration_min', 'total_tokens', 'cost', 'cache_eff', 'tool_calls', 'agent_dispatches', 'errors']) AS a,
       unnest([CAST(user_messages AS DOUBLE), messages, duration_min, input_tokens + cache_read + cache_creation + output_tokens, cost, eff,
        tool_calls, 0, errors]) AS v FROM st) GROUP BY a)""", *TAB),
    "sorted_page": w("""SELECT session_id, CAST(tool_calls AS BIGINT) AS tool_calls, start_ms FROM st
     ORDER BY tool_calls DESC, start_ms DESC, session_id LIMIT 50 OFFSET 50""", *TAB),
    "sorted_page_cache_eff": w("""SELECT session_id, CAST(cache_read AS BIGINT) AS cache_read, start_ms FROM st
     ORDER BY CASE WHEN input_tokens + cache_read + cache_creation > 0 THEN cache_read / (input_tokens + cache_read + cache_creation) ELSE -1 END,
      start_ms DESC, session_id LIMIT 25""", *TAB),
    "anonymized_projects": w("""SELECT 'Project ' || p AS project, 'Source ' || s AS source, count(*) AS sessions,
     CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd FROM (SELECT *, dense_rank() OVER (ORDER BY project) AS p,
      dense_rank() OVER (ORDER BY source) AS s FROM ses) GROUP BY p, s""", SESSION),
    "storage_top": """WITH d AS (SELECT source || '/' || lang AS name, round_even(sum(n_chars) / 1000.0 * 100, 0) / 100 AS v FROM documents GROUP BY 1),
     k AS (SELECT *, row_number() OVER (ORDER BY v DESC, name) AS rn, count(*) OVER () AS n FROM d WHERE v >= 0.1)
     SELECT CASE WHEN n > 9 AND rn > 8 THEN 'Other (' || (n - 8) || ')' ELSE name END AS name,
      CASE WHEN bool_and(n > 9 AND rn > 8) THEN round_even(sum(v) * 10, 0) / 10 ELSE sum(v) END AS size_mb FROM k GROUP BY 1""",
}

# The same selections over what transcripts give.
for _name in ("plan_periods", "current_billing"):
    SQL[f"transcript_{_name}"] = r(SQL[_name].removeprefix(r("", *PLAN)), *SEEN_PLAN)
for _name, _parts in (("tier_caps", (WINDOWS,)), ("tier_hits_by_cycle", FULL), ("plan_recommendation", FULL)):
    SQL[f"transcript_{_name.removesuffix('_by_cycle')}"] = r(SQL[_name].removeprefix(r("", *_parts)), *SEEN_FULL)

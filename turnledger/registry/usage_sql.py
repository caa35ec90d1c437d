"""SQL counterparts of the ledger queries (DuckDB dialect)."""

from __future__ import annotations

LEDGER = """ev AS (
 SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k,
        epoch_us(ts) // 1000 AS ts_ms, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS dayno FROM events),
raw AS (
 SELECT 'u' || user_id || '_' || CAST(floor(dayno / 5) AS INT) AS session_id, 'src' || (user_id % 3) AS source,
  'proj' || (user_id % 7) AS project, user_id AS account, event_id AS ord, ts_ms, event_type, k,
  CAST(DATE '1970-01-01' + CAST(ts_ms // 86400000 AS INT) AS DATE) AS day,
  CASE k % 5 WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'claude-sonnet-4-6' WHEN 2 THEN 'claude-haiku-4-5-20251001'
             WHEN 3 THEN 'claude-opus-4-8[1m]' ELSE 'claude-nova-9' END AS model,
  CAST(10 + k AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 2000 + k * 2500 END AS BIGINT) AS cache_read,
  CAST(CASE WHEN k % 4 = 0 THEN 5000 + k * 10 ELSE 100 + k END AS BIGINT) AS cache_creation,
  CAST(CASE WHEN k % 2 = 0 THEN 50 ELSE 0 END AS BIGINT) AS cache_1h, k % 6 AS n_tools FROM ev),
prices(model, display, p_in, p_out, p_rd, p_5m, p_1h) AS (VALUES
  ('claude-opus-4-8', 'Opus 4.8', 5000, 25000, 500, 6250, 10000),
  ('claude-opus-4-8[1m]', 'Opus 4.8', 5000, 25000, 500, 6250, 10000),
  ('claude-sonnet-4-6', 'Sonnet 4.6', 3000, 15000, 300, 3750, 6000),
  ('claude-haiku-4-5-20251001', 'Haiku 4.5', 1000, 5000, 100, 1250, 2000),
  ('claude-nova-9', 'Nova 9', 3000, 15000, 300, 3750, 6000)),
led AS (
 SELECT raw.*, display, p_in, p_out, p_rd, p_5m, p_1h, least(cache_1h, cache_creation) AS w1h,
  CAST(input_tokens * p_in + output_tokens * p_out + cache_read * p_rd
   + (cache_creation - least(cache_1h, cache_creation)) * p_5m + least(cache_1h, cache_creation) * p_1h AS BIGINT)
   AS cost_nusd FROM raw JOIN prices USING (model)),
calls AS (SELECT * FROM led WHERE output_tokens > 0)"""

TOOLCALLS = """, tc AS (
 SELECT led.*, pos, CASE (k + pos) % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' ELSE 'Grep' END AS tool
 FROM led CROSS JOIN (VALUES (0), (1), (2), (3), (4)) p(pos) WHERE pos < n_tools)"""

TOOLSPLIT = TOOLCALLS + """, tt AS (
 SELECT ord, session_id, tool, count(*) AS c, min(pos) AS p0, any_value(n_tools) AS n,
  any_value(output_tokens) AS o, any_value(cost_nusd) AS cost FROM tc GROUP BY ord, session_id, tool),
tr AS (SELECT *, round_even(o * c / n, 0) AS t, round_even(cost * c / n, 0) AS m,
  row_number() OVER (PARTITION BY ord ORDER BY p0 DESC) AS back FROM tt),
ts AS (SELECT ord, session_id, tool, c, o,
  CASE WHEN back = 1 THEN o - (sum(t) OVER (PARTITION BY ord) - t) ELSE t END AS tokens,
  CASE WHEN back = 1 THEN cost - (sum(m) OVER (PARTITION BY ord) - m) ELSE m END AS money FROM tr)"""

ERRORS = """, er AS (
 SELECT event_id, user_id, ts_ms,
  CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Edit' ELSE 'Grep' END AS tool,
  CASE k % 12 WHEN 0 THEN 'user' WHEN 1 THEN 'user' WHEN 2 THEN 'hook' ELSE 'tool' END AS source,
  CASE k % 12 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'rejected' WHEN 2 THEN 'hook_error' WHEN 3 THEN 'edit_no_match'
   WHEN 4 THEN 'edit_not_unique' WHEN 5 THEN 'stale_read' WHEN 6 THEN 'file_not_found' WHEN 7 THEN 'command_not_found'
   WHEN 8 THEN 'permission_denied' WHEN 9 THEN 'timeout' WHEN 10 THEN 'exit_code'
   ELSE CASE WHEN k % 4 = 2 THEN 'edit_failed' ELSE 'other' END END AS category,
  CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN 'rejected' WHEN 2 THEN 'hook' ELSE 'tool' END AS counted_as
 FROM ev WHERE event_type = 'error')"""

CHAT = """WITH chat AS (
 SELECT 'c' || conv_id AS session_id, turn AS ord, 1704067200000 + conv_id * 3600000 + turn * 60000 AS ts_ms,
  CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS type, role = 'system' AS is_meta,
  CASE WHEN role = 'user' AND (conv_id * 7 + turn) % 11 = 3
         THEN '<command-name>compact</command-name><command-args>now</command-args>'
       WHEN role = 'user' AND (conv_id * 7 + turn) % 11 = 5 THEN '[Request interrupted by user]' ELSE text END AS text
 FROM conversations),
cat AS (SELECT *, CASE WHEN type = 'assistant' THEN 'assistant'
  WHEN starts_with(ltrim(text), '<command') OR starts_with(ltrim(text), '<local-command') THEN 'command'
  WHEN starts_with(ltrim(text), '[Request interrupted') THEN 'interrupt'
  WHEN is_meta OR trim(text) = '' THEN 'meta' ELSE 'prompt' END AS category FROM chat)
"""

SUMS = ("CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
        "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read, "
        "CAST(sum(cache_creation) AS BIGINT) AS cache_creation")
ON = "FILTER (output_tokens > 0)"

SESSION = f""", ses AS (
 SELECT session_id, source, project, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS messages,
  count(*) {ON} AS calls, coalesce(sum(cost_nusd) {ON}, 0) AS cost_nusd,
  coalesce(sum(input_tokens) {ON}, 0) AS input_tokens, sum(output_tokens) AS output_tokens,
  coalesce(sum(cache_read) {ON}, 0) AS cache_read, coalesce(sum(cache_creation) {ON}, 0) AS cache_creation,
  coalesce(sum(cache_1h) {ON}, 0) AS cache_1h, coalesce(sum(n_tools) {ON}, 0) AS tool_calls,
  count(DISTINCT day) AS active_days, min(day) AS date, max(day) AS end_date FROM led
 GROUP BY session_id, source, project)"""

SES_MODEL = """, sm AS (
 SELECT session_id, model, any_value(display) AS display, count(*) AS calls, min(ord) AS first_ord,
  sum(output_tokens) AS o, sum(input_tokens) AS i, sum(cache_read) AS r, sum(cost_nusd) AS c
 FROM calls GROUP BY session_id, model)"""


def w(body: str, *extra: str) -> str:
    return "WITH " + LEDGER + "".join(extra) + "\n" + body


def wide(value: str, shape: str) -> str:
    cols = ", ".join(f"""{shape.format(f"coalesce(sum({value}) FILTER (display = '{m}' AND output_tokens > 0), 0)")} AS "{m}\""""
                     for m in ("Haiku 4.5", "Nova 9", "Opus 4.8", "Sonnet 4.6"))
    total = shape.format(f"coalesce(sum({value}) FILTER (output_tokens > 0), 0)")
    return w(f"SELECT CAST(day AS VARCHAR) AS day, {cols}, {total} AS total FROM led GROUP BY day")


BOX = """, eff AS (
 SELECT session_id, day, sum(cache_read) FILTER (output_tokens > 0) / sum(input_tokens + cache_read + cache_creation)
   FILTER (output_tokens > 0) * 100 AS e FROM led GROUP BY session_id, day
 HAVING count(*) >= 3 AND sum(input_tokens + cache_read + cache_creation) FILTER (output_tokens > 0) > 0),
q AS (SELECT day, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS med, quantile_cont(e, 0.75) AS q3
 FROM eff GROUP BY day),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


def r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


FLUSH = """, lagged AS (
 SELECT *, lag(ts_ms) OVER s AS pts, lag(cache_read) OVER s AS pread, count(*) OVER (PARTITION BY session_id) AS nt,
  max(cache_1h) OVER (PARTITION BY session_id) > 0 AS has1h, row_number() OVER s AS rn
 FROM calls WINDOW s AS (PARTITION BY session_id ORDER BY ts_ms, ord)),
built AS (SELECT *, min(CASE WHEN cache_read > cache_creation AND cache_read > 0 THEN rn END)
  OVER (PARTITION BY session_id) AS b FROM lagged),
hist AS (SELECT *, median(CASE WHEN cache_creation > 0 THEN cache_creation END) OVER h AS med,
  count(CASE WHEN cache_creation > 0 THEN 1 END) OVER h AS before
 FROM built WHERE nt >= 3 AND rn > b
 WINDOW h AS (PARTITION BY session_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fl AS (SELECT session_id, day, cache_creation, CASE WHEN ts_ms - pts >= CASE WHEN has1h THEN 3600000 ELSE 300000 END
   THEN 'gap' WHEN pread > 0 AND cache_read < 0.5 * pread THEN 'nogap' END AS kind
 FROM hist WHERE before + CASE WHEN cache_creation > 0 THEN 1 ELSE 0 END >= 3
  AND cache_creation > 2 * greatest(coalesce(med, 0), 100)),
flc AS (SELECT s.session_id, count(*) FILTER (kind = 'gap') AS gap_flushes,
  count(*) FILTER (kind = 'nogap') AS nogap_flushes,
  CAST(coalesce(sum(cache_creation) FILTER (kind = 'nogap'), 0) AS BIGINT) AS nogap_rewrite_tokens
 FROM (SELECT DISTINCT session_id FROM led) s LEFT JOIN fl USING (session_id) GROUP BY s.session_id)"""

IDLE = """, g AS (SELECT session_id, cache_creation AS cc, ts_ms - lag(ts_ms) OVER
   (PARTITION BY session_id ORDER BY ts_ms, ord) AS gap FROM calls),
gk AS (SELECT *, CASE WHEN gap IS NULL THEN 'first' WHEN gap < 300000 THEN 'short' WHEN gap < 3600000 THEN 'mid'
  ELSE 'long' END AS kind FROM g),
base AS (SELECT session_id, count(*) AS n, sum(cc) AS total,
  CAST(floor(coalesce(quantile_cont(cc, 0.5) FILTER (kind = 'short'), quantile_cont(cc, 0.5) FILTER (cc > 0), 0))
   AS BIGINT) AS baseline FROM gk GROUP BY session_id HAVING count(*) >= 2),
idle AS (SELECT gk.session_id, count(*) FILTER (kind = 'short') AS short_count, count(*) FILTER (kind = 'mid') AS mid_count,
  count(*) FILTER (kind = 'long') AS long_count,
  CAST(coalesce(sum(cc) FILTER (kind = 'short'), 0) AS BIGINT) AS short_tokens,
  CAST(coalesce(sum(cc) FILTER (kind = 'mid'), 0) AS BIGINT) AS mid_tokens,
  CAST(coalesce(sum(cc) FILTER (kind = 'long'), 0) AS BIGINT) AS long_tokens,
  CAST(coalesce(sum(greatest(0, cc - baseline)) FILTER (kind IN ('mid', 'long')), 0) AS BIGINT) AS overspend_tokens,
  any_value(baseline) AS baseline_tokens, any_value(total) AS total
 FROM gk JOIN base USING (session_id) GROUP BY gk.session_id)"""


def chain(source: str) -> str:
    """Anchored windows as a recursive walk from each account's first turn."""
    return f""", pts AS (SELECT DISTINCT account, ts_ms FROM ({source})),
win(account, start_ms) AS (
 SELECT account, min(ts_ms) FROM pts GROUP BY account
 UNION ALL
 SELECT win.account, (SELECT min(p.ts_ms) FROM pts p WHERE p.account = win.account AND p.ts_ms >= win.start_ms + 18000000)
 FROM win WHERE EXISTS (SELECT 1 FROM pts p WHERE p.account = win.account AND p.ts_ms >= win.start_ms + 18000000))"""


def windows_body(source: str) -> str:
    return chain(source) + f""", nxt AS (SELECT *, lead(start_ms) OVER (PARTITION BY account ORDER BY start_ms) AS e FROM win),
tw AS (SELECT t.*, n.start_ms FROM ({source}) t JOIN nxt n ON t.account = n.account AND t.ts_ms >= n.start_ms
  AND (n.e IS NULL OR t.ts_ms < n.e))
SELECT account, start_ms, max(ts_ms) AS end_ms, CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd, count(*) AS turn_count,
 count(DISTINCT session_id) AS sessions FROM tw GROUP BY account, start_ms"""


def window_query(source: str) -> str:
    return "WITH RECURSIVE " + LEDGER + windows_body(source)


ALL_CALLS = "SELECT * REPLACE ('all' AS account) FROM calls"
CLUSTERS = """, le AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms, ord) <= 900000 THEN 0 ELSE 1 END AS o
  FROM led WHERE event_type = 'error'),
lc AS (SELECT *, sum(o) OVER (ORDER BY ts_ms, ord) AS c FROM le),
cl AS (SELECT min(ts_ms) AS ts_ms, max(ts_ms) AS last_ms, arg_min(ord, ts_ms * 1000000 + ord) AS ord,
  arg_min(session_id, ts_ms * 1000000 + ord) AS session_id, count(*) AS merged_count FROM lc GROUP BY c)"""

SQL = {
    "daily_cost_by_model": wide("cost_nusd", "round_even({} / 1e5, 0) / 1e4"),
    "daily_tokens_by_model": wide("(input_tokens + output_tokens)", "CAST({} AS BIGINT)"),
    "cumulative_cost": w("""SELECT CAST(day AS VARCHAR) AS day, round_even(sum(c) OVER (ORDER BY day) / 1e7, 0) / 100 AS cost
     FROM (SELECT day, coalesce(sum(cost_nusd) FILTER (output_tokens > 0), 0) AS c FROM led GROUP BY day)"""),
    "daily_messages_sessions": w("""SELECT CAST(day AS VARCHAR) AS day, count(*) AS messages,
     count(DISTINCT session_id) AS sessions FROM led GROUP BY day"""),
    "cache_efficiency_boxplot": w(f"""SELECT CAST(day AS VARCHAR) AS day, count(*) AS sessions, {r2('avg(e)')} AS mean,
     {r2('any_value(med)')} AS median, {r2('any_value(q1)')} AS q1, {r2('any_value(q3)')} AS q3,
     {r2('min(e) FILTER (e BETWEEN lo AND hi)')} AS whisker_low, {r2('max(e) FILTER (e BETWEEN lo AND hi)')} AS whisker_high,
     {r2('min(e)')} AS min, {r2('max(e)')} AS max, count(*) FILTER (e < lo OR e > hi) AS outliers
     FROM eff JOIN f USING (day) GROUP BY day""", BOX),
    "cache_efficiency_outliers": w(f"""SELECT CAST(day AS VARCHAR) AS day, session_id, {r2('e')} AS eff
     FROM eff JOIN f USING (day) WHERE e < lo OR e > hi""", BOX),
    "hourly_distribution": w("""SELECT CAST(h AS INT) AS hour, count(ord) AS messages FROM range(24) r(h)
     LEFT JOIN led ON (ts_ms // 3600000) % 24 = h GROUP BY h"""),
    "weekday_distribution": w("""SELECT CAST(d AS INT) AS weekday, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][CAST(d AS INT) + 1] AS day,
     count(ord) AS messages FROM range(7) r(d) LEFT JOIN led ON (isodow(led.day) - 1) = d GROUP BY d"""),
    "session_histograms": w("""SELECT session_id, CAST((ts_ms // 3600000) % 24 AS INT) AS hour,
     CAST(isodow(day) - 1 AS INT) AS weekday, count(*) AS messages FROM led GROUP BY ALL"""),
    "project_rollup": w("""SELECT project, count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages,
     CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
     CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation,
     round_even(sum(cost_nusd) / 1e7, 0) / 100 AS cost,
     array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ses GROUP BY project""", SESSION),
    "model_rollup": w(f"""SELECT display AS model, {SUMS.replace('sum(calls)', 'count(*)')},
     round_even(sum(cost_nusd) / 1e7, 0) / 100 AS cost FROM calls GROUP BY display"""),
    "cost_by_token_type": w("""SELECT round_even(sum(i * p_in) / 1e7, 0) / 100 AS input,
     round_even(sum(o * p_out) / 1e7, 0) / 100 AS output, round_even(sum(r * p_rd) / 1e7, 0) / 100 AS cache_read,
     round_even(sum((c - least(h, c)) * p_5m + least(h, c) * p_1h) / 1e7, 0) / 100 AS cache_write,
     round_even(sum(r * (p_in - p_rd)) / 1e7, 0) / 100 AS cache_savings
     FROM (SELECT display, p_in, p_out, p_rd, p_5m, p_1h, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cache_read) AS r,
       sum(cache_creation) AS c, sum(cache_1h) AS h FROM calls GROUP BY ALL)"""),
    "cache_savings": w("""SELECT display AS model, CAST(sum(cache_read) AS BIGINT) AS cache_read,
     round_even(sum(cache_read * (p_in - p_rd)) / 1e7, 0) / 100 AS savings FROM calls GROUP BY display"""),
    "pricing_warnings": w("""SELECT min(model) AS model_id, display FROM led WHERE starts_with(model, 'claude-')
     AND display = 'Nova 9' GROUP BY display"""),
    "kpi_totals": w("""SELECT round_even(sum(cost_nusd) / 1e7, 0) / 100 AS total_cost, count(*) AS total_sessions,
     CAST(sum(messages) AS BIGINT) AS total_messages, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
     CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(cache_read) AS BIGINT) AS total_cache_read,
     CAST(sum(cache_creation) AS BIGINT) AS total_cache_creation, CAST(min(date) AS VARCHAR) AS first_day,
     CAST(max(end_date) AS VARCHAR) AS last_day, count(DISTINCT project) AS total_projects FROM ses""", SESSION),
    "kpi_derived": w("""SELECT count(*) AS sessions,
     round_even(count(*) / greatest(1, date_diff('day', min(date), max(date)) + 1) * 10, 0) / 10 AS sessions_per_day,
     round_even(sum(messages) / count(*), 0) AS messages_per_session,
     round_even(sum(cache_read) / sum(input_tokens + cache_read + cache_creation) * 100 * 10, 0) / 10 AS cache_hit_pct,
     round_even((sum(cost_nusd) / 1e9 - 2640.0) / (sum(cost_nusd) / 1e9) * 100 * 10, 0) / 10 AS savings_pct FROM ses""", SESSION),
    "rollup_sets": w("""SELECT CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(source) = 0 THEN 'source'
      WHEN grouping(day) = 0 THEN 'day' ELSE 'all' END AS grain,
      coalesce(project, source, CAST(day AS VARCHAR), 'all') AS name, count(*) AS messages,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
      CAST(coalesce(sum(cost_nusd) FILTER (output_tokens > 0), 0) AS BIGINT) AS cost_nusd
      FROM led GROUP BY GROUPING SETS ((), (project), (source), (day))"""),
    "tool_ranking": w("SELECT tool AS name, count(*) AS count FROM tc GROUP BY tool", TOOLCALLS),
    "top_n_tools": w("""SELECT label, CAST(output_tokens AS BIGINT) AS output_tokens FROM (
     (SELECT tool AS label, sum(CASE WHEN o > 0 THEN tokens ELSE 0 END) AS output_tokens FROM ts GROUP BY tool
      ORDER BY 2 DESC, 1 LIMIT 3)
     UNION ALL SELECT 'Reasoning', sum(output_tokens) FROM led WHERE n_tools = 0)""", TOOLSPLIT),
    "tool_error_classification": w("""SELECT event_id, tool, source, category, coalesce(counted_as, '') AS counted_as
     FROM er""", ERRORS),
    "error_summary": w("""SELECT CASE WHEN grouping(counted_as) = 0 THEN 'source' WHEN grouping(tool) = 0 THEN 'tool'
     ELSE 'category' END AS dimension, coalesce(counted_as, tool, category) AS name, count(*) AS count FROM er
     WHERE counted_as IS NOT NULL GROUP BY GROUPING SETS ((counted_as), (tool), (category))""", ERRORS),
    "error_totals": w("""SELECT count(counted_as) AS total_errors, (SELECT count(*) FROM tc) AS tool_calls,
     count(*) FILTER (category = 'cancelled') AS cancelled, count(*) FILTER (category = 'rejected') AS rejected,
     round_even(count(counted_as) / greatest((SELECT count(*) FROM tc), 1) * 100 * 100, 0) / 100 AS error_rate
     FROM er""", TOOLCALLS, ERRORS),
    "daily_error_rate": w("""SELECT CAST(d.day AS VARCHAR) AS day, coalesce(e.n, 0) AS errors, CAST(d.n AS BIGINT) AS calls,
     CASE WHEN d.n > 0 THEN round_even(coalesce(e.n, 0) / d.n * 100 * 10, 0) / 10 ELSE 0.0 END AS error_rate
     FROM (SELECT day, sum(n_tools) AS n FROM led GROUP BY day) d LEFT JOIN
     (SELECT CAST(DATE '1970-01-01' + CAST(ts_ms // 86400000 AS INT) AS DATE) AS day, count(*) AS n FROM er
      WHERE counted_as IS NOT NULL GROUP BY 1) e USING (day)""", ERRORS),
    "activity_calendar": w("""SELECT CAST(s.day AS VARCHAR) AS day, coalesce(m.n, 0) AS messages,
     round_even(coalesce(m.n, 0) / max(coalesce(m.n, 0)) OVER () * 100, 0) / 100 AS intensity
     FROM (SELECT CAST(unnest(generate_series(DATE '2023-01-30', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) s
     LEFT JOIN (SELECT day, count(*) AS n FROM led GROUP BY day) m USING (day)"""),
    "session_facts": w("""SELECT ses.session_id, source, project, start_ms, end_ms, messages, ses.calls,
     CAST(cost_nusd AS BIGINT) AS cost_nusd, CAST(input_tokens AS BIGINT) AS input_tokens,
     CAST(output_tokens AS BIGINT) AS output_tokens, CAST(cache_read AS BIGINT) AS cache_read,
     CAST(cache_creation AS BIGINT) AS cache_creation, CAST(cache_1h AS BIGINT) AS cache_1h,
     CAST(tool_calls AS BIGINT) AS tool_calls, coalesce(pm, 'Unknown') AS primary_model, CAST(active_days AS INT) AS active_days,
     CAST(date AS VARCHAR) AS date, CAST(end_date AS VARCHAR) AS end_date,
     round_even((end_ms - start_ms) / 6000.0, 0) / 10 AS duration_min, round_even(cost_nusd / 1e5, 0) / 1e4 AS cost
     FROM ses LEFT JOIN (SELECT session_id, first(display ORDER BY o DESC, f) AS pm FROM
       (SELECT session_id, display, sum(o) AS o, min(first_ord) AS f FROM sm GROUP BY ALL) GROUP BY session_id) USING (session_id)""",
                       SESSION, SES_MODEL),
    "session_primary_model": w("""SELECT session_id, first(display ORDER BY o DESC, first_ord) AS primary_model,
     CAST(max(o) AS BIGINT) AS output_tokens FROM sm GROUP BY session_id""", SES_MODEL),
    "session_model_breakdown": w("""SELECT session_id, display AS model, CAST(sum(calls) AS BIGINT) AS calls,
     CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(r) AS BIGINT) AS cache_read,
     CAST(sum(c) AS BIGINT) AS cost_nusd FROM sm GROUP BY session_id, display""", SES_MODEL),
    "session_day_split": w(f"""SELECT session_id, CAST(day AS VARCHAR) AS day, count(*) AS messages, count(*) {ON} AS calls,
     CAST(coalesce(sum(cost_nusd) {ON}, 0) AS BIGINT) AS cost_nusd,
     CAST(coalesce(sum(input_tokens) {ON}, 0) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
     CAST(coalesce(sum(cache_read) {ON}, 0) AS BIGINT) AS cache_read,
     CAST(coalesce(sum(cache_creation) {ON}, 0) AS BIGINT) AS cache_creation FROM led GROUP BY session_id, day"""),
    "session_spans": w("""SELECT session_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, CAST(min(day) AS VARCHAR) AS date,
     round_even((max(ts_ms) - min(ts_ms)) / 6000.0, 0) / 10 AS duration_min FROM led GROUP BY session_id"""),
    "entry_classification": CHAT + "SELECT session_id, ord, category FROM cat WHERE type = 'user'",
    "message_counters": CHAT + """SELECT session_id, count(*) FILTER (category = 'prompt') AS prompt,
     count(*) FILTER (category = 'command') AS command, count(*) FILTER (category = 'interrupt') AS interrupt,
     count(*) FILTER (category = 'meta') AS meta, count(*) FILTER (category = 'assistant') AS assistant,
     count(*) FILTER (category IN ('prompt', 'assistant')) AS messages FROM cat GROUP BY session_id""",
    "first_prompts": CHAT + """SELECT session_id, arg_min(substr(text, 1, 200), ord) AS first_prompt FROM chat
     WHERE type = 'user' AND text <> '' AND NOT starts_with(text, '<command') AND NOT starts_with(text, '<local-command')
      AND NOT starts_with(text, '[Request interrupted') GROUP BY session_id""",
    "command_label": CHAT + """SELECT session_id, ord, '/compact now' AS label FROM chat
     WHERE type = 'user' AND starts_with(text, '<command-name>compact')""",
    "api_error_classification": w("""SELECT event_id, CASE k % 9 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server_overload'
     WHEN 2 THEN 'auth' WHEN 3 THEN 'server_error' WHEN 4 THEN 'connection' WHEN 5 THEN 'content_filter'
     WHEN 6 THEN 'invalid_request' WHEN 7 THEN 'rate_limit' ELSE 'other' END AS category,
     k % 9 IN (0, 7) AS is_plan_limit FROM ev WHERE event_type = 'error'"""),
    "error_text_clean": r"""WITH c AS (SELECT doc_id, regexp_replace(replace(replace(regexp_replace(
      chr(27) || '[31m' || text || chr(27) || '[0m' || chr(13) || chr(10) || ' ' || chr(9), '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g'),
      chr(13) || chr(10), chr(10)), chr(13), chr(10)),
      '[\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z', '') AS t
      FROM documents) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest, substr(t, 1, 200) AS message FROM c""",
    "model_display": w("""SELECT model, any_value(display) AS display, any_value(display) <> 'Nova 9' AS priced,
     CAST(any_value(p_in) AS BIGINT) AS p_input, CAST(any_value(p_out) AS BIGINT) AS p_output,
     CAST(any_value(p_rd) AS BIGINT) AS p_read, CAST(any_value(p_5m) AS BIGINT) AS p_write_5m,
     CAST(any_value(p_1h) AS BIGINT) AS p_write_1h, count(*) AS calls FROM led GROUP BY model"""),
    "call_costs": w("SELECT ord, display, cost_nusd FROM led"),
    "tool_token_attribution": w("""SELECT tool, CAST(sum(c) AS BIGINT) AS calls,
     CAST(sum(CASE WHEN o > 0 THEN tokens ELSE 0 END) AS BIGINT) AS output_tokens,
     CAST(sum(CASE WHEN o > 0 THEN money ELSE 0 END) AS BIGINT) AS cost_nusd FROM ts GROUP BY tool""", TOOLSPLIT),
    "session_tool_tokens": w("""SELECT session_id, tool, CAST(sum(c) AS BIGINT) AS calls,
     CAST(sum(CASE WHEN o > 0 THEN tokens ELSE 0 END) AS BIGINT) AS output_tokens,
     CAST(sum(CASE WHEN o > 0 THEN money ELSE 0 END) AS BIGINT) AS cost_nusd FROM ts GROUP BY session_id, tool""", TOOLSPLIT),
    "reasoning_totals": w("""SELECT project, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
     CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd FROM calls WHERE n_tools = 0 GROUP BY project"""),
    "cache_flushes": w("SELECT * FROM flc", FLUSH),
    "daily_flushes": w("""SELECT CAST(date AS VARCHAR) AS date, CAST(sum(gap_flushes) AS BIGINT) AS gap,
     CAST(sum(nogap_flushes) AS BIGINT) AS nogap FROM flc JOIN (SELECT session_id, min(day) AS date FROM led GROUP BY session_id)
     USING (session_id) WHERE gap_flushes > 0 OR nogap_flushes > 0 GROUP BY date""", FLUSH),
    "idle_gaps": w("""SELECT * EXCLUDE (total), CASE WHEN total > 0
     THEN CAST(round_even(overspend_tokens * 100 / total, 0) AS BIGINT) ELSE 0 END AS overspend_pct FROM idle""", IDLE),
    "idle_gap_aggregate": w("""SELECT CAST(o AS BIGINT) AS overspend_tokens, round_even(o * 3.75 / 1e6 * 100, 0) / 100 AS overspend_usd,
     n AS sessions_with_overspend, CAST(f AS BIGINT) AS nogap_flushes, CAST(t AS BIGINT) AS nogap_rewrite_tokens,
     round_even(t * 3.75 / 1e6 * 100, 0) / 100 AS nogap_rewrite_usd FROM
     (SELECT sum(overspend_tokens) AS o, count(*) FILTER (overspend_tokens > 0) AS n FROM idle),
     (SELECT sum(nogap_flushes) AS f, sum(nogap_rewrite_tokens) AS t FROM flc)""", IDLE, FLUSH),
    "long_context": w("""SELECT session_id, max(input_tokens + cache_read + cache_creation) AS peak_context_tokens,
     max(input_tokens + cache_read + cache_creation) > 200000 AS used_long_context,
     coalesce(strftime(make_timestamp(min(ts_ms) FILTER (input_tokens + cache_read + cache_creation > 200000) * 1000),
       '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS first_long_at FROM calls GROUP BY session_id"""),
    "turn_context_flags": w("""SELECT ord, input_tokens + cache_read + cache_creation AS context_tokens,
     input_tokens + cache_read + cache_creation > 200000 AS is_long FROM led"""),
    "cache_efficiency_bands": w("""SELECT session_id, coalesce(round_even(e * 10, 0) / 10, -1.0) AS cache_eff,
     CASE WHEN e IS NULL THEN 'none' WHEN e >= 80 THEN 'good' WHEN e >= 50 THEN 'fair' ELSE 'poor' END AS band FROM
     (SELECT session_id, CASE WHEN input_tokens + cache_read + cache_creation > 0
       THEN cache_read / (input_tokens + cache_read + cache_creation) * 100 END AS e FROM ses)""", SESSION),
    "task_counts": w("""SELECT count(*) AS total, count(*) FILTER (k % 3 = 0) AS completed,
     count(*) FILTER (k % 3 = 1) AS in_progress, count(*) FILTER (k % 3 = 2) AS pending FROM led JOIN
     (SELECT session_id, min(day) AS date FROM led GROUP BY session_id) s USING (session_id)
     WHERE event_type IN ('error', 'purchase') AND date >= DATE '2024-01-16'"""),
    "windows_5h": window_query("SELECT * FROM calls"),
    "windows_5h_single_account": window_query(ALL_CALLS),
    "weekly_buckets": w("""SELECT account, CAST(CAST(day - CAST((isodow(day) - 1 - 1 + 7) % 7 AS INT) AS DATE) AS VARCHAR) AS week,
     max(ts_ms) AS end_ms, CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd, count(*) AS turn_count,
     count(DISTINCT session_id) AS sessions FROM calls GROUP BY ALL"""),
    "limit_event_clusters": w("""SELECT 'all' AS account, last_ms, session_id, ord, ts_ms, 'user_plan_limit' AS subtype,
     merged_count FROM cl""", CLUSTERS),
    "limit_fingerprints": w("""SELECT account, session_id, ts_ms, gap_start_ms,
     CASE WHEN (gap_start_ms // 3600000) % 24 BETWEEN 7 AND 22 AND (ts_ms // 3600000) % 24 BETWEEN 7 AND 22
       AND abs(ts_ms - gap_start_ms - 18000000) <= 900000 THEN 'high' ELSE 'medium' END AS confidence
     FROM (SELECT account, session_id, ts_ms, lag(ts_ms) OVER (PARTITION BY account ORDER BY ts_ms, ord) AS gap_start_ms FROM led) p
     WHERE ts_ms - gap_start_ms BETWEEN 17100000 AND 19800000 AND EXISTS (SELECT 1 FROM led q WHERE q.account = p.account
      AND q.ts_ms >= p.gap_start_ms - 7200000 AND q.ts_ms < p.gap_start_ms)"""),
    "limit_event_window_match": "WITH RECURSIVE " + LEDGER + CLUSTERS + chain(ALL_CALLS) + """
     SELECT cl.ord, cl.ts_ms, coalesce(max(win.start_ms), -1) AS start_ms FROM cl LEFT JOIN win
     ON win.start_ms <= cl.ts_ms AND cl.ts_ms < win.start_ms + 18000000 GROUP BY cl.ord, cl.ts_ms""",
}

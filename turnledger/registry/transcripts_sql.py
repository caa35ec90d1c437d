"""SQL counterparts of the transcript queries, computed from the events table without any JSON (DuckDB dialect)."""

from __future__ import annotations

import datetime as dt

from turnledger.registry.usage import AS_OF
from turnledger.registry.usage_sql import LEDGER, windows_body

# One row per kept entry (merged responses are one entry), numbered as the transcript lines are.
ENTRIES = """, t AS (
 SELECT ord AS eid, account AS usr, session_id AS sid, 'u' || (account - 1) || substr(session_id, strpos(session_id, '_')) AS par,
  account % 5 = 4 AS is_sub, event_type AS et, k, ts_ms AS t0, model, display, p_in, p_out, p_rd, p_5m, p_1h, input_tokens, output_tokens AS o,
  cache_read, cache_creation, cache_1h, cost_nusd, 'dev/proj' || (account % 7) AS proj,
  CASE WHEN k = 99 AND event_type = 'purchase' THEN NULL ELSE ts_ms END AS ts,
  -- Sessions of two files: the second follows the first, where the session has a first one.
  CASE WHEN account % 6 = 1 AND account % 5 <> 4 THEN ord // 2 * 4 + CASE WHEN ord % 2 = 1 AND min(ord % 2) OVER (PARTITION BY session_id) = 0
   THEN 281474976710656 ELSE 0 END ELSE ord * 4 END AS ob,
  ['Read', 'Bash', 'Edit', 'Grep'] AS tl FROM led),
resp AS (SELECT *, ob AS ord, NOT (et = 'purchase' AND k % 10 = 0) AS has_usage,
  CASE WHEN et = 'error' THEN [tl[k % 4 + 1]] WHEN et = 'view' THEN [tl[(k + p) % 4 + 1] for p in range(k % 6)]
   WHEN et = 'click' AND k % 10 < 7 THEN [['Agent', 'Skill', 'Bash', 'Bash', 'Bash', 'Write', 'Read'][k % 10 + 1]] ELSE [] END AS tools,
  CASE WHEN et = 'view' THEN 'Looking at item ' || k WHEN et = 'click' THEN 'Done ' || k WHEN et = 'error' THEN ''
   WHEN k % 10 = 0 THEN ['You''ve hit your limit · resets 6pm', 'API Error: 529 overloaded', 'API Error: 401 run /login',
    'API Error: 500 internal server error', 'Connection error: socket closed', 'Output blocked by content filtering',
    'prompt is too long: 210000 tokens', 'API Error: Rate limit reached', 'unclassified failure'][k % 9 + 1]
   ELSE 'Answer ' || k END AS txt,
  CASE WHEN et = 'click' AND k % 3 = 0 THEN repeat('t', k % 13) END AS think
 FROM t WHERE et IN ('error', 'view', 'click') OR (et = 'purchase' AND k % 10 IN (0, 6, 7, 8, 9))),
usr AS (
 SELECT *, ob AS ord, CASE k % 8 WHEN 0 THEN 'command' WHEN 1 THEN 'interrupt' WHEN 2 THEN 'meta' WHEN 3 THEN 'meta' ELSE 'prompt' END AS category
  FROM t WHERE et = 'signup'
 UNION ALL SELECT *, ob + 1, 'tool_result' FROM t WHERE et = 'error' OR (et = 'view' AND k % 6 > 0)
   OR (et = 'click' AND k % 10 = 0 AND usr % 5 = 3)),
ent AS (SELECT sid, ord, ts, et, k, 'assistant' AS type, 'assistant' AS category, par, is_sub FROM resp
  UNION ALL SELECT sid, ord, ts, et, k, 'user', category, par, is_sub FROM usr),
sess AS (SELECT sid, any_value(par) AS par, any_value(is_sub) AS is_sub, any_value(proj) AS proj, any_value(usr) AS usr FROM t GROUP BY sid),
own AS (SELECT s.*, CASE WHEN s.is_sub AND p.sid IS NOT NULL THEN s.par ELSE s.sid END AS owner FROM sess s LEFT JOIN sess p ON s.par = p.sid),
cnt AS (SELECT s.sid, count(*) FILTER (category = 'prompt') AS prompt, count(*) FILTER (category = 'tool_result') AS tool_result,
  count(*) FILTER (category = 'command') AS command, count(*) FILTER (category = 'interrupt') AS interrupt,
  count(*) FILTER (category = 'meta') AS meta, count(*) FILTER (category = 'assistant') AS assistant,
  count(*) FILTER (category IN ('prompt', 'assistant')) AS messages,
  count(*) FILTER (type = 'user' AND et = 'signup' AND k % 8 = 3) AS compactions,
  coalesce(min(ts), -1) AS start_ms, coalesce(max(ts), -1) AS end_ms FROM sess s LEFT JOIN ent ON ent.sid = s.sid GROUP BY s.sid),
turn AS (SELECT * FROM resp WHERE has_usage AND o > 0),
msgerr AS (SELECT *, CASE WHEN k % 10 = 9 THEN 'unknown' ELSE tl[k % 4 + 1] END AS tool FROM t WHERE et = 'error'),
nerr AS (SELECT sid, ob + 1 AS ord, tool, k, ts,
  CASE k % 12 WHEN 0 THEN 'user' WHEN 1 THEN 'user' WHEN 2 THEN 'hook' ELSE 'tool' END AS source,
  CASE k % 12 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'rejected' WHEN 2 THEN 'hook_error' WHEN 3 THEN 'edit_no_match'
   WHEN 4 THEN 'edit_not_unique' WHEN 5 THEN 'stale_read' WHEN 6 THEN 'file_not_found' WHEN 7 THEN 'command_not_found'
   WHEN 8 THEN 'permission_denied' WHEN 9 THEN 'timeout' WHEN 10 THEN 'exit_code' ELSE CASE WHEN tool = 'Edit' THEN 'edit_failed' ELSE 'other' END END AS category,
  CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN 'rejected' WHEN 2 THEN 'hook' ELSE 'tool' END AS counted_as,
  ['Cancelled: parallel tool call', 'User rejected the edit', 'hook error: exit', 'String to replace not found',
   'Found 3 matches of the string', 'File has not been read yet', 'No such file', 'bash: foo: command not found',
   'Permission denied', 'timed out after 120s', 'Exit code 1', 'unexpected'][k % 12 + 1] AS message FROM msgerr),
berr AS (SELECT sid, ord, '' AS tool, k, ts, 'backend' AS source, CASE k % 9 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server_overload'
   WHEN 2 THEN 'auth' WHEN 3 THEN 'server_error' WHEN 4 THEN 'connection' WHEN 5 THEN 'content_filter'
   WHEN 6 THEN 'invalid_request' WHEN 7 THEN 'rate_limit' ELSE 'other' END AS category, 'backend' AS counted_as, txt AS message
  FROM resp WHERE et = 'purchase' AND k % 10 = 0),
errs AS (SELECT * FROM nerr UNION ALL SELECT * FROM berr),
uses AS (SELECT sid, ord, ts, k, et, usr, is_sub, proj, unnest(tools) AS tool, unnest(range(len(tools))) AS pos FROM resp),
fops AS (SELECT sid, ord, pos, ts, proj, lower(tool) AS op, '/src/f' || (k % 10) || '.py' AS path FROM uses WHERE tool IN ('Read', 'Edit', 'Write')),
gops AS (SELECT sid, ord, 0 AS pos, ts, proj, CASE k % 10 WHEN 2 THEN 'commit' WHEN 3 THEN 'push' ELSE 'pr' END AS kind,
  CASE k % 10 WHEN 2 THEN 'fix ' || k WHEN 3 THEN 'git push origin main' ELSE 'gh pr create --title pr' || k END AS message
  FROM resp WHERE et = 'click' AND k % 10 IN (2, 3, 4)),
disp AS (SELECT sid, ord, CASE WHEN k % 20 = 0 THEN 'explorer' ELSE 'general-purpose' END AS type, 'scan ' || (k % 5) AS description,
  CASE WHEN usr % 5 = 3 THEN 'u' || (usr + 1) || substr(sid, strpos(sid, '_')) ELSE '' END AS agent_id FROM resp WHERE et = 'click' AND k % 10 = 0),
syn AS (SELECT owner AS sid, NULL AS ord, '<unlinked>' AS type, 'worker' AS description, o.sid AS agent_id FROM own o
  WHERE owner <> o.sid AND usr % 10 = 9 AND NOT EXISTS (SELECT 1 FROM disp d WHERE d.sid = o.owner AND d.agent_id = o.sid)),
alld AS (SELECT * FROM disp UNION ALL SELECT * FROM syn)"""

NARRATION = """, nar AS (SELECT *, type = 'assistant' AND coalesce(lead(type) OVER (PARTITION BY sid ORDER BY ord), 'user') = 'assistant' AS is_narration FROM ent),
blk AS (
 SELECT sid, ord, o, 0 AS bp, 'thinking' AS cat, length(think) AS w FROM turn WHERE think IS NOT NULL
 UNION ALL SELECT sid, ord, o, 1, CASE WHEN len(tools) > 0 THEN 'screen_text_narration' ELSE 'screen_text' END, length(txt) FROM turn WHERE et <> 'error'
 UNION ALL SELECT sid, ord, o, 2 + pos, CASE WHEN tool IN ('Write', 'Edit') THEN 'file_writes' WHEN tool = 'Bash' THEN 'bash_commands' ELSE 'tool_inputs' END,
  length(tool) + length(CASE WHEN tool IN ('Read', 'Edit', 'Write') THEN '{"file_path":"/src/f0.py"}' WHEN tool = 'Grep' THEN '{"pattern":"x' || k || '"}'
   WHEN tool = 'Skill' THEN '{"skill":"skill0"}' WHEN tool = 'Agent' AND k % 20 = 0 THEN '{"subagent_type":"explorer","description":"scan 0","prompt":"look around"}'
   WHEN tool = 'Agent' THEN '{"description":"scan 0","prompt":"look around"}' WHEN et <> 'click' THEN '{"command":"make test"}'
   WHEN k % 10 = 2 THEN '{"command":"git commit -m \\"fix ' || k || '\\""}' WHEN k % 10 = 3 THEN '{"command":"git push origin main"}'
   ELSE '{"command":"gh pr create --title pr' || k || '"}' END)
  FROM (SELECT sid, ord, o, k, et, unnest(tools) AS tool, unnest(range(len(tools))) AS pos FROM turn)),
bw AS (SELECT *, sum(w) OVER (PARTITION BY sid, ord) AS tw, row_number() OVER (PARTITION BY sid, ord ORDER BY bp DESC) AS back FROM blk WHERE w > 0),
bs AS (SELECT *, round_even(o * w / tw, 0) AS s FROM bw),
bt AS (SELECT sid, ord, cat, CASE WHEN back = 1 THEN o - (sum(s) OVER (PARTITION BY sid, ord) - s) ELSE s END AS tokens FROM bs),
wc AS (SELECT bt.sid, CASE WHEN cat = 'screen_text' AND is_narration THEN 'screen_text_narration' ELSE cat END AS cat, tokens
  FROM bt JOIN nar USING (sid, ord))"""

MESSAGES = """, modes AS (SELECT sid, ob AS ord, ts, k % 10 = 2 AS is_mode, CASE k % 10 WHEN 2 THEN CASE WHEN k % 20 = 2 THEN 'plan' ELSE 'default' END
    ELSE CASE WHEN k % 20 = 3 THEN 'ask' ELSE 'auto' END END AS v FROM t WHERE et = 'purchase' AND k % 10 IN (2, 3)),
mch AS (SELECT sid, ord, ts, CASE WHEN is_mode THEN 'Mode: ' ELSE 'Permission: ' END || v AS content FROM
  (SELECT *, lag(v) OVER (PARTITION BY sid, is_mode ORDER BY ord) AS pv FROM modes) WHERE pv IS NULL OR pv <> v),
msg AS (
 SELECT sid, ord, ts, CASE k % 8 WHEN 0 THEN 'command' WHEN 1 THEN 'interrupt' WHEN 3 THEN 'compaction' ELSE 'user' END AS role,
  CASE k % 8 WHEN 0 THEN '/compact now' WHEN 1 THEN '[Request interrupted by user]' WHEN 2 THEN 'note' WHEN 3 THEN '' ELSE 'Please fix item ' || k END AS content
  FROM usr WHERE et = 'signup'
 UNION ALL SELECT sid, ord, ts, CASE WHEN category = 'rejected' THEN 'rejected' ELSE 'error' END, message FROM nerr WHERE category <> 'cancelled'
 UNION ALL SELECT sid, ord, ts, CASE WHEN k % 9 IN (0, 7) THEN 'rate_limit' ELSE 'error' END, txt FROM resp WHERE et = 'purchase' AND k % 10 = 0
 UNION ALL SELECT sid, ord, ts, 'assistant', txt FROM resp WHERE NOT (et = 'purchase' AND k % 10 = 0)
 UNION ALL SELECT sid, ob, ts, 'hook', 'h' || (k % 3) FROM t WHERE et = 'purchase' AND k % 10 = 1
 UNION ALL SELECT sid, ob, ts, 'attachment', 'Image' FROM t WHERE et = 'purchase' AND k % 20 = 4
 UNION ALL SELECT sid, ob, ts, 'queue', 'enqueue: later ' || k FROM t WHERE et = 'purchase' AND k % 10 = 5
 UNION ALL SELECT sid, ord, ts, 'mode', content FROM mch),
ans AS (SELECT * FROM resp WHERE NOT (et = 'purchase' AND k % 10 = 0)),
dag AS (SELECT sid, ord, ts, 'subagent-' || (row_number() OVER (PARTITION BY sid ORDER BY ord) - 1) AS node,
  CASE WHEN k % 20 = 0 THEN 'explorer' ELSE 'general-purpose' END AS type, 'scan ' || (k % 5) AS name FROM ans WHERE et = 'click' AND k % 10 = 0)"""

# Spend per owner, with sub-agents added to a parent that exists.
USAGE = """, st AS (SELECT sid AS owner, start_ms FROM cnt WHERE start_ms >= 0),
mr AS (SELECT {own} AS owner, sid, ts, 1 AS m, has_usage AND o > 0 AS c, cost_nusd, input_tokens, o, cache_read, cache_creation FROM resp JOIN own USING (sid)
  UNION ALL SELECT {own}, sid, ts, 1, false, 0, 0, 0, 0, 0 FROM usr JOIN own USING (sid) WHERE category = 'prompt'),
md AS (SELECT mr.owner, CAST(DATE '1970-01-01' + CAST(coalesce(ts, start_ms) // 86400000 AS INT) AS DATE) AS day,
  count(*) FILTER (mr.owner = sid) AS messages, count(*) FILTER (c) AS calls, coalesce(sum(cost_nusd) FILTER (c), 0) AS cost,
  coalesce(sum(input_tokens) FILTER (c), 0) AS i, coalesce(sum(o) FILTER (c), 0) AS o, coalesce(sum(cache_read) FILTER (c), 0) AS r,
  coalesce(sum(cache_creation) FILTER (c), 0) AS w FROM mr JOIN st USING (owner) GROUP BY 1, 2)"""

ROWS = USAGE.format(own="owner") + """, tot AS (SELECT owner AS sid, sum(calls) AS calls, sum(cost) AS cost, sum(i) AS i, sum(o) AS o FROM md WHERE messages > 0 OR calls > 0 GROUP BY owner),
srow AS (SELECT c.sid, own.proj, c.messages, c.prompt, c.assistant, c.compactions, coalesce(tot.calls, 0) AS calls, coalesce(tot.cost, 0) AS cost,
  coalesce(tot.i, 0) AS i, coalesce(tot.o, 0) AS o, (SELECT count(*) FROM errs e WHERE e.sid = c.sid AND counted_as <> '') AS errors,
  (SELECT count(*) FROM uses u WHERE u.sid = c.sid) AS tool_calls, (SELECT count(*) FROM fops u WHERE u.sid = c.sid) AS file_ops,
  (SELECT count(*) FROM gops u WHERE u.sid = c.sid) AS git_ops, (SELECT count(*) FROM alld u WHERE u.sid = c.sid) AS disp,
  c.start_ms, round_even((c.end_ms - c.start_ms) / 6000.0, 0) / 10 AS duration_min, own.usr
  FROM cnt c JOIN own ON own.sid = c.sid LEFT JOIN tot ON tot.sid = c.sid WHERE own.owner = c.sid AND c.start_ms >= 0)"""

NAMES = """, nm AS (SELECT sid, 'tool' AS kind, tool AS name FROM uses UNION ALL SELECT sid, 'skill', 'skill' || (k % 4) FROM uses WHERE tool = 'Skill'
  UNION ALL SELECT sid, 'agent', type FROM alld UNION ALL SELECT sid, 'error', category FROM errs WHERE counted_as <> '')"""

# Sessions of the filtered queries: a week up to the report day, a part of the project's name, not empty.
CHOSEN = f""", chosen AS (SELECT srow.* FROM srow JOIN cnt ON cnt.sid = srow.sid WHERE lower(proj) LIKE '%proj1%' AND (srow.messages > 0 OR o > 0)
  AND DATE '1970-01-01' + CAST(end_ms // 86400000 AS INT) >= DATE '{AS_OF - dt.timedelta(days=7)}')"""

PAYLOADS = """, pay AS (
 SELECT ord, model, 'thinking' AS category, think AS p, 0 AS pos FROM resp WHERE think IS NOT NULL
 UNION ALL SELECT ord, model, 'screen_text', txt, CASE WHEN think IS NOT NULL THEN 1 ELSE 0 END FROM resp WHERE et <> 'error'
 UNION ALL SELECT ord, model, CASE WHEN tool IN ('Write', 'Edit') THEN 'file_writes' WHEN tool = 'Bash' THEN 'bash_commands' ELSE 'tool_inputs' END,
  tool || ' ' || CASE WHEN tool IN ('Read', 'Edit', 'Write') THEN '{"file_path":"/src/f0.py"}' WHEN tool = 'Grep' THEN '{"pattern":"x' || k || '"}'
   WHEN tool = 'Skill' THEN '{"skill":"skill0"}' WHEN tool = 'Agent' AND k % 20 = 0 THEN '{"subagent_type":"explorer","description":"scan 0","prompt":"look around"}'
   WHEN tool = 'Agent' THEN '{"description":"scan 0","prompt":"look around"}' WHEN et <> 'click' THEN '{"command":"make test"}'
   WHEN k % 10 = 2 THEN '{"command":"git commit -m \\"fix ' || k || '\\""}' WHEN k % 10 = 3 THEN '{"command":"git push origin main"}'
   ELSE '{"command":"gh pr create --title pr' || k || '"}' END,
  pos + CASE WHEN et = 'view' THEN 1 WHEN et = 'click' THEN 1 + CASE WHEN think IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END
  FROM (SELECT ord, model, k, et, think, unnest(tools) AS tool, unnest(range(len(tools))) AS pos FROM resp)),
smp AS (SELECT *, length(p) AS chars, CAST(ceil(length(p) / 4) AS BIGINT) + pos AS tok FROM pay WHERE length(p) >= 8)"""


TURNS = "SELECT 'src' || (usr % 3) AS account, sid AS session_id, ts AS ts_ms, cost_nusd FROM turn WHERE ts IS NOT NULL"


def q(body: str, *extra: str) -> str:
    return "WITH " + LEDGER + ENTRIES + "".join(extra) + "\n" + body


def r4(x: str) -> str:
    return f"round_even(({x}) * 1e4, 0) / 1e4"


SPLIT = """SELECT owner AS session_id, CAST(day AS VARCHAR) AS day, messages, calls, CAST(cost AS BIGINT) AS cost_nusd, CAST(i AS BIGINT) AS input_tokens,
 CAST(o AS BIGINT) AS output_tokens, CAST(r AS BIGINT) AS cache_read, CAST(w AS BIGINT) AS cache_creation FROM md WHERE messages > 0 OR calls > 0"""

PROJECT_FACTS = """SELECT proj AS project, count(*) AS sessions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(cost) AS BIGINT) AS cost_nusd,
     CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(file_ops) AS BIGINT) AS file_ops, CAST(sum(git_ops) AS BIGINT) AS git_ops,
     CAST(sum(disp) AS BIGINT) AS agent_dispatches, CAST(sum(i + o) AS BIGINT) AS tokens FROM {rows} GROUP BY proj"""

TOOL_TOKENS = """SELECT sid, tool, sum(c) AS calls, sum(CASE WHEN o > 0 THEN tokens ELSE 0 END) AS ot FROM (
         SELECT *, CASE WHEN row_number() OVER (PARTITION BY sid, ord ORDER BY p0 DESC) = 1 THEN o - (sum(x) OVER (PARTITION BY sid, ord) - x) ELSE x END AS tokens FROM (
          SELECT sid, ord, tool, count(*) AS c, min(pos) AS p0, any_value(o) AS o, round_even(any_value(o) * count(*) / any_value(n), 0) AS x FROM (
           SELECT sid, ord, CASE WHEN has_usage THEN o ELSE 0 END AS o, len(tools) AS n, unnest(tools) AS tool, unnest(range(len(tools))) AS pos FROM resp)
          GROUP BY sid, ord, tool)) GROUP BY sid, tool"""

SQL = {
    "transcript_parse": q("""SELECT type, category, count(*) AS entries, CAST(sum(n) AS BIGINT) AS lines, count(ts) AS dated, CAST(sum(tok) AS BIGINT) AS output_tokens,
     CAST(sum(b) AS BIGINT) AS blocks FROM (
      SELECT 'assistant' AS type, 'assistant' AS category, CASE WHEN et = 'view' THEN 2 ELSE 1 END AS n, ts, CASE WHEN has_usage THEN o ELSE 0 END AS tok,
       len(tools) + CASE WHEN et = 'error' THEN 0 ELSE 1 END + CASE WHEN think IS NOT NULL THEN 1 ELSE 0 END AS b FROM resp
      UNION ALL SELECT 'user', category, 1, ts, 0, CASE WHEN category = 'tool_result' THEN 1 ELSE 0 END FROM usr
      UNION ALL SELECT ['progress', 'mode', 'permission-mode', 'attachment', 'queue-operation'][k % 10], 'other', 1, ts, 0, 0 FROM t
       WHERE et = 'purchase' AND k % 10 BETWEEN 1 AND 5) GROUP BY type, category"""),
    "stream_merge": q("""SELECT sid AS session_id, ord, CAST(CASE WHEN et = 'view' THEN 2 ELSE 1 END AS BIGINT) AS n_lines,
     len(tools) + CASE WHEN et = 'error' THEN 0 ELSE 1 END + CASE WHEN think IS NOT NULL THEN 1 ELSE 0 END AS n_blocks,
     CASE WHEN has_usage THEN o ELSE 0 END AS output_tokens FROM resp"""),
    "session_attributes": q("""SELECT sid AS session_id, proj AS project, 's-' || sid AS slug, 'src' || (usr % 3) AS source, is_sub AS is_subagent,
     CASE WHEN is_sub THEN par ELSE '' END AS parent_id, CASE WHEN is_sub AND usr % 10 = 4 THEN 'explorer' ELSE '' END AS agent_type FROM sess"""),
    "transcript_counters": q("SELECT sid AS session_id, * EXCLUDE (sid) FROM cnt"),
    "transcript_first_prompts": q("""SELECT sid AS session_id, arg_min(CASE k % 8 WHEN 2 THEN 'note' WHEN 3 THEN 'summary' ELSE 'Please fix item ' || k END, ord)
     AS first_prompt FROM usr WHERE et = 'signup' AND k % 8 > 1 GROUP BY sid"""),
    "transcript_usage": q(SPLIT, USAGE.format(own="owner")),
    "transcript_usage_unlinked": q(SPLIT, USAGE.format(own="sid")),
    "subagent_rollup": q("""SELECT owner AS parent_id, own.sid AS session_id, CAST(coalesce(u.tok, 0) AS BIGINT) AS tokens, round_even(coalesce(u.c, 0) / 1e5, 0) / 1e4 AS cost,
     messages, coalesce(n, 0) AS tool_calls FROM own JOIN cnt ON cnt.sid = own.sid LEFT JOIN (SELECT sid, sum(input_tokens + o) AS tok, sum(cost_nusd) AS c FROM turn GROUP BY sid) u ON u.sid = own.sid
     LEFT JOIN (SELECT sid, count(*) AS n FROM uses GROUP BY sid) x ON x.sid = own.sid WHERE owner <> own.sid"""),
    "transcript_errors": q("SELECT sid AS session_id, ord, tool, source, category, counted_as, message FROM errs"),
    "session_error_counters": q("""SELECT sid AS session_id, count(*) FILTER (counted_as <> '') AS errors, count(*) FILTER (category = 'cancelled') AS cancelled,
     count(*) FILTER (counted_as = 'tool') AS tool_errors, count(*) FILTER (counted_as = 'hook') AS hook_errors,
     count(*) FILTER (counted_as = 'backend') AS backend_errors, count(*) FILTER (counted_as = 'rejected') AS rejected_errors FROM errs GROUP BY sid"""),
    "agent_dispatches": q("SELECT sid AS session_id, type, description, agent_id, count(*) AS n FROM alld GROUP BY ALL"),
    "file_operations": q("SELECT sid AS session_id, ord, op, path FROM fops"),
    "git_operations": q("SELECT sid AS session_id, ord, kind, message FROM gops"),
    "git_summary": q("""SELECT count(*) FILTER (kind = 'commit') AS commits, count(*) FILTER (kind = 'push') AS pushes,
     count(*) FILTER (kind = 'pr') AS prs FROM gops"""),
    "skill_ranking": q("SELECT 'skill' || (k % 4) AS name, count(*) AS count FROM uses WHERE tool = 'Skill' GROUP BY 1"),
    "hook_ranking": q("SELECT 'h' || (k % 3) AS name, count(*) AS count FROM t WHERE et = 'purchase' AND k % 10 = 1 GROUP BY 1"),
    "agent_type_ranking": q("SELECT type AS name, count(*) AS count FROM alld GROUP BY 1"),
    "agent_description_ranking": q("SELECT description AS name, count(*) AS count FROM alld GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "narration_reclass": q("SELECT sid AS session_id, ord, is_narration FROM nar WHERE type = 'assistant'", NARRATION),
    "write_category_attribution": q("""SELECT category, CAST(coalesce(s, 0) AS BIGINT) AS output_tokens, round_even(coalesce(s, 0) / sum(s) OVER () * 1e4, 0) / 1e4 AS share
     FROM (VALUES ('screen_text'), ('screen_text_narration'), ('thinking'), ('file_writes'), ('bash_commands'), ('tool_inputs')) c(category)
     LEFT JOIN (SELECT cat, sum(tokens) AS s FROM wc GROUP BY cat) ON cat = category""", NARRATION),
    "session_write_categories": q("""SELECT sid AS session_id, cat AS category, CAST(sum(tokens) AS BIGINT) AS output_tokens FROM wc GROUP BY sid, cat
     HAVING sum(tokens) > 0""", NARRATION),
    "replay_roles": q("SELECT sid AS session_id, role, count(*) AS n FROM msg GROUP BY sid, role", MESSAGES),
    "replay_messages": q("SELECT sid AS session_id, ord, role, content FROM msg WHERE role <> 'mode'", MESSAGES),
    "replay_answers": q("""SELECT sid AS session_id, ord, display, round_even(cost_nusd / 1e5, 0) / 1e4 AS cost, o AS output_tokens, len(tools) AS n_tools,
     coalesce(length(think), 0) AS thinking_chars FROM ans""", MESSAGES),
    "chat_filter": q("""SELECT sid AS session_id, ord, role FROM msg WHERE role IN ('error', 'rate_limit')
     UNION ALL SELECT sid, ord, 'assistant' FROM dag""", MESSAGES),
    "mode_changes": q("SELECT sid AS session_id, ord, content FROM mch", MESSAGES),
    "day_dividers": q("""SELECT sid AS session_id, ord, CAST(day AS VARCHAR) AS day FROM (SELECT *, lag(day) OVER (PARTITION BY sid ORDER BY ord) AS pd FROM
     (SELECT sid, ord, CAST(DATE '1970-01-01' + CAST(ts // 86400000 AS INT) AS DATE) AS day FROM msg WHERE ts IS NOT NULL)) WHERE pd IS NULL OR pd <> day""", MESSAGES),
    "command_output_tokens": q("""SELECT sid AS session_id, ord, '/compact now' AS command, CAST(coalesce((SELECT sum(a.o) FROM ans a WHERE a.sid = m.sid AND a.ord > m.ord
      AND a.ord < coalesce((SELECT min(n.ord) FROM msg n WHERE n.sid = m.sid AND n.ord > m.ord AND n.role IN ('user', 'command')), 9223372036854775807)), 0) AS BIGINT) AS output_tokens
     FROM msg m WHERE role = 'command'""", MESSAGES),
    "flow_nodes": q("""SELECT sid AS session_id, 'main' AS node_id, 'main' AS type, 'Claude' AS name, CAST(coalesce(i, 0) AS BIGINT) AS input_tokens,
      CAST(coalesce(o, 0) AS BIGINT) AS output_tokens, CAST(coalesce(r, 0) AS BIGINT) AS cache_read, CAST(coalesce(w, 0) AS BIGINT) AS cache_creation,
      CAST(coalesce(n, 0) AS BIGINT) AS tool_calls, round_even(coalesce(c, 0) * 1e4, 0) / 1e4 AS cost, 0 AS messages
      FROM (SELECT DISTINCT sid FROM msg) LEFT JOIN (SELECT sid, sum(input_tokens) AS i, sum(o) AS o, sum(cache_read) AS r, sum(cache_creation) AS w,
       sum(len(tools)) AS n, sum(round_even(cost_nusd / 1e5, 0) / 1e4) AS c FROM ans GROUP BY sid) USING (sid)
     UNION ALL SELECT sid, 'user', 'user', 'User', 0, 0, 0, 0, 0, 0, count(*) FILTER (role = 'user') FROM msg GROUP BY sid
     UNION ALL SELECT sid, node, type, name, 0, 0, 0, 0, 0, 0, 0 FROM dag""", MESSAGES),
    "flow_edges": q("""SELECT DISTINCT sid AS session_id, 'user' AS src, 'main' AS dst, 'conversation' AS type FROM msg
     UNION ALL SELECT sid, 'main', node, 'dispatch' FROM dag""", MESSAGES),
    "flow_events": q("""SELECT e.sid AS session_id, ord, CAST(greatest(0, coalesce(ts - t0, 0)) AS BIGINT) AS t, type, node_id, label, detail FROM (
      SELECT sid, ord, ts, CASE WHEN role IN ('user', 'assistant') THEN 'message' ELSE role END AS type, 'main' AS node_id,
       CASE WHEN role = 'hook' THEN content WHEN role = 'compaction' THEN '' ELSE role END AS label, '' AS detail FROM msg WHERE role IN ('user', 'assistant', 'compaction', 'hook')
      UNION ALL SELECT sid, ord, ts, 'tool_call', 'main', tool, CASE WHEN tool IN ('Read', 'Edit', 'Write') THEN '/src/f' || (k % 10) || '.py' WHEN tool = 'Grep' THEN 'x' || k
       WHEN tool = 'Skill' THEN 'skill' || (k % 4) WHEN et <> 'click' THEN 'make test' WHEN k % 10 = 2 THEN 'git commit -m "fix ' || k || '"' WHEN k % 10 = 3 THEN 'git push origin main'
       ELSE 'gh pr create --title pr' || k END FROM uses WHERE tool <> 'Agent'
      UNION ALL SELECT sid, ord, ts, 'agent_spawn', node, '', '' FROM dag) e
     LEFT JOIN (SELECT sid, arg_min(ts, ord) AS t0 FROM msg WHERE ts IS NOT NULL GROUP BY sid) b ON b.sid = e.sid""", MESSAGES),
    "session_shares": q(f"""SELECT session_id, tool, CAST(calls AS BIGINT) AS calls, CAST(ot AS BIGINT) AS output_tokens,
     CAST(CASE WHEN tt > 0 THEN floor(ot / tt * 100 + 0.5) ELSE 0 END AS BIGINT) AS share_pct FROM (
      SELECT s.sid AS session_id, tool, calls, ot, sum(ot) OVER (PARTITION BY s.sid) + coalesce(r, 0) AS tt,
       row_number() OVER (PARTITION BY s.sid ORDER BY calls DESC, tool) AS rn FROM
       ({TOOL_TOKENS}) s
       LEFT JOIN (SELECT sid, sum(o) AS r FROM turn WHERE len(tools) = 0 GROUP BY sid) USING (sid)) WHERE rn <= 15"""),
    "top_files": q("""SELECT proj AS project, path, read, edit, write, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY proj ORDER BY read + edit + write DESC, path) AS rn FROM
     (SELECT proj, path, count(*) FILTER (op = 'read') AS read, count(*) FILTER (op = 'edit') AS edit, count(*) FILTER (op = 'write') AS write FROM fops GROUP BY proj, path)) WHERE rn <= 3"""),
    "workflow_timeline": q("""SELECT proj AS project, sid AS session_id, type, label, ts AS ts_ms, CAST(shown AS INT) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY proj ORDER BY rn) AS shown FROM
      (SELECT *, row_number() OVER (PARTITION BY proj ORDER BY ts NULLS LAST, sid, ord, pos, label) AS rn FROM (
       SELECT sid, ord, pos, ts, proj, op AS type, path AS label FROM fops UNION ALL SELECT sid, ord, pos, ts, proj, 'git_' || kind, message FROM gops
       UNION ALL SELECT a.sid, coalesce(ord, 4611686018427387904), 0, NULL, proj, 'agent', description FROM alld a JOIN sess ON sess.sid = a.sid))
      WHERE rn <= 500 AND type <> 'agent') WHERE shown <= 200"""),
    "transcript_sessions": q("""SELECT sid AS session_id, proj AS project, messages, prompt, assistant, compactions, CAST(calls AS BIGINT) AS calls, CAST(cost AS BIGINT) AS cost_nusd,
     CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, errors, tool_calls, file_ops, git_ops, duration_min FROM srow""", ROWS),
    "session_export": q("""SELECT s.sid AS session_id, s.proj AS project, 'src' || (s.usr % 3) AS source, 's-' || s.sid AS slug,
      CAST(CAST(DATE '1970-01-01' + CAST(s.start_ms // 86400000 AS INT) AS DATE) AS VARCHAR) AS date, s.start_ms, c.end_ms, duration_min, s.messages,
      c.prompt AS user_messages, c.assistant AS assistant_messages, c.tool_result AS tool_results, c.command AS command_messages, c.interrupt AS interrupts,
      c.meta AS meta_messages, CAST(s.calls AS BIGINT) AS calls, CAST(s.i AS BIGINT) AS input_tokens, CAST(s.o AS BIGINT) AS output_tokens,
      CAST(coalesce(d.r, 0) AS BIGINT) AS cache_read, CAST(coalesce(d.w, 0) AS BIGINT) AS cache_creation, CAST(s.cost AS BIGINT) AS cost_nusd, s.compactions,
      errors AS error_count, (SELECT count(*) FROM errs e WHERE e.sid = s.sid AND category = 'cancelled') AS cancelled_count,
      (SELECT count(*) FROM errs e WHERE e.sid = s.sid AND counted_as = 'rejected') AS rejected_count, tool_calls, file_ops AS file_ops_count, git_ops,
      own.is_sub AS is_subagent, 1.0::DOUBLE AS file_size_mb,
      (SELECT count(*) FROM usr u WHERE u.sid = s.sid AND et = 'signup' AND k % 8 = 3 AND ts IS NOT NULL) AS dated_compactions, disp AS agent_dispatches,
      coalesce(mb, '') AS model_breakdown, CASE WHEN nd > 1 THEN dd ELSE '' END AS per_day, coalesce(hh, '') AS hour_hist, coalesce(wd, '') AS weekday_hist,
      coalesce(tt, '') AS tools, coalesce(ww, '') AS write_categories, coalesce(sk, '') AS skills, coalesce(hk, '') AS hooks, coalesce(es, '') AS errors_by_source,
      coalesce(el, '') AS error_list, coalesce(gl, '') AS git_list, coalesce(sa, '') AS subagents
     FROM srow s JOIN cnt c ON c.sid = s.sid JOIN own ON own.sid = s.sid
     LEFT JOIN (SELECT owner, count(*) AS nd, sum(r) AS r, sum(w) AS w, string_agg(CAST(day AS VARCHAR) || '=' || messages || '/' || CAST(cost AS BIGINT), ';' ORDER BY day) AS dd
      FROM md WHERE messages > 0 OR calls > 0 GROUP BY owner) d ON d.owner = s.sid
     LEFT JOIN (SELECT owner, string_agg(display || '=' || n || '/' || cost || '/' || i || '/' || o, ';' ORDER BY display) AS mb FROM (
      SELECT owner, display, count(*) AS n, CAST(sum(cost_nusd) AS BIGINT) AS cost, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o
      FROM turn JOIN own USING (sid) GROUP BY owner, display) GROUP BY owner) m ON m.owner = s.sid
     LEFT JOIN (SELECT sid, string_agg(h || '=' || n, ';' ORDER BY h) AS hh FROM (SELECT sid, CAST(ts // 3600000 % 24 AS VARCHAR) AS h, count(*) AS n
      FROM ent WHERE category IN ('prompt', 'assistant') AND ts IS NOT NULL GROUP BY ALL) GROUP BY sid) h ON h.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(h || '=' || n, ';' ORDER BY h) AS wd FROM (SELECT sid, CAST((ts // 86400000 + 3) % 7 AS VARCHAR) AS h, count(*) AS n
      FROM ent WHERE category IN ('prompt', 'assistant') AND ts IS NOT NULL GROUP BY ALL) GROUP BY sid) w ON w.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(tool || '=' || n, ';' ORDER BY tool) AS tt FROM (SELECT sid, tool, count(*) AS n FROM uses GROUP BY ALL) GROUP BY sid) t ON t.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(cat || '=' || n, ';' ORDER BY cat) AS ww FROM (SELECT sid, cat, CAST(sum(tokens) AS BIGINT) AS n FROM wc GROUP BY ALL) WHERE n > 0 GROUP BY sid) x ON x.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(name || '=' || n, ';' ORDER BY name) AS sk FROM (SELECT sid, 'skill' || (k % 4) AS name, count(*) AS n FROM uses WHERE tool = 'Skill' GROUP BY ALL) GROUP BY sid) k ON k.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(name || '=' || n, ';' ORDER BY name) AS hk FROM (SELECT sid, 'h' || (k % 3) AS name, count(*) AS n FROM t WHERE et = 'purchase' AND k % 10 = 1 GROUP BY ALL) GROUP BY sid) hk ON hk.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(counted_as || '=' || n, ';' ORDER BY counted_as) AS es FROM (SELECT sid, counted_as, count(*) AS n FROM errs WHERE counted_as <> '' GROUP BY ALL) GROUP BY sid) e ON e.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(category || '|' || message, ';' ORDER BY ord) AS el FROM errs WHERE counted_as <> '' GROUP BY sid) el ON el.sid = s.sid
     LEFT JOIN (SELECT sid, string_agg(kind || '|' || message, ';' ORDER BY ord) AS gl FROM gops GROUP BY sid) g ON g.sid = s.sid
     LEFT JOIN (SELECT owner, string_agg(sid || '|' || tok || '|' || messages || '|' || n, ';' ORDER BY sid) AS sa FROM (
      SELECT own.owner, own.sid, CAST(coalesce(u.tok, 0) AS BIGINT) AS tok, messages, coalesce(n, 0) AS n FROM own JOIN cnt ON cnt.sid = own.sid
       LEFT JOIN (SELECT sid, sum(input_tokens + o) AS tok FROM turn GROUP BY sid) u ON u.sid = own.sid
       LEFT JOIN (SELECT sid, count(*) AS n FROM uses GROUP BY sid) y ON y.sid = own.sid WHERE own.owner <> own.sid) GROUP BY owner) sa ON sa.owner = s.sid""",
     ROWS, NARRATION),
    "project_facts": q(PROJECT_FACTS.format(rows="srow"), ROWS),
    "project_names": q("""SELECT proj AS project, kind, name, count(*) AS count FROM nm JOIN (SELECT sid, proj FROM sess) USING (sid) GROUP BY ALL""", NAMES),
    "filtered_projects": q(PROJECT_FACTS.format(rows="chosen"), ROWS, CHOSEN),
    "filtered_names": q("""SELECT kind, name, count(*) AS count, count(DISTINCT sid) AS sessions FROM nm WHERE sid IN (SELECT sid FROM chosen) GROUP BY kind, name""", ROWS, CHOSEN, NAMES),
    "filtered_write_categories": q("""SELECT cat AS category, CAST(sum(tokens) AS BIGINT) AS output_tokens FROM wc WHERE sid IN (SELECT sid FROM chosen) GROUP BY cat
     HAVING sum(tokens) > 0""", ROWS, CHOSEN, NARRATION),
    "filtered_tool_tokens": q(f"""SELECT tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(ot) AS BIGINT) AS output_tokens FROM ({TOOL_TOKENS}) s
     WHERE sid IN (SELECT sid FROM chosen) GROUP BY tool""", ROWS, CHOSEN),
    "session_category_percent": q("""SELECT sid AS session_id, cat AS category, CAST(x AS BIGINT) AS output_tokens,
     CAST(floor(x / sum(x) OVER (PARTITION BY sid) * 100 + 0.5) AS BIGINT) AS share_pct FROM (SELECT sid, cat, sum(tokens) AS x FROM wc GROUP BY sid, cat HAVING sum(tokens) > 0)""", NARRATION),
    "session_markdown": q("""SELECT CAST(d AS VARCHAR) || '-' || replace(proj, '/', '_') || '-' || substr(sid, 1, 8) || '.md' AS file_name, sid AS session_id, ord, text FROM (
      SELECT sid, -1 AS ord, '---' || chr(10) || 'session_id: ' || sid || chr(10) || 'project: ' || proj || chr(10) || 'date: ' || CAST(DATE '1970-01-01' + CAST(start_ms // 86400000 AS INT) AS DATE) || chr(10)
       || 'start: "' || strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S') || 'Z"' || chr(10) || 'duration_min: ' || CAST(duration_min AS VARCHAR) || chr(10) || 'model: ' || coalesce(pm, 'Unknown') || chr(10)
       || 'messages: ' || messages || chr(10) || 'cost_usd: ' || printf('%.4f', round_even(cost / 1e9 * 1e4, 0) / 1e4) || chr(10) || 'source: src' || (usr % 3) || chr(10) || '---' || chr(10) || chr(10) || '# ' ||
       coalesce(fp, 'Session ' || substr(sid, 1, 8)) || chr(10) AS text
      FROM srow LEFT JOIN (SELECT sid, arg_min(CASE k % 8 WHEN 2 THEN 'note' WHEN 3 THEN 'summary' ELSE 'Please fix item ' || k END, ord) AS fp FROM usr WHERE et = 'signup' AND k % 8 > 1 GROUP BY sid) USING (sid)
       LEFT JOIN (SELECT sid, first(display ORDER BY s DESC, f) AS pm FROM (SELECT sid, model, any_value(display) AS display, sum(o) AS s, min(ord) AS f FROM turn GROUP BY sid, model) GROUP BY sid) USING (sid)
      UNION ALL SELECT m.sid, m.ord, CASE WHEN role = 'user' THEN '## User' ELSE '## Assistant (' || a.display || ')' END ||
       coalesce(' — ' || strftime(make_timestamp(m.ts * 1000), '%H:%M:%S'), '') || chr(10) || chr(10) || content || chr(10)
      FROM msg m LEFT JOIN ans a ON a.sid = m.sid AND a.ord = m.ord WHERE role IN ('user', 'assistant') AND trim(content) <> '')
      JOIN (SELECT sid, CAST(DATE '1970-01-01' + CAST(start_ms // 86400000 AS INT) AS DATE) AS d, proj FROM srow) USING (sid)""", ROWS, MESSAGES),
    "session_csv": q("""SELECT sid AS session_id, proj AS project, CAST(messages AS VARCHAR) AS messages, CAST(calls AS VARCHAR) AS calls,
     CASE WHEN duration_min = floor(duration_min) THEN CAST(CAST(duration_min AS BIGINT) AS VARCHAR) ELSE '=' || regexp_replace(printf('%.4f', floor(duration_min * 10000 + 0.5) / 10000), '0+$', '') END AS duration_min,
     CASE WHEN cost / 1e9 = floor(cost / 1e9) THEN CAST(CAST(cost / 1e9 AS BIGINT) AS VARCHAR) ELSE '=' || regexp_replace(printf('%.4f', floor(cost / 1e9 * 10000 + 0.5) / 10000), '0+$', '') END AS cost FROM srow""", ROWS),
    "stratified_sample": q("SELECT category, least(count(*), 40) AS n FROM smp GROUP BY category", PAYLOADS),
    "chars_per_token": q(f"""SELECT category, n, total_chars, total_tokens, {r4('m')} AS mean, {r4('md')} AS median, {r4('sd')} AS stdev, {r4('total_chars / total_tokens')} AS weighted,
     {r4("max(CASE WHEN category = 'screen_text' THEN total_chars / total_tokens END) OVER () / (total_chars / total_tokens)")} AS correction FROM
     (SELECT category, count(*) AS n, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(tok) AS BIGINT) AS total_tokens, avg(chars / tok) AS m, quantile_cont(chars / tok, 0.5) AS md,
      coalesce(stddev_samp(chars / tok), 0) AS sd FROM smp GROUP BY category)""", PAYLOADS),
    "chars_per_token_by_model": q(f"""SELECT model, count(*) AS n, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(tok) AS BIGINT) AS total_tokens,
     {r4('sum(chars) / sum(tok)')} AS weighted FROM smp WHERE ord % 5 <> 0 GROUP BY model""", PAYLOADS),
    "history_dedupe": "WITH " + LEDGER + """, h AS (SELECT session_id, ts_ms // 3600000 * 3600000 AS timestamp, 'p' || k AS display, project, ord, k FROM led)
     SELECT session_id, timestamp, arg_min(display, CASE WHEN k < 60 THEN 0 ELSE 1000000000000 END + ord) AS display, any_value(project) AS project FROM h GROUP BY session_id, timestamp""",
    "telemetry_maxima": "WITH " + LEDGER + """ SELECT session_id, max(round_even(cache_read * 997 / 1048576 * 10, 0) / 10) AS peak_rss_mb, CAST(max(k) AS DOUBLE) AS peak_heap_mb,
     max(round_even(k / 7 * 10, 0) / 10) AS max_cpu_pct, CAST(max(round_even(k * 1.5::DOUBLE, 0)) AS DOUBLE) AS max_uptime_s, count(*) AS event_count FROM led GROUP BY session_id""",
    "transcript_limit_events": q("""SELECT session_id, ts_ms, gap_start_ms, subtype, confidence, last_ms, merged_count FROM (
     SELECT arg_min(sid, (ts, type, sid)) AS session_id, min(ts) AS ts_ms, arg_min(coalesce(g, -1), (ts, type, sid)) AS gap_start_ms,
      arg_min(subtype, (ts, type, sid)) AS subtype, arg_min(conf, (ts, type, sid)) AS confidence, max(ts) AS last_ms, count(*) AS merged_count
     FROM (SELECT *, sum(opens) OVER (ORDER BY ts, type, sid) AS c FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, type, sid) <= 900000 THEN 0 ELSE 1 END AS opens FROM le)) GROUP BY c)""", """,
pr AS (SELECT sid, ord, ts FROM usr WHERE category = 'prompt' AND ts IS NOT NULL),
le AS (SELECT sid, ts, NULL::BIGINT AS g, 'explicit' AS type, 'user_plan_limit' AS subtype, 'high' AS conf FROM resp
   WHERE et = 'purchase' AND k % 10 = 0 AND k % 9 IN (0, 7)
  UNION ALL SELECT sid, ts, g, 'heuristic', '5h_fingerprint', CASE WHEN (g // 3600000) % 24 BETWEEN 7 AND 22 AND (ts // 3600000) % 24 BETWEEN 7 AND 22
   AND abs(ts - g - 18000000) <= 900000 THEN 'high' ELSE 'medium' END
   FROM (SELECT *, lag(ts) OVER (ORDER BY ts, ord, sid) AS g FROM pr) p
   WHERE ts - g BETWEEN 17100000 AND 19800000 AND EXISTS (SELECT 1 FROM pr x WHERE x.ts >= p.g - 7200000 AND x.ts < p.g))"""),
    "transcript_windows_5h": "WITH RECURSIVE " + LEDGER + ENTRIES + windows_body(TURNS),
    "transcript_weekly_buckets": q(f"""SELECT account, CAST(CAST(day - CAST((isodow(day) - 1 - 3 + 7) % 7 AS INT) AS DATE) AS VARCHAR) AS week,
     max(ts_ms) AS end_ms, CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd, count(*) AS turn_count, count(DISTINCT session_id) AS sessions
     FROM (SELECT *, CAST(DATE '1970-01-01' + CAST(ts_ms // 86400000 AS INT) AS DATE) AS day FROM ({TURNS})) GROUP BY ALL"""),
}

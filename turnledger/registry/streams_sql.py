"""SQL counterparts of the streaming queries: their batch twins (DuckDB dialect)."""

from __future__ import annotations

from turnledger.registry.transcripts_sql import q
from turnledger.registry.usage_sql import CLUSTERS, SQL as USAGE, w

SQL = {
    "stream_daily_cost": w("""SELECT CAST(day AS VARCHAR) AS day, display, CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd, count(*) AS calls
     FROM calls GROUP BY day, display"""),
    "stream_weekly_cost": w("""SELECT CAST(CAST(day - CAST((isodow(day) - 1 - 1 + 7) % 7 AS INT) AS DATE) AS VARCHAR) AS week,
     CAST(account AS VARCHAR) AS account, CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd, count(*) AS calls FROM calls GROUP BY ALL"""),
    "stream_usage_rate": w("""SELECT (ts_ms // 900000 - i) * 900000 AS start_ms, CAST(sum(cost_nusd) AS BIGINT) AS cost_nusd, count(*) AS calls
     FROM calls, range(20) r(i) GROUP BY 1"""),
    "stream_limit_clusters": w("SELECT 'all' AS account, ts_ms, last_ms, merged_count FROM cl", CLUSTERS),
    "stream_windows_5h": f"""SELECT CAST(account AS VARCHAR) AS account, start_ms, end_ms, cost_nusd, turn_count FROM ({USAGE['windows_5h']})""",
    "stream_ingest": q("""SELECT sid AS session_id, ord, 'assistant' AS type, CAST(CASE WHEN et = 'view' THEN 2 ELSE 1 END AS BIGINT) AS n_lines,
      CAST(len(tools) + CASE WHEN et = 'error' THEN 0 ELSE 1 END + CASE WHEN think IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_blocks,
      CASE WHEN has_usage THEN o ELSE 0 END AS output_tokens FROM resp
     UNION ALL SELECT sid, ord, 'user', 1, CASE WHEN category = 'tool_result' THEN 1 ELSE 0 END, 0 FROM usr
     UNION ALL SELECT sid, ob, ['progress', 'mode', 'permission-mode', 'attachment', 'queue-operation'][k % 10], 1, 0, 0 FROM t
      WHERE et = 'purchase' AND k % 10 BETWEEN 1 AND 5"""),
}

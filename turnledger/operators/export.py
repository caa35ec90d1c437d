"""The exported session row with all its nested parts, and its flat form for filters, sorting and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.config import EngineConfig
from turnledger.functions.pricing import price_calls
from turnledger.functions.scalars import day_text, iso_utc, local_hour, local_weekday, usd, utc_day
from turnledger.operators import anomalies, attribution, facts, sessions
from turnledger.session import materialize

# Sessions whose nested parts one task of the export gathers.
GATHERED_SESSIONS = 4_000

# Names of the flat session table by the columns of a session row.
FLAT = {"prompt": "user_messages", "assistant": "assistant_messages", "tool_result": "tool_results", "command": "command_messages",
        "interrupt": "interrupts", "meta": "meta_messages", "file_ops": "file_ops_count", "errors": "error_count",
        "cancelled": "cancelled_count", "rejected_errors": "rejected_count"}


def flat_rows(session_rows: DataFrame) -> DataFrame:
    """Session rows under the names that filters, attribute ranges and all sort columns use."""
    named = session_rows.withColumnsRenamed(FLAT)
    return (named.withColumn("cost", usd("cost_nusd", 4)).withColumn("date", utc_day("start_ms"))
            .withColumn("end_date", utc_day("end_ms")))


def _counted(rows: DataFrame, name: str, key: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    out = rows.groupBy("session_id", key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return out.select("session_id", F.struct("key", "value").alias(name))


def _keyed(rows: DataFrame, name: str, key: str | Column, *values: str | Column) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    value = F.struct(*values) if len(values) > 1 else F.col(values[0])
    return rows.select("session_id", F.struct(key.cast("string").alias("key"), value.alias("value")).alias(name))


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.select("session_id", F.struct(*columns).alias(name))


def children(e: DataFrame, attributes: DataFrame, cfg: EngineConfig, absorb: bool = True) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nested parts as rows ``(session_id, struct)``: maps (structs of key and value) and lists (structs in order).

    Everything that repeats is counted or summed by session and key before it is put together.
    """
    calls = sessions.turns(e)
    uses = sessions.tool_uses(e)
    slices = sessions.day_slices(e, attributes, absorb)
    errors = sessions.error_rows(e)
    marks = attribution.narration_tokens(e).where(F.col("type") == "assistant").select("session_id", "ord", "is_narration")
    writes = attribution.write_categories(calls.join(marks, ["session_id", "ord"]), ["session_id"]).where("output_tokens > 0")
    tool_tokens = attribution.tool_tokens(price_calls(calls), ["session_id"])
    use = ("cost_nusd", "input_tokens", "output_tokens", "cache_read", "cache_creation", "calls")
    models = facts.priced(slices).where("calls > 0").groupBy("session_id", "display").agg(*[F.sum(c).alias(c) for c in use])
    talk = sessions.message_rows(e).where(F.col("ts_ms").isNotNull())
    maps = [
        _keyed(models.withColumn("cost", usd("cost_nusd", 4)), "model_breakdown", "display", "cost", *use),
        _keyed(facts.session_day_split(slices), "per_day", day_text("day"), "messages", "cost_nusd", "input_tokens", "output_tokens"),
        _counted(talk, "hour_hist", local_hour("ts_ms", cfg.local_tz)),
        _counted(talk, "weekday_hist", local_weekday("ts_ms", cfg.local_tz)),
        _counted(uses, "tools", "tool"),
        _keyed(tool_tokens.withColumn("cost", usd("cost_nusd", 4)), "tool_tokens", "tool", "calls", "output_tokens", "cost"),
        _keyed(writes, "write_categories", "category", "output_tokens"),
        _counted(sessions.skills(uses), "skills", "name"),
        _counted(sessions.hooks(e), "hooks", "name"),
        _counted(errors.where("counted_as is not null"), "errors_by_source", "counted_as"),
    ]
    summaries = sessions.subagent_summaries(calls, sessions.message_counters(e), attributes) if absorb else None
    lists = [
        _listed(sessions.compactions(e), "compaction_events", "ord", "ts_ms"),
        _listed(sessions.agent_dispatches(e, attributes), "dispatches", "ord", "pos", "type", "description", "agent_id"),
        _listed(errors.where("counted_as is not null"), "error_list", "ord", "pos", "message", "tool", "source", "category", "ts_text"),
        _listed(sessions.git_operations(uses), "git_list", "ord", "pos", "kind", "message"),
        _listed(anomalies.idle_gaps(calls), "idle_gap_summary", *[f"{k}_{n}" for n in ("count", "tokens") for k in ("short", "mid", "long")],
                "baseline_tokens", "overspend_tokens", "overspend_pct"),
    ]
    if summaries is not None:
        lists.append(_listed(summaries.select(F.col("parent_id").alias("session_id"), F.col("session_id").alias("agent"), "tokens", "cost", "messages", "tool_calls"),
                             "subagents", "agent", "tokens", "cost", "messages", "tool_calls"))
    return maps, lists


def session_export(classified_entries: DataFrame, cfg: EngineConfig, absorb: bool = True) -> DataFrame:
    """One row per session with every exported field: numbers and texts flat, the rest as maps and lists.

    All nested parts meet in one shuffle: they are stacked as sparse rows, each with one part filled, and gathered by
    session, in so many partitions that a task gathers about ``GATHERED_SESSIONS`` of them whatever the size of the
    input (left to itself, Spark cuts by the bytes of compressed rows). A row holds its session's errors, dispatches and git operations, as the export does; ``children`` has them
    as rows for sessions that do not fit one.
    """
    e = classified_entries
    attributes = materialize(sessions.session_attributes(e), "export-attributes")
    rows = flat_rows(sessions.session_rows(e, absorb)).drop("agent_dispatches")
    maps, lists = children(e, attributes, cfg, absorb)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), maps + lists)
    map_names, list_names = [p.columns[1] for p in maps], [p.columns[1] for p in lists]
    parts = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-attributes.count() // GATHERED_SESSIONS))
    gathered = stacked.repartition(parts, "session_id").groupBy("session_id").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in map_names + list_names])
    nested = gathered.select("session_id", *[F.map_from_entries(n).alias(n) for n in map_names], *list_names)
    out = rows.join(nested, "session_id", "left")
    for n in list_names:
        out = out.withColumn(n, F.coalesce(n, F.array().cast(gathered.schema[n].dataType)))
    for n in map_names:
        out = out.withColumn(n, F.coalesce(n, F.map_from_entries(F.array().cast(gathered.schema[n].dataType))))
    return (out.withColumn("per_day", F.when(F.size("per_day") > 1, F.col("per_day")))
            .withColumn("idle_gap_summary", F.get("idle_gap_summary", F.lit(0)))
            .withColumn("agent_dispatches", F.size("dispatches").cast("long"))
            .withColumn("start", iso_utc("start_ms")).withColumn("end", iso_utc("end_ms"))
            .withColumn("reasoning_cost", usd("reasoning_cost_nusd", 4))
            .withColumn("file_size_mb", F.rint(F.col("file_size") / 1048576 * 100) / 100))

"""Transcript queries: lines derived from the events table through parse, merge and session operators.

The parsed entries are written once per application and input (the silver table) and read by every query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turnledger.config import EngineConfig
from turnledger.functions.pricing import price_calls
from turnledger.functions.scalars import day_text, half_even, usd
from turnledger.operators import attribution, calibration, export, facts, filters, limits, projects, replay, series, sessions
from turnledger.registry.usage import AS_OF, texted
from turnledger.session import PLAIN, materialize
from turnledger.sources import sidefiles, sinks, tables, transcripts

CFG = EngineConfig(as_of=AS_OF)
_written: dict[tuple, object] = {}


def silver(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _written:
        _written[key] = materialize(tables.transcript_entries(spark, sf), "silver", **PLAIN)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _written[key]


def gold_sessions(spark, sf):
    """The exported session rows, written once and read by the exports and project pages."""
    key = (spark.sparkContext.applicationId, sf, "sessions")
    if key not in _written:
        _written[key] = materialize(sessions.session_rows(silver(spark, sf)), "sessions")
    return _written[key]


def _known(spark, sf):
    """Attributes of all sessions, written once: dispatches read them four times, other queries next to them."""
    key = (spark.sparkContext.applicationId, sf, "attributes")
    if key not in _written:
        _written[key] = materialize(sessions.session_attributes(silver(spark, sf)), "attributes")
    return _written[key]


def transcript_parse(spark, sf):
    """Bronze to silver on the whole derived tree: entries per type after parsing and merging."""
    e = sessions.classified(transcripts.merge_streamed(tables.parsed_lines(spark, sf)))
    return e.groupBy("type", "category").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("n_lines").alias("lines"), F.count("ts_ms").alias("dated"),
        F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.size(F.coalesce("blocks", F.array().cast(e.schema["blocks"].dataType)))), F.lit(0)).alias("blocks"))


def stream_merge(spark, sf):
    e = silver(spark, sf).where(F.col("type") == "assistant")
    return e.select("session_id", "ord", "n_lines", F.size("blocks").cast("long").alias("n_blocks"),
                    F.coalesce("usage.output_tokens", F.lit(0)).alias("output_tokens"))


def session_attributes(spark, sf):
    out = sessions.session_attributes(silver(spark, sf))
    return out.select("session_id", "project", "slug", "source", "is_subagent", "parent_id", "agent_type")


def transcript_counters(spark, sf):
    out = sessions.message_counters(silver(spark, sf))
    return out.withColumn("start_ms", F.coalesce("start_ms", F.lit(-1))).withColumn("end_ms", F.coalesce("end_ms", F.lit(-1)))


def transcript_first_prompts(spark, sf):
    return sessions.first_prompts(silver(spark, sf))


def _slices(spark, sf, absorb=True):
    e = silver(spark, sf)
    return sessions.day_slices(e, _known(spark, sf), absorb)


def transcript_usage(spark, sf):
    return texted(facts.session_day_split(_slices(spark, sf)), "day")


def transcript_usage_unlinked(spark, sf):
    return texted(facts.session_day_split(_slices(spark, sf, False)), "day")


def subagent_rollup(spark, sf):
    e = silver(spark, sf)
    return sessions.subagent_summaries(sessions.turns(e), sessions.message_counters(e), _known(spark, sf))


def transcript_errors(spark, sf):
    return sessions.error_rows(silver(spark, sf)).select(
        "session_id", "ord", "tool", "source", "category", F.coalesce("counted_as", F.lit("")).alias("counted_as"), "message")


def session_error_counters(spark, sf):
    return sessions.error_counters(sessions.error_rows(silver(spark, sf)))


def agent_dispatches(spark, sf):
    e = silver(spark, sf)
    out = sessions.agent_dispatches(e, _known(spark, sf))
    return out.groupBy("session_id", "type", "description", "agent_id").agg(F.count(F.lit(1)).alias("n"))


def file_operations(spark, sf):
    return sessions.file_operations(sessions.tool_uses(silver(spark, sf))).select("session_id", "ord", "op", "path")


def git_operations(spark, sf):
    return sessions.git_operations(sessions.tool_uses(silver(spark, sf))).select("session_id", "ord", "kind", "message")


def git_summary(spark, sf):
    g = sessions.git_operations(sessions.tool_uses(silver(spark, sf)))
    return g.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("commit", "commits"), ("push", "pushes"), ("pr", "prs"))])


def skill_ranking(spark, sf):
    return series.name_ranking(sessions.skills(sessions.tool_uses(silver(spark, sf))))


def hook_ranking(spark, sf):
    return series.name_ranking(sessions.hooks(silver(spark, sf)))


def _dispatches(spark, sf):
    e = silver(spark, sf)
    return sessions.agent_dispatches(e, _known(spark, sf))


def agent_type_ranking(spark, sf):
    return series.name_ranking(_dispatches(spark, sf), "type")


def agent_description_ranking(spark, sf):
    return series.name_ranking(_dispatches(spark, sf), "description", 10)


def _talk(spark, sf):
    return attribution.narration_tokens(silver(spark, sf))


def narration_reclass(spark, sf):
    return _talk(spark, sf).where(F.col("type") == "assistant").select("session_id", "ord", "is_narration")


def _write_rows(entries):
    marks = attribution.narration_tokens(entries).where(F.col("type") == "assistant").select("session_id", "ord", "is_narration")
    return sessions.turns(entries).join(marks, ["session_id", "ord"])


def write_category_attribution(spark, sf):
    return attribution.category_shares(attribution.write_categories(_write_rows(silver(spark, sf))))


def session_write_categories(spark, sf):
    return attribution.write_categories(_write_rows(silver(spark, sf)), ["session_id"]).where(F.col("output_tokens") > 0)


def replay_roles(spark, sf):
    return replay.messages(silver(spark, sf)).groupBy("session_id", "role").agg(F.count(F.lit(1)).alias("n"))


def replay_messages(spark, sf):
    m = replay.messages(silver(spark, sf)).where(F.col("role") != "mode")
    return m.select("session_id", "ord", "role", "content")


def replay_answers(spark, sf):
    a = replay.answers(replay.messages(silver(spark, sf)))
    return a.select("session_id", "ord", "display", "cost", "output_tokens", F.size("tools").cast("long").alias("n_tools"),
                    F.coalesce(F.length("thinking"), F.lit(0)).cast("long").alias("thinking_chars"))


def chat_filter(spark, sf):
    m = replay.chat_filter(replay.messages(silver(spark, sf)), ["error", "agent-dispatch"])
    return m.select("session_id", "ord", "role")


def mode_changes(spark, sf):
    return replay.mode_changes(silver(spark, sf)).select("session_id", "ord", "content")


def day_dividers(spark, sf):
    return texted(replay.day_dividers(replay.messages(silver(spark, sf))), "day").select("session_id", "ord", "day")


def command_output_tokens(spark, sf):
    return replay.command_output_tokens(replay.messages(silver(spark, sf)))


def flow_nodes(spark, sf):
    return replay.flow_nodes(replay.messages(silver(spark, sf)))


def flow_edges(spark, sf):
    return replay.flow_edges(replay.messages(silver(spark, sf)))


def flow_events(spark, sf):
    return replay.flow_events(replay.messages(silver(spark, sf))).drop("tpos")


def session_shares(spark, sf):
    t = price_calls(sessions.turns(silver(spark, sf)))
    return replay.session_shares(attribution.tool_tokens(t, ["session_id"]), attribution.reasoning_totals(t, ["session_id"]))


def top_files(spark, sf):
    e = silver(spark, sf)
    return projects.top_files(sessions.file_operations(sessions.tool_uses(e)), _known(spark, sf), 3)


def workflow_timeline(spark, sf):
    e = silver(spark, sf)
    attributes, uses = _known(spark, sf), sessions.tool_uses(e)
    out = projects.workflow(sessions.file_operations(uses), sessions.git_operations(uses),
                            sessions.agent_dispatches(e, attributes), attributes, 500)
    shown = projects.shown_workflow(out, ["read", "edit", "write", "git_commit", "git_push", "git_pr"])
    return shown.select("project", "session_id", "type", "label", "ts_ms", "shown")


def transcript_sessions(spark, sf):
    out = sessions.session_rows(silver(spark, sf))
    return out.select("session_id", "project", "messages", "prompt", "assistant", "compactions", "calls", "cost_nusd",
                      "input_tokens", "output_tokens", "errors", "tool_calls", "file_ops", "git_ops", "duration_min")


def session_export(spark, sf):
    """Exported rows with the nested parts written out as text, each in the order of its keys or places."""
    out = export.session_export(silver(spark, sf), CFG)

    def pairs(name, value=lambda v: v.cast("string")):
        entries = F.array_sort(F.map_entries(F.coalesce(name, F.map_from_entries(F.array().cast(
            f"array<struct<key:string,value:{out.schema[name].dataType.valueType.simpleString()}>>")))))
        return F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), value(x["value"]))), ";").alias(name)

    def items(name, *fields):
        return F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";").alias(name)

    def fields(*names):
        return lambda v: F.concat_ws("/", *[v[n].cast("string") for n in names])

    return out.select(
        "session_id", "project", "source", "slug", day_text("date").alias("date"), "start_ms", "end_ms", "duration_min", "messages", "user_messages",
        "assistant_messages", "tool_results", "command_messages", "interrupts", "meta_messages", "calls", "input_tokens", "output_tokens",
        "cache_read", "cache_creation", "cost_nusd", "compactions", "error_count", "cancelled_count", "rejected_count", "tool_calls", "file_ops_count", "git_ops",
        "is_subagent", "file_size_mb", F.size("compaction_events").cast("long").alias("dated_compactions"), "agent_dispatches",
        pairs("model_breakdown", fields("calls", "cost_nusd", "input_tokens", "output_tokens")), pairs("per_day", fields("messages", "cost_nusd")),
        pairs("hour_hist"), pairs("weekday_hist"), pairs("tools"), pairs("write_categories"), pairs("skills"), pairs("hooks"), pairs("errors_by_source"),
        items("error_list", "category", "message"), items("git_list", "kind", "message"), items("subagents", "agent", "tokens", "messages", "tool_calls"))


def _names(spark, sf):
    e = silver(spark, sf)
    uses = sessions.tool_uses(e)
    return projects.named({"tool": (uses, "tool"), "skill": (sessions.skills(uses), "name"), "agent": (_dispatches(spark, sf), "type"),
                           "error": (sessions.error_rows(e).where(F.coalesce("counted_as", F.lit("")) != ""), "category")})


def project_names(spark, sf):
    return projects.name_counts(_names(spark, sf), _known(spark, sf))


# The choice of the filtered transcript queries: a week, and a part of the project's name.
CHOICE = filters.Filters(days=7, project="PROJ1")


def _chosen(spark, sf):
    return filters.select_sessions(export.flat_rows(gold_sessions(spark, sf)), CHOICE, AS_OF)


def filtered_projects(spark, sf):
    """Project totals of the chosen sessions."""
    kept = _chosen(spark, sf).select("session_id")
    return projects.project_facts(gold_sessions(spark, sf).join(kept, "session_id", "left_semi"))


def filtered_names(spark, sf):
    """Tools, skills, agent types and errors of the chosen sessions."""
    return projects.selected_names(_names(spark, sf), _chosen(spark, sf))


def filtered_write_categories(spark, sf):
    """Write categories of the chosen sessions; what precedes an entry is of its own session, so others stay out from the start."""
    entries = silver(spark, sf).join(_chosen(spark, sf).select("session_id"), "session_id", "left_semi")
    return attribution.write_categories(_write_rows(entries)).select("category", "output_tokens").where(F.col("output_tokens") > 0)


def filtered_tool_tokens(spark, sf):
    """Output tokens and calls by tool of the chosen sessions."""
    t = price_calls(sessions.turns(silver(spark, sf)).join(_chosen(spark, sf).select("session_id"), "session_id", "left_semi"))
    return attribution.tool_tokens(t, ["session_id"]).groupBy("tool").agg(
        F.sum("calls").alias("calls"), F.sum("output_tokens").alias("output_tokens"))


def session_category_percent(spark, sf):
    return replay.category_percent(session_write_categories(spark, sf))


def project_facts(spark, sf):
    return projects.project_facts(gold_sessions(spark, sf))


def session_markdown(spark, sf):
    """Markdown export: one row per block of text of every transcript."""
    e = silver(spark, sf)
    rows = gold_sessions(spark, sf).select(
        "session_id", "project", F.to_date(F.timestamp_millis("start_ms")).alias("date"), "start_ms", "duration_min",
        "primary_model", "messages", (F.col("cost_nusd") / 1e9).alias("cost_usd"), "source", "first_prompt")
    m = replay.messages(e)
    talk = m.where(F.col("role") == "user").withColumn("display", F.lit(None).cast("string")).select(
        "session_id", "ord", "ts_ms", "role", "content", "display").unionByName(
        replay.answers(m).select("session_id", "ord", "ts_ms", "role", "content", "display"))
    return sinks.markdown_lines(rows, talk)


def session_csv(spark, sf):
    return sinks.csv_cells(gold_sessions(spark, sf).select(
        "session_id", "project", "messages", "calls", "duration_min", (F.col("cost_nusd") / 1e9).alias("cost")))


def _blocks(spark, sf):
    b = calibration.block_payloads(sessions.turns(silver(spark, sf)))
    return b.withColumn("tokens", F.ceil(F.length("payload") / 4).cast("long") + F.col("pos")).withColumn(
        "degraded", F.col("ord") % 5 == 0)


def stratified_sample(spark, sf):
    out = calibration.stratified_sample(_blocks(spark, sf), 40)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def chars_per_token(spark, sf):
    out = calibration.chars_per_token(_blocks(spark, sf))
    shown = [half_even(F.col(c), 4).alias(c) for c in ("mean", "median", "stdev", "weighted", "correction")]
    return out.select("category", "n", "total_chars", "total_tokens", *shown)


def chars_per_token_by_model(spark, sf):
    out = calibration.chars_per_token_by_model(_blocks(spark, sf))
    return out.select("model", "n", "total_chars", "total_tokens", half_even(F.col("weighted"), 4).alias("weighted"))


def transcript_limit_events(spark, sf):
    """Banners and fingerprints of all transcripts, clustered together for one account."""
    out = limits.transcript_events(silver(spark, sf), F.lit("all"), CFG.local_tz)
    return out.select("session_id", "ts_ms", F.coalesce("gap_start_ms", F.lit(-1)).alias("gap_start_ms"), "subtype", "confidence",
                      "last_ms", "merged_count")


def _account_turns(spark, sf):
    return sessions.turns(silver(spark, sf)).withColumn("account", F.col("source"))


def transcript_windows_5h(spark, sf):
    return limits.windows_5h(_account_turns(spark, sf))


def transcript_weekly_buckets(spark, sf):
    return texted(limits.weekly_buckets(_account_turns(spark, sf), 3), "week")


def history_dedupe(spark, sf):
    """Two overlapping history sources written from the ledger."""
    led = tables.usage_ledger(spark, sf)
    second = F.floor(F.col("ts_ms") / 3600000) * 3600000
    lines = led.select(F.col("ord"), F.when(F.col("k") < 60, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))).alias("s"),
                       F.to_json(F.struct(F.concat(F.lit("p"), F.col("k").cast("string")).alias("display"), second.alias("timestamp"),
                                          "project", F.col("session_id").alias("sessionId"))).alias("value"))
    return sidefiles.history_rows(lines.select("ord", "value", F.explode("s").alias("source_rank")))


def telemetry_maxima(spark, sf):
    led = tables.usage_ledger(spark, sf)
    process = F.to_json(F.struct((F.col("cache_read") * 997).alias("rss"), (F.col("k") * 1048576).alias("heapUsed"),
                                 (F.col("k") / 7).alias("cpuPercent"), (F.col("k") * 1.5).alias("uptime")))
    body = F.to_json(F.struct(F.struct("session_id", process.alias("process")).alias("event_data")))
    return sidefiles.telemetry_maxima(sidefiles.telemetry_rows(
        led.select(F.lit(0).alias("source_rank"), F.lit("t.json").alias("path"), "ord", body.alias("value"))))


QUERIES = {f.__name__: f for f in (
    transcript_parse, stream_merge, session_attributes, transcript_counters, transcript_first_prompts, transcript_usage,
    transcript_usage_unlinked, subagent_rollup, transcript_errors, session_error_counters, agent_dispatches,
    file_operations, git_operations, git_summary, skill_ranking, hook_ranking, agent_type_ranking,
    agent_description_ranking, narration_reclass, write_category_attribution, session_write_categories, replay_roles,
    replay_messages, replay_answers, chat_filter, mode_changes, day_dividers, command_output_tokens, flow_nodes,
    flow_edges, flow_events, session_shares, top_files, workflow_timeline, transcript_sessions, session_export, project_facts,
    project_names, filtered_projects, filtered_names, filtered_write_categories, filtered_tool_tokens, session_category_percent,
    session_markdown, session_csv, stratified_sample, chars_per_token, chars_per_token_by_model, history_dedupe,
    telemetry_maxima, transcript_limit_events, transcript_windows_5h, transcript_weekly_buckets)}

"""Session replay tables: message list, flow graph, dividers and shares, for all sessions in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import classify
from turnledger.functions.pricing import price_calls
from turnledger.functions.scalars import half_even, usd, utc_day
from turnledger.operators import sessions
from turnledger.operators.ordering import running_total, with_previous

# Labels of the attachment kinds that are shown.
EFFORT_LABELS = {"ultra_effort_enter": "Ultra effort on", "ultra_effort_exit": "Ultra effort off",
                 "ultrathink_effort": "Ultrathink"}
ATTACHMENT_LABELS = {"edited_text_file": "Edited file", "image": "Image", "file": "File", "pasted_text": "Pasted text",
                     "pasted_contents": "Pasted content", "selected_lines": "Selection"}
ORD_CELL = 1 << 20  # positions per cell where a session is cut for ordering
ROLE_GROUPS = {"user": "user", "assistant": "assistant", "error": "error", "rate_limit": "error"}


def _label(value: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, text in labels.items():
        out = F.when(value == key, text).otherwise(out)
    return out


def _joined(blocks: str, kind: tuple, field: str, sep: str) -> Column:
    picked = F.filter(blocks, lambda b: b["btype"].isin(*kind))
    return F.array_join(F.transform(picked, lambda b: F.coalesce(b[field], F.lit(""))), sep)


def _tool_detail(b: Column) -> Column:
    def arg(name: str) -> Column:
        return F.coalesce(F.get_json_object(b["input"], f"$.{name}"), F.lit(""))

    detail = (F.when(b["name"] == "Bash", F.substring(arg("command"), 1, 200))
              .when(b["name"].isin("Read", "Edit", "Write"), arg("file_path"))
              .when(b["name"].isin("Grep", "Glob"), arg("pattern")).when(b["name"] == "Skill", arg("skill"))
              .when(b["name"] == "Agent", F.substring(arg("description"), 1, 100)).otherwise(""))
    kind = F.when(b["name"] == "Agent", F.coalesce(F.get_json_object(b["input"], "$.subagent_type"),
                                                  F.lit("general-purpose"))).otherwise("")
    prompt = F.when(b["name"] == "Agent", F.substring(arg("prompt"), 1, 2000)).otherwise("")
    return F.struct(F.coalesce(b["name"], F.lit("")).alias("name"), detail.alias("detail"), kind.alias("agent_type"),
                    prompt.alias("agent_prompt"))


def mode_changes(entries: DataFrame) -> DataFrame:
    """Mode and permission markers, only where the value differs from the previous one of its kind."""
    is_mode = F.col("type") == "mode"
    rows = entries.where(F.col("type").isin("mode", "permission-mode")).select(
        "session_id", "ord", "ts_ms", is_mode.alias("is_mode"),
        F.when(is_mode, F.col("mode")).otherwise(F.col("permission_mode")).alias("value")).where(F.col("value") != "")
    # Line order decides, so the line position is also the axis that cuts very long sessions.
    marked = with_previous(rows, ["session_id", "is_mode"], "ord", ["value"], ["value"], 1 << 20)
    changed = F.col("prev").isNull() | (F.col("prev.value") != F.col("value"))
    prefix = F.when(F.col("is_mode"), "Mode: ").otherwise("Permission: ")
    return marked.where(changed).select("session_id", "ord", "ts_ms", F.concat(prefix, "value").alias("content"))


def messages(classified_entries: DataFrame) -> DataFrame:
    """The replay list: (session_id, ord, pos, role, content, …) with the format's truncations."""
    e = classified_entries
    limit_hit = F.col("is_api_error") & classify.plan_limit_text(F.col("body"))
    backend = F.col("is_api_error") & ~classify.plan_limit_text(F.col("body")) & (F.trim("body") != "")
    api = limit_hit | backend
    texts = _joined("blocks", ("text",), "text", "\n")
    user_text, answer, thought = F.col("_user_text"), F.col("_answer"), F.col("_thought")
    is_user, is_answer = F.col("type") == "user", F.col("type") == "assistant"
    command = classify.command_label(user_text)
    role = (
        F.when(limit_hit, "rate_limit").when(backend, "error")
        .when(is_user & F.col("is_compact"), "compaction")
        .when(is_user & sessions.has_tool_result(), F.lit(None))
        .when(is_user & classify.is_command_text(user_text), F.when(command != "", "command"))
        .when(is_user & user_text.startswith(classify.INTERRUPT_PREFIX), "interrupt")
        .when(is_user & (user_text != ""), "user")
        .when(is_answer & ((answer != "") | (F.size(sessions.tool_names()) > 0) | (thought != "")), "assistant")
        .when((F.col("type") == "progress") & (F.col("data_type") == "hook_progress"), "hook")
        .when((F.col("type") == "attachment") & F.col("attachment_type").isin(*EFFORT_LABELS), "effort")
        .when((F.col("type") == "attachment") & F.col("attachment_type").isin(*ATTACHMENT_LABELS), "attachment")
        .when((F.col("type") == "queue-operation") & (F.trim("queue_text") != ""), "queue"))
    content = (
        F.when(F.col("role") == "rate_limit", F.substring("body", 1, 400))
        .when(F.col("role") == "error", F.substring("body", 1, 300))
        .when(F.col("role") == "command", command).when(F.col("role") == "interrupt", F.substring(user_text, 1, 160))
        .when(F.col("role") == "user", user_text).when(F.col("role") == "assistant", answer)
        .when(F.col("role") == "hook", F.col("hook_name"))
        .when(F.col("role") == "effort", _label(F.col("attachment_type"), EFFORT_LABELS))
        .when(F.col("role") == "attachment", _label(F.col("attachment_type"), ATTACHMENT_LABELS))
        .when(F.col("role") == "queue", F.substring(F.concat("queue_operation", F.lit(": "), F.trim("queue_text")), 1, 200))
        .otherwise(""))
    has_use = F.col("role") == "assistant"
    none = F.lit(None).cast("string")
    tools = F.transform(F.filter("blocks", lambda b: b["btype"] == "tool_use"), _tool_detail)
    flat = [F.when(has_use, F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c) for c in sessions.USAGE]
    # The role is exploded from an array of one: filters on a plain column, here and of the readers, would work out the
    # texts and the role again for each test.
    read = e.withColumn("_texts", texts).withColumn("_user_text", F.coalesce("content_text", "_texts", F.lit(""))).withColumn(
        "_answer", F.coalesce("_texts", F.lit(""))).withColumn(
        "_thought", F.trim(F.coalesce(_joined("blocks", ("thinking", "redacted_thinking"), "thinking", "\n\n"), F.lit(""))))
    rows = read.withColumn("_role", role).withColumn("role", F.explode_outer(F.array("_role"))).where(F.col("role").isNotNull()).select(
        "session_id", "ord", F.lit(-1).alias("pos"), "ts_ms", "role", content.alias("content"),
        F.when(has_use, F.col("model")).alias("model"), *flat, F.when(has_use, tools).alias("tools"),
        F.when(has_use & (thought != ""), F.substring(thought, 1, 8000)).alias("thinking"),
        F.when(backend, "backend").alias("source"),
        F.when(backend, classify.backend_error_category(F.col("body"))).alias("category"), none.alias("tool"))
    tool_type = rows.schema["tools"].dataType
    blank = {c: F.lit(None).cast("long").alias(c) for c in sessions.USAGE}

    def marker(df: DataFrame, role_: Column, content_: Column, pos: Column, source=none, category=none, tool=none):
        return df.select("session_id", "ord", pos.alias("pos"), "ts_ms", role_.alias("role"), content_.alias("content"),
                         none.alias("model"), *blank.values(), F.lit(None).cast(tool_type).alias("tools"),
                         none.alias("thinking"), source.alias("source"), category.alias("category"), tool.alias("tool"))

    failed = sessions.named_errors(e.where(~api)).where(F.col("category") != "cancelled")
    tool = F.when(F.col("tool") == "unknown", "").otherwise(F.col("tool"))
    is_rejected = F.col("counted_as") == "rejected"
    failures = marker(
        failed, F.when(is_rejected, "rejected").otherwise("error"),
        F.when(is_rejected, F.substring("message", 1, 200)).otherwise(
            F.substring(classify.clean_error_text(F.col("message")), 1, 2000)), F.col("pos"),
        F.when(~is_rejected, F.col("source")), F.when(~is_rejected, F.col("category")), tool)
    modes = marker(mode_changes(e), F.lit("mode"), F.col("content"), F.lit(-1))
    return rows.unionByName(failures).unionByName(modes)


def answers(message_rows: DataFrame) -> DataFrame:
    """Assistant messages with display model and cost rounded to four places."""
    rows = message_rows.where(F.col("role") == "assistant")
    return price_calls(rows).withColumn("cost", usd("cost_nusd", 4))


def role_group(role: Column) -> Column:
    return F.when(role == "user", "user").when(role == "assistant", "assistant").when(
        role.isin("error", "rate_limit"), "error").otherwise("event")


def chat_filter(message_rows: DataFrame, groups: list[str]) -> DataFrame:
    """Union of the chosen groups; ``agent-dispatch`` keeps answers that started an agent."""
    if not groups or "all" in groups:
        return message_rows
    dispatches = F.coalesce(F.exists("tools", lambda t: t["name"] == "Agent"), F.lit(False))
    keep = role_group(F.col("role")).isin(*groups)
    return message_rows.where(keep | dispatches if "agent-dispatch" in groups else keep)


def day_dividers(message_rows: DataFrame) -> DataFrame:
    """First message of each run of equal days (UTC days)."""
    dated = message_rows.where(F.col("ts_ms").isNotNull()).withColumn("day", utc_day("ts_ms"))
    marked = with_previous(dated.select("session_id", "ord", "pos", "day"), ["session_id"], "ord", ["pos"], ["day"],
                           ORD_CELL)
    return marked.where(F.col("prev").isNull() | (F.col("prev.day") != F.col("day"))).select(
        "session_id", "ord", "pos", "day")


def command_output_tokens(message_rows: DataFrame) -> DataFrame:
    """Output tokens of the answers after each command, up to the next user or command message.

    Edges are counted per cell of positions, so a long session is ordered by many tasks.
    """
    is_edge = F.col("role").isin("user", "command")
    relevant = message_rows.where(is_edge | (F.col("role") == "assistant"))
    marked = running_total(relevant, ["session_id"], "ord", ["pos"], is_edge.cast("long"), "grp", ORD_CELL).where(F.col("grp") > 0)
    head = F.max(F.when(is_edge, F.struct("role", "content", "ord"))).alias("h")
    return (marked.groupBy("session_id", "grp").agg(head, F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
            .where(F.col("h.role") == "command")
            .select("session_id", F.col("h.ord").alias("ord"), F.col("h.content").alias("command"), "output_tokens"))


def flow_nodes(message_rows: DataFrame) -> DataFrame:
    """Main, user and sub-agent nodes with token sums, cost and tool-call counts."""
    priced = answers(message_rows).groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation")],
        F.sum("cost").alias("cost"), F.sum(F.size("tools")).alias("tool_calls"))
    per = message_rows.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("messages"))
    base = per.join(priced, "session_id", "left")
    sums = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "tool_calls")
    zero = F.lit(0).cast("long")
    main = base.select("session_id", F.lit("main").alias("node_id"), F.lit("main").alias("type"), F.lit("Claude").alias("name"),
                       *[F.coalesce(c, zero).alias(c) for c in sums],
                       half_even(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"), zero.alias("messages"))
    user = base.select("session_id", F.lit("user").alias("node_id"), F.lit("user").alias("type"), F.lit("User").alias("name"),
                       *[zero.alias(c) for c in sums], F.lit(0.0).alias("cost"), "messages")
    agents = _dispatch_rows(message_rows).select(
        "session_id", "node_id", F.col("t.agent_type").alias("type"), F.substring("t.detail", 1, 80).alias("name"),
        *[zero.alias(c) for c in sums], F.lit(0.0).alias("cost"), zero.alias("messages"))
    return main.unionByName(user).unionByName(agents)


def _tool_rows(message_rows: DataFrame) -> DataFrame:
    """Tool calls as rows. The outer explode keeps Spark from testing the size of ``tools`` first, which would cut them out of the blocks twice."""
    return message_rows.where(F.col("role") == "assistant").select(
        "session_id", "ord", "ts_ms", F.posexplode_outer("tools").alias("tpos", "t")).where(F.col("t").isNotNull())


def _dispatch_rows(message_rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "tpos")) - 1
    agents = _tool_rows(message_rows).where(F.col("t.name") == "Agent")
    return agents.withColumn("node_id", F.concat(F.lit("subagent-"), rank.cast("string")))


def flow_edges(message_rows: DataFrame) -> DataFrame:
    talk = message_rows.select("session_id").distinct().select(
        "session_id", F.lit("user").alias("src"), F.lit("main").alias("dst"), F.lit("conversation").alias("type"))
    sent = _dispatch_rows(message_rows).select("session_id", F.lit("main").alias("src"), F.col("node_id").alias("dst"),
                                               F.lit("dispatch").alias("type"))
    return talk.unionByName(sent)


def flow_events(message_rows: DataFrame) -> DataFrame:
    """Timed events relative to the session's first dated message (never negative, 0 when undated)."""
    origin = message_rows.where(F.col("ts_ms").isNotNull()).groupBy("session_id").agg(
        F.min_by("ts_ms", F.struct("ord", "pos")).alias("t0"))
    none = F.lit("")
    points = message_rows.where(F.col("role").isin("user", "assistant", "compaction", "hook")).select(
        "session_id", "ord", F.lit(-1).alias("tpos"), "ts_ms",
        F.when(F.col("role").isin("user", "assistant"), "message").otherwise(F.col("role")).alias("type"),
        F.lit("main").alias("node_id"),
        F.when(F.col("role") == "hook", F.col("content")).when(F.col("role").isin("user", "assistant"), F.col("role"))
        .otherwise("").alias("label"), none.alias("detail"))
    calls = _tool_rows(message_rows).where(F.col("t.name") != "Agent").select(
        "session_id", "ord", "tpos", "ts_ms", F.lit("tool_call").alias("type"), F.lit("main").alias("node_id"),
        F.col("t.name").alias("label"), F.substring("t.detail", 1, 120).alias("detail"))
    spawns = _dispatch_rows(message_rows).select(
        "session_id", "ord", "tpos", "ts_ms", F.lit("agent_spawn").alias("type"), "node_id", none.alias("label"),
        none.alias("detail"))
    rows = points.unionByName(calls).unionByName(spawns).join(origin, "session_id", "left")
    t = F.greatest(F.lit(0), F.coalesce(F.col("ts_ms") - F.col("t0"), F.lit(0)))
    return rows.select("session_id", "ord", "tpos", t.alias("t"), "type", "node_id", "label", "detail")


def category_percent(categories: DataFrame) -> DataFrame:
    """Write categories of a session (one row each) with their share of all its written tokens, in whole percent."""
    total = F.sum("output_tokens").over(Window.partitionBy("session_id"))
    pct = F.when(total > 0, F.floor(F.col("output_tokens") / total * 100 + 0.5)).otherwise(0)
    return categories.select("session_id", "category", "output_tokens", pct.cast("long").alias("share_pct"))


def session_shares(tool_tokens: DataFrame, reasoning: DataFrame, limit: int = 15) -> DataFrame:
    """Per session: the most used tools with their share of all tool and reasoning output, in whole percent."""
    rest = reasoning.select("session_id", F.col("output_tokens").alias("r"))
    per = tool_tokens.groupBy("session_id").agg(F.sum("output_tokens").alias("o"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("calls"), "tool"))
    top = tool_tokens.withColumn("rank", rank).where(F.col("rank") <= limit)
    out = top.join(per, "session_id").join(rest, "session_id", "left")
    total = F.col("o") + F.coalesce("r", F.lit(0))
    pct = F.when(total > 0, F.floor(F.col("output_tokens") / total * 100 + 0.5)).otherwise(0)
    return out.select("session_id", "tool", "calls", "output_tokens", pct.cast("long").alias("share_pct"))

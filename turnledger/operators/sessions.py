"""Per-session facts from transcript entries: messages, turns, tools, errors, sub-agents, operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import classify
from turnledger.functions.pricing import price_calls
from turnledger.functions.scalars import usd
from turnledger.operators import facts
from turnledger.session import materialize

USAGE = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "cache_1h")


def first_text() -> Column:
    """String content, or the text of the first text block."""
    block = F.element_at(F.filter("blocks", lambda b: b["btype"] == "text"), 1)
    listed = F.when(F.exists("blocks", lambda b: b["btype"] == "text"), block["text"])
    return F.coalesce(F.col("content_text"), listed, F.lit(""))


def has_tool_result() -> Column:
    return F.coalesce(F.exists("blocks", lambda b: b["btype"] == "tool_result"), F.lit(False))


def classified(entries: DataFrame) -> DataFrame:
    """Add ``body`` text and ``category`` (prompt, tool_result, command, interrupt, meta, assistant, other)."""
    user = classify.user_entry_category(F.col("body"), has_tool_result(), F.col("is_meta"), F.col("is_compact"))
    return entries.withColumn("body", first_text()).withColumn(
        "category", F.when(F.col("type") == "user", user).when(F.col("type") == "assistant", "assistant")
        .otherwise("other"))


def session_attributes(entries: DataFrame) -> DataFrame:
    """First non-empty path, slug and provenance per session; one map-side-combined aggregation."""
    at = F.struct("source_rank", "file_path", "ord")

    def first(name: str, test: Column | None = None) -> Column:
        return F.min_by(name, F.when(test, at) if test is not None else at)

    filled = [first(c, F.col(c) != "").alias(c) for c in ("cwd", "slug", "agent_type", "agent_description")]
    out = entries.groupBy("session_id").agg(
        *filled, *[first(c).alias(c) for c in ("source", "file_size")], F.max("is_subagent").alias("is_subagent"),
        F.max("parent_id").alias("parent_id"), F.max("agent_id").alias("agent_id"))
    for c in ("cwd", "slug", "agent_type", "agent_description"):
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    return out.withColumn("project", classify.project_display(F.col("cwd")))


def message_counters(classified_entries: DataFrame) -> DataFrame:
    """Counts per category, compactions, and start / end over conversational entries."""
    is_talk = F.col("type").isin("user", "assistant")
    names = ("prompt", "tool_result", "command", "interrupt", "meta", "assistant")
    return classified_entries.groupBy("session_id").agg(
        *[F.count_if(F.col("category") == n).alias(n) for n in names],
        F.count_if(F.col("category").isin("prompt", "assistant")).alias("messages"),
        F.count_if((F.col("type") == "user") & F.col("is_compact")).alias("compactions"),
        F.min(F.when(is_talk, F.col("ts_ms"))).alias("start_ms"), F.max(F.when(is_talk, F.col("ts_ms"))).alias("end_ms"))


def first_prompts(classified_entries: DataFrame) -> DataFrame:
    """First 200 characters of the first user text that is no command, interrupt or tool result."""
    leads_with_result = F.coalesce(F.try_element_at(F.col("blocks"), F.lit(1))["btype"] == "tool_result", F.lit(False))
    plain = (~classify.is_command_text(F.col("body")) & ~F.col("body").startswith(classify.INTERRUPT_PREFIX)
             & (F.col("body") != "") & ~leads_with_result)
    return (classified_entries.where((F.col("type") == "user") & plain).groupBy("session_id")
            .agg(F.min_by(F.substring("body", 1, 200), F.struct("source_rank", "file_path", "ord")).alias("first_prompt")))


def tool_names() -> Column:
    uses = F.filter("blocks", lambda b: b["btype"] == "tool_use")
    return F.coalesce(F.transform(uses, lambda b: F.coalesce(b["name"], F.lit("unknown"))),
                      F.array().cast("array<string>"))


def turns(classified_entries: DataFrame) -> DataFrame:
    """Assistant entries with flat usage columns and the list of tools called."""
    assistant = classified_entries.where(F.col("type") == "assistant")
    flat = [F.coalesce(F.col(f"usage.{c}"), F.lit(0)).alias(c) for c in USAGE]
    empty = F.array().cast(classified_entries.schema["blocks"].dataType)
    return assistant.select("session_id", "source", "source_rank", "file_path", "ord", "ts_ms", "model", *flat,
                            tool_names().alias("tools"), F.coalesce("blocks", empty).alias("blocks"))


def message_rows(classified_entries: DataFrame) -> DataFrame:
    """Rows that count as messages (prompts and assistant entries), shaped for ``facts.slices``."""
    rows = classified_entries.where(F.col("category").isin("prompt", "assistant"))
    is_answer = F.col("category") == "assistant"
    flat = [F.when(is_answer, F.coalesce(F.col(f"usage.{c}"), F.lit(0))).otherwise(0).cast("long").alias(c)
            for c in USAGE]
    return rows.select("session_id", "ord", "ts_ms", F.when(is_answer, F.col("model")).alias("model"), *flat)


def day_slices(classified_entries: DataFrame, attributes: DataFrame, absorb: bool = True) -> DataFrame:
    """Session-day-model slices of a transcript set.

    With ``absorb`` the spend of sub-agent sessions whose parent exists is added to the parent by re-keying the
    rows; messages stay with their own session, and undated spend goes to the parent's start day.
    """
    counters = classified_entries.where(F.col("type").isin("user", "assistant")).groupBy("session_id").agg(
        F.min("ts_ms").alias("start_ms"))
    owners = owner_table(attributes)
    starts = counters.where(F.col("start_ms").isNotNull())
    rows = message_rows(classified_entries).withColumn("write_1h", F.least("cache_1h", "cache_creation"))
    if absorb:
        rows = rows.join(owners, "session_id")
    else:
        rows = rows.withColumn("owner_id", F.col("session_id"))
    from turnledger.functions.scalars import utc_day

    is_call = F.col("output_tokens") > 0
    own = F.col("owner_id") == F.col("session_id")
    folded = rows.groupBy("owner_id", utc_day("ts_ms").alias("day"), "model").agg(
        F.count_if(own).alias("messages"), F.count_if(is_call).alias("calls"),
        *[F.coalesce(F.sum(F.when(is_call, F.col(c))), F.lit(0)).alias(c) for c in facts.TOKEN_COLUMNS])
    dims = attributes.select(F.col("session_id").alias("owner_id"), "source", "project")
    out = folded.join(starts.withColumnRenamed("session_id", "owner_id"), "owner_id").join(dims, "owner_id")
    return (out.withColumn("day", F.coalesce("day", utc_day("start_ms"))).withColumnRenamed("owner_id", "session_id")
            .drop("start_ms")
            .groupBy(*facts.SESSION_KEYS, "day", "model")
            .agg(F.sum("messages").alias("messages"), F.sum("calls").alias("calls"),
                 *[F.sum(c).alias(c) for c in facts.TOKEN_COLUMNS])
            .where((F.col("messages") > 0) | (F.col("calls") > 0)))


def owner_table(attributes: DataFrame) -> DataFrame:
    """Owner of each session: the parent for sub-agents whose parent exists, else the session itself."""
    parents = attributes.select(F.col("session_id").alias("_p"))
    joined = attributes.join(parents, F.col("is_subagent") & (F.col("parent_id") != "")
                             & (F.col("parent_id") == F.col("_p")), "left")
    return joined.select("session_id", F.coalesce("_p", "session_id").alias("owner_id"))


def visible(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows of sessions that were not absorbed by a parent."""
    absorbed = owners.where(F.col("owner_id") != F.col("session_id")).select("session_id")
    return rows.join(absorbed, "session_id", "left_anti")


def subagent_summaries(turn_rows: DataFrame, counters: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per absorbed sub-agent: parent, tokens, cost, messages and number of tool calls."""
    owners = owner_table(attributes).where(F.col("owner_id") != F.col("session_id"))
    use = price_calls(turn_rows.where(F.col("output_tokens") > 0)).groupBy("session_id").agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_nusd").alias("cost_nusd"))
    tools = turn_rows.groupBy("session_id").agg(F.sum(F.size("tools")).alias("tool_calls"))
    return (owners.join(use, "session_id", "left").join(tools, "session_id", "left")
            .join(counters.select("session_id", "messages"), "session_id", "left")
            .select(F.col("owner_id").alias("parent_id"), "session_id", F.coalesce("tokens", F.lit(0)).alias("tokens"),
                    usd(F.coalesce("cost_nusd", F.lit(0)), 4).alias("cost"), "messages",
                    F.coalesce("tool_calls", F.lit(0)).alias("tool_calls")))


def tool_uses(entries: DataFrame) -> DataFrame:
    """One row per tool call with its arguments."""
    exploded = entries.where(F.col("type") == "assistant").select(
        "session_id", "ord", "ts_ms", "ts_text", F.posexplode("blocks").alias("pos", "b")).where(
        F.col("b.btype") == "tool_use")
    return exploded.select("session_id", "ord", "pos", "ts_ms", "ts_text", F.coalesce("b.id", F.lit("")).alias("tool_id"),
                           F.coalesce("b.name", F.lit("unknown")).alias("tool"), F.col("b.input").alias("input"))


def argument(name: str) -> Column:
    return F.coalesce(F.get_json_object("input", f"$.{name}"), F.lit(""))


def tool_results(entries: DataFrame) -> DataFrame:
    exploded = entries.where(F.col("type") == "user").select(
        "session_id", "ord", "ts_ms", "ts_text", "result_agent_id", F.posexplode("blocks").alias("pos", "b"))
    return exploded.select("session_id", "ord", "pos", "ts_ms", "ts_text", "result_agent_id",
                           F.col("b.btype").alias("btype"), F.coalesce("b.tool_use_id", F.lit("")).alias("tool_id"),
                           F.coalesce("b.content", F.lit("")).alias("content"), F.col("b.is_error").alias("is_error"))


def named_errors(entries: DataFrame) -> DataFrame:
    """Failed tool results with the tool of the latest earlier call of that id, classified.

    Hash join on (session, tool id): ids spread a large session over all tasks.
    """
    calls = tool_uses(entries).where(F.col("tool_id") != "").select(
        "session_id", "tool_id", F.col("ord").alias("call_ord"), F.col("pos").alias("call_pos"), "tool")
    failed = tool_results(entries).where(F.col("is_error"))
    joined = failed.join(calls, ["session_id", "tool_id"], "left")
    earlier = F.when(F.col("call_ord") < F.col("ord"), F.struct("call_ord", "call_pos"))
    keys = ["session_id", "ord", "pos"]
    tool = F.max_by("tool", earlier)
    named = joined.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("ts_ms", "ts_text", "tool_id", "content")],
        F.coalesce(tool, F.lit("unknown")).alias("tool"))
    message = classify.unwrap_tool_error(F.col("content"))
    out = named.withColumn("message", message).withColumn("c", classify.tool_error_class(F.col("message"), F.col("tool")))
    return out.select(*keys, "ts_ms", "ts_text", "tool_id", "tool", "message", "c.source", "c.category",
                      classify.error_account(F.col("c.source"), F.col("c.category")).alias("counted_as"))


def backend_failures(classified_entries: DataFrame) -> DataFrame:
    """API-error entries with a text, as backend errors."""
    rows = classified_entries.where(F.col("is_api_error") & (F.trim("body") != ""))
    return rows.select("session_id", "ord", F.lit(-1).alias("pos"), "ts_ms", "ts_text", F.lit("").alias("tool_id"),
                       F.lit("").alias("tool"), F.col("body").alias("message"), F.lit("backend").alias("source"),
                       classify.backend_error_category(F.col("body")).alias("category"),
                       F.lit("backend").alias("counted_as"))


def error_rows(classified_entries: DataFrame) -> DataFrame:
    """All errors of a session, cancelled sibling calls included with ``counted_as`` NULL; messages cut to 200."""
    both = named_errors(classified_entries).unionByName(backend_failures(classified_entries))
    return both.withColumn("message", F.substring("message", 1, 200))


def error_counters(errors: DataFrame) -> DataFrame:
    kinds = ("tool", "hook", "backend", "rejected")
    return errors.groupBy("session_id").agg(
        F.count("counted_as").alias("errors"), F.count_if(F.col("category") == "cancelled").alias("cancelled"),
        *[F.count_if(F.col("counted_as") == k).alias(f"{k}_errors") for k in kinds])


def hooks(entries: DataFrame) -> DataFrame:
    rows = entries.where((F.col("type") == "progress") & (F.col("data_type") == "hook_progress"))
    return rows.where(F.col("hook_name") != "").select("session_id", "ord", F.col("hook_name").alias("name"))


def skills(uses: DataFrame) -> DataFrame:
    name = F.coalesce(F.get_json_object("input", "$.skill"), F.lit("unknown"))
    return uses.where(F.col("tool") == "Skill").select("session_id", "ord", name.alias("name"))


def file_operations(uses: DataFrame) -> DataFrame:
    rows = uses.where(F.col("tool").isin("Read", "Edit", "Write")).withColumn("path", argument("file_path"))
    return rows.where(F.col("path") != "").select("session_id", "ord", "pos", "ts_ms", F.lower("tool").alias("op"), "path")


def git_operations(uses: DataFrame) -> DataFrame:
    rows = uses.where(F.col("tool") == "Bash").withColumn("g", classify.git_operation(argument("command")))
    return rows.where(F.col("g").isNotNull()).select("session_id", "ord", "pos", "ts_ms", "g.kind", "g.message")


def agent_dispatches(entries: DataFrame, attributes: DataFrame) -> DataFrame:
    """Dispatches with the agent they started.

    A tool result that names an agent links it to its call. A sub-agent without a known type adds one
    ``<unlinked>`` dispatch; a typed one whose dispatch is still open takes the first open dispatch of its type,
    matched by rank within (parent, type).
    """
    uses = tool_uses(entries).where(F.col("tool") == "Agent")
    named = (tool_results(entries).where((F.col("btype") == "tool_result") & (F.col("result_agent_id") != "")
                                         & (F.col("tool_id") != ""))
             .groupBy("session_id", "tool_id").agg(F.max_by("result_agent_id", F.struct("ord", "pos")).alias("agent_id")))
    kind = F.coalesce(F.get_json_object("input", "$.subagent_type"), F.lit("general-purpose"))
    base = uses.join(named, ["session_id", "tool_id"], "left").select(
        "session_id", "ord", "pos", "tool_id", kind.alias("type"), argument("description").alias("description"),
        F.coalesce("agent_id", F.lit("")).alias("agent_id"))

    owners = owner_table(attributes).where(F.col("owner_id") != F.col("session_id"))
    subs = attributes.join(owners, "session_id").select(
        F.col("owner_id").alias("parent"), F.col("session_id").alias("sub"), "agent_id", "agent_type", "agent_description")
    linked = base.where(F.col("agent_id") != "").groupBy("session_id", "agent_id").agg(
        F.min_by(F.struct("type", "description"), F.struct("ord", "pos")).alias("d"))
    typed = subs.join(linked.select(F.col("session_id").alias("parent"), "agent_id", "d"), ["parent", "agent_id"], "left")
    typed = typed.withColumn("kind", F.when(F.col("agent_type") != "", F.col("agent_type")).otherwise(
        F.coalesce("d.type", F.lit(""))))
    synthetic = typed.where(F.col("kind") == "").select(
        F.col("parent").alias("session_id"), F.lit(None).cast("long").alias("ord"), F.lit(0).alias("pos"),
        F.lit("").alias("tool_id"), F.lit("<unlinked>").alias("type"), F.col("agent_description").alias("description"),
        "agent_id")
    pending = typed.where((F.col("kind") != "") & (F.col("agent_id") != ""))
    pending = pending.select("parent", "kind", F.col("agent_id").alias("fill"), F.row_number().over(
        Window.partitionBy("parent", "kind").orderBy("sub")).alias("slot"))
    open_slots = base.where(F.col("agent_id") == "").select(
        "session_id", "ord", "pos", "type", F.row_number().over(
            Window.partitionBy("session_id", "type").orderBy("ord", "pos")).alias("slot"))
    filled = open_slots.join(pending, (F.col("session_id") == F.col("parent")) & (F.col("type") == F.col("kind"))
                             & (open_slots["slot"] == pending["slot"])).select("session_id", "ord", "pos", "fill")
    out = base.join(filled, ["session_id", "ord", "pos"], "left").withColumn(
        "agent_id", F.when(F.col("agent_id") == "", F.coalesce("fill", F.lit(""))).otherwise(F.col("agent_id"))).drop("fill")
    return out.unionByName(synthetic.select(out.columns))


def session_core(classified_entries: DataFrame) -> DataFrame:
    """Attributes, counters, first prompt, primary model, context peak and operation counts in one scan.

    Rows fold to (session, model) first and to the session second, so one long session is combined map-side and
    spread over its models before its own row forms, and prices meet model sums instead of calls.
    """
    from turnledger.functions.pricing import cost_nano, with_prices
    from turnledger.operators import anomalies

    at = F.struct("source_rank", "file_path", "ord")
    e = classified_entries
    is_answer = F.col("type") == "assistant"
    for c in USAGE:
        e = e.withColumn(c, F.coalesce(F.col(f"usage.{c}"), F.lit(0)))
    n_tools = F.size(F.filter("blocks", lambda b: b["btype"] == "tool_use"))
    is_call = is_answer & (F.col("output_tokens") > 0)
    thinks = is_call & (F.coalesce(n_tools, F.lit(0)) <= 0)
    dated = is_call & F.col("ts_ms").isNotNull()
    talk = F.col("type").isin("user", "assistant")
    over = dated & (anomalies.context_size() > anomalies.LONG_CONTEXT_TOKENS)

    def tools_where(test) -> Column:
        hits = F.size(F.filter("blocks", lambda b: (b["btype"] == "tool_use") & test(b)))
        return F.coalesce(F.sum(F.when(is_answer & (hits > 0), hits)), F.lit(0))

    def has_path(b: Column) -> Column:
        return b["name"].isin("Read", "Edit", "Write") & (F.coalesce(F.get_json_object(b["input"], "$.file_path"), F.lit("")) != "")

    def is_git(b: Column) -> Column:
        return (b["name"] == "Bash") & classify.git_operation(F.get_json_object(b["input"], "$.command")).isNotNull()

    leads = F.coalesce(F.try_element_at(F.col("blocks"), F.lit(1))["btype"] == "tool_result", F.lit(False))
    plain = ((F.col("type") == "user") & ~classify.is_command_text(F.col("body")) & (F.col("body") != "")
             & ~F.col("body").startswith(classify.INTERRUPT_PREFIX) & ~leads)
    tokens = ("input_tokens", "output_tokens", "cache_read", "cache_creation", "write_1h")
    e = e.withColumn("write_1h", F.least("cache_1h", "cache_creation"))
    texts = {c: F.col(c) != "" for c in ("cwd", "slug", "agent_type", "agent_description")}
    always = {c: F.lit(True) for c in ("source", "file_size")}
    counts = ("prompt", "tool_result", "command", "interrupt", "meta", "assistant")
    sums = (*counts, "messages", "compactions", "tool_calls", "file_ops", "git_ops")
    by_model = e.groupBy("session_id", F.when(is_answer, F.col("model")).alias("model")).agg(
        *[F.count_if(F.col("category") == n).alias(n) for n in counts],
        F.count_if(F.col("category").isin("prompt", "assistant")).alias("messages"),
        F.count_if((F.col("type") == "user") & F.col("is_compact")).alias("compactions"),
        F.min(F.when(talk, F.col("ts_ms"))).alias("start_ms"), F.max(F.when(talk, F.col("ts_ms"))).alias("end_ms"),
        *[F.min(F.when(test, F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"_{c}") for c, test in {**texts, **always}.items()],
        F.min(F.when(plain, F.struct(at.alias("at"), F.substring("body", 1, 200).alias("v")))).alias("_first_prompt"),
        F.max("is_subagent").alias("is_subagent"), F.max("parent_id").alias("parent_id"), F.max("agent_id").alias("agent_id"),
        tools_where(lambda b: F.lit(True)).alias("tool_calls"), tools_where(has_path).alias("file_ops"),
        tools_where(is_git).alias("git_ops"),
        F.max(F.when(dated, anomalies.context_size())).alias("peak_context_tokens"),
        F.min(F.when(over, F.col("ts_ms"))).alias("first_long_ms"),
        F.sum(F.when(is_call, F.col("output_tokens"))).alias("_out"), F.min(F.when(is_call, F.col("ord"))).alias("_first_call"),
        *[F.coalesce(F.sum(F.when(thinks, F.col(c))), F.lit(0)).alias(c) for c in tokens])
    by_model = with_prices(by_model).withColumn("reasoning_cost_nusd", cost_nano())
    best = F.max_by(F.when(F.col("_out") > 0, F.col("display")), F.when(
        F.col("_out") > 0, F.struct(F.col("_out"), -F.col("_first_call"))))
    out = by_model.groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        *[F.coalesce(F.min(f"_{c}")["v"], F.lit("")).alias(c) for c in (*texts, "source", "first_prompt")],
        F.min("_file_size")["v"].alias("file_size"), F.max("is_subagent").alias("is_subagent"),
        F.max("parent_id").alias("parent_id"), F.max("agent_id").alias("agent_id"),
        F.max("peak_context_tokens").alias("peak_context_tokens"), F.min("first_long_ms").alias("first_long_ms"),
        F.sum("output_tokens").alias("reasoning_output_tokens"), F.sum("reasoning_cost_nusd").alias("reasoning_cost_nusd"),
        F.coalesce(best, F.lit("Unknown")).alias("primary_model"))
    return (out.withColumn("project", classify.project_display(F.col("cwd")))
            .withColumn("used_long_context", F.coalesce(F.col("peak_context_tokens") > anomalies.LONG_CONTEXT_TOKENS, F.lit(False))))


def session_rows(classified_entries: DataFrame, absorb: bool = True) -> DataFrame:
    """The exported session row: one core scan plus usage by owner, errors, dispatches and cache flushes.

    The core table (one row per session) feeds six joins below, so it is written once to the shared folder.
    """
    from turnledger.operators import anomalies, series

    core = materialize(session_core(classified_entries), "session-core")
    slices_ = day_slices(classified_entries, core, absorb)
    totals = series.session_totals(slices_).drop("messages", "source", "project", "date", "end_date")
    calls = turns(classified_entries)
    # After linking, the longer cache lifetime also applies where only an absorbed sub-agent used it.
    ttl = slices_.groupBy("session_id").agg((F.max("cache_1h") > 0).alias("has_1h"))
    parts = [totals, error_counters(error_rows(classified_entries)),
             agent_dispatches(classified_entries, core).groupBy("session_id").agg(F.count(F.lit(1)).alias("agent_dispatches")),
             anomalies.cache_flushes(calls, session_ttl=ttl, compactions=compactions(classified_entries))]
    out = core.where(F.col("start_ms").isNotNull())
    for part in parts:
        out = out.join(part, "session_id", "left")
    if absorb:
        out = visible(out, owner_table(core))
    numbers = [c for c, t in out.dtypes if t == "bigint" and c not in ("start_ms", "end_ms", "first_long_ms")]
    return out.fillna(0, numbers).withColumn(
        "duration_min", F.rint((F.col("end_ms") - F.col("start_ms")) / 6000.0) / 10.0)


def compactions(entries: DataFrame) -> DataFrame:
    """Compaction events: (session_id, ord, ts_ms) of dated summary entries."""
    return entries.where((F.col("type") == "user") & F.col("is_compact") & F.col("ts_ms").isNotNull()).select(
        "session_id", "ord", "ts_ms")

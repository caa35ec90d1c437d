"""Adapters from the driver's parquet tables to the engine's inputs (column-pruned, lazy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.scalars import DAY_MS
from turnledger.session import PLAIN, materialize

EPOCH_2024_DAY = 19723  # 2024-01-01 as days since 1970-01-01
# Fixed values of the table mapping.
LEDGER_MODELS = ("claude-opus-4-8", "claude-sonnet-4-6", "claude-haiku-4-5-20251001", "claude-opus-4-8[1m]",
                 "claude-nova-9")
LEDGER_TOOLS = ("Read", "Bash", "Edit", "Grep")
ERROR_MESSAGES = (
    "Cancelled: parallel tool call", "User rejected the edit", "hook error: exit", "String to replace not found",
    "Found 3 matches of the string", "File has not been read yet", "No such file", "bash: foo: command not found",
    "Permission denied", "timed out after 120s", "Exit code 1", "unexpected",
)
BACKEND_MESSAGES = (
    "You've hit your limit · resets 6pm", "API Error: 529 overloaded", "API Error: 401 run /login",
    "API Error: 500 internal server error", "Connection error: socket closed", "Output blocked by content filtering",
    "prompt is too long: 210000 tokens", "API Error: Rate limit reached", "unclassified failure",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPREAD_ROWS = 50_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Deal the rows of an input out evenly for row-heavy work: every core has some, and no task more than ``rows``.

    How many partitions a scan has says little: splits are cut by bytes, and only the one with the middle of a row group
    reads its rows. The count comes from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def pick_known(values, index: Column) -> Column:
    """As ``pick``, NULL for a NULL index; compiled, ``element_at`` on literals takes a value for it."""
    return F.when(index.isNotNull(), pick(values, index))


def _events(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ts_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return (spread(events) if busy else events).select(
        "event_id", "user_id", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"), ts_ms.alias("ts_ms"))


def usage_ledger(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """One assistant turn per event, with session, source, project, model, usage and the tools it called.

    ``busy`` marks row-heavy use (pricing every call), for which a one-file table is spread over the cores.
    """
    k = F.col("k")
    block = F.floor((F.floor(F.col("ts_ms") / DAY_MS) - EPOCH_2024_DAY) / 5).cast("int")
    user = F.col("user_id")
    tools = F.when(k % 6 > 0, F.transform(F.sequence(F.lit(0), k % 6 - 1),
                                         lambda pos: pick(LEDGER_TOOLS, (k + pos) % 4)))
    return _events(spark, sf_dir, busy).select(
        F.concat(F.lit("u"), user.cast("string"), F.lit("_"), block.cast("string")).alias("session_id"),
        F.concat(F.lit("src"), (user % 3).cast("string")).alias("source"),
        F.concat(F.lit("proj"), (user % 7).cast("string")).alias("project"),
        user.alias("account"), F.col("event_id").alias("ord"), "ts_ms", "event_type", "k",
        pick(LEDGER_MODELS, k % 5).alias("model"),
        (k + 10).cast("long").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        F.when(k % 4 == 0, 0).otherwise(k * 2500 + 2000).cast("long").alias("cache_read"),
        F.when(k % 4 == 0, k * 10 + 5000).otherwise(k + 100).cast("long").alias("cache_creation"),
        F.when(k % 2 == 0, 50).otherwise(0).cast("long").alias("cache_1h"),
        F.coalesce(tools, F.array().cast("array<string>")).alias("tools"))


def tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return (_events(spark, sf_dir).where(F.col("event_type") == "error")
            .select("event_id", F.col("user_id").alias("account"), "ts_ms",
                    pick(LEDGER_TOOLS, k % 4).alias("tool"), pick(ERROR_MESSAGES, k % 12).alias("message")))


def backend_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_events(spark, sf_dir).where(F.col("event_type") == "error")
            .select("event_id", F.col("user_id").alias("account"), "ts_ms",
                    pick(BACKEND_MESSAGES, F.col("k") % 9).alias("text")))


def chat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = (conv * 7 + turn) % 11
    is_user = F.col("role") == "user"
    text = (F.when(is_user & (kind == 3), "<command-name>compact</command-name><command-args>now</command-args>")
            .when(is_user & (kind == 5), "[Request interrupted by user]").otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), conv.cast("string")).alias("session_id"), turn.alias("ord"),
        (F.lit(1704067200000) + conv * 3600000 + turn * 60000).alias("ts_ms"),
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"),
        (F.col("role") == "system").alias("is_meta"), text.alias("text"))


# ---- transcripts derived from the events table --------------------------------------------------------------------

def _j(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _s(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _tool_input(tool: Column, k: Column) -> Column:
    """Arguments of a derived tool call; fields that do not apply stay out of the JSON text."""
    path = F.concat(F.lit("/src/f"), (k % 10).cast("string"), F.lit(".py"))
    return F.struct(F.when(tool.isin("Read", "Edit", "Write"), path).alias("file_path"),
                    F.when(tool == "Bash", F.lit("make test")).alias("command"),
                    F.when(tool == "Grep", F.concat(F.lit("x"), k.cast("string"))).alias("pattern"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze lines: every event becomes one to three JSONL lines of its session's transcript.

    signup: user text; error: a call and its failed result; view: a response split over two lines with a tool
    result in between; click: a response with thinking and a special tool; purchase: markers and short answers.
    """
    e = _events(spark, sf_dir, busy=True)
    k, user, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    block = F.floor((F.floor(F.col("ts_ms") / DAY_MS) - EPOCH_2024_DAY) / 5).cast("int").cast("string")
    sid = F.concat(F.lit("u"), user.cast("string"), F.lit("_"), block)
    parent = F.concat(F.lit("u"), (user - 1).cast("string"), F.lit("_"), block)
    ks, es = k.cast("string"), eid.cast("string")
    iso = F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    stamp = (F.when((k == 99) & (F.col("event_type") == "purchase"), "not-a-time")
             .when(k % 7 == 0, F.col("ts_ms").cast("string")).otherwise(iso))
    base = dict(sessionId=F.col("sid"), timestamp=F.col("stamp"), cwd=F.col("cwd"), slug=F.concat(F.lit("s-"), F.col("sid")))
    e = e.select("*", sid.alias("sid"), parent.alias("parent"), stamp.alias("stamp"),
                 F.concat(F.lit("/home/dev/proj"), (user % 7).cast("string")).alias("cwd"))
    out = F.floor(F.col("value") * 10).cast("long")
    read = F.when(k % 4 == 0, 0).otherwise(k * 2500 + 2000).cast("long")
    write = F.when(k % 4 == 0, k * 10 + 5000).otherwise(k + 100).cast("long")

    def usage(output: Column) -> Column:
        one_hour = F.when(k % 2 == 0, 50).otherwise(0)
        return _s(input_tokens=(k + 10), output_tokens=output, cache_read_input_tokens=read,
                  cache_creation_input_tokens=write,
                  cache_creation=_s(ephemeral_5m_input_tokens=F.greatest(write - one_hour, F.lit(0)),
                                    ephemeral_1h_input_tokens=one_hour))

    def answer(content: Column, output: Column | None = out, **more) -> Column:
        message = dict(id=F.concat(F.lit("m"), es), model=pick_known(LEDGER_MODELS, k % 5), content=content)
        if output is not None:
            message["usage"] = usage(output)
        return _j(type="assistant", **base, message=_s(**message), **more)

    def text(value: Column) -> Column:
        return _s(type="text", text=value)

    def result(content: Column, tool_id: Column, is_error: bool) -> Column:
        return F.array(_s(type="tool_result", tool_use_id=tool_id, content=content, is_error=is_error))

    def said(content, **more) -> Column:
        return _j(type="user", **base, message=_s(role="user", content=content), **more)

    def marker(kind: str, **more) -> Column:
        return _j(type=kind, **base, **more)

    # signup
    prompt = (F.when(k % 8 == 0, said(F.lit("<command-name>compact</command-name><command-args>now</command-args>")))
              .when(k % 8 == 1, said(F.lit("[Request interrupted by user]")))
              .when(k % 8 == 2, said(F.lit("note"), isMeta=True))
              .when(k % 8 == 3, said(F.lit("summary"), isCompactSummary=True))
              .otherwise(said(F.concat(F.lit("Please fix item "), ks))))
    # error
    tool = pick_known(LEDGER_TOOLS, k % 4)
    call_id = F.concat(F.lit("t"), es)
    failing = answer(F.array(_s(type="tool_use", id=call_id, name=tool, input=_tool_input(tool, k))))
    failed = said(result(pick_known(ERROR_MESSAGES, k % 12), F.when(k % 10 == 9, F.concat(F.lit("zz"), es)).otherwise(call_id), True))
    # view
    look = answer(F.array(text(F.concat(F.lit("Looking at item "), ks))), F.lit(1).cast("long"))
    # One to five calls, cut from an array of five: the body of a lambda would be interpreted.
    many = F.slice(F.array(*[_s(
        type="tool_use", id=F.concat(F.lit("t"), es, F.lit(f"_{pos}")),
        name=pick_known(LEDGER_TOOLS, (k + pos) % 4), input=_tool_input(pick_known(LEDGER_TOOLS, (k + pos) % 4), k)) for pos in range(5)]),
        1, F.greatest(k % 6, F.lit(1)))
    uses = F.when(k % 6 == 0, answer(F.array().cast("array<struct<type:string>>"))).otherwise(answer(many))
    fine = said(result(F.lit("ok"), F.concat(F.lit("t"), es, F.lit("_0")), False))
    # click
    thinking = _s(type="thinking", thinking=F.repeat(F.lit("t"), k % 13))
    special_id = F.concat(F.lit("s"), es)

    def special(name: str, args: Column) -> Column:
        return F.to_json(_s(type="tool_use", id=special_id, name=name, input=args))

    agent = special("Agent", F.struct(F.when(k % 20 == 0, F.lit("explorer")).alias("subagent_type"),
                                     F.concat(F.lit("scan "), (k % 5).cast("string")).alias("description"),
                                     F.lit("look around").alias("prompt")))
    extra = (F.when(k % 10 == 0, agent)
             .when(k % 10 == 1, special("Skill", _s(skill=F.concat(F.lit("skill"), (k % 4).cast("string")))))
             .when(k % 10 == 2, special("Bash", _s(command=F.concat(F.lit('git commit -m "fix '), ks, F.lit('"')))))
             .when(k % 10 == 3, special("Bash", _s(command="git push origin main")))
             .when(k % 10 == 4, special("Bash", _s(command=F.concat(F.lit("gh pr create --title pr"), ks))))
             .when(k % 10 == 5, special("Write", _tool_input(F.lit("Write"), k)))
             .when(k % 10 == 6, special("Read", _tool_input(F.lit("Read"), k))))
    pieces = F.concat_ws(",", F.when(k % 3 == 0, F.to_json(thinking)), F.to_json(text(F.concat(F.lit("Done "), ks))), extra)
    # The mixed block list is spliced into the line as JSON text.
    clicked = F.replace(answer(F.lit("@@blocks@@")), F.lit('"@@blocks@@"'),
                        F.concat(F.lit("["), pieces, F.lit("]")))
    started = said(result(F.lit("started"), special_id, False),
                   toolUseResult=_s(agentId=F.concat(F.lit("u"), (user + 1).cast("string"), F.lit("_"), block)))
    # purchase
    api_error = answer(F.array(text(pick_known(BACKEND_MESSAGES, k % 9))), None, isApiErrorMessage=True)
    bought = (F.when(k % 10 == 0, api_error)
              .when(k % 10 == 1, marker("progress", data=_s(type="hook_progress", hookEvent="PreToolUse",
                                                           hookName=F.concat(F.lit("h"), (k % 3).cast("string")))))
              .when(k % 10 == 2, marker("mode", mode=F.when(k % 20 == 2, "plan").otherwise("default")))
              .when(k % 10 == 3, marker("permission-mode", permissionMode=F.when(k % 20 == 3, "ask").otherwise("auto")))
              .when(k % 10 == 4, marker("attachment", attachment=_s(type=F.when(k % 20 == 4, "image").otherwise("task_reminder"))))
              .when(k % 10 == 5, marker("queue-operation", operation="enqueue", content=F.concat(F.lit("later "), ks)))
              .otherwise(answer(F.array(text(F.concat(F.lit("Answer "), ks))))))

    kind = F.col("event_type")
    lines = (F.when(kind == "signup", F.array(prompt)).when(kind == "error", F.array(failing, failed))
             .when((kind == "view") & (k % 6 == 0), F.array(look, uses))
             .when(kind == "view", F.array(look, fine, uses))
             .when((kind == "click") & (k % 10 == 0) & (user % 5 == 3), F.array(clicked, started))
             .when(kind == "click", F.array(clicked)).otherwise(F.array(bought)))
    is_sub = user % 5 == 4
    # A column of its own is compiled; inside of the generator the expression would be interpreted. The outer form keeps
    # Spark from testing the array's size before, which would build every line twice, the first time without compiled code.
    rows = e.select("sid", "parent", is_sub.alias("is_subagent"), eid.alias("eid"), user.alias("uid"),
                    (user % 3).alias("src"), lines.alias("lines")).select("*", F.posexplode_outer("lines").alias("j", "value"))
    # Sessions of every sixth user were resumed: odd events lie in a second file whose positions start anew.
    two_files = (F.col("uid") % 6 == 1) & ~F.col("is_subagent")
    stem = F.concat("sid", F.when(two_files & (F.col("eid") % 2 == 1), "_b").otherwise(""))
    return rows.select(
        "value", (F.when(two_files, F.floor(F.col("eid") / 2)).otherwise(F.col("eid")) * 4 + F.col("j")).alias("ord"), F.col("src").cast("int").alias("source_rank"),
        F.concat(F.lit("src"), F.col("src").cast("string")).alias("source"), F.lit(1048576).cast("long").alias("file_size"),
        F.concat(F.lit("/"), stem, F.lit(".jsonl")).alias("file_path"), stem.alias("file_stem"),
        "is_subagent", F.when(F.col("is_subagent"), F.col("parent")).otherwise("").alias("parent_id"),
        F.when(F.col("is_subagent"), F.col("sid")).otherwise("").alias("agent_id"),
        F.when(F.col("is_subagent") & (F.col("uid") % 10 == 4), "explorer").otherwise("").alias("agent_type"),
        F.when(F.col("is_subagent"), "worker").otherwise("").alias("agent_description"))


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived lines, parsed. Written once, as the merge and the numbering of files read them several times."""
    from turnledger.sources.transcripts import parse_entries

    return materialize(parse_entries(transcript_lines(spark, sf_dir)), "parsed-lines", **PLAIN)


def transcript_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived lines through the same parse and merge as scanned transcripts.

    A derived file holds one session, so its lines name the same sessions as its merged entries.
    """
    from turnledger.operators.sessions import classified
    from turnledger.sources.transcripts import merge_streamed, session_positions

    parsed = parsed_lines(spark, sf_dir)
    return classified(session_positions(merge_streamed(parsed), listing=parsed))

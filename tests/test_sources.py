import datetime as dt
import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnledger import session
from turnledger.functions.pricing import price_calls
from turnledger.operators import attribution, export, filters, projects, replay, sessions
from turnledger.plans import accounts
from turnledger.sources import sidefiles, sinks, tables, transcripts
from turnledger.sources.transcripts import SourceSpec
from turnledger.session import materialize
from turnledger.streaming import ingest


def put(path, *lines, raw=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(raw if raw is not None else "".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines))


def stamp(minute, day=1):
    return f"2024-03-{day:02d}T10:{minute:02d}:00Z"


def user(sid, content, ts, **more):
    return {"type": "user", "sessionId": sid, "timestamp": ts, "cwd": "/home/u/work/app", "message": {"role": "user", "content": content}, **more}


def assistant(sid, mid, blocks, ts, out=10, model="claude-opus-4-8", **usage):
    return {"type": "assistant", "sessionId": sid, "timestamp": ts, "message": {
        "id": mid, "model": model, "content": blocks, "usage": {"input_tokens": 3, "output_tokens": out, **usage}}}


def use(tid, name, **args):
    return {"type": "tool_use", "id": tid, "name": name, "input": args}


def result(tid, content="ok", error=False):
    return {"type": "tool_result", "tool_use_id": tid, "content": content, "is_error": error}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tree"))
    old, new = f"{base}/old", f"{base}/new"
    main = [
        user("s1", "Fix the bug: now", stamp(0), slug="bold-fox"),
        assistant("s1", "m1", [{"type": "thinking", "thinking": "hm"}], stamp(1), 9),
        assistant("s1", "m1", [{"type": "text", "text": "Looking"}], stamp(1), 120),
        user("s1", [result("t1", "<tool_use_error>File has not been read yet</tool_use_error>", True)], stamp(2)),
        assistant("s1", "m1", [use("t1", "Edit", file_path="/a.py"), use("t2", "Agent", description="dig", subagent_type="scout")], stamp(3), 414),
        user("s1", [result("t2", "started")], stamp(4), toolUseResult={"agentId": "linked"}),
        "{not json", "", '"just a string"',
        assistant("s1", "m2", [use("t3", "Bash", command='git commit -m "done"')], stamp(5), 20),
        user("s1", [result("t9", "Permission denied", True)], 1709287560000),
        user("s1", "next", "yesterday-ish"),
        {"type": "assistant", "sessionId": "s1", "timestamp": stamp(7), "isApiErrorMessage": True,
         "message": {"content": [{"type": "text", "text": "You've hit your limit"}]}},
        {"type": "progress", "sessionId": "s1", "timestamp": stamp(8), "data": {"type": "hook_progress", "hookName": "lint"}},
        {"type": "pr-link", "sessionId": "s1", "timestamp": stamp(0, day=9)},
        user("s1", "summary text", stamp(9), isCompactSummary=True),
    ]
    put(f"{old}/proj/s1.jsonl", *main)
    put(f"{new}/proj/s1.jsonl", user("s1", "copy", stamp(0)), assistant("s1", "mx", [], stamp(1), 9999))
    sub = f"{new}/proj/s1/subagents"
    put(f"{sub}/agent-linked.jsonl", assistant("s1", "a1", [{"type": "text", "text": "sub"}], stamp(4), 50), user("s1", "inner", stamp(4)))
    put(f"{sub}/agent-typed.jsonl", assistant("s1", "a2", [use("x", "Read", file_path="/b.py")], stamp(5), 7, cache_creation_input_tokens=80,
                                             cache_creation={"ephemeral_1h_input_tokens": 80}))
    put(f"{sub}/agent-typed.meta.json", raw=json.dumps({"agentType": "planner", "description": "plans"}))
    put(f"{sub}/agent-lost.jsonl", assistant("s1", "a3", [{"type": "text", "text": "z"}], stamp(6), 3))
    put(f"{new}/proj/gone/subagents/agent-orphan.jsonl", assistant("gone", "o1", [{"type": "text", "text": "o"}], stamp(6), 5))
    put(f"{new}/other/resume.jsonl", user("claimed", "resumed", stamp(1)), assistant("claimed", "r1", [], stamp(2), 4))
    put(f"{new}/zzz/claimed.jsonl", assistant("claimed", "r2", [], stamp(3), 1000))
    return [SourceSpec("old", old), SourceSpec("new", new)]


@pytest.fixture(scope="module")
def entries(spark, tree):
    return materialize(sessions.classified(transcripts.read_transcripts(spark, tree)), "entries")


def test_merge_and_first_copy(entries):
    e = {r.msg_id: r for r in entries.where("type = 'assistant' AND msg_id IS NOT NULL").collect()}
    assert "mx" not in e and "r2" not in e and "r1" in e
    m1 = e["m1"]
    assert (m1.n_lines, m1.usage.output_tokens, [b.btype for b in m1.blocks]) == (3, 414, ["thinking", "text", "tool_use", "tool_use"])
    assert m1.ts_text == stamp(1)
    assert entries.where("type IS NULL").count() == 0


def test_session_rows(entries):
    rows = {r.session_id: r for r in sessions.session_rows(entries).collect()}
    assert set(rows) == {"s1", "agent-orphan", "claimed"}
    r = rows["s1"]
    assert (r.prompt, r.assistant, r.messages, r.tool_result, r.meta, r.compactions) == (2, 3, 5, 3, 1, 1)
    assert (r.project, r.slug, r.source, r.first_prompt, r.primary_model) == ("work/app", "bold-fox", "old", "Fix the bug: now", "Opus 4.8")
    assert (r.errors, r.tool_errors, r.backend_errors, r.file_ops, r.git_ops, r.tool_calls) == (3, 2, 1, 1, 1, 3)
    assert r.output_tokens == 414 + 20 + 50 + 7 + 3 and r.calls == 5
    assert r.duration_min == 9.0
    assert r.agent_dispatches == 2


def test_core_agrees_with_single_operators(entries):
    core = {r.session_id: r for r in sessions.session_core(entries).collect()}
    for r in sessions.message_counters(entries).collect():
        assert (r.prompt, r.messages, r.start_ms, r.end_ms) == (core[r.session_id].prompt, core[r.session_id].messages,
                                                                core[r.session_id].start_ms, core[r.session_id].end_ms)
    for r in sessions.session_attributes(entries).collect():
        assert (r.cwd, r.agent_type, r.parent_id, r.source) == tuple(core[r.session_id][c] for c in ("cwd", "agent_type", "parent_id", "source"))
    for r in sessions.first_prompts(entries).collect():
        assert r.first_prompt == core[r.session_id].first_prompt


def test_undated_prompt_counts_on_the_start_day(entries):
    slices = sessions.day_slices(entries, sessions.session_attributes(entries))
    days = slices.where("session_id = 's1'").groupBy("day").agg(F.sum("messages").alias("m")).collect()
    assert [(str(r.day), r.m) for r in days] == [("2024-03-01", 5)]


def test_unmerged_when_not_absorbed(entries):
    slices = sessions.day_slices(entries, sessions.session_attributes(entries), absorb=False)
    assert slices.where("session_id = 'agent-typed'").first().output_tokens == 7


def test_errors_know_their_tool(entries):
    got = sorted((r.tool, r.category, r.counted_as) for r in sessions.error_rows(entries).collect())
    assert got == [("", "rate_limit", "backend"), ("Edit", "stale_read", "tool"), ("unknown", "permission_denied", "tool")]


def test_dispatches(entries):
    rows = sessions.agent_dispatches(entries, sessions.session_attributes(entries)).where("session_id = 's1'").collect()
    assert sorted((r.type, r.agent_id) for r in rows) == [("<unlinked>", "lost"), ("scout", "linked")]


def test_open_dispatch_is_filled_by_type(spark):
    import turnledger.operators.sessions as s
    base = "/nowhere"
    lines = [("p", False, "", "", "", assistant("p", "m1", [use("t1", "Agent", subagent_type="planner"), use("t2", "Agent", subagent_type="planner")], stamp(0))),
             ("agent-b", True, "p", "b", "planner", assistant("p", "m2", [], stamp(1)))]
    rows = [(json.dumps(b), i, 0, "src", 1, f"{base}/{stem}.jsonl", stem, sub, par, aid, typ, "") for i, (stem, sub, par, aid, typ, b) in enumerate(lines)]
    df = spark.createDataFrame(rows, "value string, ord long, source_rank int, source string, file_size long, file_path string, file_stem string, "
                                     "is_subagent boolean, parent_id string, agent_id string, agent_type string, agent_description string")
    e = s.classified(transcripts.merge_streamed(transcripts.parse_entries(df)))
    got = sorted((r.tool_id, r.agent_id) for r in s.agent_dispatches(e, s.session_attributes(e)).collect())
    assert got == [("t1", "b"), ("t2", "")]


def test_subagent_summary(entries):
    rows = {r.session_id: r for r in sessions.subagent_summaries(
        sessions.turns(entries), sessions.message_counters(entries), sessions.session_attributes(entries)).collect()}
    assert set(rows) == {"agent-linked", "agent-typed", "agent-lost"}
    assert (rows["agent-linked"].tokens, rows["agent-linked"].messages, rows["agent-typed"].tool_calls) == (53, 2, 1)


def test_replay(entries):
    m = replay.messages(entries).where("session_id = 's1'").orderBy("ord", "pos")
    assert [r.role for r in m.collect()] == ["user", "assistant", "error", "assistant", "error", "user", "rate_limit", "hook", "compaction"]
    nodes = {r.node_id: r for r in replay.flow_nodes(m).collect()}
    assert nodes["main"].output_tokens == 434 and nodes["subagent-0"].type == "scout" and nodes["user"].messages == 2
    assert {(r.src, r.dst) for r in replay.flow_edges(m).collect()} == {("user", "main"), ("main", "subagent-0")}
    assert {r.t for r in replay.flow_events(m).where("type = 'tool_call'").collect()} == {60_000, 300_000}


def test_mode_changes(spark):
    rows = [("s", i, i, t, m, p) for i, (t, m, p) in enumerate([("mode", "plan", ""), ("mode", "", ""), ("permission-mode", "", "ask"),
                                                               ("mode", "plan", ""), ("mode", "default", ""), ("permission-mode", "", "ask")])]
    df = spark.createDataFrame(rows, "session_id string, ord long, ts_ms long, type string, mode string, permission_mode string")
    for spread_out in (1, 1 << 21):  # within one cell and over several
        wide = df.withColumn("ord", F.col("ord") * spread_out)
        got = [r.content for r in replay.mode_changes(wide).orderBy("ord").collect()]
        assert got == ["Mode: plan", "Permission: ask", "Mode: default"]


def test_projects(entries):
    attributes, uses = sessions.session_attributes(entries), sessions.tool_uses(entries)
    files = projects.top_files(sessions.file_operations(uses), attributes).where("project = 'work/app'").collect()
    assert [(r.path, r.edit) for r in files] == [("/a.py", 1)]
    flow = projects.workflow(sessions.file_operations(uses), sessions.git_operations(uses),
                             sessions.agent_dispatches(entries, attributes), attributes).where("project = 'work/app'").orderBy("rank")
    assert [r.type for r in flow.collect()] == ["edit", "git_commit", "agent", "agent"]


def test_line_order_survives_split_files(spark, tmp_path):
    put(f"{tmp_path}/p/big.jsonl", *[{"type": "user", "sessionId": "big", "n": i, "pad": "x" * 2000} for i in range(4000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        lines = transcripts.scan_lines(spark, [SourceSpec("x", str(tmp_path))])
        assert lines.rdd.getNumPartitions() >= 3
        got = [r.n for r in lines.orderBy("ord").select(F.get_json_object("value", "$.n").cast("int").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(4000))


def test_side_files(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    src = [SourceSpec("a", a), SourceSpec("b", b)]
    put(f"{a}/history.jsonl", {"display": "one", "timestamp": 2, "sessionId": "s", "project": "p"}, "broken")
    put(f"{b}/history.jsonl", {"display": "two", "timestamp": 2, "sessionId": "s"}, {"display": "three", "timestamp": 1, "sessionId": "s"})
    assert [r.display for r in sidefiles.load_history(spark, src).collect()] == ["three", "one"]
    event = {"event_data": {"session_id": "s", "env": {"platform": "linux"}, "process": json.dumps({"rss": 1048576 * 1.26, "cpuPercent": 3, "uptime": 2.5})}}
    put(f"{a}/telemetry/t.json", event, {"event_data": {}}, {"event_data": {"session_id": "s"}})
    maxima, env = sidefiles.load_telemetry(spark, src)
    r = maxima.first()
    assert (r.peak_rss_mb, r.max_uptime_s, r.event_count) == (1.3, 2.0, 1) and env.first().platform == "linux"
    put(f"{a}/tasks/s/1.json", raw='{"subject": "x", "status": "completed"}')
    put(f"{a}/tasks/s/notes.json", raw='{"subject": "n"}')
    put(f"{b}/tasks/s/2.json", raw='{"status": "pending"}')
    put(f"{b}/tasks/z/1.json", raw='{"subject": "only"}')
    assert {r.status: r["count"] for r in sidefiles.status_counts(sidefiles.load_tasks(spark, src)).collect()} == {"completed": 1, "unknown": 1}
    put(f"{a}/todos/l.json", raw='[{"status": "completed"}, {"status": "in_progress"}, {"status": "x"}]')
    put(f"{b}/todos/l.json", raw='[{"status": "pending"}]')
    put(f"{b}/todos/m.json", raw='{"status": "pending"}')
    assert tuple(sidefiles.load_todos(spark, src).first()) == (3, 1, 1, 1)
    put(f"{a}/plans/one.md", raw="intro\n# The plan \nbody\n")
    put(f"{b}/plans/two.md", raw="no heading")
    docs = {r.filename: (r.title, r.lines) for r in sidefiles.load_plan_documents(spark, src).collect()}
    assert docs == {"one.md": ("The plan", 3), "two.md": ("two", 1)}
    put(f"{a}/file-history/s/f1", raw="12345")
    put(f"{b}/file-history/s/f2", raw="12345")
    put(f"{b}/file-history/t/f2", raw="12345")
    assert tuple(sidefiles.snapshot_stats(spark, src).first())[:2] == (2, 2)
    sizes = {r.name: r.bytes for r in sidefiles.storage_breakdown(spark, src).collect()}
    assert sizes["file-history/"] == 10 and "_a/" in sizes and "history.jsonl" in sizes


def test_exports(spark, entries, tmp_path):
    rows = sessions.session_rows(entries)
    sheet = rows.select("session_id", "duration_min", (F.col("cost_nusd") / 1e9).alias("cost"), F.lit(-1.0).alias("cache_eff"))
    cells = {r.session_id: r for r in sinks.csv_cells(sheet, comma_decimal=True).collect()}
    assert cells["s1"].duration_min == "9" and cells["s1"].cost.startswith("=0,") and cells["s1"].cache_eff == ""
    sinks.write_sessions_csv(sheet, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    sinks.write_gold({"sessions": rows}, f"{tmp_path}/gold", {"sessions": ["project"]})
    assert spark.read.parquet(f"{tmp_path}/gold/sessions").count() == 3
    sinks.write_document({"sessions": rows.select("session_id")}, f"{tmp_path}/doc")
    assert spark.read.text(f"{tmp_path}/doc").count() == 3
    m = replay.messages(entries)
    talk = m.withColumn("display", F.lit(None).cast("string")).select("session_id", "ord", "ts_ms", "role", "content", "display")
    head = rows.select("session_id", "project", F.to_date(F.timestamp_millis("start_ms")).alias("date"), "start_ms", "duration_min",
                       "primary_model", "messages", (F.col("cost_nusd") / 1e9).alias("cost_usd"), "source", "first_prompt")
    lines = sinks.markdown_lines(head, talk)
    text = "\n".join(r.text for r in lines.where("session_id = 's1'").orderBy("ord").collect())
    assert text.startswith("---\nsession_id: s1\nproject: work/app") and "# Fix the bug: now" in text
    assert "## User — 10:00:00\n\nFix the bug: now" in text
    sinks.write_markdown(lines, f"{tmp_path}/md")
    assert spark.read.parquet(f"{tmp_path}/md").select("file_name").distinct().count() == 3


def test_markdown_name_collisions(spark):
    import datetime as dt
    df = spark.createDataFrame([("abcdefgh-1", "p/q", dt.date(2024, 1, 1)), ("abcdefgh-2", "p/q", dt.date(2024, 1, 1))], "session_id string, project string, date date")
    assert sorted(r.file_name for r in sinks.file_names(df).collect()) == ["2024-01-01-p_q-abcdefgh-2.md", "2024-01-01-p_q-abcdefgh.md"]


def test_streaming_ingest(spark, tmp_path):
    root = f"{tmp_path}/in"
    line = assistant("s", "m1", [{"type": "text", "text": "a"}], stamp(1), 5)
    put(f"{root}/p/s.jsonl", line, assistant("s", "m1", [{"type": "text", "text": "b"}], stamp(1), 9))

    def run():
        ingest.ingest(ingest.ingest_lines(spark, root, "src"), f"{tmp_path}/out", f"{tmp_path}/ck").start().awaitTermination()

    run()
    put(f"{root}/p/copy/s.jsonl", line, assistant("s", "m1", [use("t", "Read")], stamp(1), 12), user("s", "new line", stamp(2)))
    run()
    rows = ingest.stored_entries(spark, f"{tmp_path}/out").orderBy("ord").collect()
    assert [(r.type, r.n_lines) for r in rows] == [("assistant", 3), ("user", 1)]
    assert rows[0].usage.output_tokens == 12 and [b.btype for b in rows[0].blocks] == ["text", "text", "tool_use"]


def test_equal_lines_of_a_stream_count_each(spark, tmp_path):
    """Lines are known by their place, not by their text, whatever the number of the batch."""
    root, again = f"{tmp_path}/in", user("s", "same words", stamp(3))
    put(f"{root}/p/s.jsonl", again, user("s", "other words", stamp(3)), again)
    ingest.ingest(ingest.ingest_lines(spark, root, "src"), f"{tmp_path}/out", f"{tmp_path}/ck").start().awaitTermination()
    rows = ingest.stored_entries(spark, f"{tmp_path}/out").orderBy("ord").collect()
    assert [r.content_text for r in rows] == ["same words", "other words", "same words"]


def test_only_touched_sessions_are_rewritten(spark, tmp_path):
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(name, *lines):
        put(f"{root}/p/{name}.jsonl", *lines)
        ingest.ingest(ingest.ingest_lines(spark, root, "src"), out, f"{tmp_path}/ck", 4).start().awaitTermination()
        return {f"{d}/{f}" for d, _, files in os.walk(f"{out}/entries") for f in files if f.startswith("part-")}

    before = arrive("a", *[user(f"s{i}", f"words {i}", stamp(i)) for i in range(12)])
    after = arrive("b", user("s3", "more", stamp(40)))
    kept, held = ({f.split("bucket=")[1].split("/")[0] for f in files} for files in (before & after, after))
    assert len(held) > 2 and len(held - kept) == 1
    rows = ingest.stored_entries(spark, out)
    assert rows.count() == 13 and [r.content_text for r in rows.where("session_id = 's3'").orderBy("ord").collect()] == ["words 3", "more"]


def test_ingest_leaves_only_its_tables(spark, tmp_path, monkeypatch):
    """Tables and shuffle files of a batch go with their use, whatever the driver's memory."""
    root, out, shared = (f"{tmp_path}/{x}" for x in ("in", "out", "shared"))
    for module in (session, ingest):
        monkeypatch.setattr(module, "shared_folder", lambda _: shared)
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in folders for f in Path(d).rglob("shuffle_*")}

    before = shuffled()
    for name, n in (("a", 6), ("b", 3)):
        put(f"{root}/p/{name}.jsonl", *[line for i in range(n) for line in (user(f"s{i}", f"words {name}{i}", stamp(i)), assistant(f"s{i}", f"m{name}{i}", [use("t", "Read")], stamp(i)))])
        ingest.ingest(ingest.ingest_lines(spark, root, "src"), out, f"{tmp_path}/ck", 4).start().awaitTermination()
        assert not list(Path(shared).rglob("*.parquet"))
    until = time.time() + 5
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and ingest.stored_entries(spark, out).count() == 18


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(f"{root}/p/s.jsonl", user("s", "one", stamp(1)), assistant("s", "m", [{"type": "text", "text": "a"}], stamp(2), 7), user("s", "one", stamp(1)))
    lines = transcripts.scan_lines(spark, [transcripts.SourceSpec("src", root)])
    ingest.absorb(lines, 0, out)
    first = sorted(map(str, ingest.stored_entries(spark, out).collect()))
    ingest.absorb(lines, 0, out)
    ingest.absorb(lines.limit(0), 1, out)
    assert len(first) == 3 and sorted(map(str, ingest.stored_entries(spark, out).collect())) == first


def test_a_session_in_two_files(spark, tmp_path):
    """A resumed session: both files count their lines from the start, and turns still meet only their own marks."""
    root = f"{tmp_path}/two"
    for name, first in (("a", 1), ("b", 5)):
        put(f"{root}/p/{name}.jsonl", *[line for k in range(2) for line in (
            user("one", f"question {name}{k}", stamp(first + 2 * k)),
            assistant("one", f"m{name}{k}", [{"type": "text", "text": f"answer {name}{k}"}], stamp(first + 2 * k + 1), 100))])
    e = sessions.classified(transcripts.read_transcripts(spark, [transcripts.SourceSpec("src", root)]))
    rows = e.orderBy("ord").collect()
    assert len({r.ord for r in rows}) == 8 and [r.ts_ms for r in rows] == sorted(r.ts_ms for r in rows)
    turns = sessions.turns(e)
    marks = attribution.narration_tokens(e).where("type = 'assistant'").select("session_id", "ord", "is_narration")
    joined = turns.join(marks, ["session_id", "ord"])
    assert joined.count() == 4 and joined.agg(F.sum("output_tokens")).first()[0] == 400


def test_account_usage_counts_sub_agents_once(spark, entries):
    """An absorbed sub-agent spends on its parent's day and opens no window of its own, unless asked for."""
    own, both = (accounts.account_usage(entries, F.lit("me"), include_subagents=s) for s in (False, True))
    absorbed = sessions.owner_table(sessions.session_attributes(entries)).where("owner_id != session_id").select("session_id")
    assert absorbed.count() > 0
    seen = {r.session_id for r in own.turns.collect()}
    assert not seen & {r.session_id for r in absorbed.collect()} and seen < {r.session_id for r in both.turns.collect()}
    cost = own.daily_cost.agg(F.sum("cost_nusd")).first()[0]
    assert cost == both.daily_cost.agg(F.sum("cost_nusd")).first()[0] == price_calls(both.turns.where("output_tokens > 0")).agg(F.sum("cost_nusd")).first()[0]
    assert own.session_days.agg(F.sum("sessions")).first()[0] == sessions.session_rows(entries).count()


def test_every_sort_column_is_in_the_session_table(spark, entries):
    table = export.flat_rows(sessions.session_rows(entries))
    for column in (*filters.SORT_COLUMNS, "total_tokens", "cache_eff"):
        assert filters.sorted_page(table, column, 0, 2).select("session_id").count() == 2
    kept = filters.select_sessions(table, filters.Filters(ranges={"messages": (1, None)}), dt.date(2024, 1, 31))
    assert kept.count() > 0


def test_derived_lines_are_parsed_once_and_merge_as_one_list(spark):
    """A filter on the parsed line does not parse it again, and entries read the written lines."""
    from turnledger.sources import tables

    def parses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("from_json")

    lines = tables.transcript_lines(spark, "/root/testdata/sf0.001")
    assert parses(transcripts.parse_entries(lines)) == 1
    parsed = tables.parsed_lines(spark, "/root/testdata/sf0.001")
    entries = tables.transcript_entries(spark, "/root/testdata/sf0.001")
    assert parses(entries) == 0
    # The listing of files from the lines numbers sessions like the one from merged entries.
    merged = transcripts.merge_streamed(parsed)
    own = transcripts.session_positions(merged).select("session_id", "ord", "n_lines")
    assert entries.select(own.columns).exceptAll(own).isEmpty() and own.exceptAll(entries.select(own.columns)).isEmpty()
    assert parsed.count() == merged.agg(F.sum("n_lines")).first()[0]


def test_filtered_write_categories_leave_other_sessions_out_first(spark, entries, monkeypatch):
    """Only chosen sessions are ordered and weighed, and they count as in the table of all sessions."""
    from turnledger.registry import transcripts as queries

    seen, narration = [], attribution.narration_tokens
    chosen = spark.createDataFrame([("s1",)], "session_id string")
    everything = queries._write_rows(entries)
    expected = attribution.write_categories(everything.where("session_id = 's1'")).where("output_tokens > 0")
    monkeypatch.setattr(queries, "silver", lambda spark, sf: entries)
    monkeypatch.setattr(queries, "_chosen", lambda spark, sf: chosen)
    monkeypatch.setattr(attribution, "narration_tokens", lambda rows: seen.append(rows) or narration(rows))
    got = queries.filtered_write_categories(spark, "unused")
    assert {r.session_id for r in seen[0].select("session_id").distinct().collect()} == {"s1"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select("category", "output_tokens").collect()))


def _events(spark, folder, ks):
    rows = [(i, dt.datetime(2024, 1, 2, 0, 0, i), i % 3, kind, 10.0 * i, None if k is None else json.dumps({"k": k}))
            for i, (kind, k) in enumerate((kind, k) for kind in ("view", "click", "error", "purchase") for k in ks)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    return str(folder)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_derived_lines_are_compiled(spark, tmp_path):
    """The lines are a column before they are exploded, with no lambda for the calls; without ``k`` no model or tool is named."""
    lines = tables.transcript_lines(spark, _events(spark, tmp_path, [0, 5, 12, None]))
    plan = _plan(lines)
    assert "posexplode(lines#" in plan and "lambdafunction" not in plan
    bodies = [json.loads(r.value) for r in lines.collect()]
    calls = {b["message"]["id"]: b["message"] for b in bodies if b["type"] == "assistant" and isinstance(b["message"]["content"], list)}
    called = [[c.get("name") for c in m["content"] if c["type"] == "tool_use"] for m in calls.values()]
    assert sorted(map(len, called))[-1] == 5
    assert any("model" not in m for m in calls.values()) and [None] in called


def test_merge_copies_no_line_into_a_list(spark, tmp_path):
    """Whole lines are neither aggregated nor sorted for the numbering of files."""
    parsed = tables.parsed_lines(spark, _events(spark, tmp_path, [1, 2, 3]))
    merged = transcripts.merge_streamed(parsed)
    assert "Aggregate" not in _plan(merged) and "Window" in _plan(merged)
    assert "ShuffledHashJoin" in _plan(transcripts.session_positions(merged, listing=parsed))
    twice = merged.where("n_lines = 2").select("ts_ms", F.size("blocks").alias("n"), "usage.output_tokens").collect()
    assert sorted(r.n for r in twice) == [2, 3, 4] and {r.output_tokens for r in twice} == {0, 100, 200}



def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter " in line]


def test_input_is_dealt_out_evenly(spark, tmp_path):
    """A scan may have as many splits as there are cores and yet all rows in one of them."""
    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in tables.spread(rows).groupBy(F.spark_partition_id()).count().collect()]
        small = [r["count"] for r in tables.spread(rows, 1_000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == sum(small) == 20_000 and max(sizes) <= 4_000 and max(small) <= 1_500


def test_derived_lines_are_built_once(spark, tmp_path):
    """No filter on the size of the array of lines, which would build them a first time below the exchange."""
    assert not _filters(tables.transcript_lines(spark, _events(spark, tmp_path, [0, 5])))



def test_unchanged_sessions_go_straight_to_the_new_files(spark, tmp_path, monkeypatch):
    root, out, kept = f"{tmp_path}/in", f"{tmp_path}/out", []

    def store(df, name, **options):
        rows = materialize(df, name, **options)
        kept.append((name, {r.session_id for r in rows.select("session_id").distinct().collect()}))
        return rows

    monkeypatch.setattr(ingest, "materialize", store)
    for name, lines in (("a", [user(f"s{i}", f"words {i}", stamp(i)) for i in range(6)]), ("b", [user("s3", "more", stamp(40))])):
        put(f"{root}/p/{name}.jsonl", *lines)
        ingest.ingest(ingest.ingest_lines(spark, root, "src"), out, f"{tmp_path}/ck", 1).start().awaitTermination()
    assert [sorted(s) for _, s in kept[-3:]] == [["s3"]] * 3
    assert ingest.stored_entries(spark, out).count() == 7



def test_texts_of_messages_are_read_once(entries):
    """Filters test the finished role and tools; none works out texts or tools of its own."""
    m = replay.messages(entries)
    for out in (replay.flow_events(m), replay.flow_nodes(m)):
        assert not [f for f in _filters(out) if "<command-name>" in f or "agent_prompt" in f]
    assert {r.type for r in replay.flow_events(m).select("type").collect()} >= {"message", "tool_call"}



def test_write_parts_are_weighed_once(entries):
    from turnledger.registry import transcripts as queries

    assert not [f for f in _filters(attribution.write_categories(queries._write_rows(entries))) if "size(" in f]



def test_dispatches_read_stored_attributes(spark, entries, monkeypatch):
    from turnledger.registry import transcripts as queries

    monkeypatch.setattr(queries, "silver", lambda spark, sf: entries)
    assert "min_by(cwd" not in queries._dispatches(spark, "unused")._jdf.queryExecution().optimizedPlan().toString()



def test_export_gathers_few_sessions_per_task(spark, entries, monkeypatch):
    from turnledger.config import EngineConfig

    cfg = EngineConfig(as_of=dt.date(2024, 4, 1))
    expected = export.session_export(entries, cfg).select("session_id", "error_count", "agent_dispatches").collect()
    monkeypatch.setattr(export, "GATHERED_SESSIONS", 1)
    parts, n = spark.conf.get("spark.sql.shuffle.partitions"), entries.select("session_id").distinct().count()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = export.session_export(entries, cfg)
        assert n > 1 and f"hashpartitioning(session_id#" in _plan(out) and f", {n}), REPARTITION_BY_NUM" in _plan(out)
        assert sorted(out.select("session_id", "error_count", "agent_dispatches").collect()) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)

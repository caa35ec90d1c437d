import pytest
from pyspark.sql import functions as F

from turnledger.config import EngineConfig, PlanPeriod
from turnledger.functions import classify, pricing, scalars


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_timestamps(spark):
    got = column(spark, ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00.250+01:00", "1704067200000", "soon", "", None],
                 scalars.parse_ts_ms)
    assert got == [1704067200000, 1704067200250, 1704067200000, None, None, None]


def test_days_and_weekdays_are_utc(spark):
    row = spark.range(1).select(scalars.utc_day(F.lit(1704067199999)).cast("string").alias("d"),
                                scalars.local_weekday(F.lit(1704067200000), "UTC").alias("w"),
                                scalars.local_hour(F.lit(1704067200000), "Europe/Berlin").alias("h")).first()
    assert (row.d, row.w, row.h) == ("2023-12-31", 0, 1)


def test_half_even(spark):
    row = spark.range(1).select(scalars.half_even(F.lit(2.5), 0).alias("a"), scalars.half_even(F.lit(3.5), 0).alias("b"),
                                scalars.usd(F.lit(1_250_000_000), 1).alias("c")).first()
    assert (row.a, row.b, row.c) == (2.0, 4.0, 1.2)


@pytest.mark.parametrize("model,display", [
    ("claude-lyra-7-3", "Lyra 7.3"), ("claude-lyra-7-20310228", "Lyra 7"), ("claude-lyra-12-0", "Lyra 12"),
    ("claude-6-2-orion", "Orion 6.2"), ("claude-6-orion", "Orion 6"), ("< stand-in >", "Stand-in"), ("<a<b>", "<a<b>"),
    ("claude-lyra-7-3[long]", "Lyra 7.3"), ("claude-lyra-7-3 [long] [x y]", "Lyra 7.3"), ("claude-atlas", "Atlas"),
    ("local-mix-20310228", "Local Mix"), ("  ", "  "), ("", "")])
def test_model_display(spark, model, display):
    assert column(spark, [model], pricing.derived_display) == [display]


def test_price_resolution(spark):
    ids = spark.createDataFrame([("claude-opus-4-5",), ("claude-haiku-3-5[1m]",), ("claude-nova-9",), ("unknown",)], "model string")
    got = {r.model: (r.display, r.p_input, r.priced) for r in pricing.with_prices(ids).collect()}
    assert got["claude-opus-4-5"] == ("Opus 4.5", 5000, True)
    assert got["claude-haiku-3-5[1m]"] == ("Haiku 3.5", 800, True)
    assert got["claude-nova-9"] == ("Nova 9", 3000, False)
    assert got["unknown"] == ("Unknown", 3000, False)


def test_cache_write_split_and_clamp(spark):
    rows = spark.createDataFrame([("claude-sonnet-4-6", 0, 0, 0, 1_000_000, 0), ("claude-sonnet-4-6", 0, 0, 0, 1_000_000, 1_000_000),
                                  ("claude-sonnet-4-6", 0, 0, 0, 100, 5000)],
                                 "model string, input_tokens long, output_tokens long, cache_read long, cache_creation long, cache_1h long")
    assert sorted(r.cost_nusd for r in pricing.price_calls(rows).collect()) == [600_000, 3_750_000_000, 6_000_000_000]


def test_warnings_name_one_id_per_display(spark):
    ids = spark.createDataFrame([("claude-nova-9[1m]",), ("claude-nova-9",), ("claude-opus-4-8[1m]",), ("gpt",)], "model string")
    assert [tuple(r) for r in pricing.pricing_warnings(ids).collect()] == [("claude-nova-9", "Nova 9")]


def test_user_entries(spark):
    texts = ["hello", "  <command-name>x</command-name>", "<local-command-stdout>", "[Request interrupted by user]", "  \n", "[1, 2]"]
    false = F.lit(False)
    assert column(spark, texts, lambda t: classify.user_entry_category(t, false, false, false)) == [
        "prompt", "command", "command", "interrupt", "meta", "prompt"]
    assert column(spark, ["<command"], lambda t: classify.user_entry_category(t, F.lit(True), false, false)) == ["tool_result"]
    assert column(spark, ["x"], lambda t: classify.user_entry_category(t, F.lit(True), false, F.lit(True))) == ["meta"]
    assert column(spark, ["x"], lambda t: classify.user_entry_category(t, false, F.lit(True), false)) == ["meta"]


def test_tool_errors(spark):
    cases = {"Cancelled: sibling": "cancelled", "The user doesn't want to proceed": "rejected", "PreToolUse hook error": "hook_error",
             "old_string not found": "edit_no_match", "string is not unique": "edit_not_unique", "has been modified since read": "stale_read",
             "path does not exist": "file_not_found", "module not found": "file_not_found", "sh: command not found": "command_not_found",
             "Permission denied": "permission_denied", "timed out": "timeout", "SyntaxError: x": "syntax_error",
             "ModuleNotFoundError": "import_error", "Exit code 2": "exit_code", "HTTP 429 rate limit": "other"}
    got = column(spark, list(cases), lambda t: classify.tool_error_class(t, F.lit("Bash"))["category"])
    assert got == list(cases.values())
    assert column(spark, ["odd"], lambda t: classify.tool_error_class(t, F.lit("Edit"))["category"]) == ["edit_failed"]


def test_backend_errors(spark):
    cases = {"You've hit your limit": "rate_limit", "error 429": "rate_limit", "14290": "other", "529 Overloaded": "server_overload",
             "401 please run /login": "auth", "502 bad gateway": "server_error", "socket hang up": "connection",
             "blocked by content filtering": "content_filter", "prompt is too long": "invalid_request", "x": "other"}
    assert column(spark, list(cases), classify.backend_error_category) == list(cases.values())


def test_plan_limit_text(spark):
    assert column(spark, ["YOU'VE HIT YOUR LIMIT", "overloaded", None], classify.plan_limit_text) == [True, False, False]


def test_error_text(spark):
    assert column(spark, ["\x1b[31mred\x1b[0m\r\nnext\rlast \u00a0\n"], classify.clean_error_text) == ["red\nnext\nlast"]
    assert column(spark, ["a <tool_use_error>one</tool_use_error> <tool_use_error>two</tool_use_error>", "plain"],
                  classify.unwrap_tool_error) == ["two", "plain"]


def test_command_labels(spark):
    texts = ["<command-name>/close</command-name>", "<command-name>compact</command-name>\n<command-args> now </command-args>",
             "<local-command-stdout>x</local-command-stdout>", "plain", "<command-name> </command-name>"]
    assert column(spark, texts, classify.command_label) == ["/close", "/compact now", "", "", ""]


def test_git_operations(spark):
    got = column(spark, ['git commit -m "fix x"', "git commit -m 'y'", "git push", "gh pr create", "ls"], classify.git_operation)
    assert [tuple(g) if g else None for g in got] == [("commit", "fix x"), ("commit", "y"), ("push", "git push"), ("pr", "gh pr create"), None]


def test_small_names(spark):
    assert column(spark, ["/a/b/c/", "C:\\x\\y", "one", ""], classify.project_display) == ["b/c", "x/y", "one", "Unknown"]
    assert column(spark, ["Pro", "max 5X (annual)", "MAX-20x", "team"], classify.tier_name) == ["Pro", "Max 5x", "Max 20x", None]
    assert column(spark, ["a", 'x: "y"', None], classify.yaml_value) == ["a", '"x: \\"y\\""', ""]


def test_sql_functions(spark):
    names = classify.register_sql_functions(spark)
    assert len(names) == 5
    row = spark.sql("SELECT is_plan_limit_text('usage limit reached') a, backend_error_category('x 529') b, "
                    "user_entry_category('<command>', false, false, false) c, error_account('user', 'rejected') d, "
                    "call_cost_nano(1, 1, 0, 10, 20, 3, 5, 1, 2, 4) e").first()
    assert tuple(row) == (True, "server_overload", "command", "rejected", 48)


def test_config():
    cfg = EngineConfig(week_anchor="funday")
    assert cfg.week_anchor == "mon" and cfg.with_options(week_anchor="tue").anchor_weekday == 1
    with pytest.raises(ValueError):
        cfg.with_options(nope=1)
    import datetime as dt
    old = PlanPeriod("Pro", dt.date(2024, 1, 1), None, 20.0, cost_eur=18.0)
    assert old.symbol == "€" and old.local_cost == 18.0

"""Text classification as ordered CASE expressions over native string functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Phrases, categories and wrapper tags that the transcript format and its error texts use.
PLAN_LIMIT_PHRASES = (
    "you've hit your limit",
    "hit your org's monthly usage",
    "usage limit reached",
    "plan limit reached",
    "rate limit reached",
)
CANCELLED_PHRASES = ("cancelled:", "canceled:", "parallel tool call")
REJECTED_PHRASES = (
    "doesn't want to proceed", "does not want to proceed", "tool use was rejected", "user rejected",
)
HOOK_PHRASES = ("hook error", "hook_error")
TOOL_CATEGORIES = (
    ("edit_no_match", ("no replacement was performed", "old_string not found", "string to replace not found")),
    ("edit_not_unique", ("not unique", "multiple occurrences", "matches of the string")),
    ("stale_read", ("has not been read yet", "has been modified since read")),
    ("file_not_found", ("does not exist", "no such file")),
    ("command_not_found", ("command not found",)),
    ("permission_denied", ("permission", "denied")),
    ("timeout", ("timeout", "timed out")),
    ("syntax_error", ("syntaxerror", "syntax error")),
    ("import_error", ("importerror", "modulenotfounderror")),
    ("exit_code", ("exit code", "returned non-zero")),
)
BACKEND_CATEGORIES = (
    ("rate_limit", ("hit your limit", "usage limit", "rate limit", "rate_limit_error"), r"\b429\b"),
    ("server_overload", ("overloaded",), r"\b529\b"),
    ("auth", ("authentication", "run /login", "invalid authentication"), r"\b401\b"),
    ("server_error", ("internal server error", "bad gateway", "server-side issue"), r"\b5\d\d\b"),
    ("connection", ("idle timeout", "socket", "connection was closed", "timed out", "timeout"), None),
    ("content_filter", ("content filtering", "content filter"), None),
    ("invalid_request", ("prompt is too long", "too long", "invalid_request", "could not process"), r"\b400\b"),
)
USER_CATEGORIES = ("prompt", "tool_result", "command", "interrupt", "meta")
COMMAND_PREFIXES = ("<command", "<local-command")
INTERRUPT_PREFIX = "[Request interrupted"
ANSI_CSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
TRAILING_SPACE = (r"[\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z")


def _any_of(text: Column, phrases) -> Column:
    test = F.lit(False)
    for phrase in phrases:
        test = test | text.contains(phrase)
    return test


def is_command_text(text: Column) -> Column:
    return text.startswith(COMMAND_PREFIXES[0]) | text.startswith(COMMAND_PREFIXES[1])


def plan_limit_text(text: Column) -> Column:
    return _any_of(F.lower(F.coalesce(text, F.lit(""))), PLAN_LIMIT_PHRASES)


def user_entry_category(text: Column, has_tool_result: Column, is_meta: Column, is_compact: Column) -> Column:
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""))
    return (
        F.when(F.coalesce(is_compact, F.lit(False)), "meta")
        .when(F.coalesce(has_tool_result, F.lit(False)), "tool_result")
        .when(is_command_text(body), "command")
        .when(body.startswith(INTERRUPT_PREFIX), "interrupt")
        .when(F.coalesce(is_meta, F.lit(False)) | (body == ""), "meta")
        .otherwise("prompt")
    )


def tool_error_class(message: Column, tool: Column) -> Column:
    """Struct of ``source`` (user / hook / tool) and ``category``."""
    low = F.lower(F.coalesce(message, F.lit("")))
    source = (F.when(_any_of(low, CANCELLED_PHRASES) | _any_of(low, REJECTED_PHRASES), "user")
              .when(_any_of(low, HOOK_PHRASES), "hook").otherwise("tool"))
    category = (F.when(_any_of(low, CANCELLED_PHRASES), "cancelled")
                .when(_any_of(low, REJECTED_PHRASES), "rejected")
                .when(_any_of(low, HOOK_PHRASES), "hook_error"))
    for name, phrases in TOOL_CATEGORIES:
        test = _any_of(low, phrases)
        if name == "file_not_found":
            test = test | (low.contains("not found") & ~low.contains("command not found"))
        category = category.when(test, name)
    category = category.when(tool == "Edit", "edit_failed").otherwise("other")
    return F.struct(source.alias("source"), category.alias("category"))


def error_account(source: Column, category: Column) -> Column:
    """Label an error is counted under; NULL when it is not a failure (a cancelled sibling call)."""
    return (F.when((source == "user") & (category == "cancelled"), F.lit(None).cast("string"))
            .when(source == "user", "rejected").otherwise(source))


def backend_error_category(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, phrases, word in BACKEND_CATEGORIES:
        test = _any_of(low, phrases)
        if word:
            test = test | low.rlike(word)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def clean_error_text(text: Column) -> Column:
    """Terminal escapes dropped, line ends normalised, trailing white space removed."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ANSI_CSI, "")
    plain = F.regexp_replace(plain, r"\r\n?", "\n")
    return F.regexp_replace(plain, TRAILING_SPACE, "")


def unwrap_tool_error(text: Column) -> Column:
    """Body of the last ``<tool_use_error>`` element, or the text itself."""
    tail = F.substring_index(text, "<tool_use_error>", -1)
    return F.when(text.contains("<tool_use_error>"), F.substring_index(tail, "</tool_use_error>", 1)).otherwise(text)


def _between(text: Column, tag: str) -> Column:
    inner = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)(?:</{tag}>|\z)", 1)
    return F.regexp_replace(inner, r"^\s+|\s+\z", "")


def command_label(text: Column) -> Column:
    """``/name args`` of a slash-command wrapper; empty for command output and plain text."""
    name = _between(text, "command-name")
    slashed = F.when(name.startswith("/"), name).otherwise(F.concat(F.lit("/"), name))
    args = _between(text, "command-args")
    label = F.rtrim(F.concat(slashed, F.lit(" "), args))
    return F.when(text.contains("<command-name>") & (name != ""), label).otherwise("")


def git_operation(command: Column) -> Column:
    """Struct ``kind`` / ``message`` for commit, push and pull-request commands; NULL otherwise."""
    kind = (F.when(command.contains("git commit"), "commit")
            .when(command.contains("git push"), "push")
            .when(command.contains("gh pr create"), "pr"))
    double_quoted = F.regexp_extract(command, r'(?s)-m "([^"]*)', 1)
    single_quoted = F.regexp_extract(command, r"(?s)-m '([^']*)", 1)
    commit_text = (F.when(command.contains('-m "'), double_quoted)
                   .when(command.contains("-m '"), single_quoted).otherwise(""))
    message = F.substring(F.when(kind == "commit", commit_text).otherwise(command), 1, 200)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), message.alias("message")))


def project_display(path: Column) -> Column:
    """Last two parts of a path, ``Unknown`` for an empty one."""
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/")
    return F.when(F.coalesce(path, F.lit("")) == "", "Unknown").otherwise(
        F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/"))


def project_slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_")


def yaml_value(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.rlike(r'[:#"\n]'), quoted).otherwise(text)


def tier_name(plan: Column) -> Column:
    """Plan label to one of the three tiers; NULL when it is none of them."""
    low = F.trim(F.replace(F.lower(F.trim(plan)), F.lit("(annual)"), F.lit("")))
    tight = F.replace(low, F.lit(" "), F.lit(""))
    return (F.when(low.isin("pro", "pro plan"), "Pro")
            .when(tight.isin("max5x", "5x", "max-5x"), "Max 5x")
            .when(tight.isin("max20x", "20x", "max-20x"), "Max 20x"))


def _case_sql(arms, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in arms) + f" ELSE '{default}' END"


def _contains_sql(expr: str, phrases) -> str:
    return "(" + " OR ".join("contains(%s, '%s')" % (expr, p.replace("'", "\\'")) for p in phrases) + ")"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions for ad-hoc SQL users. Catalyst inlines their bodies; no Python worker runs."""
    low = "lower(coalesce(t, ''))"
    backend = [(_contains_sql(low, phrases) + (f" OR regexp({low}, r'{word}')" if word else ""), name)
               for name, phrases, word in BACKEND_CATEGORIES]
    user = [
        ("coalesce(compact, false)", "meta"),
        ("coalesce(tool_result, false)", "tool_result"),
        (" OR ".join(f"startswith(ltrim(t), '{p}')" for p in COMMAND_PREFIXES), "command"),
        (f"startswith(ltrim(t), '{INTERRUPT_PREFIX}')", "interrupt"),
        ("coalesce(meta, false) OR trim(coalesce(t, '')) = ''", "meta"),
    ]
    bodies = {
        "is_plan_limit_text(t STRING) RETURNS BOOLEAN": _contains_sql(low, PLAN_LIMIT_PHRASES),
        "backend_error_category(t STRING) RETURNS STRING": _case_sql(backend, "other"),
        "user_entry_category(t STRING, tool_result BOOLEAN, meta BOOLEAN, compact BOOLEAN) RETURNS STRING":
            _case_sql(user, "prompt"),
        "error_account(source STRING, category STRING) RETURNS STRING":
            "CASE WHEN source = 'user' AND category = 'cancelled' THEN NULL "
            "WHEN source = 'user' THEN 'rejected' ELSE source END",
        "call_cost_nano(inp BIGINT, outp BIGINT, rd BIGINT, wr BIGINT, wr1h BIGINT, p_in BIGINT, p_out BIGINT, "
        "p_rd BIGINT, p_5m BIGINT, p_1h BIGINT) RETURNS BIGINT":
            "inp * p_in + outp * p_out + rd * p_rd + (wr - least(wr1h, wr)) * p_5m + least(wr1h, wr) * p_1h",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]

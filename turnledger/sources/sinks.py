"""Exports: gold tables, the result document, session CSV, Markdown transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.classify import project_slug, yaml_value
from turnledger.functions.scalars import half_even, iso_utc


def write_gold(tables: dict[str, DataFrame], path: str, partitions: dict[str, list[str]] | None = None) -> None:
    """One Parquet table per name, partitioned where asked (for example sessions by project)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = (partitions or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{name}")


def document_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """The result document as rows (section, row as JSON): sections stay distributed."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_document(tables: dict[str, DataFrame], path: str) -> None:
    document_rows(tables).write.mode("overwrite").partitionBy("section").text(path)


def csv_cells(sessions: DataFrame, comma_decimal: bool = False) -> DataFrame:
    """Session rows as text cells: whole numbers plain, fractions as ``=`` formulas to 4 places, absent as empty."""
    cells = []
    for name, kind in sessions.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            r = F.floor(c.cast("double") * 10000 + 0.5) / 10000
            fraction = F.regexp_replace(F.format_string("%.4f", r), r"0+$", "")
            if comma_decimal:
                fraction = F.replace(fraction, F.lit("."), F.lit(","))
            text = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.concat(F.lit("="), fraction))
            if name == "cache_eff":
                text = F.when(c == -1, "").otherwise(text)
        else:
            text = c.cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(name))
    return sessions.select(*cells)


def write_sessions_csv(sessions: DataFrame, path: str, comma_decimal: bool = False) -> None:
    (csv_cells(sessions, comma_decimal).write.mode("overwrite").option("header", True)
     .option("sep", ";" if comma_decimal else ",").option("quote", '"').option("escape", '"')
     .option("lineSep", "\n").option("emptyValue", "").csv(path))


def _markdown_name(date: Column, project: Column, session_id: Column) -> Column:
    return F.concat(date, F.lit("-"), project_slug(project), F.lit("-"), F.substring(session_id, 1, 8))


def file_names(sessions: DataFrame) -> DataFrame:
    """File name per session; equal names get -2, -3 … in session-id order."""
    base = _markdown_name(F.col("date").cast("string"), F.col("project"), F.col("session_id"))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("session_id"))
    named = sessions.select("session_id", base.alias("_base")).withColumn("_n", n)
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise("")
    return named.select("session_id", F.concat("_base", suffix, F.lit(".md")).alias("file_name"))


def markdown_lines(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Markdown export as ordered lines (file_name, ord, pos, text): a session of any length stays many rows.

    ``sessions``: session_id, project, date, start_ms, duration_min, primary_model, messages, cost_usd, source,
    first_prompt. ``messages``: session_id, ord, ts_ms, role, content, display.
    """
    names = file_names(sessions)

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value)

    start = F.regexp_replace(iso_utc("start_ms"), r"\.[0-9]{3}Z$", "Z")
    first_line = F.trim(F.substring_index(F.coalesce("first_prompt", F.lit("")), "\n", 1))
    title = F.when(first_line == "", F.concat(F.lit("Session "), F.substring("session_id", 1, 8))).when(
        F.length(first_line) > 80, F.concat(F.substring(first_line, 1, 80), F.lit("…"))).otherwise(first_line)
    source = F.when(F.coalesce("source", F.lit("")) != "", line("source", yaml_value(F.col("source"))))
    head = F.array_join(F.array_compact(F.array(
        F.lit("---"), line("session_id", yaml_value(F.col("session_id"))), line("project", yaml_value(F.col("project"))),
        line("date", yaml_value(F.col("date"))), line("start", yaml_value(start)),
        line("duration_min", F.col("duration_min").cast("string")), line("model", yaml_value(F.col("primary_model"))),
        line("messages", F.col("messages").cast("string")), line("cost_usd", F.format_string("%.4f", half_even(F.col("cost_usd"), 4))), source,
        F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""))), "\n")
    header = sessions.select("session_id", F.lit(-1).cast("long").alias("ord"), head.alias("text"))

    at = F.coalesce(F.concat(F.lit(" — "), F.date_format(F.timestamp_millis("ts_ms"), "HH:mm:ss")), F.lit(""))
    model = F.coalesce(F.concat(F.lit(" ("), "display", F.lit(")")), F.lit(""))
    heading = F.when(F.col("role") == "user", F.concat(F.lit("## User"), at)).otherwise(
        F.concat(F.lit("## Assistant"), model, at))
    shown = messages.where(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))
    body = shown.select("session_id", F.col("ord").cast("long").alias("ord"),
                        F.concat(heading, F.lit("\n\n"), "content", F.lit("\n")).alias("text"))
    return header.unionByName(body).join(names, "session_id").select("file_name", "session_id", "ord", "text")


def write_markdown(lines: DataFrame, path: str) -> None:
    """All transcripts as one table (file_name, ord, text) in the order of the files, in files of the usual size."""
    lines.repartitionByRange("file_name", "ord").sortWithinPartitions("file_name", "ord").write.mode("overwrite").parquet(path)


def split_markdown(lines: DataFrame, chosen: DataFrame, path: str) -> None:
    """Single transcripts for a chosen set of ``file_name``s: one folder of text each."""
    wanted = lines.join(chosen.select("file_name").distinct(), "file_name", "left_semi")
    (wanted.repartitionByRange("file_name", "ord").sortWithinPartitions("file_name", "ord")
     .select("file_name", "text").write.mode("overwrite").partitionBy("file_name").text(path))

"""Project pages: totals, top files and the workflow timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_FILES = 15
WORKFLOW_ROWS = 500
WORKFLOW_SHOWN = 200


def with_project(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    return rows.join(attributes.select("session_id", "project"), "session_id")


def project_facts(sessions: DataFrame) -> DataFrame:
    """Totals per project over exported session rows."""
    sums = ("messages", "cost_nusd", "tool_calls", "errors", "file_ops", "git_ops", "agent_dispatches")
    return sessions.groupBy("project").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in sums],
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def named(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(session_id, kind, name)``: the named column of each table under its kind, with rows as often as they occur."""
    return reduce(DataFrame.unionByName, [rows.select("session_id", F.lit(kind).alias("kind"), F.col(name).alias("name"))
                                          for kind, (rows, name) in parts.items()])


def name_counts(names: DataFrame, attributes: DataFrame) -> DataFrame:
    """Tools, skills, agent types and errors per project. Names are counted per session before they meet their project."""
    counts = names.groupBy("session_id", "kind", "name").agg(F.count(F.lit(1)).alias("count"))
    return with_project(counts, attributes).groupBy("project", "kind", "name").agg(F.sum("count").alias("count"))


def selected_names(names: DataFrame, sessions: DataFrame) -> DataFrame:
    """How often each name occurs in the selected sessions and in how many of them."""
    counts = names.groupBy("session_id", "kind", "name").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(sessions.select("session_id"), "session_id", "left_semi").groupBy("kind", "name").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("sessions"))


def top_files(file_ops: DataFrame, attributes: DataFrame, limit: int = TOP_FILES) -> DataFrame:
    """Most touched files per project. Operations are counted per file before any ranking."""
    counts = with_project(file_ops, attributes).groupBy("project", "path").agg(
        *[F.count_if(F.col("op") == o).alias(o) for o in ("read", "edit", "write")])
    total = F.col("read") + F.col("edit") + F.col("write")
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc(total), "path"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def workflow(file_ops: DataFrame, git_ops: DataFrame, dispatches: DataFrame, attributes: DataFrame,
             limit: int = WORKFLOW_ROWS) -> DataFrame:
    """First ``limit`` workflow events per project in time order, undated ones last.

    Ranking keeps only ``limit`` rows per project; Spark prunes each task to that many before the shuffle
    (window group limit), so a hot project is not sorted whole in one task.
    """
    files = file_ops.select("session_id", "ord", "pos", "ts_ms", F.col("op").alias("type"), F.col("path").alias("label"))
    git = git_ops.select("session_id", "ord", "pos", "ts_ms", F.concat(F.lit("git_"), "kind").alias("type"),
                         F.col("message").alias("label"))
    agents = dispatches.select("session_id", F.coalesce("ord", F.lit(1 << 62)).alias("ord"), "pos",
                               F.lit(None).cast("long").alias("ts_ms"), F.lit("agent").alias("type"),
                               F.col("description").alias("label"))
    rows = with_project(files.unionByName(git).unionByName(agents), attributes)
    order = [F.col("ts_ms").asc_nulls_last(), "session_id", "ord", "pos", "label"]
    rank = F.row_number().over(Window.partitionBy("project").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def shown_workflow(events: DataFrame, types: list[str]) -> DataFrame:
    """What a page shows: the first rows of the chosen types."""
    chosen = events.where(F.col("type").isin(*types))
    order = F.row_number().over(Window.partitionBy("project").orderBy("rank"))
    return chosen.withColumn("shown", order).where(F.col("shown") <= WORKFLOW_SHOWN)

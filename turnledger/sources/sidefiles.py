"""Side files next to transcripts: prompt history, telemetry, tasks, todos, plan documents, snapshots, storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.scalars import half_even
from turnledger.sources.transcripts import SourceSpec, _union, line_order

MB = 1_048_576


def _lines(spark: SparkSession, sources: Sequence[SourceSpec], pattern: str, whole: bool = False) -> DataFrame:
    parts = []
    for rank, s in enumerate(sources):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        parts.append(reader.text(s.path, wholetext=whole).select(
            "value", F.lit(rank).alias("source_rank"), F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
            line_order(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ord")))
    return _union(parts)


def _listing(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Paths and sizes only; file contents are not read."""
    return _union([
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(s.path).select(
            F.col("path"), F.col("length").alias("size"), F.lit(rank).alias("source_rank"), F.lit(s.label).alias("source"),
            F.lit(s.path).alias("root")) for rank, s in enumerate(sources)])


def _first_source(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the first source that has each key."""
    first = rows.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return rows.join(first, [key, "source_rank"], "left_semi")


def well_formed(lines: DataFrame) -> DataFrame:
    """Lines that hold valid JSON; ``from_json`` alone would turn the others into rows of NULLs."""
    return lines.where(F.try_parse_json("value").isNotNull())


def history_rows(lines: DataFrame) -> DataFrame:
    """Prompt history from JSON lines, first copy per (session, timestamp) in (source, line) order."""
    body = F.from_json("value", "display STRING, timestamp BIGINT, project STRING, sessionId STRING")
    rows = well_formed(lines).select("source_rank", "ord", body.alias("b"))
    text = [F.coalesce(F.col(f"b.{c}"), F.lit("")).alias(c) for c in ("display", "project", "sessionId")]
    rows = rows.select("source_rank", "ord", F.coalesce("b.timestamp", F.lit(0)).alias("timestamp"), *text)
    first = F.min_by(F.struct("display", "project"), F.struct("source_rank", "ord"))
    return (rows.groupBy("sessionId", "timestamp").agg(first.alias("f"))
            .select(F.col("sessionId").alias("session_id"), "timestamp", "f.display", "f.project"))


def load_history(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    return history_rows(_lines(spark, sources, "history.jsonl")).orderBy("timestamp")


def telemetry_rows(lines: DataFrame) -> DataFrame:
    """Parsed telemetry events; ``process`` is JSON inside a string."""
    body = F.from_json("value", "event_data STRUCT<session_id: STRING, process: STRING, env: STRUCT<platform: STRING, "
                                "node_version: STRING, terminal: STRING, arch: STRING, version: STRING>>")
    proc = F.from_json("b.event_data.process", "rss DOUBLE, heapUsed DOUBLE, cpuPercent DOUBLE, uptime DOUBLE")
    rows = well_formed(lines).select("source_rank", "path", "ord", body.alias("b"))
    rows = rows.where(F.coalesce("b.event_data.session_id", F.lit("")) != "")
    return rows.select("source_rank", "path", "ord", F.col("b.event_data.session_id").alias("session_id"),
                       F.col("b.event_data.env").alias("env"), proc.alias("p"))


def telemetry_maxima(rows: DataFrame) -> DataFrame:
    """Event count and peaks per session; values are rounded before the maximum is taken."""
    def peak(field: str, places: int, unit: float = 1.0) -> Column:
        return F.max(half_even(F.coalesce(F.col(f"p.{field}"), F.lit(0.0)) / unit, places))

    return rows.where(F.col("p").isNotNull()).groupBy("session_id").agg(
        peak("rss", 1, MB).alias("peak_rss_mb"), peak("heapUsed", 1, MB).alias("peak_heap_mb"),
        peak("cpuPercent", 1).alias("max_cpu_pct"), peak("uptime", 0).alias("max_uptime_s"),
        F.count(F.lit(1)).alias("event_count"))


def telemetry_environment(rows: DataFrame) -> DataFrame:
    """The first non-empty environment record."""
    filled = F.coalesce("env.platform", "env.node_version", "env.terminal", "env.arch", "env.version").isNotNull()
    return rows.where(filled).agg(F.min_by("env", F.struct("source_rank", "path", "ord")).alias("e")).select("e.*")


def load_telemetry(spark: SparkSession, sources: Sequence[SourceSpec]) -> tuple[DataFrame, DataFrame]:
    rows = telemetry_rows(_lines(spark, sources, "*.json").where(F.col("path").contains("/telemetry/")))
    return telemetry_maxima(rows), telemetry_environment(rows)


def load_tasks(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Tasks of files with numeric names; the first source that has a session's folder wins."""
    pattern = r"/tasks/([^/]+)/([0-9]+)\.json$"
    rows = _lines(spark, sources, "*.json", whole=True).where(F.col("path").rlike(pattern))
    rows = rows.withColumn("session_id", F.regexp_extract("path", pattern, 1)).withColumn(
        "number", F.regexp_extract("path", pattern, 2).cast("long"))
    body = F.from_json("value", "subject STRING, status STRING")
    return (well_formed(_first_source(rows, "session_id")).select("session_id", "number", body.alias("b"))
            .select("session_id", "number", F.coalesce("b.subject", F.lit("")).alias("subject"),
                    F.coalesce("b.status", F.lit("unknown")).alias("status")))


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def load_todos(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Totals over todo lists; the first file of each name wins; files that hold no list are left out."""
    rows = _lines(spark, sources, "*.json", whole=True).where(F.col("path").contains("/todos/"))
    rows = rows.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    items = F.from_json("value", "ARRAY<STRUCT<status: STRING>>")
    lists = well_formed(_first_source(rows, "name")).where(F.ltrim("value").startswith("[")).select(items.alias("items")).where(
        F.col("items").isNotNull())

    def having(*states: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("items", lambda x: x["status"].isin(*states)))), F.lit(0))

    return lists.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("total"), having("completed").alias("completed"),
                     having("pending", "in_progress").alias("pending"), F.count(F.lit(1)).alias("files"))


def load_plan_documents(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Plan documents: title, lines, size and modification time. File creation times are not exposed (NULL)."""
    rows = _lines(spark, sources, "*.md", whole=True).where(F.col("path").rlike(r"/plans/[^/]+\.md$"))
    rows = rows.withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1))
    rows = _first_source(rows, "filename")
    slug = F.regexp_replace("filename", r"\.md$", "")
    heading = F.trim(F.regexp_extract("value", r"(?m)^# (.*)$", 1))
    body = F.regexp_replace("value", r"\r?\n\z", "")
    n_lines = F.when(F.length("value") == 0, 0).otherwise(F.size(F.split(body, r"\r?\n")))
    return rows.select("filename", slug.alias("slug"),
                       F.when(F.col("value").rlike(r"(?m)^# "), heading).otherwise(slug).alias("title"),
                       F.lit(None).cast("timestamp").alias("created"), "modified",
                       half_even(F.col("size") / 1024, 1).alias("size_kb"), n_lines.alias("lines"))


def snapshot_stats(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Files, sessions and megabytes below file-history; a session folder counts for its first source only."""
    pattern = r"/file-history/([^/]+)/[^/]+$"
    rows = _listing(spark, sources).where(F.col("path").rlike(pattern)).withColumn(
        "session_id", F.regexp_extract("path", pattern, 1))
    per = _first_source(rows, "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"),
                                                                     F.sum("size").alias("size"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.count(F.lit(1)).alias("total_sessions"),
                   half_even(F.coalesce(F.sum("size"), F.lit(0)) / MB, 1).alias("total_size_mb"))


def storage_breakdown(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Size per top-level entry of the last (primary) source; every other source is one entry."""
    primary = len(sources) - 1
    rows = _listing(spark, sources)
    rest = F.regexp_replace(F.expr("substring(path, instr(path, root) + length(root))"), "^/+", "")
    top = F.when(rest.contains("/"), F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    name = F.when(F.col("source_rank") == primary, top).otherwise(F.concat(F.lit("_"), "source", F.lit("/")))
    sizes = rows.groupBy(name.alias("name")).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 0)
    return sizes.select("name", half_even(F.col("bytes") / MB, 2).alias("size_mb"), "bytes").orderBy(
        F.desc("bytes"), "name")

"""Transcript scan: JSONL trees of several labelled sources to a typed ``entries`` table.

Bronze keeps one row per line with provenance from the file path. The body is parsed once into typed columns;
malformed lines drop out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.functions.scalars import parse_ts_ms
from turnledger.session import PLAIN, cut_lineage, materialize


@dataclass(frozen=True)
class SourceSpec:
    """A labelled projects folder. Sources are listed in the order in which the first copy of a session wins."""

    label: str
    path: str


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_provenance(df: DataFrame, rank: int, label: str, path: Column) -> DataFrame:
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    is_sub = path.contains("/subagents/")
    parent = F.regexp_extract(path, r"([^/]+)/subagents/(?:.*/)?[^/]+$", 1)
    agent = F.when(is_sub & stem.startswith("agent-"), F.substring(stem, 7, 1 << 20)).otherwise("")
    return (df.withColumn("source_rank", F.lit(rank)).withColumn("source", F.lit(label))
            .withColumn("file_stem", stem).withColumn("is_subagent", is_sub)
            .withColumn("parent_id", F.when(is_sub, parent).otherwise("")).withColumn("agent_id", agent))


def transcript_files(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """File listing (path and size only; contents are not read)."""
    parts = []
    for rank, s in enumerate(sources):
        listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                   .option("pathGlobFilter", "*.jsonl").load(s.path)
                   .select(F.col("path").alias("file_path"), F.col("length").alias("file_size")))
        parts.append(_with_provenance(listing, rank, s.label, F.col("file_path")))
    return _union(parts)


def first_copies(files: DataFrame) -> DataFrame:
    """First file of each stem in (source, path) order: later copies are dropped before any line is parsed."""
    return (files.groupBy("file_stem").agg(F.min(F.struct("source_rank", "file_path")).alias("f"))
            .select(F.col("f.source_rank").alias("source_rank"), F.col("f.file_path").alias("file_path")))


def line_order(block_start: Column, row_id: Column) -> Column:
    """Position of a line in its file: its split's offset plus the row id inside the partition.

    A partition holds at most as many bytes as a split is long, and a line has a byte at least, so the row ids of a
    split end before the offset of the next one. No file has to be numbered by a window.
    """
    return block_start.cast("long") + row_id.bitwiseAND(F.lit((1 << 33) - 1))


def session_positions(entries: DataFrame, session: str = "session_id", files: Sequence[str] = ("source_rank", "file_path"),
                      listing: DataFrame | None = None) -> DataFrame:
    """Make ``ord`` unique and ordered within a session whose lines come from several files.

    A resumed or forked session has lines in more than one file, and ``ord`` counts per file. Files follow each other
    in the order of ``files``; the place of a file goes above the 48 bits that a position in a file can take (files up
    to 256 TB). Only sessions with several files have rows in the joined table, which is hashed, so that the entries are
    not sorted. ``listing`` names the same sessions and files as ``entries`` where that is cheaper to read.
    """
    placed = (entries if listing is None else listing).select(session, *files).distinct().withColumn(
        "_file_rank", F.row_number().over(Window.partitionBy(session).orderBy(*files)) - 1).where("_file_rank > 0")
    out = entries.join(placed.hint("shuffle_hash"), [session, *files], "left")
    rank = F.coalesce("_file_rank", F.lit(0)).cast("long")
    return out.withColumn("ord", F.shiftleft(rank, 48) + F.col("ord")).drop("_file_rank")


def scan_lines(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Bronze lines of the first copies of all files."""
    parts = []
    for rank, s in enumerate(sources):
        text = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(s.path)
                .select("value", F.col("_metadata.file_path").alias("file_path"),
                        F.col("_metadata.file_size").alias("file_size"),
                        line_order(F.col("_metadata.file_block_start"),
                                   F.monotonically_increasing_id()).alias("ord")))
        parts.append(_with_provenance(text, rank, s.label, F.col("file_path")))
    lines = _union(parts).where(F.trim("value") != "")
    return lines.join(first_copies(transcript_files(spark, sources)), ["source_rank", "file_path"], "left_semi")


def sidecars(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Sub-agent side files: type and description per agent file stem."""
    parts = []
    for rank, s in enumerate(sources):
        meta = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json")
                .text(s.path, wholetext=True)
                .select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.meta\.json$", 1).alias("file_stem")))
        body = F.from_json("value", "agentType STRING, description STRING")
        parts.append(meta.select("file_stem", F.lit(rank).alias("source_rank"),
                                 F.coalesce(body["agentType"], F.lit("")).alias("agent_type"),
                                 F.coalesce(body["description"], F.lit("")).alias("agent_description")))
    return _union(parts)


LINE_SCHEMA = """type STRING, sessionId STRING, timestamp STRING, cwd STRING, slug STRING, isMeta BOOLEAN,
 isCompactSummary BOOLEAN, isApiErrorMessage BOOLEAN,
 message STRUCT<id: STRING, model: STRING, content: VARIANT, usage: STRUCT<
  input_tokens: BIGINT, output_tokens: BIGINT, cache_read_input_tokens: BIGINT, cache_creation_input_tokens: BIGINT,
  cache_creation: STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>>>,
 toolUseResult VARIANT, data STRUCT<type: STRING, hookName: STRING, hookEvent: STRING>, mode STRING,
 permissionMode STRING, attachment VARIANT, content STRING, operation STRING"""
BLOCK_TYPE = ("array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,"
              "tool_use_id:string,content:string,is_error:boolean>>")


def parse_blocks(content: Column) -> Column:
    """Content blocks of a message whose content is a list; NULL when it is a string. One cast of the VARIANT."""
    return F.transform(F.try_variant_get(content, "$", BLOCK_TYPE), lambda b: F.struct(
        b["type"].alias("btype"), b["text"], b["thinking"], b["id"], b["name"], b["input"], b["tool_use_id"],
        b["content"], F.coalesce(b["is_error"], F.lit(False)).alias("is_error")))


def parse_entries(lines: DataFrame) -> DataFrame:
    """Typed entries from bronze lines. ``sessionId`` of sub-agent files is replaced by the file stem.

    The line is parsed once with a fixed schema; only ``content``, which may be a string or a list, passes through
    VARIANT. Malformed lines and lines that are no objects parse to NULLs and drop out. The parsed line is exploded
    from an array of one, as a filter on a plain column would parse the line again for each field that it tests.
    """
    parsed = lines.withColumn("b", F.explode_outer(F.array(F.from_json("value", LINE_SCHEMA)))).drop("value")
    parsed = parsed.where(F.coalesce("b.type", "b.sessionId", "b.timestamp").isNotNull())
    parsed = parsed.withColumn("blocks", parse_blocks(F.col("b.message.content")))
    content, u = F.col("b.message.content"), F.col("b.message.usage")
    plain = F.when(F.col("blocks").isNull() & (F.schema_of_variant(content) == "STRING"),
                   F.try_variant_get(content, "$", "string"))
    zero = F.lit(0).cast("long")
    usage = F.when(u.isNotNull(), F.struct(
        F.coalesce(u["input_tokens"], zero).alias("input_tokens"), F.coalesce(u["output_tokens"], zero).alias("output_tokens"),
        F.coalesce(u["cache_read_input_tokens"], zero).alias("cache_read"),
        F.coalesce(u["cache_creation_input_tokens"], zero).alias("cache_creation"),
        F.coalesce(u["cache_creation"]["ephemeral_5m_input_tokens"], zero).alias("cache_5m"),
        F.coalesce(u["cache_creation"]["ephemeral_1h_input_tokens"], zero).alias("cache_1h")))

    def text(path: str, default: str = "") -> Column:
        return F.coalesce(F.col(f"b.{path}"), F.lit(default))

    def flag(path: str) -> Column:
        return F.coalesce(F.col(f"b.{path}"), F.lit(False))

    carried = [c for c in lines.columns if c != "value"]
    agent = F.try_variant_get(F.col("b.toolUseResult"), "$.agentId", "string")
    kind = F.try_variant_get(F.col("b.attachment"), "$.type", "string")
    return parsed.select(
        *carried, F.when(F.col("is_subagent"), F.col("file_stem"))
        .otherwise(F.coalesce("b.sessionId", "file_stem")).alias("session_id"),
        F.col("b.type").alias("type"), text("timestamp").alias("ts_text"), parse_ts_ms(F.col("b.timestamp")).alias("ts_ms"),
        F.col("b.message.id").alias("msg_id"), text("message.model", "unknown").alias("model"), usage.alias("usage"),
        text("cwd").alias("cwd"), text("slug").alias("slug"), flag("isMeta").alias("is_meta"),
        flag("isCompactSummary").alias("is_compact"), flag("isApiErrorMessage").alias("is_api_error"),
        plain.alias("content_text"), "blocks", F.coalesce(agent, F.lit("")).alias("result_agent_id"),
        F.col("b.data.type").alias("data_type"), text("data.hookName").alias("hook_name"),
        text("data.hookEvent").alias("hook_event"), text("mode").alias("mode"),
        text("permissionMode").alias("permission_mode"), F.coalesce(kind, F.lit("")).alias("attachment_type"),
        text("content").alias("queue_text"), text("operation", "queue").alias("queue_operation"))


def drop_claimed_files(entries: DataFrame) -> DataFrame:
    """Drop files whose stem an earlier kept file already used as a session id.

    Only files whose lines carry another session id can claim one, and normally there are none. The search runs on
    the small table of such claims until it is stable.
    """
    order = F.struct("source_rank", "file_path")
    foreign = (entries.where(~F.col("is_subagent") & (F.col("session_id") != F.col("file_stem")))
               .select(F.col("session_id").alias("claimed"), order.alias("by"), F.col("file_stem").alias("by_stem"))
               .distinct())
    files = entries.select("source_rank", "file_path", "file_stem").distinct().select("file_stem", order.alias("at"))
    contested = cut_lineage(files.join(foreign, F.col("file_stem") == F.col("claimed"))
                            .where(F.col("by") < F.col("at")).select("file_stem", "by_stem").distinct())
    if contested.isEmpty():
        return entries
    settled, count = contested.select("file_stem").distinct(), -1
    while True:
        blocked = contested.join(settled.withColumnRenamed("file_stem", "by_stem"), "by_stem", "left_anti").select(
            "file_stem").distinct()
        blocked = cut_lineage(blocked)
        now = blocked.count()
        if now == count:
            break
        settled, count = blocked, now
    return entries.join(blocked, "file_stem", "left_anti")


def merge_streamed(entries: DataFrame) -> DataFrame:
    """One entry per response: assistant rows of a file with equal message id become one.

    Blocks are joined in line order, position, time and attributes come from the first row, usage from the last row
    that has one. Rows without an id and all other entries pass through. One shuffle and one sort, on (file, message
    id, position); few lines share a message, so nothing could fold before the shuffle, and no line is copied into a list.
    """
    is_part = (F.col("type") == "assistant") & F.col("msg_id").isNotNull() & (F.col("msg_id") != "")
    parts, rest = entries.where(is_part), entries.where(~F.coalesce(is_part, F.lit(False)))
    keys = ["msg_id", "file_path", "source_rank"]
    none = F.array().cast(entries.schema["blocks"].dataType)
    rest_of_line = [c for c in entries.columns if c not in (*keys, "ord", "blocks")]
    order = Window.partitionBy(*keys).orderBy("ord", "blocks", *rest_of_line)  # equal positions have a fixed order, too
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = parts.withColumn("blocks", F.coalesce("blocks", none)).select(
        *keys, "ord", F.last("usage", ignorenulls=True).over(whole).alias("usage"),
        F.flatten(F.collect_list("blocks").over(whole)).alias("blocks"), F.count(F.lit(1)).over(whole).alias("n_lines"),
        *[c for c in rest_of_line if c != "usage"], F.row_number().over(order).alias("_line"))
    merged = merged.where("_line = 1").drop("_line")
    return merged.unionByName(rest.withColumn("n_lines", F.lit(1).cast("long")))


def read_transcripts(spark: SparkSession, sources: Sequence[SourceSpec]) -> DataFrame:
    """Scan, parse, de-duplicate and merge: the ``entries`` table of a list of sources.

    Every line is read and parsed once and written as typed columns; the search for claimed files and the merge read
    the columns that they need from there.
    """
    entries = materialize(parse_entries(scan_lines(spark, sources)), "parsed-lines", **PLAIN)
    entries = drop_claimed_files(entries)
    side = sidecars(spark, sources)
    entries = entries.join(side, ["source_rank", "file_stem"], "left")
    for c in ("agent_type", "agent_description"):
        entries = entries.withColumn(c, F.coalesce(c, F.lit("")))
    return session_positions(merge_streamed(entries))

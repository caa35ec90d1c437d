"""Filtered re-aggregation: the same facts under range, project and attribute filters.

Filters narrow the session list and the slices; the unfiltered operators are then applied unchanged, so filtered and
unfiltered results cannot disagree.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scalars import safe_ratio
from turnledger.operators.ordering import grouped_quantiles
from turnledger.session import materialize

# Range choices in days (0 = all) and the ladder of axis ends.
RANGE_DAYS = (0, 7, 30, 90, 365)
NICE_STEPS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000,
              1000000, 2000000, 5000000, 10000000)


@dataclass(frozen=True)
class Filters:
    days: int = 0
    project: str = ""
    hide_empty: bool = True
    exact_project: str | None = None
    source: str | None = None
    text: str = ""
    ranges: dict = field(default_factory=dict)

    def cutoff(self, as_of: dt.date) -> dt.date | None:
        return as_of - dt.timedelta(days=self.days) if self.days > 0 else None


def attributes() -> dict[str, Column]:
    """The nine filterable attributes over session facts."""
    into = F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")
    zero = F.lit(0)
    return {
        "user_messages": F.coalesce("user_messages", zero), "messages": F.coalesce("messages", zero),
        "duration_min": F.coalesce("duration_min", F.lit(0.0)), "total_tokens": into + F.col("output_tokens"),
        "cost": F.col("cost"),
        "cache_eff": F.floor(safe_ratio(F.col("cache_read"), into) * 100 + 0.5),
        "tool_calls": F.coalesce("tool_calls", zero), "agent_dispatches": F.coalesce("agent_dispatches", zero),
        "errors": F.coalesce("errors", zero),
    }


PRESETS = {"real": {"user_messages": (2, None)}, "costly": {"cost": (1.0, None)}}


def select_sessions(sessions: DataFrame, f: Filters, as_of: dt.date) -> DataFrame:
    """Range on the session's end day, project part, emptiness, exact project / source, free text, attributes."""
    out = sessions
    if f.hide_empty:
        out = out.where((F.col("messages") > 0) | (F.col("output_tokens") > 0))
    cutoff = f.cutoff(as_of)
    if cutoff:
        out = out.where(F.col("end_date") >= F.lit(cutoff))
    if f.project.strip():
        out = out.where(F.lower("project").contains(f.project.strip().lower()))
    if f.exact_project is not None:
        out = out.where(F.col("project") == f.exact_project)
    if f.source is not None:
        out = out.where(F.col("source") == f.source)
    if f.text:
        needle = f.text.lower()
        out = out.where(F.lower(F.coalesce("first_prompt", F.lit(""))).contains(needle)
                        | F.lower("project").contains(needle))
    table = attributes()
    for name, (low, high) in f.ranges.items():
        if low is not None:
            out = out.where(table[name] >= low)
        if high is not None:
            out = out.where(table[name] <= high)
    return out


def select_slices(day_slices: DataFrame, sessions: DataFrame, f: Filters, as_of: dt.date) -> DataFrame:
    """Slices of the selected sessions on days inside the range."""
    cutoff = f.cutoff(as_of)
    days = day_slices.where(F.col("day") >= F.lit(cutoff)) if cutoff else day_slices
    return days.join(sessions.select("session_id"), "session_id", "left_semi")


def _nice(value: Column) -> Column:
    out = F.when(F.coalesce(value, F.lit(0.0)) <= 0, 1.0)
    for step in NICE_STEPS:
        out = out.when(value <= step, float(step))
    return out.otherwise(F.pow(F.lit(10.0), F.ceil(F.log10(value))))


def attribute_domains(sessions: DataFrame) -> DataFrame:
    """Upper end per attribute: exact 99th percentile on a nice ladder; cost and percent have their own rules.

    The attributes become rows, so all of them share one distributed quantile search.
    """
    table = attributes()
    entries = F.array(*[F.struct(F.lit(n).alias("attribute"), c.cast("double").alias("value"))
                        for n, c in table.items()])
    rows = sessions.select(F.explode(entries).alias("e")).select("e.*").where(F.col("value").isNotNull())
    # Bins of 64 per power of two keep the number of bins per attribute bounded.
    bins = F.floor(F.log2(F.col("value") + 1) * 64).cast("int")
    p = grouped_quantiles(rows, ["attribute"], "value", {"p99": 0.99}, bins)
    p99 = F.col("p99")
    cents = F.greatest(F.lit(1.0), F.ceil(p99 * 100) / 100)
    top = (F.when(F.col("attribute") == "cost", F.when(cents > 1, _nice(cents)).otherwise(cents))
           .when(F.col("attribute") == "cache_eff", 100.0)
           .otherwise(_nice(F.when(p99 == 0, 1.0).otherwise(p99))))
    return p.select("attribute", F.lit(0.0).alias("low"), top.alias("high"))


SORT_COLUMNS = {
    "date": "start_ms", "project": "project", "source": "source", "model": "primary_model",
    "duration": "duration_min", "messages": "messages", "user_messages": "user_messages",
    "assistant_messages": "assistant_messages", "tool_results": "tool_results", "command_messages": "command_messages",
    "interrupts": "interrupts", "meta_messages": "meta_messages", "api_calls": "calls",
    "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read",
    "cache_write_tokens": "cache_creation", "reasoning_tokens": "reasoning_output_tokens", "cost": "cost_nusd",
    "reasoning_cost": "reasoning_cost_nusd", "compactions": "compactions", "flushes": "gap_flushes",
    "file_ops": "file_ops_count", "agent_dispatches": "agent_dispatches", "file_size": "file_size",
    "errors": "error_count", "tool_calls": "tool_calls",
}


def sort_key(column: str) -> Column:
    into = F.col("input_tokens") + F.col("cache_read") + F.col("cache_creation")
    if column == "total_tokens":
        return into + F.col("output_tokens")
    if column == "cache_eff":
        return F.coalesce(safe_ratio(F.col("cache_read"), into, None), F.lit(-1.0))
    return F.col(SORT_COLUMNS[column])


def sorted_sessions(sessions: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """Sort by a table column; equal values by start, latest first, then session id."""
    key = sort_key(column)
    first = key.asc_nulls_first() if ascending else key.desc_nulls_last()
    return sessions.orderBy(first, F.desc("start_ms"), "session_id")


def sorted_page(sessions: DataFrame, column: str, page: int, size: int, ascending: bool = False) -> DataFrame:
    """One page of the sorted table: a top-k with offset, which Spark runs without a total sort."""
    return sorted_sessions(sessions, column, ascending).offset(page * size).limit(size)


def stable_labels(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """Anonymous label per distinct name, numbered in name order.

    Names are dealt out by range and written once; each range is numbered by itself and starts after the ranges
    before it, so no task sees all names.
    """
    parts = materialize(names.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "labels")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(column)) + F.col("_start")
    return parts.join(starts, "_part").select(column, F.concat(F.lit(prefix + " "), n.cast("string")).alias("label"))


def anonymized(sessions: DataFrame) -> DataFrame:
    """Project and source names replaced by labels. AQE broadcasts the label tables when they are small."""
    out = sessions
    for column, prefix in (("project", "Project"), ("source", "Source")):
        labels = stable_labels(sessions, column, prefix)
        out = out.join(labels, column).drop(column).withColumnRenamed("label", column)
    return out


def top_with_other(items: DataFrame, name: str, value: str, top: int = 8, least: float = 0.1) -> DataFrame:
    """Largest items and one ``Other (n)`` row for the rest, once more than top + 1 items remain.

    ``items`` is already aggregated (top-level folders), so its ranking is over a small table.
    """
    kept = items.where(F.col(value) >= least)
    ranked = kept.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(value), name))).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy()))
    folded = (F.col("_n") > top + 1) & (F.col("_rn") > top)
    label = F.when(folded, F.concat(F.lit("Other ("), (F.col("_n") - top).cast("string"), F.lit(")")))
    out = ranked.groupBy(F.coalesce(label, F.col(name)).alias(name), folded.alias("_o")).agg(
        F.sum(value).alias(value))
    return out.select(name, F.when(F.col("_o"), F.rint(F.col(value) * 10) / 10).otherwise(F.col(value)).alias(value))

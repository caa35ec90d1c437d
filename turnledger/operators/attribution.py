"""Exact splits of a turn's output tokens and cost over its tools and write categories.

All parts of one turn sit in one row, so the splits need no shuffle. Every part but the last is rounded half to
even; the last part takes what is left, so parts always add up to the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scalars import half_even
from turnledger.operators.ordering import with_previous

# Categories in report order and the tools that write files.
WRITE_CATEGORIES = ("screen_text", "screen_text_narration", "thinking", "file_writes", "bash_commands",
                    "tool_inputs")
FILE_WRITE_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")


def _split(total: Column, weights: Column, weight_sum: Column) -> Column:
    """Array of whole parts of ``total`` in proportion to ``weights``; the last absorbs the remainder."""
    shares = F.transform(weights, lambda w: F.rint(total * w / weight_sum).cast("long"))
    head = F.slice(shares, 1, F.greatest(F.size(shares) - 1, F.lit(0)))
    rest = total - F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.concat(head, F.array(rest))


def tool_tokens(turns: DataFrame, keys=()) -> DataFrame:
    """Calls, output tokens and cost per tool (and ``keys``). Tokens come from turns with output only.

    Within a turn every tool but the last in first-use order gets its rounded share, and the last gets the rest:
    the whole turn minus those shares. So each share is booked twice, once for its tool and once, negative, for
    the last tool; the sums per tool are exact and need neither a window nor a second shuffle.
    """
    named = turns.select(*keys, "tools", "output_tokens", "cost_nusd", F.array_distinct("tools").alias("names"),
                         F.size("tools").alias("n"))
    rows = named.where(F.col("n") > 0).select(
        *keys, "tools", "n", "output_tokens", "cost_nusd", F.element_at("names", -1).alias("last_tool"),
        F.explode_outer("names").alias("tool"))
    calls = (F.col("n") - F.size(F.array_remove("tools", F.col("tool")))).cast("long")
    is_last = F.col("tool") == F.col("last_tool")

    def share(total: str) -> Column:
        part = F.when(is_last, F.col(total)).otherwise(F.rint(F.col(total) * F.col("calls") / F.col("n")))
        return F.when(F.col("output_tokens") > 0, part).otherwise(0).cast("long")

    rows = rows.withColumn("calls", calls).select(
        *keys, "tool", "last_tool", "calls", share("output_tokens").alias("t"), share("cost_nusd").alias("m"),
        is_last.alias("is_last"))
    own = F.struct("tool", "calls", F.col("t").alias("output_tokens"), F.col("m").alias("cost_nusd"))
    counter = F.struct(F.col("last_tool").alias("tool"), F.lit(0).cast("long").alias("calls"),
                       (-F.col("t")).alias("output_tokens"), (-F.col("m")).alias("cost_nusd"))
    booked = rows.select(*keys, F.explode(F.when(F.col("is_last"), F.array(own)).otherwise(F.array(own, counter))).alias("p"))
    return booked.groupBy(*keys, F.col("p.tool").alias("tool")).agg(
        *[F.sum(f"p.{c}").alias(c) for c in ("calls", "output_tokens", "cost_nusd")])


def reasoning_totals(turns: DataFrame, keys=()) -> DataFrame:
    """Output tokens and cost of turns that called no tool."""
    plain = turns.where((F.size("tools") == 0) & (F.col("output_tokens") > 0))
    return plain.groupBy(*keys).agg(F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
                                    F.coalesce(F.sum("cost_nusd"), F.lit(0)).alias("cost_nusd"))


def _block_weight(b: Column) -> Column:
    def size(c: Column) -> Column:
        return F.coalesce(F.length(c), F.lit(0))

    return (F.when(b["btype"] == "text", size(b["text"])).when(b["btype"] == "thinking", size(b["thinking"]))
            .when(b["btype"] == "tool_use", size(b["name"]) + size(b["input"])).otherwise(0)).cast("long")


def block_category(b: Column, with_tools: Column) -> Column:
    return (F.when(b["btype"] == "text", F.when(with_tools, "screen_text_narration").otherwise("screen_text"))
            .when(b["btype"] == "thinking", "thinking")
            .when(b["name"].isin(*FILE_WRITE_TOOLS), "file_writes")
            .when(b["name"] == "Bash", "bash_commands").otherwise("tool_inputs"))


def write_parts(turns: DataFrame) -> DataFrame:
    """Column ``writes``: array of (category, tokens) per content block with a measurable payload."""
    with_tools = F.exists("blocks", lambda b: b["btype"] == "tool_use")
    weighed = F.filter(
        F.transform("blocks", lambda b: F.struct(block_category(b, with_tools).alias("category"),
                                                 _block_weight(b).alias("w"))),
        lambda x: x["w"] > 0)
    out = turns.withColumn("_w", weighed).withColumn("_ws", F.transform("_w", lambda x: x["w"]))
    out = out.withColumn("_total", F.aggregate("_ws", F.lit(0).cast("long"), lambda a, x: a + x))
    total = F.col("_total")
    split = F.arrays_zip(F.transform("_w", lambda x: x["category"]).alias("category"),
                         _split(F.col("output_tokens"), F.col("_ws"), total).alias("tokens"))
    fallback = F.array(F.struct(F.lit("screen_text").alias("category"), F.col("output_tokens").alias("tokens")))
    writes = (F.when((F.col("output_tokens") <= 0) | (F.size("blocks") == 0), None)
              .when(F.size("_w") == 0, fallback).otherwise(split))
    return out.withColumn("writes", writes).drop("_w", "_ws", "_total")


def narration_tokens(entries: DataFrame) -> DataFrame:
    """Mark tool-less assistant turns that the next user/assistant entry continues as an assistant entry.

    ``entries`` holds user and assistant rows with ``session_id``, ``ord`` and ``type``; adds ``is_narration``.
    The next entry is the previous one along the reversed line position.
    """
    talk = entries.where(F.col("type").isin("user", "assistant")).withColumn("_back", -F.col("ord"))
    marked = with_previous(talk, ["session_id"], "_back", [], ["type"], 1 << 20)
    both = (F.col("type") == "assistant") & (F.col("prev.type") == "assistant")
    return marked.withColumn("is_narration", F.coalesce(both, F.lit(False))).drop("_back", "prev")


def write_categories(turns: DataFrame, keys=()) -> DataFrame:
    """Output tokens per write category; ``is_narration`` moves plain text of such turns to narration.

    The outer explode keeps Spark from testing the size of ``writes`` first, which would work out the parts once more.
    """
    exploded = write_parts(turns).select(*keys, "is_narration", F.size("tools").alias("n_tools"),
                                         F.explode_outer("writes").alias("w")).where(F.col("w").isNotNull())
    moved = (F.col("w.category") == "screen_text") & F.col("is_narration") & (F.col("n_tools") == 0)
    category = F.when(moved, "screen_text_narration").otherwise(F.col("w.category"))
    return exploded.groupBy(*keys, category.alias("category")).agg(F.sum("w.tokens").alias("output_tokens"))


def category_shares(totals: DataFrame) -> DataFrame:
    """Six report rows with their share of all output tokens."""
    spine = totals.sparkSession.range(len(WRITE_CATEGORIES)).select(
        F.element_at(F.array(*[F.lit(c) for c in WRITE_CATEGORIES]), F.col("id").cast("int") + 1).alias("category"))
    rows = spine.join(totals.select("category", "output_tokens"), "category", "left").select(
        "category", F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"))
    everything = F.sum("output_tokens").over(Window.partitionBy())
    share = F.col("output_tokens") / F.when(everything == 0, 1).otherwise(everything)
    return rows.withColumn("share", half_even(share, 4))

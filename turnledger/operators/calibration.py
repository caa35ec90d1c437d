"""Calibration of the write-category weights: block sample and characters per token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.attribution import FILE_WRITE_TOOLS
from turnledger.operators.ordering import grouped_quantiles

MIN_PAYLOAD = 8
CATEGORIES = ("screen_text", "thinking", "file_writes", "bash_commands", "tool_inputs")


def block_payloads(turns: DataFrame) -> DataFrame:
    """One row per assistant block that the model wrote: category, payload, model, source."""
    rows = turns.select("session_id", "ord", "source", "model", F.posexplode("blocks").alias("pos", "b"))
    b = F.col("b")
    category = (F.when(b["btype"] == "text", "screen_text").when(b["btype"] == "thinking", "thinking")
                .when(b["btype"] == "tool_use", F.when(b["name"].isin(*FILE_WRITE_TOOLS), "file_writes")
                      .when(b["name"] == "Bash", "bash_commands").otherwise("tool_inputs")))
    payload = (F.when(b["btype"] == "text", b["text"]).when(b["btype"] == "thinking", b["thinking"])
               .when(b["btype"] == "tool_use", F.concat(F.coalesce(b["name"], F.lit("")), F.lit(" "),
                                                        F.coalesce(b["input"], F.lit("")))))
    out = rows.select("session_id", "ord", "pos", "source", "model", category.alias("category"), payload.alias("payload"))
    return out.where(F.col("category").isNotNull() & (F.length("payload") >= MIN_PAYLOAD))


def stratified_sample(blocks: DataFrame, per_category: int, seed: int = 42) -> DataFrame:
    """``per_category`` blocks of each category, chosen by a seeded hash; the same input gives the same sample.

    The rank limit is pushed below the shuffle (window group limit), so each task sends at most that many rows
    per category.
    """
    key = F.xxhash64(F.lit(seed), "session_id", "ord", "pos")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(key, "session_id", "ord", "pos"))
    return blocks.withColumn("rank", rank).where(F.col("rank") <= per_category)


def chars_per_token(sample: DataFrame) -> DataFrame:
    """Mean, median, sample deviation and weighted ratio per category; needs ``tokens`` per block.

    The correction compares each category's weighted ratio with plain text (or the first category there is).
    """
    rows = sample.where(F.col("tokens") > 0).withColumn("chars", F.length("payload")).withColumn(
        "ratio", F.col("chars") / F.col("tokens"))
    stats = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean"), F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)).alias("stdev"),
        F.sum("chars").alias("total_chars"), F.sum("tokens").alias("total_tokens"))
    bins = F.floor(F.log2(F.col("ratio") + 1) * 256).cast("int")
    medians = grouped_quantiles(rows, ["category"], "ratio", {"median": 0.5}, bins).drop("n")
    out = stats.join(medians, "category").withColumn("weighted", F.col("total_chars") / F.col("total_tokens"))
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    # One row per category: the window below runs over at most five rows.
    base = F.min_by("weighted", rank).over(Window.partitionBy())
    return out.withColumn("correction", base / F.col("weighted"))


def chars_per_token_by_model(sample: DataFrame) -> DataFrame:
    """Weighted ratio per model; blocks counted with a fallback tokenizer (``degraded``) are left out."""
    rows = sample.where((F.col("tokens") > 0) & ~F.col("degraded"))
    model = F.when(F.coalesce("model", F.lit("")) == "", "(unknown)").otherwise(F.col("model"))
    return (rows.groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("total_chars"),
                                                   F.sum("tokens").alias("total_tokens"))
            .withColumn("weighted", F.col("total_chars") / F.col("total_tokens")))

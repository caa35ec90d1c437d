"""Helpers for ordered and order-statistic work that stay parallel when one key is very hot.

* Long series are first folded into fixed-width time cells per key. A gap that is at least as wide as a cell can
  only lie between two cells, so gap logic runs on the cell table, whose size is bounded by elapsed time and not
  by row count.
* ``with_previous`` reads the previous row of a series. Every key is cut into cells that different tasks sort; the
  first row of a cell takes its predecessor from a table of cell ends.
* ``grouped_quantiles`` finds exact quantiles with bin counts, without holding a group's values in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.scalars import HOUR_MS, cell

def with_previous(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], columns: Sequence[str],
                  cell_ms: int = HOUR_MS) -> DataFrame:
    """Add struct ``prev`` holding ``columns`` of the preceding row of the key, in (ts, *order) order.

    Rows are sorted per (key, cell); the table of cell ends has one row per cell that is in use.
    """
    marked = df.withColumn("_cell", cell(ts, cell_ms))
    inside = Window.partitionBy(*keys, "_cell").orderBy(ts, *order)
    payload = F.struct(*[F.col(c) for c in columns])
    ends = marked.groupBy(*keys, "_cell").agg(F.max_by(payload, F.struct(F.col(ts), *[F.col(o) for o in order])).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_cell")
    ends = ends.select(*keys, "_cell", F.lag("_last").over(across).alias("_before"))
    out = marked.withColumn("_prev", F.lag(payload).over(inside)).join(ends, [*keys, "_cell"], "left")
    return out.withColumn("prev", F.coalesce("_prev", "_before")).drop("_prev", "_before", "_cell")


def running_total(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], value: Column, out: str, width: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` (a whole number) over the rows of the key up to and with this one, in (at, *order) order.

    Rows are added up per (key, cell of ``width``); what lies before a cell comes from a table of cell sums.
    """
    marked = df.withColumn("_cell", cell(at, width)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_cell").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*keys, "_cell").agg(F.sum("_value").alias("_sum"))
    before = sums.select(*keys, "_cell", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    summed = marked.withColumn("_run", F.sum("_value").over(inside)).join(before, [*keys, "_cell"])
    return summed.withColumn(out, F.col("_before") + F.col("_run")).drop("_before", "_run", "_cell", "_value")


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      bin_of: Column) -> DataFrame:
    """Exact linear-interpolation quantiles per key: columns *keys, ``n`` and one per entry of ``probs``.

    ``bin_of`` is a monotone integer bin of ``value`` with a bounded number of bins. Equal values are merged
    first; only the bins that hold a wanted rank are ordered by value.
    """
    keys = list(keys)
    values = (df.groupBy(*keys, F.col(value).alias("_v"), bin_of.alias("_bin"))
              .agg(F.count(F.lit(1)).alias("_c")))
    counts = values.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    counts = counts.select(*keys, "_bin",
                           (F.sum("_bc").over(by_bin) - F.col("_bc")).alias("_below"), "_bc",
                           F.sum("_bc").over(whole).alias("n"))
    ranks = []
    for p in probs.values():
        position = (F.col("n") - 1) * F.lit(float(p))
        ranks += [F.floor(position), F.ceil(position)]
    wanted = counts.where(F.exists(F.array(*ranks), lambda r: (r >= F.col("_below"))
                                   & (r < F.col("_below") + F.col("_bc"))))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ordered = (values.join(wanted, [*keys, "_bin"])
               .withColumn("_hi", F.col("_below") + F.sum("_c").over(inside))
               .withColumn("_lo", F.col("_hi") - F.col("_c")))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))

    aggregates = [F.max("n").alias("n")]
    for i in range(len(probs)):
        aggregates += [at(ranks[2 * i]).alias(f"_a{i}"), at(ranks[2 * i + 1]).alias(f"_b{i}")]
    out = ordered.groupBy(*keys).agg(*aggregates)
    columns = []
    for i, (name, p) in enumerate(probs.items()):
        position = (F.col("n") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
        columns.append(F.when(share == 0, low.cast("double")).otherwise(low * (1 - share) + high * share).alias(name))
    return out.select(*keys, "n", *columns)

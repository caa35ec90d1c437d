"""Anchored usage windows, weekly buckets and limit events.

Everything is keyed by ``account``; a single-account job uses one constant key. Because that key may hold all rows,
no step sorts or collects an account's rows in one task: series are folded into time cells first, and only cell
tables (bounded by elapsed time) are ordered per account.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.pricing import price_calls
from turnledger.functions.scalars import HOUR_MS, cell, local_hour, utc_day
from turnledger.session import cut_lineage, materialize

# Fixed values.
WINDOW_MS = 5 * HOUR_MS
CLUSTER_MS = 900_000
FINGERPRINT_MIN_MS = 17_100_000
FINGERPRINT_MAX_MS = 19_800_000
FINGERPRINT_TOLERANCE_MS = 900_000
ACTIVE_PREFIX_MS = 7_200_000
DAY_HOURS = (7, 22)
TIER_FACTORS = (("Pro", 1.0), ("Max 5x", 5.0), ("Max 20x", 20.0))
PRO_CAPACITY_USD_DEFAULT = 100.0
WEEKLY_VS_WINDOW_RATIO = 7

# Islands (series without a 5-hour pause) with at most this many distinct timestamps are folded as one sorted
# array; longer ones take the pointer-doubling path, which never holds an island in one place.
ARRAY_ISLAND_POINTS = 200_000


def billable(turns: DataFrame) -> DataFrame:
    return turns.where((F.col("output_tokens") > 0) & F.col("ts_ms").isNotNull())


def _blocks(turns: DataFrame) -> DataFrame:
    """Five-hour cells with their first and last turn, and the island each belongs to.

    Two turns of one cell are closer than five hours, so a pause of five hours or more can only precede the first
    turn of a cell; after such a pause a new window always opens.
    """
    cells = (turns.groupBy("account", cell("ts_ms", WINDOW_MS).alias("block"))
             .agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("account").orderBy("block")
    pause = F.col("first_ms") - F.lag("last_ms").over(w)
    opens = pause.isNull() | (pause >= WINDOW_MS)
    return (cells.withColumn("_open", F.when(opens, F.col("first_ms")))
            .withColumn("island_ms", F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .drop("_open"))


def _starts_by_fold(points: DataFrame) -> DataFrame:
    """Window starts of short islands: a fold over the island's sorted distinct timestamps."""
    folded = F.aggregate(
        F.array_sort(F.collect_set("ts_ms")), F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t >= F.try_element_at(acc, F.lit(-1)) + WINDOW_MS),
                              F.concat(acc, F.array(t))).otherwise(acc))
    return (points.groupBy("account", "island_ms").agg(folded.alias("starts"))
            .select("account", F.explode("starts").alias("start_ms")))


def _starts_by_doubling(points: DataFrame, blocks: DataFrame, most_blocks: int) -> DataFrame:
    """Window starts of long islands by pointer doubling over the successor relation.

    The successor of a turn is the first turn at least five hours later. Each round doubles the number of known
    windows, so log2(blocks) rounds reach every window, because a five-hour cell holds at most one window start.
    """
    w = Window.partitionBy("account", "island_ms").orderBy("block")
    following = blocks.withColumn("_n1", F.lead(F.struct("block", "first_ms")).over(w)).withColumn(
        "_n2", F.lead("first_ms", 2).over(w))
    later = F.when(F.col("_n1.block") == F.col("block") + 1, F.col("_n2")).otherwise(F.col("_n1.first_ms"))
    following = following.select("account", "block", later.alias("later_ms"))

    turns = points.select("account", "block", "ts_ms", F.lit(None).cast("long").alias("src"))
    probes = points.select("account", (F.col("block") + 1).alias("block"), (F.col("ts_ms") + WINDOW_MS).alias("ts_ms"),
                           F.col("ts_ms").alias("src"))
    down = Window.partitionBy("account", "block").orderBy(F.desc("ts_ms")).rangeBetween(Window.unboundedPreceding, 0)
    hit = F.min(F.when(F.col("src").isNull(), F.col("ts_ms"))).over(down)
    edges = (turns.unionByName(probes).withColumn("nxt", hit).where(F.col("src").isNotNull())
             .select("account", (F.col("block") - 1).alias("block"), F.col("src").alias("ts_ms"), "nxt")
             .join(following, ["account", "block"])
             .select("account", "ts_ms", F.coalesce("nxt", "later_ms").alias("nxt"))
             .where(F.col("nxt").isNotNull()))
    edges = cut_lineage(edges)
    reached = points.select("account", F.col("island_ms").alias("ts_ms")).distinct()
    rounds = max(1, math.ceil(math.log2(most_blocks + 1)))
    for _ in range(rounds):
        step = reached.join(edges, ["account", "ts_ms"]).select("account", F.col("nxt").alias("ts_ms"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        hop = edges.select("account", F.col("ts_ms").alias("nxt"), F.col("nxt").alias("nxt2"))
        edges = cut_lineage(edges.join(hop, ["account", "nxt"]).select("account", "ts_ms", F.col("nxt2").alias("nxt")))
    return reached.select("account", F.col("ts_ms").alias("start_ms"))


def window_starts(turns: DataFrame, array_points: int = ARRAY_ISLAND_POINTS) -> DataFrame:
    """Starts of the anchored windows: (account, start_ms).

    The block table is small (elapsed time / five hours per account) and read several times, so it is written
    once. Its largest island decides whether the doubling path is needed.
    """
    calls = billable(turns).select("account", "ts_ms")
    w = Window.partitionBy("account", "island_ms")
    blocks = _blocks(calls).withColumn("island_blocks", F.count(F.lit(1)).over(w)).withColumn(
        "island_points", F.sum("n").over(w))
    blocks = materialize(blocks, "blocks")
    single = blocks.where(F.col("island_blocks") == 1).select("account", F.col("first_ms").alias("start_ms"))
    multi = blocks.where(F.col("island_blocks") > 1)
    is_long = F.col("island_points") > array_points
    longest = multi.where(is_long).agg(F.max("island_blocks")).first()[0]

    def points(of: DataFrame) -> DataFrame:
        return calls.withColumn("block", cell("ts_ms", WINDOW_MS)).join(
            of.select("account", "block", "island_ms"), ["account", "block"])

    if longest is None:
        return single.unionByName(_starts_by_fold(points(multi)))
    long_blocks = multi.where(is_long)
    return (single.unionByName(_starts_by_fold(points(multi.where(~is_long))))
            .unionByName(_starts_by_doubling(points(long_blocks).distinct(), long_blocks, longest)))


def _candidates(starts: DataFrame) -> DataFrame:
    """Per five-hour cell: the window start inside it and the one in the cell before."""
    block, none = cell("start_ms", WINDOW_MS), F.lit(None).cast("long")
    marks = F.array(F.struct(block.alias("block"), F.col("start_ms").alias("here_ms"), none.alias("before_ms")),
                    F.struct((block + 1).alias("block"), none.alias("here_ms"), F.col("start_ms").alias("before_ms")))
    return starts.select("account", F.explode(marks).alias("m")).groupBy("account", "m.block").agg(
        F.max("m.here_ms").alias("here_ms"), F.max("m.before_ms").alias("before_ms"))


def in_window(rows: DataFrame, starts: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Attach ``start_ms`` of the window that contains each row's timestamp (equi-join on the five-hour cell)."""
    joined = rows.withColumn("block", cell(ts, WINDOW_MS)).join(_candidates(starts), ["account", "block"], "left")
    start = (F.when(F.col(ts) >= F.col("here_ms"), F.col("here_ms"))
             .when(F.col(ts) < F.col("before_ms") + WINDOW_MS, F.col("before_ms")))
    return joined.withColumn("start_ms", start).drop("block", "here_ms", "before_ms")


def _priced_groups(rows: DataFrame, keys: list[str], with_sessions: bool) -> DataFrame:
    """Cost, turns, last turn and sessions per group: folded per session first, then per group."""
    per_session = (price_calls(rows).groupBy(*keys, "session_id")
                   .agg(F.sum("cost_nusd").alias("cost_nusd"), F.count(F.lit(1)).alias("turn_count"),
                        F.max("ts_ms").alias("end_ms")))
    aggregates = [F.max("end_ms").alias("end_ms"), F.sum("cost_nusd").alias("cost_nusd"),
                  F.sum("turn_count").alias("turn_count"), F.count(F.lit(1)).alias("sessions")]
    if with_sessions:
        aggregates.append(F.array_sort(F.collect_list("session_id")).alias("session_ids"))
    return per_session.groupBy(*keys).agg(*aggregates)


def windows_5h(turns: DataFrame, starts: DataFrame | None = None, with_sessions: bool = False) -> DataFrame:
    """Anchored five-hour windows: a window opens at the first turn at or after the end of the one before.

    ``with_sessions`` adds the sorted session ids as an array for serving; the default gives their number.
    """
    calls = billable(turns)
    starts = starts if starts is not None else window_starts(turns)
    return _priced_groups(in_window(calls, starts), ["account", "start_ms"], with_sessions)


def weekly_buckets(turns: DataFrame, anchor_weekday: int = 0, with_sessions: bool = False) -> DataFrame:
    day = utc_day("ts_ms")
    week = F.date_sub(day, F.pmod(F.weekday(day) - anchor_weekday, F.lit(7)))
    return _priced_groups(billable(turns).withColumn("week", week), ["account", "week"], with_sessions)


def fingerprints(prompts: DataFrame, tz: str = "UTC") -> DataFrame:
    """Pauses of about five hours between prompts that look like a reached limit.

    A pause of 4 h 45 min or more cannot lie inside a cell of that width, so pauses are found between the last
    prompt of one cell and the first of the next; earlier activity is looked up in two-hour cells.
    """
    dated = prompts.where(F.col("ts_ms").isNotNull())
    cells = (dated.groupBy("account", cell("ts_ms", FINGERPRINT_MIN_MS).alias("_cell"))
             .agg(F.min(F.struct("ts_ms", "ord", "session_id")).alias("first"), F.max("ts_ms").alias("last_ms")))
    w = Window.partitionBy("account").orderBy("_cell")
    pauses = cells.select("account", F.lag("last_ms").over(w).alias("gap_start_ms"),
                          F.col("first.ts_ms").alias("ts_ms"), F.col("first.session_id").alias("session_id"))
    gap = F.col("ts_ms") - F.col("gap_start_ms")
    pauses = pauses.where(gap.between(FINGERPRINT_MIN_MS, FINGERPRINT_MAX_MS))

    active = (dated.groupBy("account", cell("ts_ms", ACTIVE_PREFIX_MS).alias("_h"))
              .agg(F.min("ts_ms").alias("h_first"), F.max("ts_ms").alias("h_last")))
    home = cell("gap_start_ms", ACTIVE_PREFIX_MS)
    probes = pauses.withColumn("_h", F.explode(F.array(home, home - 1)))
    in_home = F.col("_h") == home
    seen = F.when(in_home, F.col("h_first") < F.col("gap_start_ms")).otherwise(
        F.col("h_last") >= F.col("gap_start_ms") - ACTIVE_PREFIX_MS)
    keys = ["account", "gap_start_ms", "ts_ms", "session_id"]
    kept = probes.join(active, ["account", "_h"]).where(seen).select(*keys).distinct()
    daytime = F.lit(True)
    for c in ("gap_start_ms", "ts_ms"):
        daytime = daytime & local_hour(c, tz).between(*DAY_HOURS)
    aligned = F.abs(gap - WINDOW_MS) <= FINGERPRINT_TOLERANCE_MS
    return kept.select(
        "account", "session_id", "ts_ms", "gap_start_ms", F.col("ts_ms").alias("gap_end_ms"),
        F.lit("heuristic").alias("type"), F.lit("5h_fingerprint").alias("subtype"),
        F.when(daytime & aligned, "high").otherwise("medium").alias("confidence"))


def explicit_events(api_errors: DataFrame) -> DataFrame:
    """Plan-limit banners among API-error entries (account, session_id, ord, ts_ms, text)."""
    from turnledger.functions.classify import plan_limit_text

    none = F.lit(None).cast("long")
    return api_errors.where(plan_limit_text(F.col("text"))).select(
        "account", "session_id", "ts_ms", none.alias("gap_start_ms"), none.alias("gap_end_ms"),
        F.lit("explicit").alias("type"), F.lit("user_plan_limit").alias("subtype"),
        F.lit("high").alias("confidence"), F.col("text").alias("message_text"))


def limit_events(api_errors: DataFrame, prompts: DataFrame, tz: str = "UTC") -> DataFrame:
    """Banners and fingerprints as one list; both kinds meet in the same clusters."""
    return explicit_events(api_errors).drop("message_text").unionByName(fingerprints(prompts, tz))


def transcript_events(classified_entries: DataFrame, account: Column, tz: str = "UTC") -> DataFrame:
    """Clustered limit events of transcripts: error entries with a plan-limit text, and pauses between prompts."""
    rows = classified_entries.withColumn("account", account)
    errors = rows.where(F.col("is_api_error") & (F.trim("body") != "")).select("account", "session_id", "ts_ms", F.col("body").alias("text"))
    prompts = rows.where(F.col("category") == "prompt").select("account", "session_id", "ord", "ts_ms")
    payload = ["session_id", "ts_ms", "gap_start_ms", "gap_end_ms", "type", "subtype", "confidence"]
    return cluster_events(limit_events(errors, prompts, tz), payload, ["type", "session_id"])


def cluster_events(events: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
    """Merge events at most 15 minutes after their cluster's last event; the earliest row stands for the cluster.

    Events of one 15-minute cell always belong together, so chains are formed over cells. Events without a
    timestamp stay unmerged.
    """
    row = F.struct(*payload)
    dated = events.where(F.col("ts_ms").isNotNull())
    cells = (dated.groupBy("account", cell("ts_ms", CLUSTER_MS).alias("_cell"))
             .agg(F.min_by(row, F.struct("ts_ms", *order)).alias("row"), F.min("ts_ms").alias("first_ms"),
                  F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("account").orderBy("_cell")
    pause = F.col("first_ms") - F.lag("last_ms").over(w)
    opens = F.when(pause.isNull() | (pause > CLUSTER_MS), F.col("first_ms"))
    cluster = F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = (cells.withColumn("_open", opens).withColumn("cluster_ms", cluster)
              .groupBy("account", "cluster_ms")
              .agg(F.min_by("row", "_cell").alias("row"), F.max("last_ms").alias("last_ms"),
                   F.sum("n").alias("merged_count")))
    undated = events.where(F.col("ts_ms").isNull()).select(
        "account", F.lit(None).cast("long").alias("cluster_ms"), row.alias("row"),
        F.lit(None).cast("long").alias("last_ms"), F.lit(None).cast("long").alias("merged_count"))
    return merged.unionByName(undated).select("account", "cluster_ms", "last_ms", "row.*", "merged_count")


def event_windows(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Window of each event: fingerprints by the start of their pause, banners by their own time."""
    at = F.when(F.col("subtype") == "5h_fingerprint", F.col("gap_start_ms")).otherwise(F.col("ts_ms"))
    return in_window(events.withColumn("at_ms", at).where(F.col("at_ms").isNotNull()), starts, "at_ms")


def tier_factor(tier: Column) -> Column:
    out = None
    for name, factor in TIER_FACTORS:
        out = F.when(tier == name, factor) if out is None else out.when(tier == name, factor)
    return out


def _round2(x: Column) -> Column:
    return F.rint(x * 100.0) / 100.0


def tier_caps(windows: DataFrame, override_pro: float | None = None) -> DataFrame:
    """Estimated cap per window and account.

    ``windows`` carries ``cost_nusd``, ``tier`` (active at its start) and ``hit`` (holds a limit event). The base is
    the override, else the median of limit-hit windows brought to the Pro tier, else the default; it is never below
    the dearest window that passed without a limit. Windows per account are bounded by elapsed time.
    """
    per_pro = F.when(F.col("cost_nusd") > 0, F.col("cost_nusd") / 1e9 / tier_factor(F.col("tier")))
    stats = windows.groupBy("account").agg(
        F.percentile(F.when(F.col("hit"), per_pro), F.lit(0.5)).alias("_median"),
        F.count(F.when(F.col("hit"), per_pro)).alias("_anchors"),
        F.coalesce(F.max(F.when(~F.col("hit"), per_pro)), F.lit(0.0)).alias("floor"))
    if override_pro is not None and override_pro > 0:
        base, source, anchors = F.lit(float(override_pro)), F.lit("config_override"), F.lit(0).cast("long")
        floored = F.lit(False)
    else:
        base = F.coalesce("_median", F.lit(PRO_CAPACITY_USD_DEFAULT))
        source = F.when(F.col("_anchors") > 0, "empirical").otherwise("default")
        anchors = F.col("_anchors")
        floored = F.col("floor") > base
        base = F.greatest(base, F.col("floor"))
    caps = stats.select("account", base.alias("base"), source.alias("cap_source"), anchors.alias("anchor_windows"),
                        "floor", floored.alias("floor_applied"))
    return caps.select("account", *[_round2(F.col("base") * f).alias(_cap(t)) for t, f in TIER_FACTORS],
                       _round2(F.col("base")).alias("base_pro_usd"), "anchor_windows", "cap_source",
                       _round2(F.col("floor")).alias("floor_pro_usd"), "floor_applied")


def _cap(tier: str) -> str:
    return "cap_" + tier.lower().replace(" ", "_")


def tier_hits(windows: DataFrame, caps: DataFrame, keys: list[str]) -> DataFrame:
    """Windows per group (``keys`` include account) and how many of them each tier's cap would have stopped."""
    joined = windows.join(caps, "account")
    hits = []
    for tier, factor in TIER_FACTORS:
        cap = F.col(_cap(tier))
        anchored = F.col("hit") & F.coalesce(F.lit(factor) <= tier_factor(F.col("tier")), F.lit(False))
        over = (cap > 0) & (F.col("cost_nusd") / 1e9 > cap)
        hits.append(F.count_if(anchored | over).alias("hits_" + _cap(tier)[4:]))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), *hits)


def weekly_hits(weeks: DataFrame, caps: DataFrame, keys: list[str]) -> DataFrame:
    joined = weeks.join(caps, "account")
    hits = []
    for tier, _ in TIER_FACTORS:
        cap = _round2(F.col(_cap(tier)) * WEEKLY_VS_WINDOW_RATIO)
        hits.append(F.count_if((cap > 0) & (F.col("cost_nusd") / 1e9 > cap)).alias("weekly_" + _cap(tier)[4:]))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("weeks"), *hits)

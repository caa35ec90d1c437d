"""Mixing sources to target weights by proportionate-fair scheduling of blocks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import number_bucket, number_rows

OTHER = "other"
BLOCK_ROWS = 64
MOST_WEIGHT = 10_000  # of all classes together: the length of a schedule that the driver computes


def release(block: int, weight: int, period: int) -> int:
    """First slot in which a class may get its block: earlier it would be a block or more ahead of its share."""
    return block * period // weight


def deadline(block: int, weight: int, period: int) -> int:
    """Slot before which a class must get its block: later it would be a block or more behind its share."""
    return -(-(block + 1) * period // weight)


def one_period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of every class in one period (as many slots as all weights): of the released blocks, the one with the
    earliest deadline goes first, of equal deadlines the class that sorts first. The schedule repeats itself."""
    period = sum(weights.values())
    slots: dict[str, list[int]] = {name: [] for name in weights}
    for t in range(period):
        waiting = [(deadline(len(slots[c]), w, period), c) for c, w in weights.items()
                   if len(slots[c]) < w and release(len(slots[c]), w, period) <= t]
        due, name = min(waiting)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        slots[name].append(t)
    return slots


@dataclass(frozen=True)
class Stretch:
    """What one class gets while the same classes have blocks left."""

    mix_class: str
    first_block: int
    end_block: int
    first_slot: int
    weight: int
    period: int
    offsets: list[int]


def schedule(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[Stretch]:
    """Stretches for all blocks. When a class runs out, the others go on at once with the shares they have among
    themselves. The work grows with classes and weights, not with blocks."""
    left = {c: n for c, n in blocks.items() if n > 0}
    done, start, found = dict.fromkeys(left, 0), 0, []
    while left:
        active = {c: weights[c] for c in sorted(left)}
        period, slots = sum(active.values()), one_period(active)

        def slot_of(c: str, block: int) -> int:
            turns, rest = divmod(block, active[c])
            return turns * period + slots[c][rest]

        end = 1 + min(slot_of(c, n - 1) for c, n in left.items())
        for c in active:
            turns, rest = divmod(end, period)
            got = turns * active[c] + sum(s < rest for s in slots[c])
            found.append(Stretch(c, done[c], done[c] + got, start, active[c], period, slots[c]))
            done[c] += got
            left[c] -= got
        left = {c: n for c, n in left.items() if n > 0}
        start += end
    return found


def with_classes(docs: DataFrame, weights: Mapping[str, int], source_col: str, out: str) -> DataFrame:
    known = F.col(source_col).isin(*[c for c in weights if c != OTHER])
    return docs.withColumn(out, F.when(known, F.col(source_col)).otherwise(OTHER))


def mix(docs: DataFrame, weights: Mapping[str, int], id_col: str = "doc_id", source_col: str = "source",
        block_rows: int = BLOCK_ROWS, prefix: str = "") -> DataFrame:
    """``docs`` with the place of every row in the mix; ``(slot, place)`` is its order.

    ``weights`` are whole numbers; sources that it does not name, and rows without a source, share the class
    ``other``. Rows of a class are numbered in hash order and cut into blocks of ``block_rows``. Block k of a class
    with weight w of W is released in slot floor(k W / w) and due before slot ceil((k + 1) W / w); the earliest
    deadline among the released goes first. So at every slot, each class is within one block of its share of the
    slots since the set of classes with rows left last changed. No row is dropped or repeated.

    Counts per class reach the driver, as many as there are weights. The schedule of one period is computed there
    and repeated by arithmetic, so rows find their slot in a broadcast table whose size the weights bound.

    Rows that repeat a key get places of their own; an empty table gives an empty result. New columns: ``mix_class``,
    ``row_in_class``, ``block``, ``release``, ``due``, ``slot``, ``place``, each with ``prefix``.
    """
    if not weights or min(weights.values()) < 1 or sum(weights.values()) > MOST_WEIGHT:
        raise ValueError(f"weights must be positive whole numbers, at most {MOST_WEIGHT} together")
    weights = {OTHER: 1, **weights}
    name, bucket, number = prefix + "mix_class", prefix + "_bucket", prefix + "row_in_class"
    rows = with_classes(docs, weights, source_col, name).withColumn(bucket, number_bucket(F.col(id_col)))
    counts = {r[0]: -(-r[1] // block_rows) for r in rows.groupBy(name).count().collect()}
    stretches = [(s.mix_class, s.first_block, s.end_block, s.first_slot, s.weight, s.period, s.offsets) for s in schedule(counts, weights)]
    table = docs.sparkSession.createDataFrame(
        stretches, "_class string, _first long, _end long, _start long, _weight long, _period long, _offsets array<int>")
    numbered = number_rows(rows, name, bucket, [id_col], number).drop(bucket)
    block = F.floor(F.col(number) / block_rows)
    joined = numbered.join(F.broadcast(table), (F.col(name) == F.col("_class")) & (block >= F.col("_first")) & (block < F.col("_end")))
    k = block - F.col("_first")
    turns, rest = F.floor(k / F.col("_weight")), (k % F.col("_weight")).cast("int")
    new = {
        "block": block,
        "release": F.col("_start") + F.floor(k * F.col("_period") / F.col("_weight")),
        "due": F.col("_start") + F.ceil((k + 1) * F.col("_period") / F.col("_weight")),
        "slot": F.col("_start") + turns * F.col("_period") + F.get("_offsets", rest),
        "place": F.col(number) % block_rows}
    return joined.select("*", *[c.cast("long").alias(prefix + n) for n, c in new.items()]).drop(
        "_class", "_first", "_end", "_start", "_weight", "_period", "_offsets")

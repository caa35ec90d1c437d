"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from turnledger.llm.common import number_rows
from turnledger.llm.components import components
from turnledger.session import materialize

DIMENSIONS = 8
BLOCK = 256
FAN = 8
FIT_ROWS = 4096
_SLACK = 1e-9


def _valid(vectors: DataFrame, id_col: str, vector_col: str, group_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).cast("string").alias("label"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                      & finite & F.exists("v", lambda x: x != 0))


def principal_axes(rows: DataFrame, dimensions: int, fit_rows: int) -> np.ndarray:
    """Leading principal directions of at most ``fit_rows`` unit vectors, taken in hash order.

    The sample only decides how well blocks are told apart: a projection on any orthonormal directions never makes
    two vectors more distant, so it cannot lose a pair.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").toArrow().column(0).to_pylist()
    width = max(map(len, sample), default=1)
    unit = np.array([np.pad(np.array(v) / np.linalg.norm(v), (0, width - len(v))) for v in sample]).reshape(-1, width)
    if not len(unit):
        return np.zeros((dimensions, 1))
    axes = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)[2][:dimensions]
    return np.pad(axes, ((0, dimensions - len(axes)), (0, 0)))


def _projected(axes: np.ndarray, cell: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, places, raw = [], [], []
            for v in batch.column(2).to_pylist():
                v = np.array(v)
                k = min(len(v), axes.shape[1])
                place = axes[:, :k] @ (v[:k] / np.linalg.norm(v))
                places.append(place.tobytes())
                cells.append(np.floor(place / cell).astype(np.int32))
                raw.append(v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tolist() for c in cells], pa.list_(pa.int32())),
                 pa.array(places, pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "key", "cell", "place", "raw"])
    return run


def _blocks(block: int):
    """Cut the sorted rows of a partition into runs of one key, with the box that holds each run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key, ids, places, raw = TaskContext.get().partitionId(), 0, None, [], [], []

        def flush():
            box = np.frombuffer(b"".join(places)).reshape(len(ids), -1)
            return pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([box.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([box.max(axis=0).tolist()], pa.list_(pa.float64())),
                 pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(raw)], pa.binary())],
                names=["key", "part", "number", "lo", "hi", "ids", "raw"])

        for batch in batches:
            for vec_id, k, place, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ids and (k != key or len(ids) == block):
                    yield flush()
                    number, ids, places, raw = number + 1, [], [], []
                key = k
                ids.append(vec_id)
                places.append(place)
                raw.append(v)
        if ids:
            yield flush()
    return run


def _gap(dimensions: int) -> Column:
    """Squared distance between the boxes of two intervals."""
    total = F.lit(0.0)
    for i in range(dimensions):
        apart = F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"))
        total = total + apart * apart
    return total


def _level(boxes: DataFrame, step: int, dimensions: int) -> DataFrame:
    """Intervals of ``step`` consecutive blocks with their boxes."""
    bounds = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(dimensions)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(dimensions)]
    return boxes.groupBy("key", F.floor(F.col("seq") / step).alias("at")).agg(*bounds)


def _close_intervals(boxes: DataFrame, dimensions: int, limit: float, fan: int) -> DataFrame:
    """Pairs of blocks whose boxes are within reach: join long intervals, then the parts of those that remain."""
    most = boxes.agg(F.max("seq")).first()[0] or 0
    depth = 0
    while fan ** depth <= most:
        depth += 1
    pairs = None
    for level in range(depth, -1, -1):
        here = _level(boxes, fan ** level, dimensions)
        left = here.select("key", F.col("at").alias("a"), *[F.col(c).alias(f"a_{c}") for c in here.columns[2:]])
        right = here.select("key", F.col("at").alias("b"), *[F.col(c).alias(f"b_{c}") for c in here.columns[2:]])
        if pairs is None:  # the whole sequence is one interval
            joined = left.join(right, "key")
        else:
            up = pairs.select("key", F.col("a").alias("pa"), F.col("b").alias("pb"))
            joined = (up.join(left.withColumn("pa", F.floor(F.col("a") / fan)), ["key", "pa"])
                      .join(right.withColumn("pb", F.floor(F.col("b") / fan)), ["key", "pb"]).where("a <= b"))
        pairs = materialize(joined.where(_gap(dimensions) <= limit).select("key", "a", "b"), "ego-pairs")
    return pairs


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect whatever ``close`` connects, fewer than rows plus columns."""
    rows_left, cols_left, chosen = np.ones(close.shape[0], bool), np.ones(close.shape[1], bool), []
    for start in np.flatnonzero(close.any(axis=1)):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        todo = [(True, start)]
        while todo:
            is_row, i = todo.pop()
            if is_row:
                new = np.flatnonzero(close[i] & cols_left)
                cols_left[new] = False
                chosen += [(i, j) for j in new]
            else:
                new = np.flatnonzero(close[:, i] & rows_left)
                rows_left[new] = False
                chosen += [(j, i) for j in new]
            todo += [(not is_row, j) for j in new]
    return chosen


def _joined(threshold: float):
    def run(same: bool, ids_a: bytes, raw_a: bytes, ids_b: bytes, raw_b: bytes) -> dict:
        ia, ib = np.frombuffer(ids_a, np.int64), np.frombuffer(ids_b, np.int64)
        xa, xb = np.frombuffer(raw_a).reshape(len(ia), -1), np.frombuffer(raw_b).reshape(len(ib), -1)
        cosine = (xa @ xb.T) / np.outer(np.sqrt((xa * xa).sum(axis=1)), np.sqrt((xb * xb).sum(axis=1)))
        close = (cosine >= threshold) & (ia[:, None] != ib[None, :])
        counts = [(int(v), int(n)) for v, n in zip(ia, close.sum(axis=1)) if n]
        if not same:
            counts += [(int(v), int(n)) for v, n in zip(ib, close.sum(axis=0)) if n]
        return {"counts": counts, "links": [(int(ia[i]), int(ib[j])) for i, j in _forest(close)]}
    return F.udf(run, "struct<counts: array<struct<vec_id: long, n: long>>, links: array<struct<u: long, v: long>>>", useArrow=False)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                         group_col: str = "label", dimensions: int = DIMENSIONS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per vector: how many others of its label have a cosine of at least ``threshold``, and its component.

    1. Unit vectors are projected on their leading principal directions and sorted by label and grid cell (the
       epsilon grid order), then cut into blocks of consecutive rows.
    2. Intervals of blocks are joined recursively: two intervals whose boxes are farther apart than any linked pair
       can be are skipped, the others are split into their parts, down to blocks.
    3. Pairs of blocks are compared by matrix products on the whole vectors. Each pair of blocks returns link counts
       and a spanning forest, not the links, so a group of copies costs rows in proportion to its size.
    4. Forests are joined to components.

    A vector that is null, zero, or holds a null or a value that is not finite, or whose label or key is null, is
    linked with nothing and is its own component. Vectors of different lengths do not link. Rows that repeat a key
    are not linked with each other; their links are added up under the key, which gets one row. An empty table gives
    an empty result; other columns are left out.
    """
    rows = _valid(vectors, id_col, vector_col, group_col).select(
        "vec_id", F.concat_ws(":", F.size("v").cast("string"), "label").alias("key"), "v")
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    axes = principal_axes(rows, dimensions, FIT_ROWS)
    cells = rows.mapInArrow(_projected(axes, epsilon or 1e-6), "vec_id long, key string, cell array<int>, place binary, raw binary")
    order = ["key", *[F.col("cell")[i] for i in range(dimensions)], "vec_id"]
    ordered = cells.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "key", "place", "raw")
    blocks = materialize(ordered.mapInArrow(
        _blocks(block), "key string, part int, number int, lo array<double>, hi array<double>, ids binary, raw binary"), "ego-blocks")
    bounds = [F.col(side)[i].alias(f"{side}{i}") for side in ("lo", "hi") for i in range(dimensions)]
    placed = number_rows(blocks.select("key", "part", "number"), "key", "part", ["number"], "seq")
    placed = materialize(placed.select("key", "part", "number", F.col("seq").cast("long").alias("seq")), "ego-order")
    placed = blocks.join(placed, ["key", "part", "number"])
    boxes = materialize(placed.select("key", "seq", *bounds), "ego-boxes")
    pairs = _close_intervals(boxes, dimensions, epsilon * epsilon + _SLACK, fan)
    content = placed.select("key", "seq", "ids", "raw")
    left = content.select("key", F.col("seq").alias("a"), F.col("ids").alias("ids_a"), F.col("raw").alias("raw_a"))
    right = content.select("key", F.col("seq").alias("b"), F.col("ids").alias("ids_b"), F.col("raw").alias("raw_b"))
    both = pairs.join(left, ["key", "a"]).join(right, ["key", "b"])
    found = materialize(both.select(_joined(threshold)(F.col("a") == F.col("b"), "ids_a", "raw_a", "ids_b", "raw_b").alias("r"))
                        .select("r.*"), "ego-found")
    counts = (found.select(F.explode("counts").alias("c")).groupBy(F.col("c.vec_id").alias("vec_id"))
              .agg(F.sum("c.n").alias("n_links")))
    placed = components(found.select(F.explode("links").alias("l")).select("l.u", "l.v"), "u", "v", "ego-components")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    component = F.coalesce("component", "vec_id")
    return (every.join(counts, "vec_id", "left").join(placed.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")))

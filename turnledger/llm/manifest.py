"""Merkle manifest of a table: levels built bottom-up as parent-linked node rows, proofs by a recursive query."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import number_in_order
from turnledger.session import materialize

FAN = 3
BLOCK = 6561  # leaves that ask one copy of a node
UPPER = 64  # level numbers of the tree over the sources start here; a source of 3^63 leaves stays below
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def digest(text: Column) -> Column:
    """H as 32 bytes; ``as_hex`` is its text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _field(value: Column) -> Column:
    written = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[_field(columns[name]) for name in FIELDS]))


def _grow(nodes: DataFrame, biggest: int, base: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Climb from the lowest nodes of many trees to their roots; ``(links, roots)``.

    ``nodes``: tree, size (nodes of the tree on this level), i (place among them), level, first and span (its leaves),
    hash. Every level is written; of ``biggest`` lowest nodes, log3(biggest) levels arise.
    """
    links, roots, height = [], [], 0
    while True:
        roots.append(nodes.where("size = 1"))
        if biggest <= 1:
            break
        height, biggest = height + 1, -(-biggest // FAN)
        runs = nodes.where("size > 1").groupBy("tree", "size", F.floor(F.col("i") / FAN).alias("i")).agg(
            F.array_sort(F.collect_list(F.struct("first", "level", "span", "hash"))).alias("kids"))
        runs = materialize(runs.withColumn("hash", digest(F.array_join(F.transform("kids", lambda k: as_hex(k["hash"])), ""))),
                           f"{name}-{height}")
        level = F.lit(base + height)

        def others(keep) -> Column:
            return F.aggregate(F.filter("kids", keep), F.lit(b"").cast("binary"), lambda done, k: F.concat(done, k["hash"]))

        first = F.col("kids")[0]["first"]
        links.append(runs.select(F.explode(F.transform("kids", lambda kid: F.struct(
            kid["level"].alias("level"), kid["first"].alias("first"), kid["span"].alias("span"), level.alias("parent_level"),
            first.alias("parent_first"), others(lambda k: k["first"] < kid["first"]).alias("before"),
            others(lambda k: k["first"] > kid["first"]).alias("after")))).alias("node")).select("node.*"))
        nodes = runs.select("tree", F.ceil(F.col("size") / FAN).alias("size"), "i", level.alias("level"), first.alias("first"),
                            F.aggregate("kids", F.lit(0).cast("long"), lambda n, k: n + k["span"]).alias("span"), "hash")
    return links, reduce(DataFrame.unionByName, roots)


def _per_block(df: DataFrame) -> DataFrame:
    """A copy of a node for each block of leaves below it: a block asks its own, so the root is no hot key."""
    last = F.floor((F.col("first") + F.col("span") - 1) / BLOCK)
    return df.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), last)))


FOLD = "unhex(sha2(CAST(concat(lower(hex({n}before)), lower(hex({c}folded)), lower(hex({n}after))) AS BINARY), 256))"
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT place, coalesce(parent_level, 0) AS level, parent_first AS first, if(parent_level IS NULL, folded, {fold_leaf}) AS folded,
         coalesce(concat(before, after), CAST('' AS BINARY)) AS siblings, doc_id, leaf, start
  FROM {leaves}
  UNION ALL
  SELECT c.place, n.parent_level, n.parent_first, {fold_node}, concat(n.before, n.after), CAST(NULL AS {key}), CAST(NULL AS BINARY), CAST(NULL AS BIGINT)
  FROM climb c JOIN {nodes} n ON n.block = c.place DIV {block} AND n.level = c.level AND n.first = c.first)
SELECT place DIV {block} AS block, max(doc_id) AS doc_id, max(leaf) AS leaf, max(start) AS start, max_by(folded, level) AS folded,
       sha2(CAST(lower(hex(aggregate(array_sort(collect_list(struct(level, siblings))), CAST('' AS BINARY), (a, s) -> concat(a, s.siblings)))) AS BINARY), 256) AS proof
FROM climb GROUP BY place
"""


def climb(leaves: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``(block, doc_id, leaf, start, folded, proof)``: every leaf ascends by the links of the node rows in one recursive query.

    ``leaves`` bring their own link; ``nodes`` hold the links above. Each step appends the siblings of one level as a
    row and folds the leaf's hash with them; at the end the few rows of a leaf are put together. Spark stops recursive
    queries at a million rows unless told otherwise; that setting is lifted while the result is written.
    """
    spark, views = leaves.sparkSession, {"leaves": f"leaves_{uuid.uuid4().hex}", "nodes": f"nodes_{uuid.uuid4().hex}"}
    limit, key = spark.conf.get(ROW_LIMIT, None), leaves.schema["doc_id"].dataType.simpleString()
    leaves.createOrReplaceTempView(views["leaves"])
    nodes.createOrReplaceTempView(views["nodes"])
    try:
        spark.conf.set(ROW_LIMIT, "-1")
        return materialize(spark.sql(CLIMB.format(**views, key=key, block=BLOCK, fold_leaf=FOLD.format(n="", c=""),
                                                  fold_node=FOLD.format(n="n.", c="c."))), name)
    finally:
        spark.conf.unset(ROW_LIMIT) if limit is None else spark.conf.set(ROW_LIMIT, limit)
        for view in views.values():
            spark.catalog.dropTempView(view)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """One row per document: its leaf, the roots above it, its proof, and the root that the tampered row folds to.

    A leaf is the digest of doc_id, source, lang, n_chars and text; ``tampered`` gives the text that is checked. The
    leaves of a source in the order of doc_id are joined by threes, level by level, to a subroot, and the subroots in
    the order of the sources to the root. Nodes are kept as rows with a link to their parent and the hashes of their
    siblings; the proof of a leaf is gathered by ascending those links.

    Nulls are written as ``-`` and sort first. Rows that repeat a doc_id are leaves of their own, ordered by their
    hash. Empty and long texts are whole leaves. An empty table gives an empty result; other columns are left out.
    """
    plain = {name: F.col(name) for name in FIELDS}
    rows = docs.select(F.col("doc_id"), F.col("source"), leaf_of(plain).alias("leaf"), leaf_of({**plain, "text": tampered}).alias("folded"))
    rows = materialize(rows, "manifest-hashed")  # sorting by range reads its input twice
    placed = number_in_order(rows, ["source", "doc_id", "leaf"], "place", "manifest-rows")
    # The first place of a source: joined through (range, source), so that a hot source is spread over its ranges.
    shares = placed.groupBy("_part", "source").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("size"))
    shares = materialize(shares, "manifest-shares")
    sources = materialize(shares.groupBy(F.col("source").alias("_source")).agg(
        F.min("place").alias("start"), F.sum("size").alias("size")), "manifest-sources")
    starts = shares.select(F.col("_part").alias("_at"), F.col("source").alias("_name")).join(
        sources, F.col("_name").eqNullSafe(F.col("_source"))).drop("_name")
    leaves = placed.join(starts, (F.col("_part") == F.col("_at")) & F.col("source").eqNullSafe(F.col("_source")))
    leaves = materialize(leaves.select("place", "start", "size", "doc_id", "leaf", "folded"), "manifest-leaves")
    biggest, count = sources.agg(F.max("size"), F.count(F.lit(1))).first()

    lowest = leaves.select(F.col("start").alias("tree"), "size", (F.col("place") - F.col("start")).alias("i"), F.lit(0).alias("level"),
                           F.col("place").alias("first"), F.lit(1).cast("long").alias("span"), F.col("leaf").alias("hash"))
    links, subroots = _grow(lowest, biggest or 0, 0, "manifest-level")
    subroots = materialize(subroots, "manifest-subroots")
    ordered = number_in_order(subroots.drop("i", "size"), ["first"], "i", "manifest-ordered")
    upper = ordered.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), "i", "level", "first", "span", "hash")
    upper_links, roots = _grow(upper, count, UPPER, "manifest-upper")
    found = roots.first()
    root = F.lit(as_text(found["hash"]) if found else None).cast("string")

    none = docs.sparkSession.createDataFrame([], "level int, first long, span long, parent_level int, parent_first long, before binary, after binary")
    links = reduce(DataFrame.unionByName, links + upper_links, none)
    # Two thirds of all nodes are leaves: they take their link along, and only the others are searched at every step.
    own = links.where("level = 0").select(F.col("first").alias("place"), "parent_level", "parent_first", "before", "after")
    nodes = materialize(_per_block(links.where("level > 0")), "manifest-nodes")
    climbed = climb(leaves.select("place", "start", "doc_id", "leaf", "folded").join(own, "place", "left"), nodes, "manifest-climb")
    tops = _per_block(subroots.select("first", "span", F.col("hash").alias("subroot"))).drop("span").withColumnRenamed("first", "start")
    folded = as_hex(F.col("folded"))
    return climbed.join(tops, ["block", "start"]).select(
        "doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.col("proof").alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))


def as_text(value: bytes) -> str:
    return bytes(value).hex()


def without_line_ends(doc_id: Column, text: Column) -> Column:
    """The tampering of the registered query: documents whose key has an even checksum lose their line ends."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)

"""From raw documents to token ids: quality, exact copies, near copies, mix of the sources, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import quality
from turnledger.llm.bpe import decode, encode
from turnledger.llm.common import free_name, number_in_order, read
from turnledger.llm.exact_dedup import exact_duplicates
from turnledger.llm.language_id import held_out
from turnledger.llm.mixing import mix
from turnledger.llm.near_dedup import near_duplicates
from turnledger.session import materialize

QUALITY_THRESHOLD = 0.3
TARGETS = {f"src{k}": 2 + k % 4 for k in range(20)}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labels outside the held-out fifth.

    Null and empty texts are judged like any other; repeated rows and null keys are judged one by one. An empty table
    stays empty. Columns of any name pass through.
    """
    labels, score = read(spark, sf_dir, "labels"), free_name(docs, "_score")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    return quality.score(docs, model, out=score).where(F.col(score) >= QUALITY_THRESHOLD).select(*docs.columns)


def file_numbers(docs: DataFrame) -> DataFrame:
    """``(_file, _number)``: the Parquet files of ``docs`` in the order in which Spark's writer numbered them (part,
    then file of the part), files of other names by path. Numbered in Spark; no list of files reaches the driver."""
    path = F.col("_metadata.file_path")

    def number(pattern: str):
        return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("_file", pattern, 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0))

    files = docs.select(path.alias("_file")).distinct()
    files = files.withColumn("_part_of", number(r"part-([0-9]{1,10})[^/]*$")).withColumn("_file_of", number(r"-c([0-9]{1,10})[^/]*$"))
    return number_in_order(files, ["_part_of", "_file_of", "_file"], "_number", "pipeline-files").select("_file", "_number")


def with_row_ids(spark: SparkSession, docs: DataFrame, out: str) -> DataFrame:
    """``docs`` (read from Parquet files) and a number that no two rows share and that follows their order: the number
    of the file, the row in it."""
    numbers = file_numbers(docs)
    file, index = free_name(docs, "_file_path"), free_name(docs, "_row_index")
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
    number, path = free_name(placed, "_file_number"), free_name(placed, "_file_name")
    numbers = numbers.select(F.col("_file").alias(path), F.col("_number").alias(number))
    return placed.join(numbers, F.col(file) == F.col(path)).select(*docs.columns, (F.shiftleft(number, 40) + F.col(index)).alias(out))


def keep_first(docs: DataFrame, rows: DataFrame, row: str, groups: DataFrame, *order) -> DataFrame:
    """The first row of every group in the order of ``order``, key (null last) and place, with the columns of ``docs``.
    ``groups``: ``_row``, ``_group``."""
    ranked = F.struct(*order, F.col("doc_id").isNull().alias("keyless"), F.col("doc_id").alias("key"), F.col(row).alias("_row"))
    first = rows.select(F.col(row).alias("_row"), ranked.alias("_rank")).join(groups, "_row").groupBy("_group").agg(F.min("_rank").alias("_rank"))
    kept = free_name(rows, "_kept")
    return rows.join(first.select(F.col("_rank._row").alias(kept)), F.col(row) == F.col(kept), "left_semi").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the longest, then the smallest key. Rows are told apart by place,
    so repeated rows and null keys are grouped like all others.

    Null and empty texts form one group. An empty table stays empty. Columns of any name pass through.
    """
    row = free_name(docs, "_row")
    rows = with_row_ids(spark, docs, row)
    groups = exact_duplicates(rows, row).select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    return keep_first(docs, rows, row, groups, (-F.length(F.coalesce("text", F.lit("")))).alias("shortness"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: the smallest key. Rows are told apart by place, so repeated rows
    and null keys are grouped like all others.

    Texts without words are near nothing and stay. An empty table stays empty. Columns of any name pass through.
    """
    row = free_name(docs, "_row")
    rows = with_row_ids(spark, docs, row)
    return keep_first(docs, rows, row, near_duplicates(rows, row).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files in the order of their numbers, rows in the order of the files.

    A null source is mixed as ``other``. Repeated rows and null keys keep a place each. An empty table stays empty.
    Columns of any name pass through.
    """
    prefix = free_name(docs, "_mix_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    placed = mix(docs, TARGETS, prefix=prefix)
    order = [f"{prefix}slot", f"{prefix}place"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and its ``position``, a number that grows in the order of the mix.

    ``docs`` is read from Parquet files: the numbers in a file's name and the row in the file carry that order. Null
    and empty texts have no ids. Repeated rows and null keys keep a row each. An empty table gives an empty result;
    other columns are left out.
    """
    row = free_name(docs, "_row")
    rows = with_row_ids(spark, docs, row)
    coded = decode(encode(rows, carry=F.col(row)))
    return coded.select("doc_id", F.col("carried").alias("position"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mix", mix_sources), ("tokens", to_tokens)]

# Neither the trained classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

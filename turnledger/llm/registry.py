"""Queries of the training-data operators over the driver tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from turnledger.llm import language_id, pii, quality
from turnledger.llm.bpe import decode, encode
from turnledger.llm.common import read
from turnledger.llm.embedding_dedup import embedding_duplicates
from turnledger.llm.exact_dedup import exact_duplicates
from turnledger.llm.licenses import scan_licenses
from turnledger.llm.manifest import manifest, without_line_ends
from turnledger.llm.mixing import mix
from turnledger.llm.near_dedup import near_duplicates
from turnledger.llm.registry_sql import SQL as SQL
from turnledger.llm.sharding import shard
from turnledger.llm.substring_dedup import repeated_bytes
from turnledger.llm.whitening import whiten


def op1_pii(spark, sf_dir):
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.array_join("base", ",")
    return found.select("doc_id", *[f"n_{kind}" for kind in pii.KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.concat("base", "terms"), ",").alias("spans"))


def op2_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, corpus_pipeline.TARGETS)


def op3_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    net = language_id.fit(docs.where(~out))
    return language_id.predict(docs, net).withColumn("held_out", out)


def op5_bpe(spark, sf_dir):
    coded = decode(encode(read(spark, sf_dir, "documents")))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~out))
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark, sf_dir):
    return embedding_duplicates(read(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    found = scan_licenses(read(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda p: p["at"])
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op11_merkle_manifest(spark, sf_dir):
    return manifest(read(spark, sf_dir, "documents"), without_line_ends(F.col("doc_id"), F.col("text")))


def op12_suffix_array_dedup(spark, sf_dir):
    found = repeated_bytes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_embedding_whitening(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_mixing, op3_sharding, op4_language_id, op5_bpe, op6_quality_classifier, op7_minhash_near_dedup,
    op8_embedding_near_dedup, op9_exact_dedup, op10_license_scan, op11_merkle_manifest, op12_suffix_array_dedup, op13_embedding_whitening, pipeline)}

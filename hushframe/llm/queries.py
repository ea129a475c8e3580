"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import (
    decontamination,
    divergence,
    fillmiddle,
    licenses,
    packing,
    quality_rules,
    quality_sites,
    sharding,
    simhash,
    substrings,
    tokencounts,
    toxicity,
    warc,
)
from hushframe.llm.tables import read, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(kept, " "), 256).alias("kept_sha256")
    )


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign(
        rows, "doc_id", sharding.tree(sharding.SHARDS), sharding.tree(sharding.SHARDS + 1),
        order=["size", "text_crc32"],
    )
    return placed.withColumn("law", F.lit("key"))


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",").cast("binary")
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated"
    )


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    for name in ("base_labels", "labels"):
        found = found.withColumn(name, F.array_join(name, ","))
    return found


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), "refers_to",
    )


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_rules.train(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


@query
def op7_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_sites.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.transform(read(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fillmiddle.restored(), 256).alias("restored_sha256"),
    )


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

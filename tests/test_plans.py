"""What the physical plans must and must not hold."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from catalog import views as v
from hushframe.operators import audit, calls, entities, merge, redact
from hushframe.sources.tables import read_table, spread


@pytest.fixture
def docs(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/documents.parquet")


def no_shuffle_no_python(plan):
    return not any(w in plan for w in ("Exchange Round", "Exchange hash", "Python", "Arrow", "SortMerge"))


@pytest.mark.parametrize(
    "build",
    [
        lambda d: redact.redact_text(d, "text"),
        lambda d: redact.redact_table(v.as_leaf_documents(d)),
        lambda d: redact.redact_json(d, "text"),
        lambda d: entities.redact_deep(d, ["text"], detector=v.RULES),
        lambda d: calls.redact_calls(v.as_calls(d), detector=v.RULES),
        lambda d: audit.audit_log(calls.redact_calls(v.as_calls(d))),
        lambda d: entities.detect_entities(entities.chunk_rows(d, "doc_id", ["text"]), v.RULES, "doc_id"),
    ],
)
def test_in_row_operators_neither_shuffle_nor_leave_the_jvm(docs, build):
    plan = plan_of(build(docs))
    assert no_shuffle_no_python(plan)
    assert plan.count("FileScan") == 1


def test_only_needed_columns_are_read(docs):
    done = redact.redact_text(docs, "text").select("doc_id", "text")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(done)


def test_totals_alone_do_not_keep_other_columns(docs):
    done = redact.redact_text(docs, "text").select("redaction_count")
    assert "ReadSchema: struct<text:string>" in plan_of(done)


def test_filters_on_other_columns_reach_the_scan(docs):
    done = redact.redact_text(docs, "text").where(F.col("lang") == "fr")
    assert "EqualTo(lang,fr)" in plan_of(done)
    done = calls.redact_calls(v.as_calls(docs).where(F.col("tool_name") == "src1"))
    assert "EqualTo(source,src1)" in plan_of(done)


def test_each_mask_appears_once(docs):
    plan = plan_of(redact.redact_text(docs, "text"))
    assert plan.count("regexp_count") + plan.count("regexp_extract_all") == 5
    plan = plan_of(audit.audit_log(calls.redact_calls(v.as_calls(docs))))
    # Blocks, parameters and failure message: three texts, five patterns each.
    assert plan.count("regexp_extract_all") == 15


def test_filters_on_totals_do_not_copy_the_redaction(docs):
    for done in (
        redact.redact_text(docs, "text"),
        entities.redact_deep(docs, ["text"], detector=v.RULES),
        calls.redact_calls(v.as_calls(docs), detector=v.RULES),
    ):
        once = plan_of(done).count("regexp_extract_all")
        assert plan_of(done.where("redaction_count > 0")).count("regexp_extract_all") == once


def test_entity_table_costs_one_shuffle_of_the_texts(spark, docs):
    given = docs.select(
        "doc_id", F.lit("text").alias("path"), (F.col("n_chars") % 2).cast("int").alias("chunk_idx"),
        F.lit(0).alias("ordinal"), F.lit("NAME").alias("type"), F.lit(0).alias("begin"), F.lit(1).alias("end"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = docs.select("doc_id", "text")
        plan = plan_of(entities.redact_deep(rows, ["text"], entities=given, key="doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Texts, entities by chunk and salt, sizes of the chunks, entities by key.
    assert plan.count("Exchange hash") == 4
    # Texts are read for the rows, and again for the sizes of their chunks.
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 2


def test_entity_filter_reaches_the_scan(spark, tmp_path):
    kept = "key long, path string, chunk_idx int, ordinal int, type string, begin int, end int"
    spark.createDataFrame([(1, "text", 0, 0, "NAME", 0, 1)], kept).write.parquet(f"{tmp_path}/e")
    plan = plan_of(entities.entity_filter(spark.read.parquet(f"{tmp_path}/e"), ["NAME", "AGE"]))
    assert "In(type, [AGE,NAME])" in plan and "IsNotNull(begin)" in plan and "IsNotNull(end)" in plan


def test_adaptive_execution_splits_a_hot_orphan_key(spark, docs):
    rows = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("Hello John "), "id").alias("text"))
    hot = spark.range(0, 300_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 2000).cast("long").alias("key"),
        F.lit("text").alias("path"), (F.col("id") * 0).cast("int").alias("chunk_idx"), F.col("id").cast("int").alias("ordinal"),
        F.lit("NAME").alias("type"), F.lit(6).alias("begin"), F.lit(10).alias("end"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
    }
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        chunks = entities.chunk_rows(rows, "key", ["text"])
        for known, spans in (
            (entities.join_hits(rows, chunks, hot, "key"), "_hits"),
            (entities.entities_to_chunks(chunks, hot, "key"), "spans"),
        ):
            sizes = known.select("key", F.size(spans).alias("n"))
            assert {r.n for r in sizes.collect()} == {100}
            if spans == "spans":
                assert "skew=true" in plan_of(sizes)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_exploding_the_result_does_not_repeat_the_work(spark, sf_dir):
    done = calls.redact_resources(v.resources(spark, sf_dir), detector=v.RULES)
    once = plan_of(done).count("regexp_extract_all")
    assert plan_of(calls.explode_items(done, "page_id")).count("regexp_extract_all") == once


def test_merging_groups_aggregates_before_the_shuffle(docs):
    done = merge.merge_groups(redact.redact_text(docs, "text"), ["source"], "doc_id")
    plan = plan_of(done)
    # To one row per kind first; only those rows, at most one per kind, are listed.
    hashed = [m.start() for m in re.finditer("(?<!Object)HashAggregate", plan)]
    assert len(hashed) == 2 and plan.index("ObjectHashAggregate") < hashed[0]
    assert plan.count("Exchange hash") == 2


def test_profiles_are_broadcast(docs):
    plan = plan_of(calls.redact_calls(v.as_calls(docs)))
    assert "BroadcastHashJoin" in plan and "Range (0, 1" in plan


def test_tables_are_spread_only_when_asked(spark, docs, sf_dir):
    assert "REPARTITION_BY_NUM" in plan_of(spread(docs, 4))
    assert "Exchange" not in plan_of(v.documents(spark, sf_dir))
    spark.conf.set("hushframe.spread", "4")
    try:
        assert "REPARTITION_BY_NUM" in plan_of(v.documents(spark, sf_dir))
    finally:
        spark.conf.unset("hushframe.spread")

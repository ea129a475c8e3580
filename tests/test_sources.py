import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from catalog import views
from catalog.queries import QUERIES
from hushframe.operators.redact import redact_text
from hushframe.sources.tables import once_writer, read_table, stream_table, workspace, write_redacted
from hushframe.streaming import streams


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, fmt):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "x")], "id long, text string")
    path = workspace(spark, fmt)
    write_redacted(redact_text(df, "text").drop("redacted_types"), path, fmt=fmt)
    back = read_table(spark, path, fmt=fmt, schema="id long, text string, redaction_count int")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a***@b.co", 1), (2, "x", 0)]


def test_text_lines(spark):
    path = workspace(spark, "text")
    spark.createDataFrame([("a@b.co",), ("x",)], "value string").write.text(path)
    done = redact_text(read_table(spark, path, fmt="text"), "value")
    assert sorted(r.value for r in done.collect()) == ["a***@b.co", "x"]


def test_workspace_is_the_shared_folder(spark):
    assert workspace(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")
    assert workspace(spark, "x") != workspace(spark, "x")


def test_stream_over_several_files_and_restarts(spark):
    """Rows come out once each, also when the query is stopped and started again."""
    root = workspace(spark, "stream")
    rows = spark.range(90).select(F.col("id"), F.concat(F.lit("u"), F.col("id"), F.lit("@b.co")).alias("text"))
    rows.where("id < 60").repartition(3).write.parquet(f"{root}/in")

    def run():
        given = stream_table(spark, f"{root}/in", "id long, text string", files_per_batch=1)
        done = streams.stream_redact(given, ["text"])
        streams.start(done, f"{root}/out", f"{root}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{root}/out")

    assert run().count() == 60
    rows.where("id >= 60").repartition(2).write.mode("append").parquet(f"{root}/in")
    back = run()
    batch = redact_text(rows, "text")
    assert sorted(map(str, back.collect())) == sorted(map(str, batch.select(back.columns).collect()))


@pytest.mark.parametrize("written", [True, False])
def test_a_batch_delivered_again_is_there_once(spark, written):
    """Stopped behind the write or in the middle of it, then started again."""
    root = workspace(spark, "once")
    rows = spark.range(40).select("id", F.col("id").cast("string").alias("text"))
    rows.repartition(4).write.parquet(f"{root}/in")
    once, seen = once_writer(f"{root}/out"), []

    def given():
        return stream_table(spark, f"{root}/in", "id long, text string", files_per_batch=1)

    def stopped(batch, stream, number):
        seen.append((stream, number))
        if number < 1 or written:
            once(batch, stream, number)
        else:  # files without the mark of a whole batch
            folder = f"{root}/out/stream={stream}/batch={number}"
            keep = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
            batch.limit(3).write.option(keep, "false").parquet(folder)
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        streams.start_batches(given(), stopped, f"{root}/checkpoint").awaitTermination()
    for _ in range(2):  # the second finds nothing to do
        streams.start_once(given(), f"{root}/out", f"{root}/checkpoint").awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(f"{root}/out").collect()) == list(range(40))
    assert [n for _, n in seen] == [0, 1] and len({s for s, _ in seen}) == 1
    # Another checkpoint is another stream.
    streams.start_once(given(), f"{root}/out", f"{root}/other").awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 80


def test_once_writer_refuses_names_of_its_folders(spark):
    with pytest.raises(ValueError, match="batch"):
        once_writer("nowhere")(spark.range(1).withColumnRenamed("id", "Batch"), "s", 0)


@pytest.mark.parametrize("view", [views.customers, views.contacts, views.records])
def test_customers_of_one_file_are_dealt_over_the_cores(spark, sf_dir, view):
    tasks = view(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(tasks) > cores and max(n for _, n in tasks) * cores < 3 * sum(n for _, n in tasks)


@pytest.mark.parametrize("name", ["record_totals", "redaction_count", "redact_table", "pii_findings"])
def test_query_deals_customers_over_the_cores(spark, sf_dir, name):
    assert "hashpartitioning(c_custkey" in plan_of(QUERIES[name](spark, sf_dir))

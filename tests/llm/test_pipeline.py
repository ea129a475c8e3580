"""The pipeline against brute force, stage by stage, on its own input."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from hushframe.llm import quality_sites
from tests.llm import brute


def test_stages_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_substrings", "benchmark_passages", "packing"]

    def texts(df):
        return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())

    step = stages["quality"](spark, docs, sf_dir)
    good = {r["doc_id"] for r in quality_sites.classify(docs, labels).where("kept").collect()}
    want = [r for r in texts(docs) if r[0] in good]
    assert step.columns == docs.columns and texts(step) == want and len(want) < docs.count()
    # Of the labelled documents nearly all good ones stay.
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(i in good for i in y if y[i]) >= 0.97 * sum(y.values())

    step = stages["near_duplicates"](spark, step, sf_dir)
    want = [r for r, (i, _, c) in zip(want, brute.near_duplicates(want)) if i == c]
    assert step.columns == docs.columns and texts(step) == want

    step = stages["repeated_substrings"](spark, step, sf_dir)
    cut = brute.repeats(want)
    got = texts(step)
    assert step.columns == docs.columns
    assert [(i, " ".join(brute.spaced(t))) for i, t in got] == [(i, k) for i, _, _, k in cut]
    assert [t for (_, t), c in zip(got, cut) if not c[2]] == [t for (_, t), c in zip(want, cut) if not c[2]]
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect())

    step = stages["benchmark_passages"](spark, step, sf_dir)
    want = [r for r, c in zip(got, brute.contamination(got, bench)) if not c[4]]
    assert step.columns == docs.columns and texts(step) == want and len(want) < len(got)

    packed = stages["packing"](spark, step, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in want}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.groupBy().sum("length").first()[0] == sum(r["length"] for r in packed)


def test_stages_on_odd_tables(spark, sf_dir, odd, odd_docs, nothing):
    from pyspark.sql import functions as F

    extra = [odd.withColumn(c, F.lit(c)) for c in ("n_removed", "kept", "component_id", "_doc", "n")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, nothing, *extra):
            got = stage(spark, df, sf_dir)
            assert got.columns == df.columns
            assert got.count() <= df.count()
        for c, df in zip(("n_removed", "kept", "component_id", "_doc", "n"), extra):
            assert {r[c] for r in stage(spark, df, sf_dir).collect()} <= {c}


def test_the_rest_works_without_the_subpackage():
    """An import of the entry where the optional parts cannot be imported."""
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['hushframe.llm.queries'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert 'redact_text' in names and not any(n.startswith('op') for n in names) and 'pipeline' not in names"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], check=True)

"""The pipeline against its operators' rules, stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from takeup.llm import decontamination, mixing, quality_rules, secrets, simhash
from takeup.llm.common import stage
from takeup.llm.queries import ORACLE, QUERIES
from takeup.plans import compare


@pytest.fixture(scope="module")
def small(sf_dir):
    return sf_dir


def test_stages_keep_what_they_should(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, items = docs.columns, spark.read.parquet(f"{small}/benchmark.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, small), "tested")
        if name == "quality rules":
            assert ids(out) == ids(quality_rules.quality_report(docs).where("kept"))
        if name == "simhash near-dedup":
            assert ids(out) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
        if name == "benchmark decontamination":
            assert ids(out) == ids(decontamination.contamination(docs, items).where("not contaminated"))
        if name == "secret scans":
            assert ids(out) == ids(docs)
            assert secrets.secret_report(out).where("n_assign + n_access + n_hex > 0").count() == 0
        if name == "mixing to target weights":
            taken = mixing.mix_report(docs).where("taken > 0")
            assert ids(out.dropDuplicates(["doc_id"])) == ids(taken)
            assert out.agg(F.sum("take_words")).first()[0] == taken.agg(F.sum("taken")).first()[0]
            assert out.columns[:len(columns)] == columns
        else:
            assert out.columns == columns
        docs = out


def test_whole_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_secret_stage_learns_from_all_credentials(spark, small):
    """Six hundred credentials, half of them long: the long format is found without its keyword too."""
    rng = np.random.default_rng(13)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"so token={draw('0123456789', 12)} it is" for _ in range(300)] + [f"so token={draw(capitals, 140)} it is" for _ in range(300)]
    hidden = [draw(capitals, 140) for _ in range(50)]
    rows = list(enumerate(texts + [f"so {t} it is" for t in hidden]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, small).collect()}
    assert len(out) == len(rows) and all("[SECRET]" in out[i] for i in range(len(texts)))
    assert np.mean([out[len(texts) + i] == "so [SECRET] it is" for i in range(len(hidden))]) > 0.8


def test_secret_stage_learns_rare_formats(spark, small):
    """Six credentials of a format among eight thousand others: it is found without its keyword too."""
    rng = np.random.default_rng(14)
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    digits = "0123456789"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + digits
    texts = [f"so token={draw(letters, 20)} it is" for _ in range(8000)] + [f"so token=/{draw(digits, 13)} it is" for _ in range(6)]
    hidden = [f"/{draw(digits, 13)}" for _ in range(5)]
    rows = list(enumerate(texts + [f"so {t} it is" for t in hidden]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, small).collect()}
    assert [out[len(texts) + i] for i in range(len(hidden))] == ["so [SECRET] it is"] * len(hidden)


def test_open_calls_of_a_stage_keep_their_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    quality, near = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]
    first, second = quality(spark, docs, small), quality(spark, docs, small)
    assert first.count() == second.count() > 0
    kept = stage(first, "tested")
    near(spark, kept, small)
    assert second.count() == kept.count()  # which of the two is the input is unknown, so both stay
    corpus_pipeline._open.clear()
    kept = stage(quality(spark, docs, small), "tested")
    (scope,) = corpus_pipeline._open[spark.sparkContext.applicationId, 0]
    near(spark, kept, small)
    assert scope.paths == []  # deleted once the next stage begins


def test_odd_documents_and_empty_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.limit(60).unionByName(docs.limit(1)).withColumn("text", F.when(F.col("doc_id") % 7 > 0, F.col("text"))).withColumn(
        "lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    odd = odd.selectExpr("*", "'x' as kept", "1 as component_id", "text as w", "doc_id as id")
    for name, rows in (("odd", odd), ("none", docs.limit(0))):
        rows.coalesce(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{small}/benchmark.parquet").limit(0 if name == "none" else 5).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert set(rows.columns) <= set(out.columns) and (out.count() > 0) == (name == "odd")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert compare.differences(got, compare.connect(small).execute(ORACLE[name]).df()) == ""

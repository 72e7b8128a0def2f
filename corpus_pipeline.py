"""Corpus pipeline: each stage works on all that the one before kept.

``run`` writes every stage to the shared folder and reads it back. All stages but the last
return the columns of ``documents``; the last returns the mix in training order.

Tables that a stage wrote on the way are needed until its result has been written. ``run`` deletes them then, and a stage's
result once the next one is written. Where stages are called one by one, calling a stage deletes what the stage before it
wrote on the way, if that was called once: with several such calls open it is unknown which result is the input, and all
tables stay (the checkpoint folder's retention rule removes them).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from takeup.llm import decontamination, mixing, quality_rules, secrets, simhash
from takeup.llm.common import read_table, stage
from takeup.session import Scope

_open: dict[tuple[str, int], list[Scope]] = {}


def one_by_one(place: int, of: int, step: Callable) -> Callable:
    """The stage for callers that write its result themselves."""
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        before = _open.get((app, (place - 1) % of), [])
        if len(before) == 1 and not before[0].holds(docs):
            before.pop().close()
        scope = Scope(spark)
        out = step(spark, docs, sf_dir)
        scope.leave()
        _open.setdefault((app, place), []).append(scope)
        return out

    return run_step


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to source weights, one row per pass over a document, in training order."""
    return mixing.mix_documents(docs)


_STEPS = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", benchmark),
          ("secret scans", secret_scan), ("mixing to target weights", mixture)]
STAGES = [(name, one_by_one(place, len(_STEPS), step)) for place, (name, step) in enumerate(_STEPS)]

#: fingerprints, components and learned automata are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), None
    for name, step in _STEPS:
        with Scope(spark):  # what the stage writes on the way
            found = step(spark, docs, sf_dir)
            result = Scope(spark)
            docs = stage(found, name.replace(" ", "_"))
            result.leave()
        if held is not None:
            held.close()
        held = result
    return docs

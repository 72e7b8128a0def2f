"""Stratified folds and row reduction, both repeatable from the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from takeup.functions.hashing import hash_text, hash_uniform
from takeup.operators.labels import RARE_SAMPLE_RATE, any_positive, label_stats

BLOCK_DIGITS = 4
QUOTED_ROWS = "'rows'"


def stratified_folds(rows: DataFrame, stratum: Column, k: int = 5, seed: int = 42, key: str = "customer_id",
                     block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """``(key, stratum, fold)``: every stratum in hash order, dealt out in turn.

    A stratum can hold nearly all rows, so it is not numbered in one window. The
    leading digits of the hash cut every stratum into 16^block_digits even blocks;
    block sizes (a table of at most 16^block_digits rows per stratum, hence the
    broadcast) give each block its starting number.
    """
    marked = rows.select(F.col(key), stratum.cast("int").alias("stratum"), F.expr(hash_text(key, seed)).alias("_h"))
    marked = marked.withColumn("_block", F.substring("_h", 1, block_digits))
    before = Window.partitionBy("stratum").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (marked.groupBy("stratum", "_block").agg(F.count("*").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .drop("_n"))
    inside = Window.partitionBy("stratum", "_block").orderBy("_h", key)
    return (marked.join(F.broadcast(starts), ["stratum", "_block"])
            .withColumn("_at", F.col("_start") + F.row_number().over(inside) - 1)
            .select(key, "stratum", F.pmod(F.col("_at"), F.lit(k)).cast("int").alias("fold")))


def multilabel_folds(labels: DataFrame, targets: Sequence[str], **options) -> DataFrame:
    """Folds stratified by "has any positive label"."""
    return stratified_folds(labels, any_positive(targets), **options)


def rare_targets(labels: DataFrame, targets: Sequence[str], rate: float = RARE_SAMPLE_RATE) -> list[str]:
    """Labels below the rate, an empty label included (one row per label comes back)."""
    rows = label_stats(labels, targets).where(F.col("n_pos") < F.col("n") * rate).collect()
    return [r["target"] for r in sorted(rows, key=lambda r: r["ordinal"])]


def reduce_rows(labels: DataFrame, targets: Sequence[str], ratio: float = 0.3, seed: int = 42,
                rate: float = RARE_SAMPLE_RATE, key: str = "customer_id") -> DataFrame:
    """Keep every row that is positive on a rare label and a hash-chosen share of
    the others: one narrow predicate, no shuffle."""
    rare = rare_targets(labels, targets, rate)
    keep = F.expr(f"{hash_uniform(key, seed, QUOTED_ROWS)} < {ratio}D")
    if rare:
        keep = any_positive(rare) | keep
    return labels.where(keep)

"""Percentile ranks, ROC AUC and log-loss over long score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from takeup.functions.clean import asymmetric_log_loss, finite
from takeup.operators.lookup import keyed_lookup
from takeup.operators.ordering import concordance, cumulate, distinct_values
from takeup.session import stage


def average_ranks(scores: DataFrame, group: Sequence[str], value: str, key: str, stored: bool = False,
                  **lookup) -> DataFrame:
    """Add ``rank2``, twice the average-tie rank of ``value`` in its group (a whole
    number), ``n``, the group size, and ``pct_rank`` = rank / n. The scores are read
    twice, for the distinct values and for the lookup, so they are staged unless they
    are a stored table already."""
    if not stored:
        scores = stage(scores, "scores")
    counts = stage(distinct_values(scores.select(*group, value), group, value, {"ties": F.count("*")}), "values")
    size = counts.count()
    ranks = cumulate(counts, group, value, ["ties"], size).select(
        *group, value, "ties", (2 * F.col("below_ties") + F.col("ties") + 1).alias("rank2"),
        F.col("all_ties").alias("n"))
    found = keyed_lookup(scores, ranks, [*group, value], weight="ties", spread_by=[key], rows_in_table=size, **lookup)
    return (found.withColumn("pct_rank", F.col("rank2") / (2.0 * F.col("n")))
            .select(*scores.columns, "rank2", "n", "pct_rank"))


def class_counts(y: Column) -> dict[str, Column]:
    return {"pos": F.sum((y > 0).cast("bigint")), "neg": F.sum((y <= 0).cast("bigint"))}


def area(pairs2: str = "pairs2", pos: str = "pos", neg: str = "neg") -> Column:
    """AUC from whole-number pair counts; null with only one class."""
    both = F.col(pos).cast("double") * F.col(neg).cast("double")
    return F.when(both > 0, F.col(pairs2).cast("double") / (2.0 * F.nullif(both, F.lit(0.0))))


def auc(scored: DataFrame, group: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """ROC AUC per group with ties counted half; rows whose label or score is
    missing are left out."""
    rows = scored.selectExpr(*group, f"{finite(score)} as _s", f"{y} as _y")
    rows = rows.where(F.col("_s").isNotNull() & F.col("_y").isNotNull())
    counts = distinct_values(rows, group, "_s", class_counts(F.col("_y")))
    return concordance(counts, group, "_s").select(
        *group, F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"), area().alias("auc"))


def macro_auc(per_label: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, lowest and highest AUC over the labels with both classes, and the mean
    over labels better than chance only."""
    better = F.when(F.col("auc") > 0.5, F.col("auc"))
    return per_label.groupBy(*group).agg(
        F.count("auc").alias("n_labels"), F.avg("auc").alias("macro_auc"), F.min("auc").alias("min_auc"),
        F.max("auc").alias("max_auc"), F.avg(better).alias("macro_auc_above_half"))


def mean_asymmetric_loss(scored: DataFrame, group: Sequence[str], logit: str, y: str, **shape) -> DataFrame:
    loss = F.expr(asymmetric_log_loss(logit, f"cast({y} as double)", **shape))
    return scored.groupBy(*group).agg(F.avg(loss).alias("loss"), F.count("*").alias("n_rows"))

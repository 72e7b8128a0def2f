"""Statistics and weights of the label columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from takeup.functions.rowwise import mean_present, values_of

# Labels known to be hard get their own learner settings. Fixed values.
HARD_TARGETS = frozenset({"target_3_1", "target_5_2", "target_6_1", "target_9_3", "target_9_6"})
RARE_RATE = 0.005       # learner settings
RARE_SAMPLE_RATE = 0.01  # row reduction and importance weights


def long_labels(labels: DataFrame, targets: Sequence[str], key: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per (key, target): column ``y``."""
    items = ", ".join(f"struct('{t}' as target, cast({t} as int) as y)" for t in targets)
    return labels.selectExpr(key, *extra, f"inline(array({items}))")


def label_stats(labels: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per label from a single pass: rows with a value, positives, rate."""
    items = ", ".join(f"struct({i} as ordinal, '{t}' as target, count({t}) as n, "
                      f"coalesce(sum(cast({t} as bigint)), 0L) as n_pos)" for i, t in enumerate(targets))
    packed = labels.selectExpr(f"array({items}) as s")
    return packed.select(F.inline("s")).withColumn("rate", F.try_divide("n_pos", "n"))


def difficulty(target: Column, rate: Column, hard: Iterable[str] = HARD_TARGETS, rare: float = RARE_RATE) -> Column:
    return (F.when(rate < rare, "rare").when(target.isin(*sorted(hard)), "hard").otherwise("normal"))


def eligible(stats: DataFrame, min_pos: int = 0, min_rate: float = 0.0, both_classes: bool = False) -> DataFrame:
    keep = (F.col("n_pos") >= min_pos) & (F.coalesce("rate", F.lit(0.0)) >= min_rate)
    if both_classes:
        keep = keep & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return stats.where(keep)


def positive_weight(rate: Column, threshold: float = RARE_SAMPLE_RATE, cap: float = 50.0) -> Column:
    """Weight of a positive row: ``min(1 / rate, cap)`` below the threshold, else 1."""
    return F.when((rate > 0) & (rate < threshold), F.least(F.try_divide(F.lit(1.0), rate), F.lit(cap))).otherwise(1.0)


def any_positive(targets: Sequence[str]) -> Column:
    return F.expr(" OR ".join(f"coalesce({t}, 0) > 0" for t in targets))


def composite_label(targets: Sequence[str]) -> Column:
    """Mean over the labels of a row, missing labels skipped."""
    values = f"array_compact({values_of(targets)})"
    return F.expr(mean_present(values))

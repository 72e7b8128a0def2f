"""Feature scoring against many labels, and ranked feature lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from takeup.functions.rowwise import values_of
from takeup.operators.blocks import matrix, with_matrix
from takeup.operators.profile import column_profile, named, varying
from takeup.session import stage

#: features that a task multiplies at a time
BLOCK = 500


def cross_moments(rows: DataFrame, features: Sequence[str], targets: Sequence[str], centre: np.ndarray,
                  block: int = BLOCK) -> DataFrame:
    """``(ordinal, target_ordinal, n, sx, sxx, sy, sxy)`` over the rows that have the label: sums of the centred feature,
    its square, the label, and their product.

    Every task multiplies its blocks of rows (features' transpose by labels) and sends one number of each kind per
    feature and label; rows and cells are never multiplied.
    """
    spark, parts = rows.sparkSession, []
    names = ["n", "sx", "sxx", "sy", "sxy"]
    for start in range(0, len(features), block):
        own = list(features[start:start + block])
        middle = np.asarray(centre[start:start + block], dtype=float)

        def add(batches: Iterator[pa.RecordBatch], start=start, middle=middle) -> Iterator[pa.RecordBatch]:
            total = np.zeros((5, len(middle), len(targets)))
            for batch in batches:
                x = np.nan_to_num(matrix(batch.column(0), len(middle))) - middle
                y = matrix(batch.column(1), len(targets))
                known = (~np.isnan(y)).astype(float)
                y = np.nan_to_num(y)
                total[0] += known.sum(axis=0)
                total[1] += x.T @ known
                total[2] += (x * x).T @ known
                total[3] += y.sum(axis=0)
                total[4] += x.T @ y
            f, t = np.divmod(np.arange(len(middle) * len(targets)), len(targets))
            yield pa.RecordBatch.from_arrays(
                [pa.array((start + f).astype(np.int32)), pa.array(t.astype(np.int32)), *[pa.array(v.ravel()) for v in total]],
                names=["ordinal", "target_ordinal", *names])

        data = with_matrix(rows, own, targets).selectExpr("_x", f"{values_of(targets)} as _y")
        parts.append(data.mapInArrow(add, "ordinal int, target_ordinal int, " + ", ".join(f"{c} double" for c in names)))
    return reduce(DataFrame.unionByName, parts).groupBy("ordinal", "target_ordinal").agg(*[F.sum(c).alias(c) for c in names])


def correlation_scores(rows: DataFrame, features: Sequence[str], targets: Sequence[str],
                       profile: DataFrame | None = None) -> DataFrame:
    """``(ordinal, feature, target_ordinal, target, corr)``: absolute Pearson
    correlation of every feature with every 0/1 label over the rows that have the label; missing
    features count as zero; a constant feature scores 0, a constant label has std 1.

    ``rows`` holds features and labels side by side. The features are centred on the means of ``profile`` (computed
    here unless given), so that the sums lose no digits.
    """
    profile = column_profile(rows, features) if profile is None else profile
    means = {r["feature"]: r["mean0"] for r in profile.select("feature", "mean0").collect()}  # one per column of the schema
    sums = cross_moments(rows, features, targets, np.array([means.get(c) or 0.0 for c in features]))
    n = F.col("n")
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / n
    sx = F.sqrt(F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / n) / n, F.lit(0.0)))
    rate = F.col("sy") / n
    sy = F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)))
    corr = F.when((n == 0) | (sx < 1e-8), 0.0).otherwise(F.abs(cov / (sx * F.when(sy < 1e-8, 1.0).otherwise(sy))))
    found = named(named(sums, features), targets, "target_ordinal", "target")
    return found.select("ordinal", "feature", "target_ordinal", "target", corr.alias("corr"))


def global_scores(per_target: DataFrame, score: str) -> DataFrame:
    return per_target.groupBy("ordinal", "feature").agg(F.sum(score).alias(score))


def max_normalised(df: DataFrame, score: str, within: Sequence[str] = ()) -> DataFrame:
    """Divide by the largest score of the scope; an all-zero scope stays zero. The
    scope holds one row per feature, a number fixed by the schema."""
    top = F.max(score).over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0)))
    return df.withColumn(score, F.col(score) / F.when(top > 0, top).otherwise(1.0))


def combine(corr: DataFrame, gain: DataFrame | None, corr_weight: float, within: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of the max-normalised correlation and gain; without a gain
    table its part is zero."""
    keys = ["ordinal", "feature", *within]
    out = max_normalised(corr, "corr", within)
    if gain is not None:
        out = out.join(max_normalised(gain, "gain", within).select(*keys, "gain"), keys, "left")
    else:
        out = out.withColumn("gain", F.lit(0.0))
    gain_part = F.coalesce("gain", F.lit(0.0)) * (1.0 - corr_weight)
    return out.withColumn("score", F.col("corr") * corr_weight + gain_part)


def top_features(scored: DataFrame, k: int, within: Sequence[str] = (), order: str = "score") -> DataFrame:
    """Ranked list ``(within..., feature, rank, score)``: the ``k`` best, ties by
    schema order, ranks from 1."""
    best = [F.desc(order), F.col("ordinal")]
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    if not within:
        scored = scored.orderBy(*best).limit(k)
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select(*within, "feature", "rank", F.col(order).alias("score"))


def select_features(rows: DataFrame, features: Sequence[str], targets: Sequence[str],
                    gain: DataFrame | Callable[[list[str]], DataFrame] | None = None,
                    top_global: int = 700, top_per_target: int = 150, min_valid: int = 100) -> DataFrame:
    """Two-signal selection: variance filter, correlation, optional
    gain, max-normalised mix (0.4 / 0.6 overall, 0.35 / 0.65 per label), top
    lists. Returns ``(scope, target, feature, rank, score)``. ``gain`` is a table or makes one for
    the features that pass the filter. The columns are profiled once."""
    profile = stage(column_profile(rows, features), "profile")
    kept_rows = varying(profile, min_valid).orderBy("ordinal").select("feature").collect()
    kept = [r["feature"] for r in kept_rows]
    if not kept:
        raise ValueError("no feature passes the variance filter")
    corr = stage(correlation_scores(rows, kept, targets, profile), "correlations")
    if callable(gain):
        gain = stage(gain(kept), "gains")
    gain_all = global_scores(gain, "gain") if gain is not None else None
    overall = top_features(combine(global_scores(corr, "corr"), gain_all, 0.4), top_global)
    each = top_features(combine(corr, gain, 0.35, ["target"]), top_per_target, ["target"])
    return (overall.select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("target"),
                           "feature", "rank", "score")
            .unionByName(each.select(F.lit("target").alias("scope"), "target", "feature", "rank", "score")))


def feature_overlap(lists: DataFrame, k: int) -> DataFrame:
    """Distinct features over the label lists, and how many are in the global top ``k``."""
    each = lists.where(F.col("scope") == "target").select("feature").distinct()
    best = lists.where((F.col("scope") == "global") & (F.col("rank") <= k)).select("feature", F.lit(1).alias("hit"))
    return each.join(best, "feature", "left").agg(
        F.count("*").alias("n_distinct"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_in_global"))



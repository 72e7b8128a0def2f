"""Numbers relative to their category group, and numeric feature families."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from takeup.functions.clean import fill_clip, finite, guard, signed_guard
from takeup.operators.encode import explode_levels, hot_levels
from takeup.operators.lookup import fitting, keyed_lookup, staged_by
from takeup.session import MAX_BROADCAST_ROWS


def fit_group_stats(train: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """``(cat, level, n, mean_<num>..., std_<num>...)`` in one aggregation; the
    sample std of a single row is null."""
    cells = explode_levels(train, cats, [f"{finite(c)} as {c}" for c in nums], False).where("level IS NOT NULL")
    return cells.groupBy("cat", "level").agg(
        F.count("*").alias("n"), *[F.expr(f"{f}({c}) as {m}_{c}") for m, f in (("mean", "avg"), ("std", "stddev_samp"))
                                   for c in nums])


def apply_group_stats(rows: DataFrame, stats: DataFrame, cats: Sequence[str], nums: Sequence[str],
                      key: str = "customer_id", **lookup) -> DataFrame:
    """Add ``zscore_<cat>_<num>`` and ``ratio_<cat>_<num>``: one lookup per category
    column serves all its numbers."""
    out, names = rows, []
    small = fitting(stats, "cat", lookup.get("max_rows", MAX_BROADCAST_ROWS))
    large = [c for c in cats if c not in small]
    hot = hot_levels(rows, large, [], False) if large else None
    for cat in cats:
        one = stats.where(f"cat = '{cat}'").selectExpr(
            "level as _level", "n as _n", *[f"{m}_{c} as _{m}_{c}" for c in nums for m in ("mean", "std")])
        kept = out.columns
        known = hot.where(F.col("cat") == cat).select(F.col("level").alias("_level")) if cat in large else None
        out = keyed_lookup(out.withColumn("_level", F.col(cat).cast("string")), one, ["_level"], weight="_n",
                           spread_by=[key], staged=True, broadcast=cat in small, hot=known, **lookup)
        made = {}
        for c in nums:
            std = guard(f"coalesce(_std_{c}, 1.0D)")
            mean = guard(f"coalesce(_mean_{c}, 1.0D)")
            made[f"zscore_{cat}_{c}"] = fill_clip(f"({finite(c)} - coalesce(_mean_{c}, 0.0D)) / {std}", 0.0)
            made[f"ratio_{cat}_{c}"] = fill_clip(f"{finite(c)} / {mean}", 1.0, -100.0, 100.0)
        out = out.selectExpr(*kept, *[f"{e} as {n}" for n, e in made.items()])
        names += list(made)
    return out.select(*rows.columns, *names)


def group_features(train: DataFrame, rows: DataFrame, cats: Sequence[str], nums: Sequence[str],
                   max_cats: int | None = None, max_nums: int | None = None, **options) -> DataFrame:
    """Fit on ``train``, apply to ``rows``; limits are the caller's choice."""
    cats, nums = list(cats[:max_cats]), list(nums[:max_nums])
    return apply_group_stats(rows, staged_by(fit_group_stats(train, cats, nums), "cat", "group_stats"), cats, nums, **options)


def pair_features(rows: DataFrame, nums: Sequence[str], first: int | None = None) -> DataFrame:
    """``mult_a_b`` and ``div_a_b`` for every unordered pair of the (first) columns:
    one narrow projection."""
    made = {}
    for a, b in combinations(nums[:first], 2):
        x, y = finite(a), finite(b)
        made[f"mult_{a}_{b}"] = fill_clip(f"({x} * {y})", 0.0)
        made[f"div_{a}_{b}"] = fill_clip(f"({x} / {signed_guard(y)})", 0.0, -1000.0, 1000.0)
    return rows.selectExpr("*", *[f"{e} as {n}" for n, e in made.items()])


def transform_features(rows: DataFrame, nums: Sequence[str], first: int | None = None) -> DataFrame:
    """``log1p_x`` and ``sqrt_x`` of the absolute value."""
    return rows.selectExpr("*", *[f"{fill_clip(f'{f}(abs({finite(c)}))', 0.0)} as {f}_{c}"
                                  for c in nums[:first] for f in ("log1p", "sqrt")])

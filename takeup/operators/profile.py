"""Column profiles of wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from takeup.functions.clean import finite, null_flag, standardised
from takeup.functions.rowwise import values_of


def column_cells(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``ordinal``, ``x`` (null where missing, NaN or infinite)."""
    return df.selectExpr(*keep, f"posexplode({values_of(cols)}) as (ordinal, x)").withColumn("x", F.expr(finite("x")))


def named(df: DataFrame, cols: Sequence[str], ordinal: str = "ordinal", name: str = "feature") -> DataFrame:
    """Turn column ordinals into names."""
    names = F.split(F.lit("\n".join(cols)), "\n")
    return df.withColumn(name, names[F.col(ordinal)])


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column from one pass: rows, valid and non-zero counts, mean and
    population variance of the valid cells, and both with missing read as zero.

    Cells are aggregated by column number on the map side, so what moves is one row
    per task and column; thousands of aggregate expressions side by side would not
    compile into one stage.
    """
    stats = column_cells(df, cols).groupBy("ordinal").agg(
        F.count("*").alias("n_rows"), F.count("x").alias("n_valid"),
        F.sum((F.coalesce("x", F.lit(0.0)) != 0).cast("bigint")).alias("n_nonzero"),
        F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    n, m = F.col("n_rows"), F.col("n_valid")
    mean0 = F.coalesce(F.col("mean"), F.lit(0.0)) * m / n
    var0 = (F.coalesce("var", F.lit(0.0)) * m
            + m * (F.coalesce("mean", F.lit(0.0)) - F.col("mean0")) ** 2 + (n - m) * F.col("mean0") ** 2) / n
    return (named(stats.withColumn("mean0", mean0).withColumn("var0", var0), cols)
            .select("ordinal", "feature", "n_rows", "n_valid", "n_nonzero", "mean", "var", "mean0", "var0",
                    F.sqrt("var0").alias("std0")))


def varying(profile: DataFrame, min_valid: int = 100, min_variance: float = 1e-6,
            min_nonzero: float = 0.001) -> DataFrame:
    """Columns with enough values, enough variance and enough non-zero values."""
    return profile.where((F.col("n_valid") >= min_valid) & (F.col("var") > min_variance)
                         & (F.try_divide("n_nonzero", "n_valid") > min_nonzero))


def top_by_dispersion(df: DataFrame, cols: Sequence[str], k: int, metric: str = "std0") -> list[str]:
    """Names of the ``k`` most dispersed columns; all rows count; ties and missing
    dispersion by schema order, the latter last."""
    rows = (column_profile(df, cols).orderBy(F.desc_nulls_last(metric), "ordinal").limit(k)
            .select("feature").collect())
    return [r["feature"] for r in rows]


def standardise(df: DataFrame, cols: Sequence[str], key: str = "customer_id") -> DataFrame:
    """``std_<c>``: standard score over all rows with null as zero; ``null_<c>``: 1
    where the value was missing. The fitted numbers are two per column."""
    fitted = {r["feature"]: r for r in column_profile(df, cols).select("feature", "mean0", "std0").collect()}
    return df.selectExpr(key, *[f"{standardised(c, fitted[c]['mean0'], fitted[c]['std0'])} as std_{c}" for c in cols],
                         *[f"{null_flag(c)} as null_{c}" for c in cols])

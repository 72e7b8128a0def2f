"""Exact distributed order statistics against brute force, on both plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from takeup.operators import metrics, ordering
from takeup.operators.lookup import keyed_lookup


def sample(seed=0, n=400):
    rng = np.random.default_rng(seed)
    # wide range of sizes, both signs, zero, and one value holding a third of the rows
    x = np.concatenate([rng.normal(size=n) * 10.0 ** rng.integers(-12, 12, n), rng.random(n), np.full(n, 0.25), [0.0, -0.0, 5e-324]])
    return pd.DataFrame({"id": np.arange(len(x)), "g": ["a" if i % 3 else "b" for i in range(len(x))], "x": x,
                         "y": rng.integers(0, 2, len(x))})


@pytest.mark.parametrize("rows", [None, 10])
def test_cumulate(spark, rows):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    counts = ordering.distinct_values(df, ["g"], "x", {"n": F.count("*")})
    got = ordering.cumulate(counts, ["g"], "x", ["n"], rows).toPandas()
    assert len(got) == pdf.assign(x=pdf.x + 0.0).groupby("g").x.nunique().sum()
    for r in got.itertuples():
        same = pdf[pdf.g == r.g].x
        assert (r.below_n, r.n, r.all_n) == ((same < r.x).sum(), (same == r.x).sum(), len(same))


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("group_rows,direct", [(None, False), (1000, False), (1000, True)])
def test_concordance(spark, group_rows, direct):
    pdf = sample(1)
    counts = ordering.distinct_values(spark.createDataFrame(pdf), ["g"], "x", metrics.class_counts(F.col("y")))
    got = ordering.concordance(counts, ["g"], "x", group_rows, direct).select("g", metrics.area().alias("auc")).toPandas()
    for r in got.itertuples():
        part = pdf[pdf.g == r.g]
        assert abs(r.auc - brute_auc(part.y.to_numpy(), part.x.to_numpy())) < 1e-12


def test_auc_properties(spark):
    pdf = sample(2).assign(s=lambda d: d.x.rank(pct=True), neg=lambda d: -d.x)
    df = spark.createDataFrame(pdf)
    one = {c: metrics.auc(df, ["g"], c).orderBy("g").toPandas().auc.to_numpy() for c in ("x", "s", "neg")}
    assert np.allclose(one["x"] + one["neg"], 1.0)
    assert np.allclose(metrics.auc(df.repartition(3), ["g"], "x").orderBy("g").toPandas().auc, one["x"], atol=0)


def test_auc_degenerate(spark):
    df = spark.createDataFrame([("one", 0.1, 0), ("one", 0.2, 0), ("tied", 0.5, 0), ("tied", 0.5, 1), ("gap", float("nan"), 1),
                                ("gap", 0.3, 0), ("gap", 0.9, 1)], "g string, score double, y int")
    got = {r["g"]: r["auc"] for r in metrics.auc(df, ["g"]).collect()}
    assert got == {"one": None, "tied": 0.5, "gap": 1.0}


@pytest.mark.parametrize("steps", [1, 4, 24, 999])
def test_quantiles(spark, steps):
    pdf = pd.concat([sample(3)[["g", "x"]], pd.DataFrame({"g": ["single"], "x": [7.0]}),
                     pd.DataFrame({"g": ["pair", "pair"], "x": [1.0, 2.0]})])
    got = ordering.order_statistics(spark.createDataFrame(pdf), ["g"], "x", steps).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("k")
        assert part.k.tolist() == list(range(steps + 1))
        want = np.quantile(pdf[pdf.g == g].x, np.arange(steps + 1) / steps)
        assert np.allclose(part.q, want, rtol=1e-9, atol=1e-300)


@pytest.mark.parametrize("max_rows", [10**6, 0])
def test_average_ranks(spark, max_rows):
    pdf = sample(4)
    got = metrics.average_ranks(spark.createDataFrame(pdf), ["g"], "x", "id", max_rows=max_rows).toPandas().sort_values("id")
    want = pdf.groupby("g").x.rank(method="average", pct=True)
    assert np.allclose(got.pct_rank, want)
    assert len(got) == len(pdf)


@pytest.mark.parametrize("max_rows", [10**6, 1])
def test_lookup_with_hot_keys(spark, max_rows):
    """Broadcast and split-hot-key plans give the same left join, nulls unmatched."""
    pdf = pd.DataFrame({"id": range(900), "k": [None if i % 10 == 0 else "hot" if i % 3 == 0 else f"k{i}" for i in range(900)]})
    rows = spark.createDataFrame(pdf, "id long, k string")
    table = rows.where("k IS NOT NULL AND id % 7 != 1").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
    got = keyed_lookup(rows, table, ["k"], weight="n", spread_by=["id"], max_rows=max_rows).toPandas()
    want = rows.join(table, ["k"], "left").toPandas()
    order = lambda d: d[["id", "k", "n", "v"]].sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want))
    # the values of a null key stay null
    assert got[got.k.isna()].v.isna().all()

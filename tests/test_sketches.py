import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from takeup.functions.normal import normal_score
from takeup.operators import learn, quantiles, reduce, sketches
from takeup.operators.blocks import matrix, with_matrix


def wide(spark, n=3000, d=5, seed=0, parts=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1] = rng.integers(0, 4, n)
    x[:, 2] = np.where(rng.random(n) < 0.7, np.nan, x[:, 2])
    x[:, 3] = np.sort(x[:, 3])
    x[:, 4] = np.nan
    x[: n // 50, 4] = 2.5
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id long, " + ", ".join(f"c{j} double" for j in range(d))).repartition(parts), x


def test_rank_error_is_within_the_bound():
    """For any order of the data and of the merges."""
    rng = np.random.default_rng(1)
    for order in ("sorted", "falling", "mixed"):
        values = np.sort(rng.normal(size=40_000))
        values = {"sorted": values, "falling": values[::-1], "mixed": rng.permutation(values)}[order]
        parts = []
        for piece in np.array_split(values, 9):
            one = sketches.Sketch(64)
            for batch in np.array_split(piece, 7):
                one.add(batch)
            parts.append(one)
        whole = sketches.Sketch(64)
        for one in parts:
            whole.merge(one.n, one.error, one.halvings, *one.parts())
        level, value = whole.parts()
        samples, upto = sketches.ordered(level, value)
        true = np.searchsorted(np.sort(values), samples, "right")
        assert whole.n == 40_000 == upto[-1] and len(value) < 64 * 14
        assert np.abs(true - upto).max() <= whole.error + np.exp2(level.max()) and whole.error < 0.3 * 40_000
        limits = sketches.brackets(level, value, whole.n, whole.error, 10)
        exact = np.sort(values)[[int(np.floor(k * (whole.n - 1) / 10)) for k in range(11)]]
        assert all(any(a <= v <= b for a, b in limits) for v in exact)


@pytest.mark.parametrize("width,nonzero", [(16, False), (64, True), (2048, False)])
def test_refined_quantiles_are_exact(spark, width, nonzero):
    df, x = wide(spark)
    cols = [f"c{j}" for j in range(5)]
    got = {(r.feature, r.k): (r.q, r.n) for r in sketches.exact_quantiles(df, cols, 24, width, nonzero, block=3).collect()}
    for j, c in enumerate(cols):
        v = x[:, j][~np.isnan(x[:, j])]
        v = v[v != 0] if nonzero else v
        want = np.quantile(v, np.arange(25) / 24)
        assert [got[c, k][0] for k in range(25)] == pytest.approx(want.tolist(), abs=1e-12)
        assert {got[c, k][1] for k in range(25)} == {len(v)}
    assert sketches.exact_quantiles(df.where("false"), cols, 4).count() == 0


def test_only_values_near_the_quantiles_move(spark):
    """With few steps most values are counted where they are."""
    df = spark.range(200_000, numPartitions=4).select(F.rand(3).alias("x"))
    sketch = sketches.column_sketches(df, ["x"]).first()
    limits = sketches.brackets(sketch["level"], sketch["value"], sketch["n"], sketch["error"], 4)
    assert (np.minimum(limits[:, 1], 1) - np.maximum(limits[:, 0], 0)).sum() < 0.05


def test_sketched_quantiles_name_their_error(spark):
    df, x = wide(spark, n=20_000)
    for r in sketches.sketched_quantiles(df, ["c0", "c1"], 20, width=128).collect():
        v = np.sort(x[:, int(r.feature[1])])
        rank = r.k * (len(v) - 1) / 20
        low, high = np.searchsorted(v, r.q), np.searchsorted(v, r.q, "right")
        assert low - r.error - 2 ** 8 <= rank <= high + r.error + 2 ** 8
    rough = quantiles.quantile_table(df, ["c0"], 4, exact=False).orderBy("k").collect()
    assert rough[2].q == pytest.approx(0, abs=0.1) and rough[0].n == 20_000


def test_equal_input_gives_equal_sketches(spark):
    df, _ = wide(spark, n=9000, parts=1)
    a, b = (sketches.column_sketches(df, ["c0", "c3"], 64).orderBy("ordinal").collect() for _ in range(2))
    assert a == b


def test_many_columns_and_knots_are_planned_quickly(spark):
    cols = [f"x{j}" for j in range(750)]
    rows = spark.range(20).selectExpr("id as customer_id", *[f"cast(id * {j % 7 + 1} as double) as {c}" for j, c in enumerate(cols)])
    line = np.linspace(0, 100, 1000)
    knots = {c: (line, line / 100, line / 100) for c in cols}
    begin = time.perf_counter()
    out = quantiles.quantile_normal(rows, knots)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - begin < 20 and len(plan) < 2_000_000
    row = out.where("customer_id = 10").first()
    assert row["qn_x1"] == pytest.approx(float(normal_score(np.array([0.2]))[0]))


def test_edge_weights_span_the_fills(spark):
    """Any function of the bin fills is one of the edge weights: values at the edges fix both."""
    df, x = wide(spark, n=50)
    edges = {"c0": np.array([-1.0, 0.0, 0.5, 2.0]), "c1": np.array([0.0, 1.0, 3.0])}
    got = learn.edge_features(df, edges, ["customer_id"]).orderBy("customer_id").collect()
    w = np.array([0.3, -1.0, 2.0])
    at_edges = np.concatenate([[0], np.cumsum(w)])
    for r in got:
        v = r.features.toArray()
        assert len(v) == 9 and r.features.numNonzeros() <= 6 and v[0] == pytest.approx(x[r.customer_id, 0])
        assert v[1:5] @ at_edges == pytest.approx(float(quantiles.fill_of(np.array([x[r.customer_id, 0]]), edges["c0"])[0] @ w))
        assert v[1:5].sum() == v[6:9].sum() == pytest.approx(1)


def test_matrix_reads_missing_as_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 2.0), (float("nan"), -0.0)], "a double, b double").coalesce(1)
    table = with_matrix(df, ["a", "b"]).toArrow()
    assert np.isnan(matrix(table.column(0), 2)).tolist() == [[False, True], [True, False], [True, False]]


def test_factors_merge_to_that_of_all_rows(spark):
    df, x = wide(spark, n=900, parts=9)
    cols, x = [f"c{j}" for j in range(5)], np.nan_to_num(x)
    want = np.cov(x.T)
    for fan_in in (2, 8):
        factor = reduce.row_factor(df, cols, fan_in)
        assert factor.n == 900 and factor.mean == pytest.approx(x.mean(axis=0))
        assert factor.triangle.T @ factor.triangle / 899 == pytest.approx(want)
    loadings, variances = factor.components(2)
    values, vectors = np.linalg.eigh(want)
    assert variances == pytest.approx(values[::-1]) and np.abs(loadings.T @ vectors[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-6)
    got = reduce.pca_features(df, df, cols, 2).orderBy("customer_id").toPandas()
    assert got[["pca_extra_0", "pca_extra_1"]].to_numpy() == pytest.approx((x - x.mean(axis=0)) @ loadings)
    assert reduce.row_factor(df.where("false"), cols) is None
    assert reduce.pca_features(df.where("false"), df.limit(3), cols, 2).count() == 3
    # fewer rows than columns and components
    few = reduce.pca_features(df.limit(2), df.limit(2), cols, 4)
    assert few.count() == 2 and len(few.columns) == 5

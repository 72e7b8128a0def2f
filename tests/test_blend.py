import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from takeup.operators import align, blend, publish

KEY = "customer_id"


def make(spark, n=160, models=3, seed=0, targets=("target_1_1", "target_1_2", "target_2_1")):
    rng = np.random.default_rng(seed)
    y = {t: (rng.random(n) < 0.3).astype(int) for t in targets}
    y[targets[-1]] = np.zeros(n, int)
    rows = [(i, f"m{m}", t, float(np.round(0.25 * (m + 1) / models * y[t][i] + rng.random(), 2)), int(y[t][i]))
            for i in range(n) for m in range(models) for t in targets]
    return spark.createDataFrame(rows, f"{KEY} long, model string, target string, score double, y int"), y


def brute(scores: pd.DataFrame, models, grid):
    """First best weights by trying every grid point."""
    out = {}
    for t, part in scores.groupby("target"):
        r = [(part[part.model == m].sort_values(KEY).score.rank(method="average") * 2).astype(int).to_numpy() for m in models]
        y = part[part.model == models[0]].sort_values(KEY).y.to_numpy()
        if y.min() == y.max():
            continue
        best = (-1, None)
        for w in grid:
            b = sum(wi * ri for wi, ri in zip(w, r))
            pos, neg = b[y == 1], b[y == 0]
            pairs = 2 * (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum()
            if pairs > best[0]:
                best = (pairs, w)
        out[t] = (best[1], best[0] / (2 * (y == 1).sum() * (y == 0).sum()))
    return out


def test_grid_sizes():
    assert [len(blend.simplex_grid(k, blend.default_step(k))) for k in (2, 3, 4)] == [51, 231, 286]
    assert len(blend.simplex_grid(2, 5)) == 21
    assert len(blend.fine_grid((20, 20, 30, 30))) == 11**3
    assert all(sum(w) == 100 and min(w) >= 0 for w in blend.fine_grid((0, 0, 0, 100)))
    assert blend.simplex_grid(2, 50) == [(0, 100), (50, 50), (100, 0)]
    assert sum(blend.equal_weights(3)) == 100


@pytest.mark.parametrize("levels", [(), (4, 16, 64)])
def test_search_is_exhaustive(spark, levels):
    """Pruning never changes the winner."""
    scores, _ = make(spark)
    models = ["m0", "m1", "m2"]
    ranks = blend.rank_table(scores, models)
    got = blend.search_weights(ranks, 3, step=10, levels=levels)
    want = brute(scores.toPandas(), models, blend.simplex_grid(3, 10))
    for t, (w, value) in want.items():
        assert got[t]["weights"] == w and got[t]["auc"] == pytest.approx(value)
    assert got["target_2_1"] == {"weights": (100 / 3,) * 3, "auc": 0.5}


@pytest.mark.parametrize("limit,levels", [(30, ()), (200, (8, 64)), (4000, ())])
@pytest.mark.parametrize("k,step", [(2, 2), (3, 10)])
def test_coarse_cells_never_change_the_winner(spark, limit, levels, k, step):
    """Whether cells decide, only rule out, or say nothing."""
    scores, _ = make(spark, n=300, models=k, seed=11)
    models = [f"m{m}" for m in range(k)]
    ranks = blend.rank_table(scores, models)
    got = blend.search_weights(ranks, k, step=step, levels=levels, limit=limit)
    for t, (w, value) in brute(scores.toPandas(), models, blend.simplex_grid(k, step)).items():
        assert got[t]["weights"] == w and got[t]["auc"] == pytest.approx(value)


def test_cells_are_bounded_and_keep_all_rows(spark):
    scores, y = make(spark, n=500, models=3, seed=13)
    ranks = blend.rank_table(scores, ["m0", "m1", "m2"])
    for limit in (27, 64, 10_000):
        cells = blend.rank_cells(ranks, 3, limit).toPandas()
        for t, part in cells.groupby("target"):
            assert len(part) <= max(limit, 0) and part.pos.sum() == y[t].sum() and (part.pos + part.neg).sum() == 500
            low, high = np.stack(part.low), np.stack(part.high)
            assert (low <= high).all() and (limit < 500 or (low == high).all())
    plan = blend.rank_cells(ranks, 3, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # rows are not multiplied by the candidates


def test_bounds_hold_the_exact_count():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(2, 40))
        pos, neg = rng.integers(0, 4, n), rng.integers(0, 4, n)
        low = rng.integers(0, 30, n)
        high = low + rng.integers(0, 6, n)
        value = rng.integers(low, high + 1)
        exact = sum(int(pos[i] * neg[j]) * (2 * (value[i] > value[j]) + (value[i] == value[j])) for i in range(n) for j in range(n))
        least, most = blend.pair_bounds(pos, neg, low, high)
        assert least <= exact <= most
        assert blend.pair_bounds(pos, neg, value, value) == (exact, exact)
    big = np.array([10 ** 10, 0]), np.array([0, 10 ** 10])
    assert blend.pair_bounds(*big, np.array([5, 3]), np.array([5, 3])) == (2 * 10 ** 20, 2 * 10 ** 20)


def test_pruning_drops_losers(spark):
    scores, _ = make(spark, n=400, models=2, seed=3)
    ranks = blend.rank_table(scores, ["m0", "m1"]).where("target = 'target_1_1'")
    points = {"target_1_1": list(enumerate(blend.simplex_grid(2, 2)))}
    kept = blend.prune(ranks, points, 400, levels=(32, 64))
    assert 0 < len(kept["target_1_1"]) < 51


def test_blocked_and_direct_areas_agree(spark):
    scores, _ = make(spark, models=2, seed=5)
    ranks = blend.rank_table(scores, ["m0", "m1"], max_rows=0).where("target != 'target_2_1'")
    points = {t: list(enumerate(blend.simplex_grid(2, 25))) for t in ("target_1_1", "target_1_2")}
    frames = [blend.exact_areas(ranks, points, n).select("target", "o", F.col("pairs2").cast("long").alias("p"), "auc")
              .toPandas().sort_values(["target", "o"]).reset_index(drop=True) for n in (None, 160, blend.DIRECT_ROWS + 1)]
    pd.testing.assert_frame_equal(frames[0], frames[1])
    pd.testing.assert_frame_equal(frames[0], frames[2])


def test_refinement_beats_coarse(spark):
    scores, _ = make(spark, models=4, seed=7)
    ranks = blend.rank_table(scores, [f"m{k}" for k in range(4)])
    coarse = blend.search_weights(ranks, 4, step=20, refine=False)
    fine = blend.search_weights(ranks, 4, step=20, refine=True)
    for t in coarse:
        assert fine[t]["auc"] >= coarse[t]["auc"]
        assert sum(fine[t]["weights"]) == pytest.approx(100)


def test_gate(spark):
    scores, _ = make(spark, models=2)
    ranks = blend.rank_table(scores, ["m0", "m1"])
    solo = {"target_1_1": (0.60, 0.66), "target_1_2": (0.60, 0.65), "target_2_1": (None, None)}
    got = blend.two_model_blend(ranks, solo)
    assert got["target_1_1"] == {"weights": (0, 100), "auc": 0.66}
    assert got["target_1_2"]["weights"][0] % 5 == 0 and got["target_2_1"]["auc"] == 0.5


def test_apply_and_publish(spark):
    scores, _ = make(spark, n=5, models=2)
    ranks = blend.rank_table(scores.drop("y"), ["m0", "m1"])
    found = {t: {"weights": (100, 0), "auc": 0.5} for t in ("target_1_1", "target_1_2", "target_2_1")}
    blended = blend.apply_weights(ranks, found)
    pdf = scores.where("model = 'm0' AND target = 'target_1_1'").toPandas().set_index(KEY).score.rank(pct=True)
    got = blended.where("target = 'target_1_1'").toPandas().set_index(KEY).score
    assert np.allclose(got.sort_index(), pdf.sort_index())
    template = spark.createDataFrame([(0,), (77,)], f"{KEY} long")
    out = publish.submission(blended, template, ["target_1_1", "target_9_9"])
    rows = {r[KEY]: r for r in out.collect()}
    assert out.columns == [KEY, "predict_1_1", "predict_9_9"] and dict(out.dtypes)[KEY] == "int"
    assert rows[77]["predict_1_1"] == -10.0 and rows[0]["predict_9_9"] == -10.0
    assert rows[0]["predict_1_1"] == pytest.approx(np.log(min(pdf[0], 1 - 1e-7) / (1 - min(pdf[0], 1 - 1e-7))))


def test_reports(spark):
    found = {"a": {"weights": (100, 0), "auc": 0.8}, "b": {"weights": (50, 50), "auc": 0.7}, "c": {"weights": (0, 100), "auc": 0.4}}
    report = {r["model"]: r for r in blend.blend_report(blend.weights_table(spark, found, ["x", "y"])).collect()}
    assert report["x"]["mean_weight"] == 0.75 and report["y"]["n_used"] == 2 and report["x"]["n_labels"] == 2
    frame = spark.createDataFrame([("a", 0.8), ("b", 0.7), ("c", None)], "target string, auc double")
    assert {(r["side"], r["target"]) for r in blend.worst_and_best(frame, 1).collect()} == {("worst", "b"), ("best", "a")}


def test_label_report_and_summary(spark):
    found = {"a": {"weights": (99, 1), "auc": 0.8}, "b": {"weights": (50, 50), "auc": 0.4}, "c": {"weights": (50, 50), "auc": 0.5}}
    weights = blend.weights_table(spark, found, ["x", "y"])
    solo = spark.createDataFrame([("x", "a", 0.75), ("y", "a", 0.6), ("x", "b", None)], "model string, target string, auc double")
    rows = {r["target"]: r for r in blend.label_report(weights, solo, ["x", "y"]).collect()}
    assert (rows["a"].solo_x, rows["a"].solo_y, rows["a"].weight_x, rows["a"].blend_auc, rows["a"].n_used) == (0.75, 0.6, 0.99, 0.8, 1)
    assert rows["b"].solo_x is None and rows["c"].n_used == 2
    usable = spark.createDataFrame([("a",), ("b",)], "target string")
    row = blend.blend_summary(weights, usable, "all").first()
    assert row.n_labels == 2 and row.mean_auc == pytest.approx(0.6) and row.mean_auc_above_half == 0.8 and row.min_auc == 0.4


def test_fold_average(spark):
    df = spark.createDataFrame([(1, "m", "t", 0.2), (1, "m", "t", 0.4)], f"{KEY} long, model string, target string, score double")
    assert align.fold_average(df).first()["score"] == pytest.approx(0.3)

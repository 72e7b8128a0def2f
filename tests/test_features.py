"""Small tables with answers worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from takeup.functions import clean as C
from takeup.operators import align, assemble, encode, folds, groupstats, labels, profile, quantiles, reduce, selection, wide
from takeup.roles import KEY, check_features, clean_feature_list, conform, infer_roles, predict_name
from takeup.session import stage
from takeup.sources import tables

NAN, INF = float("nan"), float("inf")


def one(spark, expr, **values):
    cols = [f"{v} as {k}" for k, v in values.items()]
    return spark.range(1).selectExpr(*cols, "1 as _").selectExpr(f"{expr} as r").first()["r"]


def test_guards_and_fills(spark):
    for b, want in (("0.0D", 1000.0), ("0.0005D", 1000.0), ("-0.0005D", -1000.0), ("4.0D", 0.25)):
        assert one(spark, f"1 / {C.signed_guard('b')}", b=b) == pytest.approx(want)
    assert one(spark, C.guard("b"), b="-0.0005D") == 1.0
    assert one(spark, C.fill_number("b"), b="double('NaN')") == 0.0
    assert one(spark, C.fill_number("b"), b="double('Infinity')") == 0.0
    assert one(spark, C.fill_clip("b", 1.0, -5, 5), b="double('Infinity')") == 5.0
    assert one(spark, C.fill_clip("b", 1.0, -5, 5), b="cast(null as double)") == 1.0
    assert one(spark, C.fill_category("b"), b="cast(null as int)") == -1
    assert one(spark, C.category_level("b"), b="cast(null as string)") == "__NA__"
    assert one(spark, C.logit("b"), b="0.0D") == pytest.approx(math.log(1e-7 / (1 - 1e-7)))


def test_roles():
    cols = [KEY, "cat_1", "num_3", "num_feature_7", "Column_0", "target_1_1"]
    roles = infer_roles(cols)
    assert (roles.cats, roles.nums, roles.extras, roles.targets) == (["cat_1"], ["num_3"], ["num_feature_7"], ["target_1_1"])
    assert clean_feature_list(["b", KEY, "Column_1", "a", "gone"], ["a", "b"], limit=1) == ["b"]
    assert clean_feature_list(["b", "a"], ["a", "b"], exclude=["b"]) == ["a"]
    assert predict_name("target_3_1") == "predict_3_1"


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], f"{KEY} long, a double, b string")
    with pytest.raises(TypeError):
        check_features(df)
    assert check_features(df.drop("b")) == ["a"]
    with pytest.raises(ValueError, match="missing"):
        conform(df, ["a", "zz"])


def test_row_aggregates(spark):
    rows = [(1, None, None, None), (2, 0.0, None, 3.0), (3, NAN, INF, -2.0), (4, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, f"{KEY} long, a double, b double, c double")
    got = {r[0]: tuple(r)[1:] for r in wide.row_aggregates(df, ["a", "b", "c"], "x").collect()}
    assert got == {1: (0.0, None, 0, 0), 2: (3.0, 1.5, 2, 1), 3: (-2.0, -2.0, 1, 1), 4: (6.0, 2.0, 3, 3)}
    blocks = {r[0]: tuple(r)[1:] for r in wide.block_aggregates(df, ["a", "b", "c"], 2).collect()}
    assert blocks[1] == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert blocks[4] == (3.0, 1.5, 0.5, 3.0, 3.0, 0.0)
    nulls = {r[0]: tuple(r)[1:] for r in wide.null_pattern(df, ["a", "b", "c"], 2).collect()}
    assert nulls[2] == (1, 0, 0, 1)


def test_cross_target_ties(spark):
    df = spark.createDataFrame([(1, 0.5, 0.7, 0.5)], f"{KEY} long, meta_target_1_1 double, meta_target_1_2 double, meta_target_2_1 double")
    r = wide.cross_target_features(df, ["target_1_1", "target_1_2", "target_2_1"]).first()
    assert [r[f"meta_rank_target_{t}"] for t in ("1_1", "1_2", "2_1")] == [1, 0, 2]
    assert r["meta_all_q25"] == 0.5 and r["meta_all_q75"] == pytest.approx(0.6)
    assert "meta_grp2_mean" not in r.asDict() and r["meta_grp1_max"] == 0.7


def te_rows(spark):
    rows = [(1, "a", 0, 1), (2, "a", 1, 0), (3, "a", 1, 1), (4, None, 0, 1), (5, None, 1, 0), (6, "own", 0, 1),
            (7, "a", None, None), (8, "unseen", None, None), (9, None, None, None)]
    return spark.createDataFrame(rows, f"{KEY} long, cat_1 string, fold int, t int")


@pytest.mark.parametrize("max_rows", [10**6, 0])
def test_oof_encoding(spark, max_rows):
    out = encode.oof_target_encode(te_rows(spark), ["cat_1"], ["t"], max_rows=max_rows)
    got = {r[KEY]: r["te_cat_1_t"] for r in out.collect()}
    p, s = 4 / 6, 50.0
    enc = lambda total, n: (total + s * p) / (n + s)
    want = {1: enc(1, 2), 2: enc(1, 1), 3: enc(1, 1), 4: enc(0, 1), 5: enc(1, 1), 6: p,
            7: enc(2, 3), 8: p, 9: enc(1, 2)}
    assert got == pytest.approx(want)


def test_oof_encoding_ignores_own_label(spark):
    """With the prior taken outside the fold, flipping a row's label leaves its own value alone."""
    rows = te_rows(spark)
    flipped = rows.withColumn("t", F.when(F.col(KEY) == 3, 1 - F.col("t")).otherwise(F.col("t")))
    value = [encode.oof_target_encode(d, ["cat_1"], ["t"], prior="fold").where(f"{KEY} = 3").first()["te_cat_1_t"]
             for d in (rows, flipped)]
    assert value[0] == value[1]


def test_encoding_dispersion_equals_rowwise(spark):
    rows = te_rows(spark)
    table = stage(encode.fit_target_means(rows.where("fold IS NOT NULL"), ["cat_1"], ["t"], "fold"), "enc")
    got = encode.encoding_dispersion(table, ["t"]).first()["std"]
    made = encode.oof_target_encode(rows, ["cat_1"], ["t"]).where("fold IS NOT NULL").toPandas()
    assert got == pytest.approx(made.te_cat_1_t.std(ddof=0))


def test_composite_encoding_null_gets_prior(spark):
    rows = te_rows(spark).withColumn("y", F.col("t").cast("double"))
    out = encode.composite_target_encode(rows, ["cat_1"], "y", F.col("fold").isNotNull())
    got = {r[KEY]: r["cat_1"] for r in out.collect()}
    p = 4 / 6
    assert got[4] == got[9] == got[8] == pytest.approx(p)
    assert got[1] == got[7] == pytest.approx((2 + 50 * p) / 53)


def test_frequency(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], f"{KEY} long, cat_1 string")
    for limit in (10**6, 0):
        got = {r[KEY]: r["freq_cat_1"] for r in encode.frequency_encode(df, ["cat_1"], max_rows=limit).collect()}
        assert got == {1: 0.5, 2: 0.5, 3: 0.25, 4: None}
    filled = encode.frequency_encode(df, ["cat_1"], replace=True)
    assert {r[KEY]: r["cat_1"] for r in filled.collect()}[4] == 0.0


def test_eligible_categories(spark):
    df = spark.range(3000).selectExpr(f"id as {KEY}", "'x' as cat_1", "id % 3 as cat_2", "id as cat_3", "nullif(id % 2, 1) as cat_4")
    assert encode.eligible_categories(df, ["cat_1", "cat_2", "cat_3", "cat_4"]) == ["cat_2"]


@pytest.mark.parametrize("max_rows", [10**6, 0])
def test_group_stats(spark, max_rows):
    rows = [(1, "a", 1.0), (2, "a", 3.0), (3, "single", 5.0), (4, None, 2.0), (5, "a", None), (6, "new", 8.0)]
    df = spark.createDataFrame(rows, f"{KEY} long, cat_1 string, num_1 double")
    out = groupstats.group_features(df.where(f"{KEY} < 6"), df, ["cat_1"], ["num_1"], max_rows=max_rows)
    got = {r[KEY]: (r["zscore_cat_1_num_1"], r["ratio_cat_1_num_1"]) for r in out.collect()}
    sd = math.sqrt(2)
    assert got[1] == pytest.approx((-1 / sd, 0.5))
    assert got[3] == pytest.approx((0.0, 1.0))          # one row: no std, so divided by 1
    assert got[4] == pytest.approx((2.0, 2.0))          # null level matches nothing
    assert got[5] == (0.0, 1.0) and got[6] == pytest.approx((8.0, 8.0))


def test_pairs_and_transforms(spark):
    df = spark.createDataFrame([(1, 6.0, -0.0005), (2, None, 2.0), (3, -8.0, 2.0)], f"{KEY} long, a double, b double")
    got = {r[KEY]: r for r in groupstats.pair_features(df, ["a", "b"]).collect()}
    assert got[1]["div_a_b"] == -1000.0 and got[2]["mult_a_b"] == 0.0 and got[3]["div_a_b"] == -4.0
    t = {r[KEY]: r for r in groupstats.transform_features(df, ["a"]).collect()}
    assert t[3]["log1p_a"] == pytest.approx(math.log(9)) and t[3]["sqrt_a"] == pytest.approx(math.sqrt(8)) and t[2]["sqrt_a"] == 0.0


def test_variance_filter_thresholds(spark):
    df = spark.range(200).selectExpr("CASE WHEN id < 99 THEN id END as few", "CASE WHEN id < 100 THEN double(id) END as enough",
                                     "1.0D as constant", "cast(null as double) as empty", "0.0D as zero")
    cols = df.columns
    assert [r["feature"] for r in profile.varying(profile.column_profile(df, cols)).collect()] == ["enough"]


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((300, 6)) < 0.6, np.nan, rng.normal(2, 3, (300, 6)))
    x[:, 5] = 4.0
    y = np.column_stack([rng.random(300) < 0.1, rng.random(300) < 0.5, np.zeros(300)]).astype(int)
    pdf = pd.DataFrame(np.where(np.isnan(x), None, x), columns=list("abcdef")).astype(float)
    df = spark.createDataFrame(pdf.assign(t0=y[:, 0], t1=y[:, 1], t2=y[:, 2]))
    got = selection.correlation_scores(df, list("abcdef"), ["t0", "t1", "t2"]).toPandas().set_index(["feature", "target"])["corr"]
    full = np.nan_to_num(x)
    for j, f in enumerate("abcdef"):
        for k in range(3):
            want = 0.0 if j == 5 or k == 2 else abs(np.corrcoef(full[:, j], y[:, k])[0, 1])
            assert got[f, f"t{k}"] == pytest.approx(want, abs=1e-9)


def test_normalisation_and_ranking(spark):
    df = spark.createDataFrame([(0, "a", 2.0), (1, "b", 4.0), (2, "c", 4.0)], "ordinal int, feature string, corr double")
    top = selection.top_features(selection.combine(df, None, 0.4), 2).orderBy("rank").collect()
    assert [(r["feature"], r["rank"], r["score"]) for r in top] == [("b", 1, 0.4), ("c", 2, 0.4)]
    zero = df.withColumn("corr", F.lit(0.0))
    assert selection.max_normalised(zero, "corr").agg(F.sum("corr")).first()[0] == 0.0


def test_bin_edges(spark):
    df = spark.range(50).selectExpr("double(id) as spread", "CASE WHEN id < 1 THEN 1.0D END as single", "double(id % 2) as tied",
                                    "CASE WHEN id < 10 THEN double(id) END as ten", "cast(null as double) as none")
    edges = quantiles.collect_arrays(quantiles.bin_edges(df, df.columns), "edges")
    assert np.allclose(edges["spread"], np.quantile(range(50), np.linspace(0, 1, 25)))
    assert np.allclose(edges["single"], np.linspace(-3, 3, 25)) and np.allclose(edges["none"], np.linspace(-3, 3, 25))
    assert np.allclose(edges["tied"], np.linspace(0, 1, 25))
    padded = quantiles.collect_arrays(quantiles.bin_edges(df, ["tied", "ten"], padded=True), "edges")
    assert np.allclose(padded["tied"], np.linspace(-1e-6, 1 + 1e-6, 25)) and np.allclose(padded["ten"], np.linspace(-3, 3, 25))
    coded = quantiles.piecewise_linear_encode(df.selectExpr("bigint(spread) as customer_id", "spread"), {"spread": [0.0, 10.0, 10.0, 20.0]})
    got = {r[0]: r[1] for r in coded.collect()}
    assert got[5] == pytest.approx([0.5, 0, 0]) and got[15] == pytest.approx([1, 1, 0.5])


def test_sketch_quantiles_close(spark):
    df = spark.range(2000).selectExpr("double(id) as x")
    got = quantiles.quantile_table(df, ["x"], 10, exact=False).orderBy("k").toPandas()
    assert np.allclose(got.q, np.arange(11) * 200, atol=3)


def test_quantile_level_two_sided(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=120), 1)
    train = spark.createDataFrame(pd.DataFrame({"x": x}))
    probe = np.concatenate([x, rng.normal(size=50) * 2, [-99.0, 99.0]])
    knots = quantiles.fit_knots(train, ["x"], 40)
    got = quantiles.quantile_level(spark.createDataFrame(pd.DataFrame({"i": range(len(probe)), "x": probe})), knots).toPandas().sort_values("i").x_cdf
    # whole-number positions: rounding in np.quantile would split tied quantiles
    xs, at = np.sort(x), np.arange(40) * (len(x) - 1)
    q = xs[at // 39] + (xs[-(-at // 39)] - xs[at // 39]) * (at % 39) / 39
    ref = np.arange(40) / 39
    want = 0.5 * (np.interp(probe, q, ref) - np.interp(-probe, -q[::-1], -ref[::-1]))
    inside = (probe > q[0]) & (probe < q[-1])
    assert np.allclose(got[inside], want[inside], atol=1e-9)
    assert got.iloc[-2] == 0.0 and got.iloc[-1] == 1.0


def test_inverse_normal(spark):
    from statistics import NormalDist

    from takeup.functions.normal import inverse_normal

    ps = [1e-7, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").selectExpr("p", f"{inverse_normal('p')} as z")
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-7, abs=1e-8)


def test_pca_rank_one(spark):
    df = spark.range(60).selectExpr(f"id as {KEY}", "double(id) as a", "2.0D * id as b", "-1.0D * id as c")
    got = reduce.pca_features(df, df, ["a", "b", "c"], k=2).toPandas().sort_values(KEY)
    want = (np.arange(60) - 29.5) * math.sqrt(6)  # largest loading (b) positive
    shift = got.pca_extra_0 - got.pca_extra_0.mean()
    assert np.allclose(shift, want) and np.allclose(got.pca_extra_0.mean(), 0, atol=1e-6)
    assert got.pca_extra_1.std() < 1e-6
    assert reduce.pca_features(df, df, ["a"], k=2) is None


def test_folds_equal_single_window(spark):
    df = spark.range(3000).selectExpr(f"id as {KEY}", "int(id % 7 = 0) as target_1_1")
    got = folds.multilabel_folds(df, ["target_1_1"], block_digits=2).toPandas().set_index(KEY)
    again = folds.multilabel_folds(df.repartition(5), ["target_1_1"], block_digits=3).toPandas().set_index(KEY)
    assert (got.fold.sort_index() == again.fold.sort_index()).all()  # block size and layout do not matter
    assert len(got) == 3000
    sizes = got.groupby(["stratum", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_reduce_rows_keeps_rare(spark):
    df = spark.range(2000).selectExpr(f"id as {KEY}", "int(id % 500 = 3) as target_1_1", "int(id % 2 = 0) as target_1_2")
    kept = folds.reduce_rows(df, ["target_1_1", "target_1_2"]).toPandas()
    assert kept.target_1_1.sum() == 4 and 500 < len(kept) < 700
    assert folds.rare_targets(df, ["target_1_1", "target_1_2"]) == ["target_1_1"]


def test_key_checks(spark):
    a = spark.createDataFrame([(1,), (2,)], f"{KEY} long")
    b = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], f"{KEY} long, t int")
    with pytest.raises(ValueError, match="partner"):
        assemble.assert_key_aligned(a, b)
    assemble.assert_key_aligned(a, b, both_ways=False)
    with pytest.raises(ValueError, match="repeated"):
        assemble.assert_key_aligned(a.union(a), b)
    with pytest.raises(ValueError):
        assemble.attach_labels(b.select(KEY), b.where("t < 7"), ["t"])
    assert assemble.attach_labels(b.select(KEY), b.where("t < 7"), ["t"], strict=False).where("t IS NULL").count() == 1
    with pytest.raises(ValueError, match="share"):
        assemble.assemble(a, b, b)


def test_align_scores(spark):
    spine = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], f"{KEY} long, t1 int, t2 int")
    scores = spark.createDataFrame([(1, "m", "t1", 0.9), (9, "m", "t1", 0.1), (1, "other", "t1", 0.3)], f"{KEY} long, model string, target string, score double")
    got = {(r[KEY], r["target"]): (r["score"], r["y"]) for r in align.align_scores(spine, scores, ["m"], ["t1", "t2"], spine).collect()}
    assert got == {(1, "t1"): (0.9, 1), (1, "t2"): (0.5, 0), (2, "t1"): (0.5, 0), (2, "t2"): (0.5, 1)}


def test_label_rules(spark):
    df = spark.range(1000).selectExpr(f"id as {KEY}", "int(id < 3) as target_9_9", "int(id < 8) as target_3_1", "int(id < 300) as target_1_1", "0 as target_1_2")
    ts = ["target_9_9", "target_3_1", "target_1_1", "target_1_2"]
    stats = labels.label_stats(df, ts)
    got = {r["target"]: (r["k"], r["w"]) for r in stats.select(
        "target", labels.difficulty(F.col("target"), F.col("rate")).alias("k"), labels.positive_weight(F.col("rate")).alias("w")).collect()}
    assert got == {"target_9_9": ("rare", 50.0), "target_3_1": ("hard", 50.0), "target_1_1": ("normal", 1.0), "target_1_2": ("rare", 1.0)}
    assert [r["target"] for r in labels.eligible(stats, min_pos=50).collect()] == ["target_1_1"]
    empty = labels.label_stats(df.where("false"), ts)
    assert empty.where("rate IS NULL").count() == 4


def test_feature_lists_and_reuse(spark, tmp_path):
    lists = spark.createDataFrame([("global", None, "b", 1, 1.0), ("global", None, "a", 2, 0.5), ("target", "t", "c", 1, 0.2)],
                                  "scope string, target string, feature string, rank int, score double")
    path = str(tmp_path / "lists")
    tables.save_feature_lists(lists, path)
    assert tables.load_feature_list(spark, path) == ["b", "a"]
    assert tables.load_feature_list(spark, path, limit=1) == ["b"]
    assert tables.load_feature_list(spark, path, "target", "t") == ["c"]
    assert not tables.exists(spark, str(tmp_path / "none"))
    built = []
    for _ in range(2):
        tables.reuse_or_build(spark, str(tmp_path / "art"), lambda: built.append(1) or lists)
    assert built == [1]
    for settings in ("other", "other"):
        tables.reuse_or_build(spark, str(tmp_path / "art"), lambda: built.append(2) or lists, settings)
    assert built == [1, 2] and spark.read.parquet(str(tmp_path / "art")).columns == lists.columns
    tables.save(lists, str(tmp_path / "f"), floats=True)
    assert dict(spark.read.parquet(str(tmp_path / "f")).dtypes)["score"] == "float"


def test_level_table_is_read_once_over_all_categories(spark):
    """Every category reads its own directory of the staged table."""
    rows = spark.range(200).selectExpr("id as customer_id", "id % 3 as a", "id % 5 as b", "id % 7 as c", "id % 2 as y", "int(id % 4) as fold")
    plans = [encode.frequency_encode(rows, ["a", "b", "c"]), encode.oof_target_encode(rows, ["a", "b", "c"], ["y"])]
    for out in plans:
        text = out._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in text.split("\n") if "FileScan parquet" in line]
        assert len(scans) == 3 and all(sum(f"= {c})" in line.split("PartitionFilters")[1] for line in scans) == 1 for c in "abc")
    assert plans[0].where("customer_id = 4").first()["freq_a"] == pytest.approx(67 / 200)


def test_hot_levels_of_all_categories_come_from_one_pass(spark):
    rows = spark.range(3000).selectExpr("id as customer_id", "if(id < 1000, 'hot', cast(id as string)) as a", "cast(id as string) as b", "int(id % 2) as fold")
    hot = encode.hot_levels(rows, ["a", "b"], ["fold"], False).collect()
    assert {(r["cat"], r["level"], r["fold"]) for r in hot} == {("a", "hot", 0), ("a", "hot", 1)}
    # beyond the broadcast the same values come from the split shuffle join
    few, many = (encode.frequency_encode(rows, ["a", "b"], **o).orderBy("customer_id").collect() for o in ({}, {"max_rows": 0}))
    assert few == many


def test_repeated_scores_are_an_error(spark):
    spine = spark.createDataFrame([(1,), (2,)], "customer_id long")
    scores = spark.createDataFrame([(1, "m", "t", 0.2), (1, "m", "t", None), (3, "m", "t", 0.9)], "customer_id long, model string, target string, score double")
    got = {(r.customer_id, r.model): r.score for r in align.align_scores(spine, scores, ["m", "n"], ["t"]).collect()}
    assert got == {(1, "m"): 0.2, (1, "n"): 0.5, (2, "m"): 0.5, (2, "n"): 0.5}
    twice = scores.union(spark.createDataFrame([(1, "m", "t", 0.3)], scores.schema))
    with pytest.raises(Exception, match="repeated scores of 1"):
        align.align_scores(spine, twice, ["m", "n"], ["t"]).collect()

"""Shape of the physical plans."""

import re

from pyspark.sql import functions as F

from takeup.operators import assemble, encode, groupstats, profile, selection, wide
from takeup.operators.lookup import fitting, keyed_lookup
from takeup.plans import catalog
from takeup.plans.inputs import Inputs
from takeup.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return plan(df).split("== Physical Plan ==")[1]


def wide_file(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(500).selectExpr("id as customer_id", *[f"double(id % {k + 2}) as c{k}" for k in range(120)]).write.parquet(path)
    return path


def test_scan_reads_only_what_is_used(spark, tmp_path):
    text = physical(tables.scan(spark, wide_file(spark, tmp_path), ["c3"]).where("customer_id > 400"))
    assert "ReadSchema: struct<customer_id:bigint,c3:double>" in text
    assert "PushedFilters: [IsNotNull(customer_id), GreaterThan(customer_id,400)]" in text


def test_row_features_are_narrow(spark, tmp_path):
    df = spark.read.parquet(wide_file(spark, tmp_path))
    cols = df.columns[1:]
    for out in (wide.row_aggregates(df, cols, "x"), wide.null_pattern(df, cols, 50), wide.block_aggregates(df, cols, 50),
                groupstats.pair_features(df, cols[:4]), groupstats.transform_features(df, cols[:4])):
        assert "Exchange" not in physical(out)


def test_profile_moves_partial_sums_only(spark, tmp_path):
    text = physical(profile.column_profile(spark.read.parquet(wide_file(spark, tmp_path)), [f"c{k}" for k in range(120)]))
    assert text.count("Exchange") == 1 and "partial_" in text


def test_bucketed_sets_join_without_exchange(spark):
    for name in ("set_a", "set_b", "set_c"):
        tables.save_bucketed(spark.range(300).selectExpr("id as customer_id", f"id * 2 as {name}_v"), name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = assemble.assemble(*[spark.table(n) for n in ("set_a", "set_b", "set_c")])
        assert "Exchange" not in physical(out) and "SortMergeJoin" in physical(out)
        assert out.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("set_a", "set_b", "set_c"):
            spark.sql(f"DROP TABLE {name}")


def test_no_cross_joins(spark, sf_dir):
    from takeup.plans.catalog import QUERIES

    for name in ("align_scores", "correlation_scores", "quantile_edges", "masked_corruption", "publish_submission"):
        text = physical(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_partitions_do_not_change_results(spark):
    df = spark.range(400).selectExpr("id as customer_id", "string(id % 3) as cat_1", "double(id % 17) as num_1")
    stats = [groupstats.fit_group_stats(d, ["cat_1"], ["num_1"]).select(F.sum("mean_num_1")).first()[0]
             for d in (df, df.repartition(7), df.coalesce(1))]
    assert max(stats) - min(stats) < 1e-9


def test_target_means_do_not_gather_a_category(spark):
    rows = spark.range(2000).selectExpr("string(id % 700) as cat_1", "string(id % 3) as cat_2", "int(id % 5) as fold", "id % 2 as t")
    for prior in ("global", "fold"):
        text = physical(encode.fit_target_means(rows, ["cat_1", "cat_2"], ["t"], "fold", prior=prior))
        assert "hashpartitioning(cat#" in text and not re.search(r"hashpartitioning\(cat#\d+, \d+\)", text)
        assert not re.search(r"Window \[[^\n]*\], \[cat#\d+(, fold#\d+)?\]", text)


def test_lookup_spreads_null_and_unseen_hot_keys(spark):
    rows = spark.range(40000).selectExpr("id", "case when id % 2 = 0 then null when id % 4 = 1 then 'unseen' else string(id % 5003) end as k")
    table = spark.range(5003).selectExpr("string(id) as k", "id * 2 as v", "1 as n")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for bound in ({"max_rows": 10}, {"max_bytes": 1000}):
            out = keyed_lookup(rows, table, ["k"], weight="n", spread_by=["id"], **bound)
            sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 40000 and max(sizes) < 2 * 40000 / 16
            wrong = "not (v <=> if(k is null or k = 'unseen', null, 2 * bigint(try_cast(k as int))))"
            assert out.where(wrong).count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_broadcasts_of_one_call_share_a_bound(spark):
    table = spark.range(300).selectExpr("string(id % 3) as part", "repeat('x', int(100 * (id % 3))) as level")
    assert fitting(table, "part") == {"0", "1", "2"}
    assert fitting(table, "part", max_bytes=20000) == {"0", "1"}
    assert fitting(table, "part", max_rows=99) == set()


def test_selection_sees_every_train_row(spark, sf_dir, monkeypatch):
    seen = {}

    def counted(rows, *args, **options):
        seen["rows"] = rows.count()
        return select(rows, *args, **options)

    select = selection.select_features
    monkeypatch.setattr(selection, "select_features", counted)
    catalog.QUERIES["feature_overlap_all_rows"](spark, sf_dir)
    assert seen["rows"] == Inputs(spark, sf_dir).train_targets().count()


def test_components_are_the_operators_thirty(spark, sf_dir):
    out = catalog.QUERIES["pca_features"](spark, sf_dir)
    assert sum(f.name != "customer_id" for f in out.schema.fields) == 30


def test_co_located_sets_are_joined_without_an_exchange(spark, tmp_path):
    from takeup.sources import tables

    spine = spark.range(50).selectExpr("id as customer_id")
    sets = {f"s{k}": spark.range(60).selectExpr("id as customer_id", f"double(id * {k}) as x{k}") for k in range(4)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = tables.co_located({"spine": spine, **sets}, f"{tmp_path}/sets", 8)
        out = assemble.base_features(placed.pop("spine"), list(placed.values()))
        text = out._jdf.queryExecution().executedPlan().toString()
        assert text.count("SortMergeJoin") == 4 and "Exchange" not in text
        assert out.count() == 50 and out.where("customer_id = 7").first()["x3"] == 21.0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_half_written_sets_are_none(spark, tmp_path):
    from takeup.sources import tables

    spark.range(3).write.parquet(f"{tmp_path}/whole")
    spark.range(3).write.parquet(f"{tmp_path}/half")
    (tmp_path / "half" / "_SUCCESS").unlink()
    found = tables.optional_sets(spark, {n: f"{tmp_path}/{n}" for n in ("whole", "half", "none")})
    assert set(found) == {"whole"}

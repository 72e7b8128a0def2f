"""Client tables derived from the star-schema test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from takeup.functions.hashing import hash_text, hash_uniform

CUTOFF = "2001-01-01"
BRANDS = [f"Brand#{k}" for k in range(1, 26)]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = ["A", "N", "R"]
MODELS = {"m1": 0.30, "m2": 0.25, "m3": 0.15, "m4": 0.05}
CATS = ["cat_1", "cat_2", "cat_3", "cat_4", "cat_5"]
NUMS = [f"num_{i}" for i in range(1, 9)]
BRAND_COLS = [f"num_feature_b_{k}" for k in range(1, 26)]
TYPE_COLS = [f"num_feature_t_{t.lower()}" for t in TYPES]
CROSS_COLS = [f"num_feature_bt_{k}_{t.lower()}" for k in range(1, 26) for t in TYPES]
EXTRAS = BRAND_COLS + TYPE_COLS + CROSS_COLS + ["num_feature_const"]
TARGETS = ([f"target_1_{i}" for i in range(1, 6)] + [f"target_2_{i}" for i in range(1, 7)]
           + [f"target_3_{i}" for i in range(1, 4)] + ["target_4_1", "target_5_1", "target_5_2", "target_6_1"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> str:
    return f"floor({c} * 100 + 0.5)"


def lines(spark: SparkSession, sf_dir: str, past: bool) -> DataFrame:
    """Order lines with their order and part, on one side of the cutoff."""
    orders = table(spark, sf_dir, "orders").where(f"o_orderdate {'<' if past else '>='} timestamp'{CUTOFF}'")
    return (table(spark, sf_dir, "lineitem")
            .join(orders, F.expr("l_orderkey = o_orderkey"))
            .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")))


SPLIT_LITERAL = "'split'"


def split_of(key: str) -> str:
    return f"CASE WHEN substring({hash_text(key, SPLIT_LITERAL)}, 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END"


def _aggregated(df: DataFrame, by: list[str], *exprs: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.expr(e) for e in exprs])


def main_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    past_orders = table(spark, sf_dir, "orders").where(f"o_orderdate < timestamp'{CUTOFF}'")
    by_priority = _aggregated(past_orders, ["o_custkey", "o_orderpriority"],
                              "count(*) as n", f"sum({_cents('o_totalprice')}) as cents")
    order_side = _aggregated(by_priority.withColumnRenamed("o_custkey", "k1"), ["k1"],
                             "min_by(o_orderpriority, struct(-n, o_orderpriority)) as cat_4",
                             "cast(sum(n) as double) as num_2", "sum(cents) / 100.0D as num_3")
    by_part = _aggregated(lines(spark, sf_dir, True), ["o_custkey", "p_brand", "l_partkey"], "count(*) as n",
                          "sum(cast(l_quantity as bigint)) as qty", f"sum({_cents('l_discount')}) as disc",
                          f"sum({_cents('l_tax')}) as tax", "max(l_extendedprice) as price")
    by_brand = _aggregated(by_part, ["o_custkey", "p_brand"], "sum(n) as n", "sum(qty) as qty", "sum(disc) as disc",
                           "sum(tax) as tax", "max(price) as price", "count(*) as parts")
    line_side = _aggregated(by_brand.withColumnRenamed("o_custkey", "k2"), ["k2"],
                            "min_by(p_brand, struct(-qty, p_brand)) as brand", "sum(qty) / sum(n) as num_4",
                            "sum(disc) / sum(n) / 100.0D as num_5", "max(price) as num_6",
                            "cast(sum(parts) as double) as num_7", "sum(tax) / sum(n) / 100.0D as num_8")
    joined = (table(spark, sf_dir, "customer")
              .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"), "left")
              .join(order_side, F.expr("c_custkey = k1"), "left").join(line_side, F.expr("c_custkey = k2"), "left"))
    draw = hash_uniform("c_custkey", "'c5'")
    return joined.selectExpr(
        "c_custkey as customer_id", f"{split_of('c_custkey')} as split", "c_mktsegment as cat_1", "c_nationkey as cat_2",
        "n_regionkey as cat_3", "cat_4", f"CASE WHEN {draw} >= 0.1 THEN brand END as cat_5", "c_acctbal as num_1", *NUMS[1:])


def extra_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide and sparse: past quantity by brand, by brand and type, and mean price by
    type. Lines are reduced to (client, brand, type) before they are pivoted."""
    cells = _aggregated(lines(spark, sf_dir, True), ["o_custkey", "p_brand", "p_type"],
                        "sum(cast(l_quantity as bigint)) as qty", f"sum({_cents('l_extendedprice')}) as cents",
                        "count(*) as n")
    cells = cells.withColumn("cell", F.expr("concat('num_feature_bt_', substring(p_brand, 7, 2), '_', lower(p_type))"))
    cross = cells.groupBy("o_custkey").pivot("cell", CROSS_COLS).agg(F.first("qty"))
    by_type = _aggregated(cells.withColumnRenamed("o_custkey", "k1"), ["k1"], *[
        f"try_divide(sum(CASE WHEN p_type = '{t}' THEN cents END), "
        f"sum(CASE WHEN p_type = '{t}' THEN n END) * 100.0D) as {c}" for t, c in zip(TYPES, TYPE_COLS)])
    brands = [f"cast(aggregate(array_compact(array({', '.join(f'num_feature_bt_{k}_{t.lower()}' for t in TYPES)})), "
              f"cast(null as bigint), (a, v) -> coalesce(a, 0L) + v) as double) as num_feature_b_{k}" for k in range(1, 26)]
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey as customer_id")
    wide = cross.join(by_type, F.expr("o_custkey = k1"))
    return keys.join(wide, F.expr("customer_id = o_custkey"), "left").selectExpr(
        "customer_id", *brands, *TYPE_COLS, *[f"cast({c} as double) as {c}" for c in CROSS_COLS],
        "1.0D as num_feature_const")


def target_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = "p_brand = 'Brand#1' AND p_type = 'ECONOMY'"
    tests = ([f"o_orderpriority = '{p}'" for p in PRIORITIES] + [f"p_type = '{t}'" for t in TYPES]
             + [f"l_returnflag = '{f}'" for f in FLAGS] + ["true", first, f"{first} AND p_size > 40", "false"])
    found = _aggregated(lines(spark, sf_dir, False), ["o_custkey"],
                        *[f"max(cast({c} as int)) as {t}" for t, c in zip(TARGETS, tests)])
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey as customer_id")
    return (keys.join(found, F.expr("customer_id = o_custkey"), "left")
            .selectExpr("customer_id", *[f"coalesce({t}, 0) as {t}" for t in TARGETS]))


def train_keys(df: DataFrame) -> DataFrame:
    return df.where(f"{split_of('customer_id')} = 'train'")


def test_keys(df: DataFrame) -> DataFrame:
    return df.where(f"{split_of('customer_id')} = 'test'")


def score_table(target: DataFrame, models: dict[str, float] = MODELS) -> DataFrame:
    """Long scores of synthetic models: a noisy copy of the label, two decimals so
    that ties occur; some keys are missing from every model."""
    which = ", ".join(f"struct('{m}' as model, {a}D as a)" for m, a in models.items())
    labels = ", ".join(f"struct('{t}' as target, {t} as y)" for t in TARGETS)
    rows = target.selectExpr("*", f"inline(array({which}))")
    kept, u = hash_uniform("customer_id", "model", "'drop'"), hash_uniform("customer_id", "model", "target")
    rows = rows.where(f"{kept} >= 0.02").selectExpr("customer_id", "model", "a", f"inline(array({labels}))")
    return rows.selectExpr("customer_id", "model", "target", "y",
                           f"floor((a * y + (1 - a) * {u}) * 100 + 0.5) / 100.0D as score")


def template_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission rows: the test keys and one key that no table has."""
    keys = test_keys(table(spark, sf_dir, "customer").selectExpr("c_custkey as customer_id"))
    return keys.unionByName(keys.selectExpr("min(-1L) as customer_id"))

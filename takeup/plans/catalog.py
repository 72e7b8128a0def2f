"""Registered queries: one or more per operator, with SQL for an independent check.

both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from takeup.functions import clean as C, normal
from takeup.functions.hashing import hash_uniform
from takeup.operators import (align, assemble, blend, boost, encode, folds, groupstats, labels, learn, metrics, profile,
                              publish, quantiles, reduce, selection, split_gain, wide)
from takeup.plans import standins as S
from takeup.plans.inputs import Inputs
from takeup.plans.oracle import cte, rounded, uniform
from takeup.roles import check_features, clean_feature_list, conform, infer_roles, target_groups
from takeup.session import new_path
from takeup.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MODELS = list(S.MODELS)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir))
        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return register


def r(expr: str, digits: int = 4) -> str:
    """Rounding that both engines do bit for bit."""
    return f"floor(({expr}) * 1e{digits}D + 0.5D) / 1e{digits}D"


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.selectExpr(*[f"{r(f.name, digits)} as {f.name}" if f.dataType.simpleString() in ("double", "float")
                           else f.name for f in df.schema.fields])


def sql_round(cols, digits: int = 4) -> str:
    return ", ".join(f"{rounded(c, digits)} AS {c}" for c in cols)


# -- sources, projections ------------------------------------------------------

@query("role_projection", cte("main") + "SELECT customer_id, num_3, cat_2, num_1 FROM main")  # P1-P3 P11 P12 T6 F8 U3
def _(i: Inputs) -> DataFrame:
    df = i.drop_split()
    roles = infer_roles(df.columns)
    wanted = ["num_3", "Column_0", "cat_2", "no_such_column", "customer_id", "num_1", "num_7"]
    return conform(df, clean_feature_list(wanted, roles.features, limit=3))


@query("parquet_roundtrip", cte("main") + "SELECT customer_id, num_2, (SELECT count(*) FROM main) AS n_rows, "  # S1-S6
       "13::INTEGER AS n_columns FROM main")
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "roundtrip")
    tables.save(i.drop_split().drop("num_8"), path)
    spark, n = i.spark, len(tables.column_names(i.spark, path))
    return tables.scan(spark, path, ["num_2"]).selectExpr(
        "*", f"cast({tables.row_count(spark, path)} as bigint) as n_rows", f"{n} as n_columns")


@query("score_store_roundtrip", cte("score") + """SELECT model, target, 0::INTEGER AS fold, count(*) AS n,
       sum(floor(score*100+0.5)::BIGINT)::BIGINT AS cents, 'num_feature_b_1' AS first_feature
       FROM score WHERE target IN ('target_1_1','target_4_1') GROUP BY 1,2""")  # S7 S8
def _(i: Inputs) -> DataFrame:
    path, lists = new_path(i.spark, "scores"), new_path(i.spark, "lists")
    scores = i.all_scores().where("target IN ('target_1_1', 'target_4_1')").selectExpr("*", "0 as fold")
    tables.save_scores(scores.where("model != 'm1'"), path)
    tables.save_scores(scores.where("model = 'm1'"), path)  # adds a model, keeps the others
    ranked = profile.column_profile(i.extra(), S.EXTRAS[:3]).selectExpr(
        "'global' as scope", "cast(null as string) as target", "feature", "ordinal + 1 as rank", "1.0D as score")
    tables.save_feature_lists(ranked, lists)
    first = tables.load_feature_list(i.spark, lists, limit=1)[0]
    return tables.load_scores(i.spark, path).groupBy("model", "target", "fold").agg(
        F.count("*").alias("n"), F.expr("sum(cast(floor(score * 100 + 0.5) as bigint)) as cents"),
        F.lit(first).alias("first_feature"))


@query("optional_feature_sets", cte("main", "extra") + f"""SELECT customer_id, num_2, 1::INTEGER AS n_sets,
       list_count([{', '.join(S.EXTRAS)}])::INTEGER AS global_extra_nonnull FROM main JOIN extra USING (customer_id)""")  # S9 S11
def _(i: Inputs) -> DataFrame:
    root = new_path(i.spark, "sets")
    tables.reuse_or_build(i.spark, f"{root}/aggs", lambda: wide.row_aggregates(i.extra(), S.EXTRAS, "global_extra"))
    again = tables.reuse_or_build(i.spark, f"{root}/aggs", lambda: i.extra().where("false"))
    sets = tables.optional_sets(i.spark, {"aggs": f"{root}/aggs", "encodings": f"{root}/none"})
    joined = assemble.assemble(i.main().select("customer_id", "num_2"),
                               *[again.select("customer_id", "global_extra_nonnull") for _ in sets])
    return joined.selectExpr("*", f"{len(sets)} as n_sets")


@query("resume_remaining_units", cte("folds") + """SELECT model, target, fold FROM (VALUES ('m1'),('m2')) a(model),
       (VALUES ('target_1_1'),('target_4_1')) b(target), (SELECT DISTINCT fold FROM folds)
       WHERE NOT (model='m1' AND (target='target_1_1' OR fold < 2))""")  # S10
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "scores")
    done = (i.all_scores().join(i.folds().select("customer_id", "fold"), "customer_id")
            .where("model = 'm1' AND (target = 'target_1_1' OR target = 'target_4_1' AND fold < 2)"))
    tables.save_scores(done, path)
    units = i.folds().select("fold").distinct().selectExpr(
        "fold", "inline(array(struct('m1' as model), struct('m2' as model)))").selectExpr(
        "model", "inline(array(struct('target_1_1' as target), struct('target_4_1' as target)))", "fold")
    return tables.remaining_units(units, tables.load_scores(i.spark, path))


@query("label_lookup", cte("template", "target", "train_target") + """SELECT 'lenient' AS mode, customer_id, target_1_1, target_4_1
       FROM template LEFT JOIN target USING (customer_id)
       UNION ALL SELECT 'strict', customer_id, target_1_1, target_4_1 FROM train_target""")  # J4 J5 P18
def _(i: Inputs) -> DataFrame:
    wanted = ["target_1_1", "target_4_1"]
    lenient = assemble.attach_labels(i.template(), i.target(), wanted, strict=False)
    strict = assemble.attach_labels(S.train_keys(i.main()).select("customer_id"), i.target(), wanted)
    return lenient.selectExpr("'lenient' as mode", "*").unionByName(strict.selectExpr("'strict' as mode", "*"))


@query("train_test_union", cte("main") + "SELECT customer_id, cat_1, num_1, split FROM main")  # U1 U2
def _(i: Inputs) -> DataFrame:
    return assemble.stack(S.train_keys(i.drop_split()), S.test_keys(i.drop_split()), ["customer_id", "cat_1", "num_1"])


@query("key_alignment_check", cte("template", "splits") + """SELECT 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right,
       (SELECT count(*) FROM splits WHERE customer_id NOT IN (SELECT customer_id FROM template)) AS missing_left,
       (SELECT count(*) FROM template WHERE customer_id NOT IN (SELECT customer_id FROM splits)) AS missing_right,
       (SELECT count(*) FROM template JOIN splits USING (customer_id)) AS matched""")  # P18
def _(i: Inputs) -> DataFrame:
    return assemble.key_report(i.template(), i.main())


@query("typed_fill_projection", cte("main", "extra") + f"""SELECT customer_id, coalesce(cat_2, -1) AS code,
       coalesce(cat_5, '__NA__') AS level, {rounded("coalesce(num_4,0)::FLOAT::DOUBLE")} AS stored,
       {rounded("least(greatest(coalesce(num_feature_b_1,0),5),40)")} AS clipped,
       {rounded("1/(CASE WHEN abs(num_1/1e6) < 0.001 THEN CASE WHEN num_1 >= 0 THEN 0.001 ELSE -0.001 END ELSE num_1/1e6 END)")} AS guarded,
       (num_feature_b_1 IS NULL)::INTEGER AS missing, (num_1 <> 0) AS is_nonzero
       FROM main JOIN extra USING (customer_id)""")  # P4-P10 F7
def _(i: Inputs) -> DataFrame:
    df = i.main().join(i.extra(), "customer_id")
    return df.selectExpr(
        "customer_id", f"{C.fill_category('cat_2')} as code", f"{C.category_level('cat_5')} as level",
        f"{r(C.fill_float('num_4'))} as stored", f"{r(C.fill_clip('num_feature_b_1', 0.0, 5.0, 40.0))} as clipped",
        f"{r('1 / ' + C.signed_guard('(num_1 / 1e6D)'))} as guarded", f"{C.null_flag('num_feature_b_1')} as missing",
        "num_1 != 0 as is_nonzero")


@query("feature_assembly", cte("template", "main", "extra") + "SELECT t.customer_id, "
       + ", ".join(f"{rounded(f'coalesce({c},0)::FLOAT::DOUBLE')} AS {c}" for c in [*S.NUMS, *S.TYPE_COLS])
       + ", coalesce(list_count([" + ", ".join(f"e.{c}" for c in S.EXTRAS)
       + "]),0)::DOUBLE AS global_extra_nonnull, coalesce(num_feature_b_1,0)::DOUBLE AS num_feature_b_1 "
       "FROM template t LEFT JOIN main USING (customer_id) LEFT JOIN extra e ON e.customer_id=t.customer_id")  # J1-J3 M12 M13 P5
def _(i: Inputs) -> DataFrame:
    aggs = wide.row_aggregates(i.extra(), S.EXTRAS, "global_extra").select("customer_id", "global_extra_nonnull")
    base = assemble.base_features(i.template(), [i.main().select("customer_id", *S.NUMS),
                                                 i.extra().select("customer_id", *S.TYPE_COLS), aggs])
    return round_doubles(assemble.with_label_features(base, i.extra(), ["num_feature_b_1", "num_feature_t_large", "gone"]))


# -- labels, folds, sampling -----------------------------------------------------

_STATS = """SELECT ord, target, count(*) AS n, sum(y)::BIGINT AS n_pos, sum(y)::BIGINT/count(*) AS rate
    FROM long_target JOIN names USING (target) JOIN splits USING (customer_id) WHERE split='train' GROUP BY 1,2"""


@query("label_stats", cte("long_target", "names", "splits", stats=_STATS) + f"""SELECT target, n, n_pos, {rounded('rate', 6)} AS rate,
       CASE WHEN rate < 0.005 THEN 'rare' WHEN target IN ('target_3_1','target_5_2','target_6_1','target_9_3','target_9_6')
            THEN 'hard' ELSE 'normal' END AS kind,
       n_pos >= 50 AS enough, rate >= 0.002 AS common, n_pos > 0 AND n_pos < n AS two_class FROM stats""")  # A1 A2 P16 P20
def _(i: Inputs) -> DataFrame:
    stats = labels.label_stats(i.train_targets(), S.TARGETS)
    kind = labels.difficulty(F.col("target"), F.col("rate"))
    flags = {"enough": dict(min_pos=50), "common": dict(min_rate=0.002), "two_class": dict(both_classes=True)}
    out = stats.withColumn("kind", kind)
    for name, rule in flags.items():
        hit = labels.eligible(stats, **rule).select("target", F.lit(True).alias(name))
        out = out.join(F.broadcast(hit), "target", "left").na.fill({name: False})  # one row per label
    return out.selectExpr("target", "n", "n_pos", f"{r('rate', 6)} as rate", "kind", *flags)


@query("class_weights", cte("long_target", "names", "splits", stats=_STATS) + f"""SELECT target,
       {rounded('CASE WHEN rate > 0 AND rate < 0.01 THEN least(1/rate, 50) ELSE 1 END')} AS weight,
       {rounded('CASE WHEN rate > 0 AND rate < 0.05 THEN least(1/rate, 50) ELSE 1 END')} AS weight_5pct FROM stats""")  # M24
def _(i: Inputs) -> DataFrame:
    stats = labels.label_stats(i.train_targets(), S.TARGETS)
    return round_doubles(stats.select("target", labels.positive_weight(F.col("rate")).alias("weight"),
                                      labels.positive_weight(F.col("rate"), threshold=0.05).alias("weight_5pct")))


@query("stratified_folds", cte("folds") + "SELECT customer_id, stratum, fold FROM folds")  # A20 W3
def _(i: Inputs) -> DataFrame:
    return folds.multilabel_folds(i.train_targets(), S.TARGETS)


_RARE_HIT = " OR ".join(f"({t}=1 AND (SELECT sum({t}) < count(*)*0.01 FROM train_target))" for t in S.TARGETS)


@query("turbo_sample", cte("train_target") + f"""SELECT customer_id FROM train_target WHERE {_RARE_HIT}
       OR {uniform("customer_id||'-42-rows'")} < 0.3""")  # P14 R1 U4
def _(i: Inputs) -> DataFrame:
    return folds.reduce_rows(i.train_targets(), S.TARGETS).select("customer_id")


# -- encodings -------------------------------------------------------------------

@query("frequency_encode", cte("main") + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c})/(count(*) OVER ())::DOUBLE END', 6)} AS freq_{c}"
    for c in S.CATS) + " FROM main")  # U1 A5 J6 M3
def _(i: Inputs) -> DataFrame:
    both = assemble.stack(S.train_keys(i.drop_split()), S.test_keys(i.drop_split()), ["customer_id", *S.CATS])
    out = encode.frequency_encode(both, S.CATS)
    return round_doubles(out.select("customer_id", *[f"freq_{c}" for c in S.CATS]), 6)


TE_LABELS = S.TARGETS
_TE_ROWS = """SELECT m.customer_id, fold, cat, level, {labels} FROM (
    SELECT customer_id, cat, level FROM (SELECT customer_id, {levels} FROM main)
    UNPIVOT INCLUDE NULLS (level FOR cat IN ({cats}))) m
    LEFT JOIN folds USING (customer_id) JOIN target USING (customer_id)"""


def _te_ctes(targets, null_level: str = "coalesce({c}::VARCHAR,'__NA__')") -> str:
    """Refit per fold: statistics of the other folds for train rows, of all train
    rows (fold -1) for test rows."""
    rows = _TE_ROWS.format(labels=", ".join(targets), cats=", ".join(S.CATS),
                           levels=", ".join(f"{null_level.format(c=c)} AS {c}" for c in S.CATS))
    fit = f"""SELECT cat, level, k, {", ".join(f"sum({t}) FILTER (WHERE fold<>k) AS s_{t}" for t in targets)},
        count(*) FILTER (WHERE fold<>k) AS n FROM te_rows, (SELECT unnest([-1,0,1,2,3,4]) AS k)
        WHERE fold IS NOT NULL GROUP BY 1,2,3"""
    priors = f"SELECT {', '.join(f'avg({t}) AS p_{t}' for t in targets)} FROM target JOIN folds USING (customer_id)"
    values = ", ".join(f"coalesce((s_{t} + 50*p_{t})/(n+50), p_{t}) AS {t}" for t in targets)
    encoded = f"""SELECT r.customer_id, r.fold, r.cat, {values} FROM te_rows r LEFT JOIN fit f
        ON f.cat=r.cat AND f.level=r.level AND f.k=coalesce(r.fold,-1), priors"""
    return cte("main", "folds", "target", te_rows=rows, fit=fit, priors=priors, encoded=encoded)


@query("oof_target_encode", _te_ctes(TE_LABELS) + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'''max({t}) FILTER (WHERE cat='{c}')''', 6)} AS te_{c}_{t}" for t in TE_LABELS for c in S.CATS)
       + " FROM encoded GROUP BY 1")  # A7 W5 J8 J11 M1
def _(i: Inputs) -> DataFrame:
    out = encode.oof_target_encode(i.main_with_folds(), S.CATS, TE_LABELS)
    return round_doubles(out.select("customer_id", *[f"te_{c}_{t}" for t in TE_LABELS for c in S.CATS]), 6)


@query("oof_target_encode_matrix", _te_ctes(S.TARGETS).rstrip() + f""",
     long AS (SELECT customer_id, fold, 'te_'||cat||'_'||target AS name, cat, target, e FROM encoded
              UNPIVOT (e FOR target IN ({', '.join(S.TARGETS)})) WHERE target IN (SELECT target FROM names)),
     best AS (SELECT name, std FROM (SELECT name, cat, ord, stddev_pop(e) AS std FROM long JOIN names USING (target)
              WHERE fold IS NOT NULL GROUP BY 1,2,3) ORDER BY std DESC, ord, cat LIMIT 20)
     SELECT name, {rounded('std', 6)} AS std, count(*) AS n, {rounded('sum(e)', 3)} AS total
     FROM long JOIN best USING (name) GROUP BY name, std""".replace(
         "long AS (", "names AS (SELECT * FROM (VALUES " + ", ".join(f"({k},'{t}')" for k, t in enumerate(S.TARGETS))
         + f") v(ord, target) JOIN (FROM (SELECT {', '.join(f'avg({t}) AS {t}' for t in S.TARGETS)} FROM target JOIN folds USING (customer_id))"
         f" UNPIVOT (rate FOR target IN ({', '.join(S.TARGETS)}))) USING (target) WHERE rate >= 0.002),\n     long AS ("))  # J11 T3 A15
def _(i: Inputs) -> DataFrame:
    rows = i.main_with_folds()
    stats = labels.label_stats(rows.where("fold IS NOT NULL"), S.TARGETS)
    usable = [t["target"] for t in labels.eligible(stats, min_rate=0.002).orderBy("ordinal").collect()]
    out = encode.oof_target_encode(rows, S.CATS, usable, top=20)
    made = [c for c in out.columns if c.startswith("te_")]
    stats = profile.column_profile(out.where("fold IS NOT NULL"), made).selectExpr("feature as name", "std0 as std")
    cells = profile.named(profile.column_cells(out, made), made, name="name")
    totals = cells.groupBy("name").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    # one row per encoding
    return totals.join(F.broadcast(stats), "name").selectExpr(
        "name", f"{r('std', 6)} as std", "n", f"{r('total', 3)} as total")


_COMPOSITE = "(" + "+".join(S.TARGETS) + f")/{len(S.TARGETS)}.0"


@query("composite_target_encode", cte("main", "folds", "target", y=f"SELECT customer_id, {_COMPOSITE} AS y FROM target",
       p="SELECT avg(y) AS p FROM y JOIN folds USING (customer_id)") + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'coalesce(e_{c}, p)', 6)} AS {c}" for c in S.CATS) + " FROM main, p " + " ".join(
    f"LEFT JOIN (SELECT {c}, (sum(y)+50*any_value(p))/(count(*)+50) AS e_{c} FROM main JOIN folds USING (customer_id) "
    f"JOIN y USING (customer_id), p WHERE {c} IS NOT NULL GROUP BY 1) t_{c} ON t_{c}.{c}=main.{c}" for c in S.CATS))  # A21 M2 J8
def _(i: Inputs) -> DataFrame:
    rows = i.main_with_folds().withColumn("y", labels.composite_label(S.TARGETS))
    out = encode.composite_target_encode(rows, S.CATS, "y", F.col("fold").isNotNull())
    return round_doubles(out.select("customer_id", *S.CATS), 6)


@query("category_eligibility", cte("main") + " UNION ALL ".join(
    f"SELECT '{c}' AS cat, CASE WHEN n <= 500 THEN n END AS n_levels, n > 500 AS too_many, n BETWEEN 2 AND 500 AS eligible "
    f"FROM (SELECT count(DISTINCT {c}) AS n FROM main WHERE split='train')" for c in [*S.CATS, "customer_id", "split"]))  # A8 P17
def _(i: Inputs) -> DataFrame:
    names = [*S.CATS, "customer_id", "split"]
    train = S.train_keys(i.main())
    good = set(encode.eligible_categories(train, names))
    return encode.distinct_levels(train, names).withColumn("eligible", F.col("cat").isin(*good))


# -- numeric families --------------------------------------------------------------

def _guard(x: str) -> str:
    return f"CASE WHEN abs({x}) < 0.001 THEN 1.0 ELSE {x} END"


def _group_sql() -> str:
    joins = " ".join(
        f"LEFT JOIN (SELECT {c}, {', '.join(f'avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}' for n in S.NUMS)} "
        f"FROM main WHERE split='train' GROUP BY 1) g_{c} ON g_{c}.{c}=main.{c}" for c in S.CATS)
    cols = []
    for c in S.CATS:
        for n in S.NUMS:
            mean, std = f"g_{c}.m_{n}", f"coalesce(g_{c}.s_{n},1)"
            cols.append(f"{rounded(f'coalesce((main.{n}-coalesce({mean},0))/({_guard(std)}),0)')} AS zscore_{c}_{n}")
            ratio = f"main.{n}/({_guard(f'coalesce({mean},1)')})"
            cols.append(f"{rounded(f'least(greatest(coalesce({ratio},1),-100),100)')} AS ratio_{c}_{n}")
    return cte("main") + f"SELECT main.customer_id, {', '.join(cols)} FROM main {joins}"


@query("group_zscore_ratio", _group_sql())  # A6 J7 F3 M4
def _(i: Inputs) -> DataFrame:
    rows = i.drop_split()
    out = groupstats.group_features(S.train_keys(rows), rows, S.CATS, S.NUMS)
    return round_doubles(out.drop(*S.CATS, *S.NUMS))


_PAIRS = [(a, b) for k, a in enumerate(S.NUMS) for b in S.NUMS[k + 1:]]
_SIGNED = "CASE WHEN abs({b}) < 0.001 THEN CASE WHEN {b} >= 0 THEN 0.001 ELSE -0.001 END ELSE {b} END"


@query("pairwise_interactions", cte("main") + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'coalesce({a}*{b},0)')} AS mult_{a}_{b}, "
    f"{rounded(f'least(greatest(coalesce({a}/({_SIGNED.format(b=b)}),0),-1000),1000)')} AS div_{a}_{b}"
    for a, b in _PAIRS) + " FROM main")  # J12 F2 M5
def _(i: Inputs) -> DataFrame:
    return round_doubles(groupstats.pair_features(i.main().select("customer_id", *S.NUMS), S.NUMS).drop(*S.NUMS))


@query("numeric_transforms", cte("main") + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'coalesce(ln(1+abs({c})),0)')} AS log1p_{c}, {rounded(f'coalesce(sqrt(abs({c})),0)')} AS sqrt_{c}"
    for c in S.NUMS) + " FROM main")  # F1 M6
def _(i: Inputs) -> DataFrame:
    return round_doubles(groupstats.transform_features(i.main().select("customer_id", *S.NUMS), S.NUMS).drop(*S.NUMS))


# -- row-wise over wide tables -----------------------------------------------------

def _arr(cols) -> str:
    return "[" + ", ".join(cols) + "]"


def _row_sql(cols, prefix: str, nonnull: bool) -> str:
    x = _arr(cols)
    parts = {"sum": rounded(f"coalesce(list_sum({x}),0)"), "mean": rounded(f"list_avg({x})"),
             "nonnull": f"list_count({x})::INTEGER", "nonzero": f"len([v FOR v IN {x} IF v <> 0])::INTEGER"}
    if not nonnull:
        del parts["nonnull"]
    return cte("extra") + "SELECT customer_id, " + ", ".join(f"{e} AS {prefix}_{n}" for n, e in parts.items()) + " FROM extra"


@query("row_global_aggs", _row_sql(S.EXTRAS, "global_extra", True))  # A9 D3 D4
def _(i: Inputs) -> DataFrame:
    return round_doubles(wide.row_aggregates(i.extra(), S.EXTRAS, "global_extra"))


@query("row_local_aggs", _row_sql(S.EXTRAS[:100], "local_extra", False))  # A10
def _(i: Inputs) -> DataFrame:
    df = i.extra()
    return round_doubles(wide.row_aggregates(df, clean_feature_list(S.EXTRAS, df.columns, 100), "local_extra",
                                             with_nonnull=False))


_BLOCKS = [S.EXTRAS[k:k + 50] for k in range(0, len(S.EXTRAS), 50)]


@query("null_pattern_blocks", cte("extra") + "SELECT customer_id, " + ", ".join(
    f"({len(b)}-list_count({_arr(b)}))::INTEGER AS nullcnt_{g}, "
    f"len([v FOR v IN {_arr(b)} IF v <> 0])::INTEGER AS nonzero_{g}" for g, b in enumerate(_BLOCKS)) + " FROM extra")  # A13
def _(i: Inputs) -> DataFrame:
    return wide.null_pattern(i.extra(), S.EXTRAS, 50)


@query("subgroup_aggs", cte("extra") + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'list_{f}([coalesce(v,0) FOR v IN {_arr(b)}])')} AS subgroup_{n}_{g}"
    for g, b in enumerate(_BLOCKS) for n, f in (("sum", "sum"), ("mean", "avg"), ("std", "stddev_pop"))) + " FROM extra")  # A14
def _(i: Inputs) -> DataFrame:
    return round_doubles(wide.block_aggregates(i.extra(), S.EXTRAS, 50))


def _cross_sql() -> str:
    groups = {"all": S.TARGETS, **{f"grp{g}": ts for g, ts in target_groups(S.TARGETS).items() if len(ts) > 1}}
    cols = [f"meta_{t}" for t in S.TARGETS]
    for n, ts in groups.items():
        x = _arr([f"meta_{t}" for t in ts])
        cols += [f"{rounded(f'list_avg({x})')} AS meta_{n}_mean", f"list_max({x}) AS meta_{n}_max",
                 f"{rounded(f'list_stddev_pop({x})')} AS meta_{n}_std"]
    x = _arr([f"meta_{t}" for t in S.TARGETS])
    cols += [f"list_min({x}) AS meta_all_min"]
    cols += [f"{rounded(f'''list_aggregate({x}, 'quantile_cont', {q})''')} AS meta_all_{n}" for n, q in (("q25", 0.25), ("q75", 0.75))]
    cols += [f"rank_{t}::INTEGER AS meta_rank_{t}" for t in S.TARGETS]
    wide_sql = ", ".join(f"max(score) FILTER (WHERE target='{t}') AS meta_{t}, max(place) FILTER (WHERE target='{t}') AS rank_{t}"
                         for t in S.TARGETS)
    return cte("aligned", "names") + f"""SELECT customer_id, {', '.join(cols)} FROM (SELECT customer_id, {wide_sql} FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, ord) - 1 AS place
        FROM aligned JOIN names USING (target) WHERE model='m1') GROUP BY 1)"""


@query("cross_target_features", _cross_sql())  # A11 A12 W2 M11
def _(i: Inputs) -> DataFrame:
    scores = align.align_scores(i.target(), i.score(), ["m1"], S.TARGETS)
    meta = align.to_wide(scores, S.TARGETS, "meta_")
    out = wide.cross_target_features(meta, S.TARGETS)
    exact = {f"meta_{t}" for t in S.TARGETS} | {c for c in out.columns if c.endswith(("_max", "_min"))}
    return out.selectExpr(*[c if c in exact or "rank" in c or c == "customer_id" else f"{r(c)} as {c}" for c in out.columns])


# -- column profiles and selection -------------------------------------------------

_PROFILE = """SELECT ord, feature, count(*) AS n_rows, count(x) AS n_valid,
    sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_nonzero, avg(x) AS mean, var_pop(x) AS var,
    avg(coalesce(x,0)) AS mean0, var_pop(coalesce(x,0)) AS var0, stddev_pop(coalesce(x,0)) AS std0
    FROM extra_cells GROUP BY 1,2"""
_KEPT = f"SELECT * FROM ({_PROFILE}) WHERE n_valid >= 100 AND var > 1e-6 AND n_nonzero/n_valid > 0.001"


@query("column_profile", cte("extra_cells", prof=_PROFILE) + f"""SELECT ord::INTEGER AS ordinal, feature, n_rows, n_valid,
       n_nonzero, {sql_round(['mean', 'var', 'mean0', 'var0', 'std0'], 3)} FROM prof""")  # A3 A15 A24
def _(i: Inputs) -> DataFrame:
    return round_doubles(profile.column_profile(S.train_keys(i.extra()), S.EXTRAS), 3)


@query("variance_filter", cte("extra_cells", kept=_KEPT) + "SELECT feature, n_valid FROM kept")  # P15
def _(i: Inputs) -> DataFrame:
    return profile.varying(profile.column_profile(S.train_keys(i.extra()), S.EXTRAS)).select("feature", "n_valid")


@query("correlation_scores", cte("corr") + f"SELECT feature, target, {rounded('corr')} AS corr FROM corr")  # A4 D6
def _(i: Inputs) -> DataFrame:
    out = selection.correlation_scores(i.train_extra_targets(), S.EXTRAS, S.TARGETS)
    return round_doubles(out.select("feature", "target", "corr"))


_GLOBAL = """SELECT ord, feature, 0.4*sum(corr)/max(sum(corr)) OVER () AS score FROM corr GROUP BY 1,2"""
_EACH = """SELECT ord, feature, target, 0.35*corr/CASE WHEN max(corr) OVER (PARTITION BY target) > 0
    THEN max(corr) OVER (PARTITION BY target) ELSE 1 END AS score FROM corr"""


@query("topk_features_global", cte("corr", scored=_GLOBAL) + f"""SELECT feature, (row_number() OVER (ORDER BY score DESC, ord))::INTEGER AS rank,
       {rounded('score')} AS score FROM scored ORDER BY score DESC, ord LIMIT 70""")  # T1 A19 A22
def _(i: Inputs) -> DataFrame:
    corr = selection.correlation_scores(i.train_extra_targets(), S.EXTRAS, S.TARGETS)
    scored = selection.combine(selection.global_scores(corr, "corr"), None, 0.4)
    return round_doubles(selection.top_features(scored, 70))


@query("topk_features_per_target", cte("corr", scored=_EACH) + f"""SELECT target, feature, rank, {rounded('score')} AS score FROM (
       SELECT *, (row_number() OVER (PARTITION BY target ORDER BY score DESC, ord))::INTEGER AS rank FROM scored)
       WHERE rank <= 15""")  # T2 A22
def _(i: Inputs) -> DataFrame:
    corr = selection.correlation_scores(i.train_extra_targets(), S.EXTRAS, S.TARGETS)
    return round_doubles(selection.top_features(selection.combine(corr, None, 0.35, ["target"]), 15, ["target"]))


_SEL = dict(
    sample=f"SELECT customer_id FROM train_target WHERE {_RARE_HIT} OR {uniform('customer_id||' + chr(39) + '-42-rows' + chr(39))} < 0.3",
    cells="SELECT * FROM extra_cells WHERE customer_id IN (SELECT customer_id FROM sample)",
    kept="""SELECT ord, feature FROM (SELECT ord, feature, count(x) AS n, var_pop(x) AS v, avg((x <> 0)::INTEGER) AS z FROM cells
            GROUP BY 1,2) WHERE n >= 20 AND v > 1e-6 AND z > 0.001""",
    scor="""SELECT ord, feature, target, CASE WHEN sx < 1e-8 THEN 0.0 ELSE abs(c/(sx*CASE WHEN sy < 1e-8 THEN 1.0 ELSE sy END)) END AS corr
            FROM (SELECT ord, feature, target, covar_pop(coalesce(x,0), y) AS c, stddev_pop(coalesce(x,0)) AS sx, stddev_pop(y) AS sy
                  FROM cells JOIN kept USING (ord, feature) JOIN long_target USING (customer_id) GROUP BY 1,2,3)""",
    g=_GLOBAL.replace("FROM corr", "FROM scor"), e=_EACH.replace("FROM corr", "FROM scor"),
    lists="""SELECT 'global' AS scope, NULL AS target, feature, (row_number() OVER (ORDER BY score DESC, ord))::INTEGER AS rank, score FROM g
             QUALIFY rank <= 40 UNION ALL SELECT 'target', target, feature,
             (row_number() OVER (PARTITION BY target ORDER BY score DESC, ord))::INTEGER AS rank, score FROM e QUALIFY rank <= 15""")


_OVERLAP = """SELECT
       (SELECT count(DISTINCT feature) FROM lists WHERE scope='target') AS n_distinct,
       (SELECT count(*) FROM lists WHERE scope='global' AND rank <= 30 AND feature IN
         (SELECT feature FROM lists WHERE scope='target')) AS n_in_global"""
# the same statistics over every train row
_SEL_ALL = {**_SEL, "sample": "SELECT customer_id FROM train_target"}


def _selected(i: Inputs, reduced: bool = False) -> DataFrame:
    rows = i.extra().join(folds.reduce_rows(i.train_targets(), S.TARGETS), "customer_id") if reduced else i.train_extra_targets()
    return selection.select_features(rows, S.EXTRAS, S.TARGETS, top_global=40, top_per_target=15, min_valid=20)


@query("feature_selection", cte("train_target", "long_target", "extra_cells", **_SEL)
       + f"SELECT scope, target, feature, rank, {rounded('score')} AS score FROM lists")  # M8 P14 P15 A4 T1 T2
def _(i: Inputs) -> DataFrame:
    return round_doubles(_selected(i, reduced=True))


@query("feature_overlap", cte("train_target", "long_target", "extra_cells", **_SEL) + _OVERLAP)  # A26 U3
def _(i: Inputs) -> DataFrame:
    return selection.feature_overlap(_selected(i, reduced=True), 30)


@query("feature_selection_all_rows", cte("train_target", "long_target", "extra_cells", **_SEL_ALL)
       + f"SELECT scope, target, feature, rank, {rounded('score')} AS score FROM lists")  # M8 P14 P15 A4 T1 T2
def _(i: Inputs) -> DataFrame:
    return round_doubles(_selected(i))


@query("feature_overlap_all_rows", cte("train_target", "long_target", "extra_cells", **_SEL_ALL) + _OVERLAP)  # A26 U3
def _(i: Inputs) -> DataFrame:
    return selection.feature_overlap(_selected(i), 30)


# best single split of every feature: rows and positives on both sides of every cut, gradients of the logistic loss at the label's rate
_SPLIT = dict(
    nz="SELECT ord, x FROM extra_cells WHERE x <> 0",
    lists_="SELECT ord, list(x ORDER BY x) AS x, min(x) AS least, min(x) FILTER (WHERE x > 0) AS first FROM nz GROUP BY 1",
    cuts="""SELECT DISTINCT ord, c FROM (SELECT ord, first AS c FROM lists_ WHERE first IS NOT NULL UNION ALL
      SELECT ord, 0.0 FROM lists_ WHERE least < 0 UNION ALL
      SELECT ord, x[1 + (k*(len(x)-1))//255] + (x[1 + (k*(len(x)-1) + 254)//255] - x[1 + (k*(len(x)-1))//255]) * ((k*(len(x)-1)) % 255)/255.0
      FROM lists_, (SELECT unnest(range(255)) AS k))""",
    cl="SELECT ord, list(c ORDER BY c) AS cl FROM cuts GROUP BY 1",
    binned="""SELECT customer_id, ord, feature, coalesce(len(list_filter(cl, lambda c: c <= coalesce(x, 0))), 0) AS bin
      FROM extra_cells LEFT JOIN cl USING (ord)""",
    able="""SELECT target, sum(y)::BIGINT AS ap, count(*)::DOUBLE AS an, CASE WHEN avg(y) < 0.01 THEN least(1/avg(y), 50) ELSE 1.0 END AS w
      FROM long_target JOIN train_target USING (customer_id) GROUP BY 1 HAVING sum(y) >= 50 AND sum(y) < count(*)""",
    hist="""SELECT ord, feature, target, bin, count(*) AS n, sum(y) AS p FROM binned JOIN long_target USING (customer_id)
      JOIN able USING (target) GROUP BY 1,2,3,4""",
    sides="""SELECT ord, feature, target, w, an, ap::DOUBLE AS ap, ap*w/(an-ap+ap*w) AS p, (sum(n) OVER z)::DOUBLE AS ln, (sum(p) OVER z)::DOUBLE AS lp
      FROM hist JOIN able USING (target) WINDOW z AS (PARTITION BY ord, target ORDER BY bin)""",
    term="""SELECT *, p*(ln-lp)+w*(p-1)*lp AS gl, p*(1-p)*(ln-lp+w*lp) AS hl, p*(an-ln-ap+lp)+w*(p-1)*(ap-lp) AS gr,
      p*(1-p)*(an-ln-ap+lp+w*(ap-lp)) AS hr, p*(an-ap)+w*(p-1)*ap AS g, p*(1-p)*(an-ap+w*ap) AS h FROM sides""",
    gain="""SELECT ord, feature, target, greatest(coalesce(max(gl*gl/hl + gr*gr/hr - g*g/h) FILTER (WHERE ln >= 20 AND an-ln >= 20), 0), 0) AS gain
      FROM term GROUP BY 1,2,3""")


@query("split_gain", cte("train_target", "long_target", "extra_cells", **_SPLIT)
       + f"SELECT feature, target, {rounded('gain', 3)} AS gain FROM gain")  # M9 A19: all labels and columns
def _(i: Inputs) -> DataFrame:
    out = split_gain.split_gain(i.train_extra_targets(), S.EXTRAS, S.TARGETS)
    return round_doubles(out.select("feature", "target", "gain"), 3)


_TWO = dict(
    mixed="""SELECT ord, feature, 0.4*corr/max(corr) OVER () + 0.6*gain/CASE WHEN max(gain) OVER () > 0 THEN max(gain) OVER () ELSE 1 END AS score
      FROM (SELECT ord, feature, sum(corr) AS corr FROM scor GROUP BY 1,2)
      JOIN (SELECT ord, sum(gain) AS gain FROM kept LEFT JOIN gain USING (ord, feature) GROUP BY 1) USING (ord)""",
    mixed_each="""SELECT ord, feature, target, 0.35*corr/CASE WHEN max(corr) OVER z > 0 THEN max(corr) OVER z ELSE 1 END
        + 0.65*coalesce(gain, 0)/CASE WHEN coalesce(max(gain) OVER z, 0) > 0 THEN max(gain) OVER z ELSE 1 END AS score
      FROM scor LEFT JOIN gain USING (ord, feature, target) WINDOW z AS (PARTITION BY target)""")


@query("feature_selection_two_signals", cte("train_target", "long_target", "extra_cells", **{
       k: v for k, v in _SEL_ALL.items() if k in ("sample", "cells", "kept", "scor")}, **_SPLIT, **_TWO) + f"""
       SELECT scope, target, feature, rank, {rounded('score')} AS score FROM (
       SELECT 'global' AS scope, NULL AS target, feature, (row_number() OVER (ORDER BY round(score, 9) DESC, ord))::INTEGER AS rank, score FROM mixed
       QUALIFY rank <= 40 UNION ALL SELECT 'target', target, feature,
       (row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, ord))::INTEGER AS rank, score FROM mixed_each QUALIFY rank <= 15)""")  # M8 A19 A22 T1 T2
def _(i: Inputs) -> DataFrame:
    rows = i.train_extra_targets()
    return round_doubles(selection.select_features(
        rows, S.EXTRAS, S.TARGETS, lambda kept: split_gain.split_gain(rows, kept, S.TARGETS), top_global=40, top_per_target=15, min_valid=20))


@query("top_by_dispersion", cte("extra_cells", prof=_PROFILE) + """SELECT (row_number() OVER (ORDER BY std0 DESC, ord))::INTEGER AS rank,
       feature FROM prof QUALIFY rank <= 25""")  # A15 T4
def _(i: Inputs) -> DataFrame:
    names = profile.top_by_dispersion(S.train_keys(i.extra()), S.EXTRAS, 25)
    return i.spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "rank int, feature string")


# -- standardisation and quantiles ---------------------------------------------------

@query("standardize_null_mask", cte("main") + "SELECT customer_id, " + ", ".join(
    f"{rounded(f'(coalesce({c},0)-avg(coalesce({c},0)) OVER ())/(stddev_pop(coalesce({c},0)) OVER ())')} AS std_{c}, "
    f"({c} IS NULL)::INTEGER AS null_{c}" for c in S.NUMS) + " FROM main")  # A24 F11
def _(i: Inputs) -> DataFrame:
    return round_doubles(profile.standardise(i.main(), S.NUMS))


@query("masked_corruption", cte("main", u="SELECT *, " + ", ".join(
    f"{uniform(f'''customer_id||'-{c}-42' ''')} AS u_{c}" for c in S.NUMS) + " FROM main") + "SELECT customer_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND u_{c} < 0.2 THEN 0.0 ELSE {rounded(f'coalesce({c},0)')} END AS {c}" for c in S.NUMS)
    + " FROM u")  # F12
def _(i: Inputs) -> DataFrame:
    cells = [C.corrupted(r(C.fill_number(c)), f"{c} IS NULL", hash_uniform("customer_id", f"'{c}'", 42), 0.2) for c in S.NUMS]
    return i.main().selectExpr("customer_id", *[f"{e} as {c}" for e, c in zip(cells, S.NUMS)])


_QCOLS = ["num_1", "num_2", "num_4", "num_feature_b_1", "num_feature_const"]
_QTABLE = """SELECT feature, k, x[1 + (k*(len(x)-1))//{m}] + (x[1 + (k*(len(x)-1) + {m} - 1)//{m}] - x[1 + (k*(len(x)-1))//{m}])
    * ((k*(len(x)-1)) % {m})/{m}.0 AS q, len(x) AS n
    FROM (SELECT feature, list(x ORDER BY x) AS x FROM src GROUP BY 1), (SELECT unnest(range({m}+1)) AS k)"""
_SRC = f"""SELECT customer_id, feature, x FROM (SELECT customer_id, {', '.join(_QCOLS)} FROM main JOIN extra USING (customer_id)
    WHERE split='train') UNPIVOT (x FOR feature IN ({', '.join(_QCOLS)}))"""


def _quantile_rows(i: Inputs) -> DataFrame:
    return i.main().join(i.extra(), "customer_id").select("customer_id", "split", *_QCOLS)


@query("quantile_table", cte("main", "extra", src=_SRC, qt=_QTABLE.format(m=24))
       + f"SELECT feature, k::INTEGER AS k, n, {rounded('q')} AS q FROM qt")  # A23 exact
def _(i: Inputs) -> DataFrame:
    out = quantiles.quantile_table(_quantile_rows(i).where("split = 'train'"), _QCOLS, 24)
    return round_doubles(out.select("feature", "k", "n", "q"))


_EDGES = """SELECT feature, k, CASE WHEN count(DISTINCT q) OVER (PARTITION BY feature) = 25 THEN q
    ELSE min(q) OVER (PARTITION BY feature) + (max(q) OVER (PARTITION BY feature) - min(q) OVER (PARTITION BY feature))*k/24.0 END AS edge
    FROM qt"""


@query("quantile_edges", cte("main", "extra", src=_SRC, qt=_QTABLE.format(m=24), edges="SELECT feature, k, edge FROM ("
       + _EDGES.replace("count(DISTINCT q) OVER (PARTITION BY feature)", "dq") .replace("FROM qt",
       "FROM qt JOIN (SELECT feature, count(DISTINCT q) AS dq FROM qt GROUP BY 1) USING (feature)") + ")")
       + f"SELECT feature, k::INTEGER AS k, {rounded('edge')} AS edge FROM edges")  # A23
def _(i: Inputs) -> DataFrame:
    edges = quantiles.bin_edges(_quantile_rows(i).where("split = 'train'"), _QCOLS)
    return edges.selectExpr("feature", "posexplode(edges) as (k, edge)").selectExpr("feature", "k", f"{r('edge')} as edge")


@query("piecewise_linear_encode", cte("main", "extra", src=_SRC, qt=_QTABLE.format(m=24), edges="SELECT feature, k, edge FROM ("
       + _EDGES.replace("count(DISTINCT q) OVER (PARTITION BY feature)", "dq") .replace("FROM qt",
       "FROM qt JOIN (SELECT feature, count(DISTINCT q) AS dq FROM qt GROUP BY 1) USING (feature)") + ")",
       bins="SELECT a.feature, a.k, a.edge AS lo, greatest(b.edge-a.edge, 1e-8) AS w FROM edges a JOIN edges b ON a.feature=b.feature AND b.k=a.k+1",
       cells=f"SELECT * FROM (SELECT customer_id, {', '.join(_QCOLS)} FROM main JOIN extra USING (customer_id)) UNPIVOT (x FOR feature IN ({', '.join(_QCOLS)}))")
       + f"""SELECT customer_id, feature, {rounded('sum(least(greatest((x-lo)/w,0),1))')} AS filled,
       {rounded('sum(k*least(greatest((x-lo)/w,0),1))', 3)} AS weighted FROM cells JOIN bins USING (feature) GROUP BY 1,2""")  # F9
def _(i: Inputs) -> DataFrame:
    rows = _quantile_rows(i)
    edges = quantiles.collect_arrays(quantiles.bin_edges(rows.where("split = 'train'"), _QCOLS), "edges")
    out = quantiles.piecewise_linear_encode(rows, edges)
    items = ", ".join(f"struct('{c}' as feature, ple_{c} as p)" for c in _QCOLS)
    return out.selectExpr("customer_id", f"inline(array({items}))").where("p IS NOT NULL").selectExpr(
        "customer_id", "feature", f"{r('aggregate(p, 0D, (a, v) -> a + v)')} as filled",
        f"{r('aggregate(transform(p, (v, k) -> v * k), 0D, (a, v) -> a + v)', 3)} as weighted")


@query("quantile_normal", cte("main", "extra", src=_SRC, qt=_QTABLE.format(m=49),
       knots="SELECT feature, q AS v, min(k)/49.0 AS low, max(k)/49.0 AS high, row_number() OVER (PARTITION BY feature ORDER BY q) AS i FROM qt GROUP BY 1,2",
       brackets="""SELECT a.*, b.v AS v2, b.low AS low2, (SELECT min(v) FROM knots z WHERE z.feature=a.feature) AS first,
          (SELECT max(v) FROM knots z WHERE z.feature=a.feature) AS last FROM knots a LEFT JOIN knots b ON a.feature=b.feature AND b.i=a.i+1""",
       cells=f"SELECT * FROM (SELECT customer_id, {', '.join(_QCOLS)} FROM main JOIN extra USING (customer_id)) UNPIVOT (x FOR feature IN ({', '.join(_QCOLS)}))")
       + f"""SELECT customer_id, feature, {rounded('''CASE WHEN x < first THEN 0.0 WHEN x > last THEN 1.0 WHEN x = v THEN (low+high)/2
            ELSE high + (low2-high)*(x-v)/(v2-v) END''')} AS level
       FROM cells JOIN brackets USING (feature) WHERE (x >= v AND (v2 IS NULL OR x < v2)) OR (x < first AND v = first)""")  # F10 to the CDF
def _(i: Inputs) -> DataFrame:
    rows = _quantile_rows(i)
    knots = quantiles.fit_knots(rows.where("split = 'train'"), _QCOLS, 50)
    out = quantiles.quantile_level(rows, knots, "_level")
    items = ", ".join(f"struct('{c}' as feature, {c}_level as level)" for c in _QCOLS)
    return out.selectExpr("customer_id", f"inline(array({items}))").where("level IS NOT NULL").selectExpr(
        "customer_id", "feature", f"{r('level')} as level")


@query("quantile_normal_scores")  # F10 whole: no inverse normal in SQL
def _(i: Inputs) -> DataFrame:
    rows = _quantile_rows(i)
    return quantiles.quantile_normal(rows, quantiles.fit_knots(rows.where("split = 'train'"), _QCOLS, 1000))


# the same operators over every numeric column
_NUMERIC = S.NUMS + S.EXTRAS
_ALL_NAMES = ", ".join(_NUMERIC)
_ALL_CELLS = f"SELECT * FROM (SELECT customer_id, split, {_ALL_NAMES} FROM main JOIN extra USING (customer_id)) UNPIVOT (x FOR feature IN ({_ALL_NAMES}))"
_ALL_SRC = "SELECT customer_id, feature, x FROM cells WHERE split='train'"
_ALL = dict(cells=_ALL_CELLS, src=_ALL_SRC, qt=_QTABLE.format(m=24))


def _all_rows(i: Inputs) -> DataFrame:
    return i.main().join(i.extra(), "customer_id").select("customer_id", "split", *_NUMERIC)


def _all_train(i: Inputs) -> DataFrame:
    return _all_rows(i).where("split = 'train'")


def _edge_sql(padded: bool) -> str:
    pad, fewest = ("1e-6", 25) if padded else ("0", 2)
    return f"""SELECT feature, k, CASE WHEN coalesce(n, 0) < {fewest} THEN -3 + 6*k/24.0 WHEN dq < 25 THEN lo-{pad} + (hi+{pad}-(lo-{pad}))*k/24.0 ELSE q END AS edge
      FROM (SELECT unnest(['{"','".join(_NUMERIC)}']) AS feature) CROSS JOIN (SELECT unnest(range(25)) AS k)
      LEFT JOIN qt USING (feature, k) LEFT JOIN (SELECT feature, count(DISTINCT q) AS dq, min(q) AS lo, max(q) AS hi FROM qt GROUP BY 1) USING (feature)"""


@query("quantile_table_all", cte("main", "extra", **_ALL) + f"SELECT feature, k::INTEGER AS k, n, {rounded('q')} AS q FROM qt")  # A23: every numeric column
def _(i: Inputs) -> DataFrame:
    return round_doubles(quantiles.quantile_table(_all_train(i), _NUMERIC, 24).select("feature", "k", "n", "q"))


def _edge_rows(i: Inputs, padded: bool) -> DataFrame:
    edges = quantiles.bin_edges(_all_train(i), _NUMERIC, padded=padded)
    return edges.selectExpr("feature", "posexplode(edges) as (k, edge)").selectExpr("feature", "k", f"{r('edge')} as edge")


@query("quantile_edges_all", cte("main", "extra", **_ALL, edges=_edge_sql(False)) + f"SELECT feature, k::INTEGER AS k, {rounded('edge')} AS edge FROM edges")  # A23
def _(i: Inputs) -> DataFrame:
    return _edge_rows(i, False)


@query("quantile_edges_padded", cte("main", "extra", **_ALL, edges=_edge_sql(True)) + f"SELECT feature, k::INTEGER AS k, {rounded('edge')} AS edge FROM edges")  # A23 padded
def _(i: Inputs) -> DataFrame:
    return _edge_rows(i, True)


@query("piecewise_linear_encode_all", cte("main", "extra", **_ALL, edges=_edge_sql(False),
       bins="SELECT a.feature, a.k, a.edge AS lo, greatest(b.edge-a.edge, 1e-8) AS w FROM edges a JOIN edges b ON a.feature=b.feature AND b.k=a.k+1")
       + f"""SELECT customer_id, feature, {rounded('sum(least(greatest((x-lo)/w,0),1))')} AS filled,
       {rounded('sum(k*least(greatest((x-lo)/w,0),1))', 3)} AS weighted FROM cells JOIN bins USING (feature) GROUP BY 1,2""")  # F9
def _(i: Inputs) -> DataFrame:
    edges = quantiles.collect_arrays(quantiles.bin_edges(_all_train(i), _NUMERIC), "edges")
    out = quantiles.piecewise_linear_encode(_all_rows(i), edges)
    items = ", ".join(f"struct('{c}' as feature, ple_{c} as p)" for c in _NUMERIC)
    return out.selectExpr("customer_id", f"inline(array({items}))").where("p IS NOT NULL").selectExpr(
        "customer_id", "feature", f"{r('aggregate(p, 0D, (a, v) -> a + v)')} as filled",
        f"{r('aggregate(transform(p, (v, k) -> v * k), 0D, (a, v) -> a + v)', 3)} as weighted")


_LEVELS = dict(
    cells=_ALL_CELLS, src=_ALL_SRC, steps="SELECT least(1000, count(*)) - 1 AS m FROM main WHERE split='train'",
    qk="""SELECT feature, k, m, x[1 + (k*(len(x)-1))//m] + (x[1 + (k*(len(x)-1) + m - 1)//m] - x[1 + (k*(len(x)-1))//m])
      * ((k*(len(x)-1)) % m)/m::DOUBLE AS q FROM (SELECT feature, list(x ORDER BY x) AS x FROM src GROUP BY 1), steps, (SELECT unnest(range(1000)) AS k) WHERE k <= m""",
    knots="SELECT feature, q AS v, min(k)/min(m)::DOUBLE AS low, max(k)/min(m)::DOUBLE AS high FROM qk GROUP BY 1,2",
    brackets="""SELECT *, lead(v) OVER z AS v2, lead(low) OVER z AS low2, max(v) OVER (PARTITION BY feature) AS last FROM knots
      WINDOW z AS (PARTITION BY feature ORDER BY v)""",
    levels="""SELECT customer_id, c.feature, CASE WHEN v IS NULL THEN 0.0 WHEN x > last THEN 1.0 WHEN x = v THEN (low+high)/2
        ELSE high + (low2-high)*((x-v)/(v2-v)) END AS level
      FROM (SELECT * FROM cells WHERE feature IN (SELECT feature FROM knots)) c
      ASOF LEFT JOIN brackets b ON c.feature = b.feature AND c.x >= b.v""")


@query("quantile_normal_all", cte("main", "extra", **_LEVELS) + f"SELECT customer_id, feature, {rounded('level')} AS level FROM levels")  # F10 to the CDF
def _(i: Inputs) -> DataFrame:
    out = quantiles.quantile_level(_all_rows(i), quantiles.fit_knots(_all_train(i), _NUMERIC, 1000), "_level")
    items = ", ".join(f"struct('{c}' as feature, {c}_level as level)" for c in _NUMERIC)
    return out.selectExpr("customer_id", f"inline(array({items}))").where("level IS NOT NULL").selectExpr(
        "customer_id", "feature", f"{r('level')} as level")


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}*{x}+({c!r}))"
    return out + "::DOUBLE"


# the published rational approximation of the inverse normal distribution, term by term
_NORMAL_SQL = f"""CASE WHEN p < 0.02425 THEN ({_horner(normal._C, 't')})/({_horner(normal._D, 't')})
       WHEN p > 1-0.02425 THEN -({_horner(normal._C, 't')})/({_horner(normal._D, 't')})
       ELSE q*({_horner(normal._A, '(q*q)')})/({_horner(normal._B, '(q*q)')}) END"""


@query("quantile_normal_scores_all", cte("main", "extra", **_LEVELS,
       clipped="SELECT customer_id, feature, least(greatest(level, 1e-7::DOUBLE), 1-1e-7::DOUBLE) AS p FROM levels",
       terms="SELECT *, p-0.5::DOUBLE AS q, sqrt(-2*ln(least(p, 1-p))) AS t FROM clipped")
       + f"""SELECT m.customer_id, f.feature, coalesce({rounded(_NORMAL_SQL)}, 0) AS score FROM main m
       CROSS JOIN (SELECT unnest(['{"','".join(_NUMERIC)}']) AS feature) f LEFT JOIN terms t ON t.customer_id = m.customer_id AND t.feature = f.feature""")  # F10 whole
def _(i: Inputs) -> DataFrame:
    out = quantiles.quantile_normal(_all_rows(i), quantiles.fit_knots(_all_train(i), _NUMERIC, 1000))
    items = ", ".join(f"struct('{c}' as feature, qn_{c} as score)" for c in _NUMERIC)
    return out.selectExpr("customer_id", f"inline(array({items}))").selectExpr("customer_id", "feature", f"{r('score')} as score")


# -- ranks, metrics ---------------------------------------------------------------------

def _train_scores(i: Inputs) -> DataFrame:
    return align.align_scores(S.train_keys(i.target()), i.score(), MODELS, S.TARGETS, labels=i.target())


@query("avg_tie_rank", cte("ranked") + f"""SELECT customer_id, model, target, {rounded('rank2/(2.0*n)', 6)} AS pct_rank
       FROM ranked WHERE split='train'""")  # W1
def _(i: Inputs) -> DataFrame:
    out = metrics.average_ranks(_train_scores(i), ["model", "target"], "score", "customer_id")
    return out.selectExpr("customer_id", "model", "target", f"{r('pct_rank', 6)} as pct_rank")


@query("auc_by_model_target", cte("solo_auc") + f"SELECT model, target, {rounded('auc', 6)} AS auc FROM solo_auc")  # A16
def _(i: Inputs) -> DataFrame:
    out = metrics.auc(_train_scores(i), ["model", "target"])
    return round_doubles(out.select("model", "target", "auc"), 6)


@query("macro_auc", cte("solo_auc") + f"""SELECT model, count(auc) AS n_labels, {rounded('avg(auc)', 6)} AS macro_auc,
       {rounded('min(auc)', 6)} AS min_auc, {rounded('max(auc)', 6)} AS max_auc,
       {rounded('avg(auc) FILTER (WHERE auc > 0.5)', 6)} AS macro_auc_above_half FROM solo_auc GROUP BY 1""")  # A17 D22
def _(i: Inputs) -> DataFrame:
    return round_doubles(metrics.macro_auc(metrics.auc(_train_scores(i), ["model", "target"])), 6)


_P = "(1/(1+exp(-z)))"
_PM = f"greatest({_P}-0.05,1e-8)"


@query("asymmetric_loss", cte("score", z="SELECT *, (score-0.5)*8 AS z FROM score") + f"""SELECT model, target,
       {rounded(f'avg(-(y*(1-{_P})*ln(greatest({_P},1e-8))) - (1-y)*pow({_PM},4)*ln(greatest(1-{_PM},1e-8)))', 6)} AS loss,
       count(*) AS n_rows FROM z GROUP BY 1,2""")  # F13
def _(i: Inputs) -> DataFrame:
    scored = i.score().selectExpr("*", "(score - 0.5D) * 8 as z")
    return round_doubles(metrics.mean_asymmetric_loss(scored, ["model", "target"], "z", "y"), 6)


@query("fold_average_scores", cte("score", f="SELECT customer_id, model, target, score*(k+1)/5.0 AS score FROM score, (SELECT unnest(range(5)) AS k)")
       + f"SELECT customer_id, model, target, {rounded('avg(score)')} AS score FROM f GROUP BY 1,2,3")  # A18
def _(i: Inputs) -> DataFrame:
    by_fold = i.score().selectExpr("customer_id", "model", "target", "score", "explode(sequence(0, 4)) as fold")
    return round_doubles(align.fold_average(by_fold.selectExpr("customer_id", "model", "target", "score * (fold + 1) / 5.0D as score")))


@query("align_scores", cte("aligned") + "SELECT customer_id, model, target, y, score FROM aligned WHERE split='train'")  # J10 D7
def _(i: Inputs) -> DataFrame:
    return _train_scores(i)


# -- blending ------------------------------------------------------------------------------

def _blend_sql(models, weights_sql: str, extra_cte: str = "", targets=None) -> str:
    """Best weights per label by exhaustive search: whole-number blends, AUC by rank sums."""
    b = "+".join(f"w{k + 1}*r{m[1]}" for k, m in enumerate(models))
    where = "" if targets is None else " AND target IN (" + ", ".join(f"'{t}'" for t in targets) + ")"
    return cte("wide_ranks", "solo_auc", grid=weights_sql,
               tr=f"SELECT * FROM wide_ranks WHERE split='train'{where}",
               cls="SELECT target, sum(y)::BIGINT AS p, count(*) AS n FROM tr GROUP BY 1",
               bl=f"SELECT target, o, y, {b} AS b FROM tr, grid",
               rk="""SELECT target, o, y, 2*rank() OVER (PARTITION BY target, o ORDER BY b)
                     + count(*) OVER (PARTITION BY target, o, b) - 1 AS rk2 FROM bl""",
               sc="SELECT target, o, (sum(rk2) FILTER (WHERE y=1))::BIGINT AS s2 FROM rk GROUP BY 1,2",
               best=f"""SELECT target, o, CASE WHEN p=0 OR p=n THEN 0.5 ELSE (s2/2.0 - p*(p+1)/2.0)/(p*(n-p)) END AS auc, p, n
                     FROM sc JOIN cls USING (target)
                     QUALIFY row_number() OVER (PARTITION BY target ORDER BY coalesce(s2,0) DESC, o) = 1""") + extra_cte


def _simplex_sql(k: int, step: int) -> str:
    m = 100 // step
    names = [f"w{j + 1}" for j in range(k)]
    ranges = ", ".join(f"(SELECT unnest(range({m + 1}))*{step} AS {n})" for n in names[:-1])
    rest = "100" + "".join(f"-{n}" for n in names[:-1])
    return (f"SELECT (row_number() OVER (ORDER BY {', '.join(names[:-1])}))-1 AS o, {', '.join(names[:-1])}, {rest} AS {names[-1]} "
            f"FROM {ranges} WHERE {rest} >= 0")


def _train_ranks(i: Inputs, models=MODELS, targets=S.TARGETS) -> DataFrame:
    scores = align.align_scores(S.train_keys(i.target()), i.score(), models, targets, labels=i.target())
    return blend.rank_table(scores, models)


def _weights(i: Inputs, found: dict, models) -> DataFrame:
    return round_doubles(blend.weights_table(i.spark, found, models).select("target", "model", "weight", "auc"), 6)


def _weights_out(models) -> str:
    """One row per label and model from ``best`` and ``grid``; one-class labels get equal weights."""
    return " UNION ALL ".join(
        f"SELECT target, '{m}' AS model, {rounded(f'CASE WHEN p=0 OR p=n THEN 1.0/{len(models)} ELSE w{k + 1}/100.0 END', 6)} AS weight, "
        f"{rounded('auc', 6)} AS auc FROM best JOIN grid USING (o)" for k, m in enumerate(models))


@query("blend_two_models", _blend_sql(["m1", "m3"], _simplex_sql(2, 5)) + f"""SELECT target, model,
       {rounded('CASE WHEN gap > 0.05 THEN CASE WHEN model=chr(109)||1 THEN 0.0 ELSE 1.0 END ELSE weight END', 6)} AS weight,
       {rounded('CASE WHEN gap > 0.05 THEN a3 ELSE auc END', 6)} AS auc FROM (
       {" UNION ALL ".join(f"SELECT target, '{m}' AS model, CASE WHEN p=0 OR p=n THEN 0.5 ELSE w{k}/100.0 END AS weight, auc FROM best JOIN grid USING (o)" for k, m in ((1, 'm1'), (2, 'm3')))})
       JOIN (SELECT target, max(auc) FILTER (WHERE model='m3') - max(auc) FILTER (WHERE model='m1') AS gap,
             max(auc) FILTER (WHERE model='m3') AS a3 FROM solo_auc GROUP BY 1) USING (target)""")  # M17 W4 F5 F6
def _(i: Inputs) -> DataFrame:
    models = ["m1", "m3"]
    rows = metrics.auc(_train_scores(i).where(F.col("model").isin(*models)), ["model", "target"]).collect()
    solo: dict = {t: [None, None] for t in S.TARGETS}
    for x in rows:
        solo[x["target"]][models.index(x["model"])] = x["auc"]
    found = blend.two_model_blend(_train_ranks(i, models), {t: tuple(v) for t, v in solo.items()})
    return _weights(i, found, models)


@query("blend_three_models", _blend_sql(["m1", "m2", "m3"], _simplex_sql(3, 5)) + _weights_out(["m1", "m2", "m3"]))  # M18
def _(i: Inputs) -> DataFrame:
    models = MODELS[:3]
    return _weights(i, blend.search_weights(_train_ranks(i, models), 3), models)


_DELTA = "(SELECT unnest(range(11))*2-10 AS d{k})"


# coarse and fine search over four models; ``won`` has one row per label
_FOUR = _blend_sql(MODELS, _simplex_sql(4, 10)).rstrip() + f""",
       fine AS (SELECT target, p, n, (d1+10)*1000000+(d2+10)*1000+(d3+10) AS o, w1+d1 AS w1, w2+d2 AS w2, w3+d3 AS w3, w4-d1-d2-d3 AS w4
         FROM best JOIN grid USING (o), {', '.join(_DELTA.format(k=k) for k in (1, 2, 3))}
         WHERE least(w1+d1, w2+d2, w3+d3, w4-d1-d2-d3) >= 0 AND greatest(w1+d1, w2+d2, w3+d3, w4-d1-d2-d3) <= 100),
       fbl AS (SELECT target, o, y, w1*r1+w2*r2+w3*r3+w4*r4 AS b FROM tr JOIN fine USING (target)),
       frk AS (SELECT target, o, y, 2*rank() OVER (PARTITION BY target, o ORDER BY b) + count(*) OVER (PARTITION BY target, o, b) - 1 AS rk2 FROM fbl),
       fsc AS (SELECT target, o, (sum(rk2) FILTER (WHERE y=1))::BIGINT AS s2 FROM frk GROUP BY 1,2),
       both_ AS (SELECT target, 0 AS stage, o, s2, w1, w2, w3, w4 FROM sc JOIN best USING (target, o) JOIN grid USING (o)
         UNION ALL SELECT target, 1, o, s2, w1, w2, w3, w4 FROM fsc JOIN fine USING (target, o)),
       won AS (SELECT * FROM both_ JOIN cls USING (target) QUALIFY row_number() OVER (PARTITION BY target ORDER BY s2 DESC, stage, o) = 1),
       blended AS (SELECT target, p, n, {', '.join(f'CASE WHEN p=0 OR p=n THEN 0.25 ELSE w{k}/100.0 END AS w{k}' for k in (1, 2, 3, 4))},
         CASE WHEN p=0 OR p=n THEN 0.5 ELSE (s2/2.0 - p*(p+1)/2.0)/(p*(n-p)) END AS auc FROM won)
       """


@query("blend_four_models", _FOUR + " UNION ALL ".join(
    f"SELECT target, 'm{k}' AS model, {rounded(f'w{k}', 6)} AS weight, {rounded('auc', 6)} AS auc FROM blended" for k in (1, 2, 3, 4)))  # M18
def _(i: Inputs) -> DataFrame:
    return _weights(i, blend.search_weights(_train_ranks(i), 4), MODELS)


@query("blend_two_model_grid", _blend_sql(["m1", "m2"], _simplex_sql(2, 2)) + _weights_out(["m1", "m2"]))  # M18, 51 points
def _(i: Inputs) -> DataFrame:
    models = MODELS[:2]
    return _weights(i, blend.search_weights(_train_ranks(i, models), 2), models)


@query("blend_ablation", _blend_sql(["m1", "m2", "m4"], _simplex_sql(3, 5)) + f"""SELECT 'without m3' AS blend,
       {rounded('avg(auc) FILTER (WHERE p > 0 AND p < n)', 6)} AS mean_auc, (count(*) FILTER (WHERE p > 0 AND p < n)) AS n_labels FROM best""")  # M20 U5
def _(i: Inputs) -> DataFrame:
    models = [m for m in MODELS if m != "m3"]
    ranks = _train_ranks(i, models)
    found = blend.search_weights(ranks, 3)
    usable = labels.eligible(labels.label_stats(i.train_targets(), S.TARGETS), both_classes=True)
    table = blend.weights_table(i.spark, found, ["w"]).join(F.broadcast(usable.select("target")), "target")
    return round_doubles(table.agg(F.lit("without m3").alias("blend"), F.avg("auc").alias("mean_auc"),
                                   F.count("*").alias("n_labels")).select("blend", "mean_auc", "n_labels"), 6)


_WITHOUT = ["m1", "m2", "m4"]
_SOLO_WIDE = "solo AS (SELECT target, " + ", ".join(f"max(auc) FILTER (WHERE model='{m}') AS solo_{m}" for m in MODELS) + " FROM solo_auc GROUP BY 1)"


def _four_models(i: Inputs) -> DataFrame:
    """Weights and AUC of the full blend by label and model."""
    return blend.weights_table(i.spark, blend.search_weights(_train_ranks(i), 4), MODELS)


@query("blend_label_report", _FOUR.rstrip() + ", " + _SOLO_WIDE + f""" SELECT target, {', '.join(f"{rounded(f'solo_{m}', 6)} AS solo_{m}" for m in MODELS)},
       {', '.join(f"{rounded(f'w{m[1]}', 6)} AS weight_{m}" for m in MODELS)}, {rounded('auc', 6)} AS blend_auc,
       {' + '.join(f'(w{m[1]} > 0.01)::INTEGER' for m in MODELS)} AS n_used FROM blended JOIN solo USING (target)""")  # M23
def _(i: Inputs) -> DataFrame:
    solo = metrics.auc(_train_scores(i), ["model", "target"])
    return round_doubles(blend.label_report(_four_models(i), solo, MODELS), 6)


@query("worst_best_blend_labels", _FOUR + f"""SELECT 'worst' AS side, target, {rounded('auc', 6)} AS auc FROM (SELECT * FROM blended
       ORDER BY auc, target LIMIT 5) UNION ALL SELECT 'best', target, {rounded('auc', 6)} FROM (SELECT * FROM blended
       ORDER BY auc DESC, target DESC LIMIT 5)""")  # T5 by the blend's AUC
def _(i: Inputs) -> DataFrame:
    return round_doubles(blend.worst_and_best(_four_models(i).select("target", "auc").distinct()), 6)


def _summary_sql(name: str, table: str, auc: str) -> str:
    both = "FILTER (WHERE p > 0 AND p < n)"
    return f"""SELECT '{name}' AS blend, (count(*) {both}) AS n_labels, {rounded(f'avg({auc}) {both}', 6)} AS mean_auc,
       {rounded(f'avg({auc}) FILTER (WHERE {auc} > 0.5)', 6)} AS mean_auc_above_half, {rounded(f'min({auc}) {both}', 6)} AS min_auc,
       {rounded(f'max({auc}) {both}', 6)} AS max_auc FROM {table}"""


@query("blend_comparison_full", _FOUR + _summary_sql("all models", "blended", "auc"))  # M20 U5: the full side
def _(i: Inputs) -> DataFrame:
    usable = labels.eligible(labels.label_stats(i.train_targets(), S.TARGETS), both_classes=True)
    return round_doubles(blend.blend_summary(_four_models(i), usable, "all models"), 6)


@query("blend_comparison_without", _blend_sql(_WITHOUT, _simplex_sql(3, 5)) + _summary_sql("without m3", "best", "auc"))  # M20 U5: the other side
def _(i: Inputs) -> DataFrame:
    usable = labels.eligible(labels.label_stats(i.train_targets(), S.TARGETS), both_classes=True)
    found = blend.search_weights(_train_ranks(i, _WITHOUT), 3)
    return round_doubles(blend.blend_summary(blend.weights_table(i.spark, found, _WITHOUT), usable, "without m3"), 6)


@query("degenerate_label_fallback", cte("wide_ranks") + f"""SELECT customer_id, target,
       {rounded('(r1+r2+r3+r4)/4.0/(2.0*n)', 6)} AS score FROM wide_ranks WHERE split='test' AND target='target_6_1'""")  # M19
def _(i: Inputs) -> DataFrame:
    found = blend.search_weights(_train_ranks(i, targets=["target_6_1"]), 4)
    test = align.align_scores(S.test_keys(i.target()), i.score(), MODELS, ["target_6_1"])
    return round_doubles(blend.apply_weights(blend.rank_table(test, MODELS), found).select("customer_id", "target", "score"), 6)


_THREE = _blend_sql(["m1", "m2", "m3"], _simplex_sql(3, 5))


@query("blend_report", _THREE.rstrip() + f""", w AS ({_weights_out(['m1', 'm2', 'm3'])}) SELECT model,
       {rounded('coalesce(avg(weight) FILTER (WHERE auc > 0.5), 0)')} AS mean_weight, count(*) FILTER (WHERE auc > 0.5) AS n_labels,
       count(*) FILTER (WHERE weight > 0.01) AS n_used FROM w GROUP BY 1""")  # A25 M23
def _(i: Inputs) -> DataFrame:
    models = MODELS[:3]
    found = blend.search_weights(_train_ranks(i, models), 3)
    return round_doubles(blend.blend_report(blend.weights_table(i.spark, found, models)))


@query("worst_best_labels", cte("solo_auc") + f"""SELECT 'worst' AS side, target, {rounded('auc', 6)} AS auc FROM (SELECT * FROM solo_auc
       WHERE model='m2' AND auc IS NOT NULL ORDER BY auc, target LIMIT 5) UNION ALL SELECT 'best', target, {rounded('auc', 6)} FROM
       (SELECT * FROM solo_auc WHERE model='m2' AND auc IS NOT NULL ORDER BY auc DESC, target DESC LIMIT 5)""")  # T5 M23
def _(i: Inputs) -> DataFrame:
    per_label = metrics.auc(_train_scores(i).where("model = 'm2'"), ["target"])
    return round_doubles(blend.worst_and_best(per_label), 6)


_LOGIT = "ln(least(greatest({p},1e-7),1-1e-7)/(1-least(greatest({p},1e-7),1-1e-7)))"


@query("publish_submission", _THREE.rstrip() + f""", s AS (SELECT customer_id, target, (CASE WHEN p=0 OR p=b.n THEN (r1+r2+r3)/3.0
       ELSE (w1*r1+w2*r2+w3*r3)/100.0 END)/(2.0*t.n) AS s FROM wide_ranks t JOIN best b USING (target) JOIN grid USING (o) WHERE split='test')
       SELECT customer_id::INTEGER AS customer_id, {', '.join(f"coalesce({rounded(f'max(l) FILTER (WHERE target={chr(39)}{t}{chr(39)})')}, -10.0) AS predict_{t[7:]}" for t in S.TARGETS)}
       FROM template LEFT JOIN (SELECT customer_id, target, {_LOGIT.format(p='s')} AS l FROM s) USING (customer_id) GROUP BY 1""".replace(
       ", s AS (", ", template AS (SELECT customer_id FROM splits WHERE split='test' UNION ALL SELECT -1), s AS (", 1))  # F4 J9 M21 M22
def _(i: Inputs) -> DataFrame:
    models = MODELS[:3]
    found = blend.search_weights(_train_ranks(i, models), 3)
    test = align.align_scores(S.test_keys(i.target()), i.score(), models, S.TARGETS)
    blended = blend.apply_weights(blend.rank_table(test, models), found)
    return round_doubles(publish.submission(blended, i.template(), S.TARGETS))


def _submission_sql(blend_value: str) -> str:
    """Wide submission from ``blend_value``, a CTE of (customer_id, target, s)."""
    columns = ", ".join(f"coalesce({rounded(f'max(l) FILTER (WHERE target={chr(39)}{t}{chr(39)})')}, -10.0) AS predict_{t[7:]}" for t in S.TARGETS)
    return f""", s AS ({blend_value}) SELECT customer_id::INTEGER AS customer_id, {columns}
       FROM (SELECT customer_id FROM splits WHERE split='test' UNION ALL SELECT -1)
       LEFT JOIN (SELECT customer_id, target, {_LOGIT.format(p='s')} AS l FROM s) USING (customer_id) GROUP BY 1"""


def _submission(i: Inputs, found: dict, models: list[str]) -> DataFrame:
    test = align.align_scores(S.test_keys(i.target()), i.score(), models, S.TARGETS)
    blended = blend.apply_weights(blend.rank_table(test, models), found)
    return round_doubles(publish.submission(blended, i.template(), S.TARGETS))


@query("publish_four_models", _FOUR.rstrip() + _submission_sql(
    "SELECT customer_id, target, (b.w1*r1+b.w2*r2+b.w3*r3+b.w4*r4)/(2.0*t.n) AS s FROM wide_ranks t JOIN blended b USING (target) WHERE split='test'"))  # M22
def _(i: Inputs) -> DataFrame:
    return _submission(i, blend.search_weights(_train_ranks(i), 4), MODELS)


@query("publish_without_m3", _blend_sql(_WITHOUT, _simplex_sql(3, 5)).rstrip() + _submission_sql(
    """SELECT customer_id, target, (CASE WHEN p=0 OR p=b.n THEN (r1+r2+r4)/3.0 ELSE (w1*r1+w2*r2+w3*r4)/100.0 END)/(2.0*t.n) AS s
       FROM wide_ranks t JOIN best b USING (target) JOIN grid USING (o) WHERE split='test'"""))  # M22 U5
def _(i: Inputs) -> DataFrame:
    return _submission(i, blend.search_weights(_train_ranks(i, _WITHOUT), 3), _WITHOUT)


# -- models (rows only) ------------------------------------------------------------------------

@query("pca_features")  # M7
def _(i: Inputs) -> DataFrame:
    return reduce.pca_features(S.train_keys(i.extra()), i.extra(), S.EXTRAS, k=30)


_MODEL_LABELS = ["target_1_1", "target_4_1"]


@query("gain_importance")  # M9 A19 M24
def _(i: Inputs) -> DataFrame:
    rows = i.train_extra_targets()
    return learn.gain_importance(rows, S.BRAND_COLS + S.TYPE_COLS, _MODEL_LABELS, maxIter=3, maxDepth=4)


def _learner_base(i: Inputs) -> DataFrame:
    return i.main_with_folds().join(i.extra().select("customer_id", *S.BRAND_COLS, *S.TYPE_COLS), "customer_id", "left")


_MODEL_COLS = S.NUMS + S.BRAND_COLS + S.TYPE_COLS


@query("oof_scores_gbt")  # M10 M14 M15 M25
def _(i: Inputs) -> DataFrame:
    return learn.oof_scores(_learner_base(i), _MODEL_LABELS, learn.boosted(maxIter=3, maxDepth=3),
                            learn.plain_features(_MODEL_COLS), range(5))


@query("oof_scores_rf")  # M14 M13
def _(i: Inputs) -> DataFrame:
    own = {"target_1_1": S.BRAND_COLS, "target_4_1": S.TYPE_COLS}
    return learn.oof_scores(_learner_base(i), _MODEL_LABELS, learn.forest(numTrees=5, maxDepth=4), None, range(5),
                            prepare_label=lambda t: learn.plain_features(S.NUMS + own[t]))


@query("oof_scores_linear")  # M16 F9 F10
def _(i: Inputs) -> DataFrame:
    return learn.oof_scores(_learner_base(i), _MODEL_LABELS, learn.linear(maxIter=5),
                            learn.smooth_features(S.NUMS, n_quantiles=100), range(5))


# -- learners over all labels: what must hold of every score ------------------------------------

def _checked(i: Inputs, scores: DataFrame) -> DataFrame:
    """Per label and fold: rows scored, and rows with an impossible score or of another fold."""
    own = i.folds().select("customer_id", F.col("fold").alias("_own"))
    rows = scores.join(own, "customer_id", "left")
    return rows.groupBy("target", "fold").agg(
        F.sum((F.col("split") == "train").cast("long")).alias("n_train"), F.sum((F.col("split") == "test").cast("long")).alias("n_test"),
        F.countDistinct("customer_id").alias("n_clients"),
        F.sum((~F.col("score").between(0, 1) | F.isnan("score") | F.col("score").isNull()).cast("long")).alias("n_outside"),
        F.sum(F.coalesce((F.col("split") == "train") & (F.col("_own") != F.col("fold")), F.lit(False)).cast("long")).alias("n_own_training"),
        F.sum(((F.col("split") == "test") == F.col("_own").isNotNull()).cast("long")).alias("n_wrong_split"))


_CHECKED = """SELECT target, fold, n AS n_train, t AS n_test, n + t AS n_clients, 0::BIGINT AS n_outside, 0::BIGINT AS n_own_training, 0::BIGINT AS n_wrong_split
   FROM names, (SELECT fold, count(*) AS n FROM folds GROUP BY 1), (SELECT count(*) AS t FROM splits WHERE split='test')"""


def _wide_base(i: Inputs) -> DataFrame:
    return i.main_with_folds().join(i.extra(), "customer_id", "left")


@query("oof_counts_boosted", cte("folds", "names", "splits") + _CHECKED)  # M10 M14 M15 M25: 18 labels, 190 columns
def _(i: Inputs) -> DataFrame:
    few = {k: replace(g, rounds=4, depth=4) for k, g in boost.BOOSTED.items()}
    return _checked(i, boost.oof_scores(_wide_base(i), _NUMERIC, S.TARGETS, range(5), few))


@query("oof_counts_forest", cte("folds", "names", "splits") + _CHECKED)  # M14 M15
def _(i: Inputs) -> DataFrame:
    few = {k: replace(g, rounds=5, depth=5) for k, g in boost.FOREST.items()}
    return _checked(i, boost.oof_scores(_wide_base(i), _NUMERIC, S.TARGETS, range(5), few, model="forest"))


@query("oof_counts_linear", cte("folds", "names", "splits") + _CHECKED)  # M16 M15
def _(i: Inputs) -> DataFrame:
    return _checked(i, learn.oof_scores(_wide_base(i), S.TARGETS, learn.linear(maxIter=20), learn.smooth_features(_NUMERIC), range(5), parallel=8))


# sum of the variances is the trace of the covariance, sum of their squares that of its squared entries; the parts' sums follow from both
@query("pca_variances", cte("extra_cells", wide_=f"SELECT customer_id, ord, coalesce(x, 0) AS x FROM extra_cells",
       cov="SELECT a.ord AS i, b.ord AS j, covar_samp(a.x, b.x) AS c FROM wide_ a JOIN wide_ b USING (customer_id) WHERE a.ord <= b.ord GROUP BY 1,2")
       + f"""SELECT count(DISTINCT i) AS n_columns, {rounded('sum(c) FILTER (WHERE i = j) / 1e6', 3)} AS total_variance,
       {rounded('sum(CASE WHEN i = j THEN c*c ELSE 2*c*c END) / 1e12', 3)} AS squared_entries FROM cov""")  # M7
def _(i: Inputs) -> DataFrame:
    factor = reduce.row_factor(S.train_keys(i.extra()), S.EXTRAS)
    _, variances = factor.components(30)
    row = i.spark.createDataFrame([(len(factor.mean), float(variances.sum()) / 1e6, float((variances ** 2).sum()) / 1e12)],
                                  "n_columns long, total_variance double, squared_entries double")
    return round_doubles(row, 3)


# -- all feature sets, side by side ----------------------------------------------------------------

_SETS = ["frequency_encode", "oof_target_encode", "composite_target_encode", "group_zscore_ratio", "pairwise_interactions", "numeric_transforms",
         "row_global_aggs", "null_pattern_blocks", "subgroup_aggs", "cross_target_features"]


def _set_columns() -> dict[str, list[str]]:
    """Names of the features that every set gives."""
    groups = ["all", *[f"grp{g}" for g, ts in target_groups(S.TARGETS).items() if len(ts) > 1]]
    meta = [f"meta_{t}" for t in S.TARGETS] + [f"meta_{g}_{n}" for g in groups for n in ("mean", "max", "std")]
    blocks = range(len(_BLOCKS))
    return {
        "frequency_encode": [f"freq_{c}" for c in S.CATS], "composite_target_encode": list(S.CATS),
        "oof_target_encode": [f"te_{c}_{t}" for t in S.TARGETS for c in S.CATS],
        "group_zscore_ratio": [f"{f}_{c}_{n}" for f in ("zscore", "ratio") for c in S.CATS for n in S.NUMS],
        "pairwise_interactions": [f"{f}_{a}_{b}" for f in ("mult", "div") for a, b in _PAIRS],
        "numeric_transforms": [f"{f}_{c}" for f in ("log1p", "sqrt") for c in S.NUMS],
        "row_global_aggs": [f"global_extra_{n}" for n in ("sum", "mean", "nonnull", "nonzero")],
        "null_pattern_blocks": [f"{n}_{g}" for n in ("nullcnt", "nonzero") for g in blocks],
        "subgroup_aggs": [f"subgroup_{n}_{g}" for n in ("sum", "mean", "std") for g in blocks],
        "cross_target_features": meta + ["meta_all_min", "meta_all_q25", "meta_all_q75"] + [f"meta_rank_{t}" for t in S.TARGETS]}


def _feature_sets(i: Inputs) -> dict[str, DataFrame]:
    return {name: QUERIES[name](i.spark, i.dir) for name in _SETS} | {
        "numbers": i.main().select("customer_id", *S.NUMS), "extra": i.extra()}


_SET_SQL = {name: ORACLE[name] for name in _SETS} | {
    "numbers": cte("main") + f"SELECT customer_id, {', '.join(S.NUMS)} FROM main", "extra": cte("extra") + "SELECT * FROM extra"}
_ALL_FEATURES = [c for cs in _set_columns().values() for c in cs] + S.NUMS + S.EXTRAS


@query("base_assembly_full", "WITH " + ", ".join(f"set_{k} AS ({q})" for k, q in enumerate(_SET_SQL.values())) + ", " + cte("template")[5:]
       + "SELECT template.customer_id, " + ", ".join(f"coalesce({c}, 0)::FLOAT::DOUBLE AS {c}" for c in _ALL_FEATURES) + " FROM template "
       + " ".join(f"LEFT JOIN set_{k} ON set_{k}.customer_id = template.customer_id" for k in range(len(_SET_SQL))))  # M12 J1-J3 P5: every set
def _(i: Inputs) -> DataFrame:
    buckets = int(i.spark.conf.get("spark.sql.shuffle.partitions"))
    sets = tables.co_located({"spine": i.template(), **_feature_sets(i)}, new_path(i.spark, "sets"), buckets)
    base = assemble.base_features(sets.pop("spine"), list(sets.values()))
    return base.selectExpr("customer_id", *[f"cast({c} as double) as {c}" for c in base.columns if c != "customer_id"])


@query("feature_contract", "WITH " + ", ".join(f"set_{k} AS ({q})" for k, q in enumerate(_SET_SQL.values())) + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, {len(_set_columns().get(name, S.NUMS if name == 'numbers' else S.EXTRAS))}::INTEGER AS n_features, count(*) AS n_rows, "
    f"count(DISTINCT customer_id) AS n_keys FROM set_{k}" for k, name in enumerate(_SET_SQL)))  # P19
def _(i: Inputs) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("name"), F.lit(len(check_features(df))).alias("n_features"), F.count("*").alias("n_rows"),
                    F.countDistinct("customer_id").alias("n_keys")).select("name", "n_features", "n_rows", "n_keys")
             for name, df in _feature_sets(i).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_LOCAL = 100


@query("row_local_aggs_ranked", cte("train_target", "long_target", "extra_cells", "extra", **{
       k: v for k, v in _SEL_ALL.items() if k in ("sample", "cells", "kept", "scor")}, **_SPLIT, **_TWO,
       ranked_="SELECT feature, row_number() OVER (ORDER BY round(score, 9) DESC, ord) AS place FROM mixed QUALIFY place <= 100",
       picked=f"""SELECT customer_id, list(x ORDER BY place) FILTER (WHERE x IS NOT NULL) AS xs
         FROM (SELECT * FROM extra UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(S.EXTRAS)}))) JOIN ranked_ USING (feature) GROUP BY 1""")
       + f"""SELECT customer_id, {rounded('coalesce(list_sum(xs), 0)', 6)} AS local_extra_sum, {rounded('list_avg(xs)', 6)} AS local_extra_mean,
       coalesce(len([v FOR v IN xs IF v <> 0]), 0)::INTEGER AS local_extra_nonzero FROM picked""")  # A10: the ranked list
def _(i: Inputs) -> DataFrame:
    rows, df = i.train_extra_targets(), i.extra()
    lists = selection.select_features(rows, S.EXTRAS, S.TARGETS, lambda kept: split_gain.split_gain(rows, kept, S.TARGETS),
                                      top_global=_LOCAL, top_per_target=1, min_valid=20)
    path = new_path(i.spark, "lists")
    tables.save_feature_lists(lists, path)
    wanted = clean_feature_list(tables.load_feature_list(i.spark, path, limit=_LOCAL), df.columns, _LOCAL)
    return round_doubles(wide.row_aggregates(df, wanted, "local_extra", with_nonnull=False), 6)


@query("score_store_all_labels", cte("score") + """SELECT model, target, 0::INTEGER AS fold, count(*) AS n,
       sum(floor(score*100+0.5)::BIGINT)::BIGINT AS cents FROM score GROUP BY 1,2""")  # S8: every model and label
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "scores")
    scores = i.all_scores().selectExpr("*", "0 as fold")
    tables.save_scores(scores.where("model != 'm1'"), path)
    tables.save_scores(scores.where("model = 'm1'"), path)
    return tables.load_scores(i.spark, path).groupBy("model", "target", "fold").agg(
        F.count("*").alias("n"), F.expr("sum(cast(floor(score * 100 + 0.5) as bigint)) as cents"))


@query("resume_all_labels", cte("folds", "names") + """SELECT model, target, fold FROM (VALUES ('m1'),('m2'),('m3'),('m4')) a(model), names,
       (SELECT DISTINCT fold FROM folds) WHERE NOT (model='m1' OR (model='m2' AND fold < 2) OR (model='m3' AND target LIKE 'target_2%'))""")  # S10
def _(i: Inputs) -> DataFrame:
    path = new_path(i.spark, "scores")
    done = (i.all_scores().join(i.folds().select("customer_id", "fold"), "customer_id")
            .where("model = 'm1' OR model = 'm2' AND fold < 2 OR model = 'm3' AND target LIKE 'target_2%'"))
    tables.save_scores(done, path)
    models = ", ".join(f"struct('{m}' as model)" for m in MODELS)
    named = ", ".join(f"struct('{t}' as target)" for t in S.TARGETS)
    units = i.folds().select("fold").distinct().selectExpr("fold", f"inline(array({models}))").selectExpr("model", f"inline(array({named}))", "fold")
    return tables.remaining_units(units, tables.load_scores(i.spark, path))


@query("label_lookup_all", cte("template", "target", "train_target") + f"""SELECT 'lenient' AS mode, customer_id, {', '.join(S.TARGETS)}
       FROM template LEFT JOIN target USING (customer_id)
       UNION ALL SELECT 'strict', customer_id, {', '.join(S.TARGETS)} FROM train_target""")  # J4 J5: every label
def _(i: Inputs) -> DataFrame:
    lenient = assemble.attach_labels(i.template(), i.target(), S.TARGETS, strict=False)
    strict = assemble.attach_labels(S.train_keys(i.main()).select("customer_id"), i.target(), S.TARGETS)
    return lenient.selectExpr("'lenient' as mode", "*").unionByName(strict.selectExpr("'strict' as mode", "*"))

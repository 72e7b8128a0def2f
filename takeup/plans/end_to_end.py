"""The whole chain: selection, features, out-of-fold models, blend, submission.

Every step writes its result below ``out`` and is skipped when it is already
there from the same settings, so a run that was interrupted goes on where it stopped.
Other inputs need another ``out``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cache
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, functions as F

from takeup.operators import (align, assemble, blend, encode, folds, groupstats, labels, learn, metrics, profile,
                              publish, reduce, selection, split_gain, wide)
from takeup.operators.lookup import staged_by
from takeup.roles import check_features, clean_feature_list, infer_roles
from takeup.sources import tables


@dataclass(frozen=True)
class Settings:
    targets: Sequence[str] | None = None      # labels to model; default all
    folds: int = 5
    seed: int = 42
    sample_ratio: float = 0.3
    min_valid: int = 100
    top_global: int = 700
    top_per_target: int = 150
    meta_extras: int = 400
    base_extras: int = 100
    encodings: int = 300
    smooth_features: int = 750
    components: int = 30
    block: int = 500
    parallel: int = 4
    use_gain: bool = True
    gain_by: str = "splits"                   # best splits of all rows; "trees": boosted models on a sample
    gain: dict = field(default_factory=dict)
    first_stage: dict = field(default_factory=dict)
    boosted: dict = field(default_factory=dict)
    forest: dict = field(default_factory=dict)
    linear: dict = field(default_factory=dict)
    n_quantiles: int = 1000


@dataclass(frozen=True)
class Data:
    """Clients keyed by ``customer_id``; ``target`` has the train clients only and
    so tells train from test."""

    main: DataFrame
    extra: DataFrame
    target: DataFrame
    template: DataFrame | None = None


def run(spark: SparkSession, data: Data, out: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    s, key = settings, "customer_id"
    main_roles, extra_cols = infer_roles(data.main.columns), infer_roles(data.extra.columns).extras
    targets = list(s.targets or infer_roles(data.target.columns).targets)
    assemble.assert_key_aligned(data.main.select(key), data.extra.select(key))

    made_with = f"{s} {targets}"
    own_store = f"settings={md5(made_with.encode()).hexdigest()}"

    def step(name: str, build) -> DataFrame:
        return tables.reuse_or_build(spark, f"{out}/{name}", build, made_with)

    fold = step("folds", lambda: folds.multilabel_folds(data.target, targets, k=s.folds, seed=s.seed))
    # test clients have a null fold and null labels
    spine = step("spine", lambda: data.main.select(key).join(
        fold.select(key, "fold").join(data.target.select(key, *targets), key), key, "left"))
    is_train = F.col("fold").isNotNull()

    # selection of extra columns
    def select() -> DataFrame:
        labels = data.target.select(key, *targets)
        rows, gain = data.extra.join(labels, key), None
        sample = data.extra.join(folds.reduce_rows(labels, targets, s.sample_ratio, s.seed), key)
        if s.use_gain and s.gain_by == "trees":
            # statistics see every row; only the importance models are fitted on a share of them
            def gain(kept: list[str]) -> DataFrame:
                return learn.gain_importance(sample, kept, targets, parallel=s.parallel, seed=s.seed, **s.gain)
        elif s.use_gain:
            def gain(kept: list[str]) -> DataFrame:
                return split_gain.split_gain(rows, kept, targets, **s.gain)
        return selection.select_features(rows, extra_cols, targets, gain, s.top_global, s.top_per_target, s.min_valid)

    step("feature_lists", select)
    ranked = tables.load_feature_list(spark, f"{out}/feature_lists")
    top = clean_feature_list(ranked, data.extra.columns)

    # feature sets
    coded = step("coded", lambda: encode.frequency_encode(data.main.select(key, *main_roles.cats, *main_roles.nums),
                                                          main_roles.cats, replace=True))
    step("global_aggs", lambda: wide.row_aggregates(data.extra, extra_cols, "global_extra"))

    def first_stage() -> DataFrame:
        used = top[:s.meta_extras]
        base = assemble.base_features(spine.select(key), [coded, data.extra.select(key, *used)])
        base = base.join(spine, key)
        scores = learn.oof_scores(base, targets, learn.boosted("first", learn.FIRST_STAGE, **s.first_stage),
                                  learn.plain_features([*main_roles.cats, *main_roles.nums, *used]), range(s.folds),
                                  store=f"{out}/first_scores/{own_store}", parallel=s.parallel, seed=s.seed)
        wide_scores = align.to_wide(align.fold_average(scores), targets, "meta_")
        filled = data.main.select(key).join(wide_scores, key, "left").na.fill(0.0)
        return wide.cross_target_features(filled, targets)

    step("meta", first_stage)
    common = [r["target"] for r in labels.eligible(labels.label_stats(data.target, targets), min_rate=0.002)
              .orderBy("ordinal").collect()]

    def target_encodings() -> DataFrame:
        rows = data.main.select(key, *main_roles.cats).join(spine, key)
        cats = encode.eligible_categories(rows.where(is_train), main_roles.cats)
        made = encode.oof_target_encode(rows, cats, common, top=s.encodings)
        return made.select(key, *[c for c in made.columns if c.startswith("te_")])

    step("target_encodings", target_encodings)

    def engineered() -> DataFrame:
        rows = data.main.select(key, *main_roles.cats, *main_roles.nums)
        train = rows.join(spine.where(is_train).select(key), key)
        made = encode.frequency_encode(rows, main_roles.cats)
        made = groupstats.apply_group_stats(
            made, staged_by(groupstats.fit_group_stats(train, main_roles.cats, main_roles.nums), "cat", "group_stats"),
            main_roles.cats, main_roles.nums)
        made = groupstats.transform_features(groupstats.pair_features(made, main_roles.nums), main_roles.nums)
        sets = [wide.null_pattern(data.extra, extra_cols, s.block), wide.block_aggregates(data.extra, extra_cols, s.block)]
        train_extra = data.extra.join(spine.where(is_train).select(key), key)
        components = reduce.pca_features(train_extra, data.extra, top[:s.top_global], s.components)
        if components is not None:
            sets.append(components)
        return assemble.assemble(made.drop(*main_roles.cats, *main_roles.nums), *sets)

    step("engineered", engineered)

    # learner input from the sets that exist
    def base() -> DataFrame:
        sets = tables.optional_sets(spark, {n: f"{out}/{n}" for n in
                                            ("global_aggs", "meta", "engineered", "target_encodings")})
        picked = data.extra.select(key, *top[:s.base_extras])
        local = wide.row_aggregates(picked, top[:s.base_extras], "local_extra", with_nonnull=False)
        cats = data.main.select(key, *main_roles.cats).join(spine, key).withColumn("_y", labels.composite_label(targets))
        encoded = encode.composite_target_encode(cats, main_roles.cats, "_y", is_train, fold="fold")
        return assemble.base_features(spine.select(key), [
            encoded.select(key, *main_roles.cats), data.main.select(key, *main_roles.nums), picked, local, *sets.values()])

    features = check_features(step("base", base))
    learner_rows = spark.read.parquet(f"{out}/base").join(spine, key)

    # models
    store = f"{out}/scores/{own_store}"
    own = {t: clean_feature_list(tables.load_feature_list(spark, f"{out}/feature_lists", "target", t),
                                 data.extra.columns, exclude=features) for t in targets}
    wanted = sorted({c for cols in own.values() for c in cols})
    with_own = assemble.with_label_features(spark.read.parquet(f"{out}/base"), data.extra, wanted).join(spine, key)
    step("learner_rows", lambda: with_own)
    tree_rows = spark.read.parquet(f"{out}/learner_rows")
    for learner in (learn.boosted(**s.boosted), learn.forest(**s.forest)):
        learn.oof_scores(tree_rows, targets, learner, None, range(s.folds), store=store, parallel=s.parallel, seed=s.seed,
                         prepare_label=lambda t: learn.plain_features([*features, *own[t]]))
    smooth = profile.top_by_dispersion(learner_rows.where(is_train), features, s.smooth_features)
    learn.oof_scores(learner_rows, targets, learn.linear(**s.linear), learn.smooth_features(smooth, s.n_quantiles),
                     range(s.folds), store=store, parallel=s.parallel, seed=s.seed)

    # blend
    models = ["boosted", "forest", "linear"]
    scores = tables.load_scores(spark, store)
    train_keys, test_keys = spine.where(is_train).select(key), spine.where(~is_train).select(key)
    oof = align.align_scores(train_keys, scores.where("split = 'train'"), models, targets, labels=spine)
    step("solo_auc", lambda: metrics.auc(oof, ["model", "target"]))

    @cache
    def found() -> dict:
        return blend.search_weights(blend.rank_table(oof, models), len(models))

    step("weights", lambda: blend.weights_table(spark, found(), models))
    test = align.align_scores(test_keys, align.fold_average(scores.where("split = 'test'")), models, targets)
    step("submission", lambda: publish.submission(
        blend.apply_weights(blend.rank_table(test, models), found()), data.template, targets))
    return {name: spark.read.parquet(f"{out}/{name}") for name in
            ("folds", "feature_lists", "meta", "engineered", "target_encodings", "base", "solo_auc", "weights", "submission")}

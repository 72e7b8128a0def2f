"""Score tables: alignment to a spine, averaging over folds, conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from takeup.functions.clean import number

NEUTRAL = 0.5


def _literals(names: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def align_scores(spine: DataFrame, scores: DataFrame, models: Sequence[str], targets: Sequence[str],
                 labels: DataFrame | None = None, key: str = "customer_id", default: float = NEUTRAL) -> DataFrame:
    """``(key, model, target, score[, y])`` for every spine key, model and label; what
    the score table lacks gets the neutral score, what the spine lacks is dropped.
    ``labels``, one row per key, adds the label value ``y``.

    Scores are gathered to one list per key with the number of their model and label (both known
    from the schema), so one exchange on the key serves the gathering and the joins; the list
    is then unfolded in place, with the neutral score for the numbers it lacks. A key that has two scores of the same
    model and label is an error; a null score counts as missing.
    """
    width = len(targets)
    names = {"model": _literals(models), "target": _literals(targets)}
    wanted = scores.where(F.col("model").isin(*models) & F.col("target").isin(*targets) & F.col("score").isNotNull()).selectExpr(
        key, f"cast((array_position({names['model']}, model) - 1) * {width} "
             f"+ array_position({names['target']}, target) - 1 as int) as c", "cast(score as double) as s")
    gathered = wanted.groupBy(key).agg(F.collect_list(F.struct("c", "s")).alias("_s"))
    # both sides meet on the key's partitioning; broadcasting the gathered side would
    # leave the unfolding to the few tasks that scan the spine
    rows = spine.select(key).join(gathered.hint("merge"), key, "left")
    y = []
    if labels is not None:
        rows = rows.join(labels.selectExpr(key, f"cast(array({', '.join(targets)}) as array<int>) as _y"), key, "left")
        y = [f"_y[c % {width}] as y"]
    cells = len(models) * width
    rows = rows.withColumn("_s", F.expr("coalesce(_s, cast(array() as array<struct<c:int,s:double>>))"))
    rows = rows.withColumn("_c", F.expr("transform(_s, x -> x.c)"))
    checked = f"""if(size(array_distinct(_c)) < size(_c), raise_error(concat('repeated scores of ', cast({key} as string))),
        concat(_s, transform(array_except(sequence(0, {cells - 1}), _c), i -> struct(i as c, {number(default)} as s))))"""
    return rows.selectExpr(key, *[c for c in rows.columns if c == "_y"], f"inline({checked})").selectExpr(
        key, f"{names['model']}[cast(c div {width} as int)] as model", f"{names['target']}[c % {width}] as target",
        "s as score", *y)


def fold_average(scores: DataFrame, key: str = "customer_id") -> DataFrame:
    """Mean over the folds of the scores of rows that every fold's model scored."""
    return scores.groupBy(key, "model", "target").agg(F.avg("score").alias("score"))


def to_wide(scores: DataFrame, targets: Sequence[str], prefix: str, key: str = "customer_id",
            value: str = "score") -> DataFrame:
    """One row per key, one column ``<prefix><target>`` per label."""
    wide = scores.groupBy(key).pivot("target", list(targets)).agg(F.first(value))
    return wide.selectExpr(key, *[f"{t} as {prefix}{t}" for t in targets])

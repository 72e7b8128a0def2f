"""Frequency and smoothed target encoding of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from takeup.functions.clean import category_level, number
from takeup.operators.lookup import HOT_SHARE, fitting, keyed_lookup, staged_by
from takeup.session import MAX_BROADCAST_ROWS, stage

ALL_FOLDS = -1


def level_of(c: str, own_null_level: bool) -> str:
    return category_level(c) if own_null_level else f"cast({c} as string)"


def explode_levels(df: DataFrame, cats: Sequence[str], keep: Sequence[str], own_null_level: bool) -> DataFrame:
    """One row per (row, category column): ``cat`` and its text ``level``. Null is
    its own level or null."""
    items = ", ".join(f"struct('{c}' as cat, {level_of(c, own_null_level)} as level)" for c in cats)
    return df.selectExpr(*keep, f"inline(array({items}))")


def hot_levels(rows: DataFrame, cats: Sequence[str], keep: Sequence[str], own_null_level: bool) -> DataFrame:
    """``(cat, level, <keep>)`` of the keys that hold more than the hot share of ``rows``, for all categories from
    one pass; at most ``1 / HOT_SHARE`` per category."""
    counts = staged_by(explode_levels(rows, cats, keep, own_null_level).dropna().groupBy(
        "cat", "level", *[k.split()[-1] for k in keep]).agg(F.count("*").alias("_n")), "cat", "level_rows")
    total = counts.groupBy("cat").agg(F.sum("_n").alias("_total"))  # one row per category
    hot = counts.join(F.broadcast(total), "cat").where(F.col("_n") > F.col("_total") * HOT_SHARE)
    return stage(hot.drop("_n", "_total"), "hot_levels")


# -- which categories qualify ------------------------------------------------

def distinct_levels(df: DataFrame, cats: Sequence[str], max_levels: int = 500) -> DataFrame:
    """``(cat, n_levels, too_many)`` without nulls; ``n_levels`` is exact or null.

    A sketch pass (one row out) rules out columns that are far beyond
    ``max_levels``; only the rest are counted exactly, so an identifier-like
    column never has its levels shuffled. Above ``max_levels`` there is no number.
    """
    sketch = df.agg(*[F.approx_count_distinct(F.col(c), 0.02).alias(c) for c in cats]).first().asDict()
    exact = [c for c in cats if sketch[c] <= 2 * max_levels]
    rough = [c for c in cats if c not in exact]
    parts = []
    if exact:
        levels = explode_levels(df, exact, [], False).groupBy("cat", "level").agg(F.lit(1).alias("one"))
        n = levels.groupBy("cat").agg(F.count("level").alias("n"))
        few = F.col("n") <= max_levels
        parts.append(n.select("cat", F.when(few, F.col("n")).alias("n_levels"), (~few).alias("too_many")))
    if rough:
        items = F.array(*[F.struct(F.lit(c).alias("cat"), F.lit(None).cast("bigint").alias("n_levels"),
                                   F.lit(True).alias("too_many")) for c in rough])
        parts.append(df.sparkSession.range(1).select(F.inline(items)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eligible_categories(df: DataFrame, cats: Sequence[str], low: int = 2, high: int = 500) -> list[str]:
    """Categories with between ``low`` and ``high`` levels, in schema order."""
    rows = distinct_levels(df, cats, high).where(F.col("n_levels").between(low, high)).collect()
    found = {r["cat"] for r in rows}
    return [c for c in cats if c in found]


# -- frequency ---------------------------------------------------------------

def level_counts(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """``(cat, level, n, freq)`` over all rows given; a null level keeps its row so
    that frequencies refer to every row."""
    counts = explode_levels(df, cats, [], False).groupBy("cat", "level").agg(F.count("*").alias("n"))
    # totals per category column: one row each, computed without moving the levels
    total = counts.groupBy("cat").agg(F.sum("n").alias("_total"))
    return (counts.join(F.broadcast(total), "cat")
            .select("cat", "level", "n", (F.col("n") / F.col("_total")).alias("freq")))


def frequency_encode(rows: DataFrame, cats: Sequence[str], population: DataFrame | None = None,
                     key: str = "customer_id", replace: bool = False, **lookup) -> DataFrame:
    """Add ``freq_<cat>``, the share of the level among all rows of ``population``
    (train and test together). Null stays null, or becomes 0 with ``replace``, which
    puts the frequency in place of the category."""
    counts = staged_by(level_counts(population if population is not None else rows, cats), "cat", "level_counts")
    small = fitting(counts, "cat", lookup.get("max_rows", MAX_BROADCAST_ROWS))
    large = [c for c in cats if c not in small]
    hot = hot_levels(rows, large, [], False) if large else None
    out = rows
    for c in cats:
        one = counts.where((F.col("cat") == c) & F.col("level").isNotNull()).select(
            F.col("level").alias("_level"), "n", F.col("freq").alias("_freq"))
        out = out.withColumn("_level", F.col(c).cast("string"))
        known = hot.where(F.col("cat") == c).select(F.col("level").alias("_level")) if c in large else None
        out = keyed_lookup(out, one, ["_level"], weight="n", spread_by=[key], staged=True, broadcast=c in small, hot=known, **lookup)
        if replace:
            out = out.drop("_level", "n").withColumn(c, F.coalesce("_freq", F.lit(0.0))).drop("_freq")
        else:
            out = out.drop("_level", "n").withColumnRenamed("_freq", f"freq_{c}")
    return out.select(*rows.columns, *([] if replace else [f"freq_{c}" for c in cats]))


# -- target means ------------------------------------------------------------

def smoothed(total: str, n: str, prior: str, smoothing: float) -> str:
    return f"({total} + {number(smoothing)} * ({prior})) / ({n} + {number(smoothing)})"


def fit_target_means(train: DataFrame, cats: Sequence[str], labels: Sequence[str], fold: str | None = None,
                     smoothing: float = 50.0, prior: str = "global", own_null_level: bool = True) -> DataFrame:
    """Encodings ``(cat, level, fold, n, e_<label>...)`` in one aggregation.

    ``fold = -1`` holds the statistics of all train rows, for test rows. For every
    fold of train rows the encoding is what a refit on the other folds would give:
    the level's totals minus its own fold's. A level seen only in its own fold is
    left with no rows and so gets the prior. Labels stay side by side as aggregate
    columns, so a row is multiplied by the number of categories only.
    """
    cells = explode_levels(train, cats, [f"{fold or ALL_FOLDS} as fold", *labels], own_null_level)
    stats = cells.groupBy("cat", "level", "fold").agg(
        F.count("*").alias("n"), *[F.expr(f"sum(cast({t} as double)) as s_{t}") for t in labels])
    # the table below has at most categories x levels x folds rows; staged because
    # both totals, a window and the full-fit branch read it
    stats = stage(stats, "target_sums")
    sums = ["n", *[f"s_{t}" for t in labels]]
    # one row per category and fold, so it may be broadcast: its size does not grow with rows or levels
    by_fold = stage(stats.groupBy("cat", "fold").agg(*[F.sum(m).alias(f"f_{m}") for m in sums]), "target_totals")
    by_cat = stage(by_fold.groupBy("cat").agg(*[F.sum(f"f_{m}").alias(f"c_{m}") for m in sums]), "target_totals")
    totals = by_fold.join(F.broadcast(by_cat), "cat")
    # a window holds the folds of one level
    stats = stats.selectExpr("*", *[f"sum({m}) OVER (PARTITION BY cat, level) as l_{m}" for m in sums],
                             "row_number() OVER (PARTITION BY cat, level ORDER BY fold) as first"
                             ).join(F.broadcast(totals), ["cat", "fold"])
    overall = {t: f"c_s_{t} / c_n" for t in labels}
    outside = {t: f"try_divide(c_s_{t} - f_s_{t}, c_n - f_n)" for t in labels} if prior == "fold" else overall
    full = stats.where("first = 1").selectExpr(
        "cat", "level", f"{ALL_FOLDS} as fold", "l_n as n",
        *[f"{smoothed(f'l_s_{t}', 'l_n', overall[t], smoothing)} as e_{t}" for t in labels])
    if fold is None:
        return full
    held_out = stats.selectExpr("cat", "level", "fold", "n", *[
        f"{smoothed(f'(l_s_{t} - s_{t})', '(l_n - n)', outside[t], smoothing)} as e_{t}" for t in labels])
    return held_out.unionByName(full)


def label_priors(train: DataFrame, labels: Sequence[str]) -> dict[str, float]:
    row = train.selectExpr(*[f"avg(cast({t} as double)) as {t}" for t in labels]).first()
    return {t: row[t] for t in labels}


def apply_target_means(rows: DataFrame, encodings: DataFrame, names: dict[str, tuple[str, str]],
                       priors: dict[str, float], fold: str | None = None, own_null_level: bool = True,
                       key: str = "customer_id", **lookup) -> DataFrame:
    """Add the columns ``{name: (cat, label)}``. Rows whose ``fold`` is null (test)
    use the full fit; a level without an encoding gets the label's prior."""
    by_cat: dict[str, dict[str, str]] = {}
    for name, (cat, label) in names.items():
        by_cat.setdefault(cat, {})[name] = label
    small = fitting(encodings, "cat", lookup.get("max_rows", MAX_BROADCAST_ROWS))
    of_fold = f"coalesce({fold}, {ALL_FOLDS})" if fold else f"{ALL_FOLDS}"
    large = [c for c in by_cat if c not in small]
    hot = hot_levels(rows, large, [f"{of_fold} as fold"], own_null_level) if large else None
    out = rows.withColumn("_fold", F.expr(of_fold))
    for cat, wanted in by_cat.items():
        one = encodings.where(f"cat = '{cat}'").selectExpr(
            "level as _level", "fold as _fold", "n as _n", *[f"e_{t} as _e_{name}" for name, t in wanted.items()])
        kept = out.columns
        known = hot.where(F.col("cat") == cat).select(F.col("level").alias("_level"), F.col("fold").alias("_fold")) if cat in large else None
        out = keyed_lookup(out.withColumn("_level", F.expr(level_of(cat, own_null_level))), one, ["_level", "_fold"],
                           weight="_n", spread_by=[key], staged=True, broadcast=cat in small, hot=known, **lookup)
        out = out.selectExpr(*kept, *[f"coalesce(_e_{name}, {number(priors[t])}) as {name}" for name, t in wanted.items()])
    return out.select(*rows.columns, *names)


def encoding_dispersion(encodings: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Population std over all train rows of every held-out encoding, from the
    encoding table alone: each of its rows stands for ``n`` equal train values."""
    items = ", ".join(f"struct({i} as label_ordinal, '{t}' as target, e_{t} as e)" for i, t in enumerate(labels))
    cells = encodings.where(F.col("fold") != ALL_FOLDS).selectExpr("cat", "n", f"inline(array({items}))")
    mean = cells.groupBy("cat", "label_ordinal", "target").agg(
        (F.sum(F.col("n") * F.col("e")) / F.sum("n")).alias("mean"))
    # (cat, label) pairs: bounded by the schema
    centred = cells.join(F.broadcast(mean), ["cat", "label_ordinal", "target"])
    return centred.groupBy("cat", "label_ordinal", "target").agg(
        F.sqrt(F.sum(F.col("n") * (F.col("e") - F.col("mean")) ** 2) / F.sum("n")).alias("std"))


def oof_target_encode(rows: DataFrame, cats: Sequence[str], labels: Sequence[str], fold: str = "fold",
                      smoothing: float = 50.0, prior: str = "global", top: int | None = None,
                      key: str = "customer_id", **lookup) -> DataFrame:
    """Out-of-fold encodings ``te_<cat>_<label>`` for train rows (``fold`` set) and
    full-fit encodings for test rows (``fold`` null). With ``top``, only the most
    dispersed encodings are built at all."""
    train = rows.where(F.col(fold).isNotNull())
    encodings = staged_by(fit_target_means(train, cats, labels, fold, smoothing, prior), "cat", "encodings")
    names = {f"te_{c}_{t}": (c, t) for t in labels for c in cats}
    if top is not None and len(names) > top:
        kept = {f"te_{r['cat']}_{r['target']}"
                for r in (encoding_dispersion(encodings, labels)
                          .orderBy(F.desc("std"), "label_ordinal", "cat").limit(top).collect())}
        names = {n: v for n, v in names.items() if n in kept}
    return apply_target_means(rows, encodings, names, label_priors(train, labels), fold, key=key, **lookup)


def composite_target_encode(rows: DataFrame, cats: Sequence[str], y: str, is_train: Column,
                            fold: str | None = None, smoothing: float = 50.0, key: str = "customer_id",
                            **lookup) -> DataFrame:
    """Replace every category by the smoothed mean of one numeric label; null and
    unseen levels get the overall mean. With ``fold`` the train rows are encoded
    out of fold; without it each row's own label leaks into its value."""
    train = rows.where(is_train)
    encodings = staged_by(fit_target_means(train.where(F.col(y).isNotNull()), cats, [y], fold, smoothing,
                                           own_null_level=False).where(F.col("level").isNotNull()), "cat", "encodings")
    names = {f"_enc_{c}": (c, y) for c in cats}
    out = apply_target_means(rows, encodings, names, label_priors(train, [y]), fold, own_null_level=False,
                             key=key, **lookup)
    return out.withColumns({c: F.col(f"_enc_{c}") for c in cats}).drop(*names)



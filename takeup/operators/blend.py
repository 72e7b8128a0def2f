"""Rank blending of models: per-label weight search and its application.

Weights are whole hundredths and ranks are doubled average ranks, so a blended
value is a whole number and ties are exact, whatever the order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from takeup.operators.metrics import area, average_ranks, class_counts
from takeup.operators.ordering import DIRECT_ROWS, LONG_PAIR_ROWS, concordance, distinct_values, pair_product
from takeup.session import stage

WHOLE = 100
GATE = 0.05
# most joint rank cells of a label; one task reads the cells of one label
MAX_CELLS = 1 << 18
# successive resolutions of the pruning histograms
BIN_LEVELS = (512, 8192, 131072)

Weights = tuple[int, ...]
Candidates = dict[str, list[tuple[int, Weights]]]


# -- weight grids ------------------------------------------------------------

def simplex_grid(k: int, step: int) -> list[Weights]:
    """All weights of ``k`` models in multiples of ``step`` hundredths that sum to
    100, first model slowest."""
    if k == 1:
        return [(WHOLE,)]

    def fill(left: int, models: int) -> list[Weights]:
        if models == 1:
            return [(left,)]
        return [(w, *rest) for w in range(0, left + 1, step) for rest in fill(left - w, models - 1)]

    return fill(WHOLE, k)


def default_step(k: int) -> int:
    """Coarse step: 2 for two models, 5 for three, 10 beyond."""
    return {2: 2, 3: 5}.get(k, 10)


def fine_grid(centre: Sequence[int], reach: int = 10, step: int = 2) -> list[Weights]:
    """Weights around ``centre`` in all but the last coordinate, which takes the rest."""
    out = []
    for shift in product(range(-reach, reach + 1, step), repeat=len(centre) - 1):
        head = tuple(c + d for c, d in zip(centre, shift))
        w = (*head, WHOLE - sum(head))
        if all(0 <= v <= WHOLE for v in w):
            out.append(w)
    return out


def equal_weights(k: int) -> Weights:
    """Used when no grid point has any correctly ordered pair."""
    base = WHOLE // k
    return (*[base] * (k - 1), WHOLE - base * (k - 1))


# -- joint rank cells --------------------------------------------------------

def rank_cells(ranks: DataFrame, k: int, limit: int = MAX_CELLS) -> DataFrame:
    """``(target, pos, neg, low, high)``: counts of the rows in every cell of the joint rank space, and the
    cell's smallest box around their ranks.

    A label with at most ``limit`` rows keeps every rank vector as a cell of its own. Larger ones have a grid of
    equal steps per model, as many as make at most ``limit`` cells in all. Rows meet their cell
    on the map side, so no task sends more rows than there are cells.
    """
    steps = int(limit ** (1.0 / k) + 1e-9)
    cell = f"transform(r, x -> if(n <= {limit}, x, x * {steps} div (2 * n + 1)))"
    sides = [f"{f}(r[{m}]) as {f}{m}" for f in ("min", "max") for m in range(k)]
    cells = ranks.selectExpr("target", "y", "r", f"{cell} as cell").groupBy("target", "cell").agg(
        F.expr("sum(cast(y > 0 as bigint)) as pos"), F.expr("count(*) as rows"), *[F.expr(e) for e in sides])
    box = [f"array({', '.join(f'{f}{m}' for m in range(k))}) as {name}" for f, name in (("min", "low"), ("max", "high"))]
    return cells.selectExpr("target", "pos", "rows - pos as neg", *box)


def pair_bounds(pos: np.ndarray, neg: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, int]:
    """Least and most ordered pairs, doubled, when a row's value is only known to lie between ``low`` and ``high``.

    Both are the exact count where every low equals its high.
    """
    plus, minus = pos > 0, neg > 0
    point = low is high

    def counted(mine: np.ndarray, other: np.ndarray) -> int:
        order = np.argsort(other[minus])
        ends, total = other[minus][order], np.concatenate([[0], np.cumsum(neg[minus][order])])
        # those strictly below count twice, those that may just tie count once
        below = total[np.searchsorted(ends, mine[plus])] + total[np.searchsorted(ends, mine[plus], "right")]
        if float(total[-1]) * float(pos.sum()) * 2 < 2 ** 62:
            return int(pos[plus] @ below)
        return sum(int(a) * int(b) for a, b in zip(pos[plus], below))

    least = counted(low, high)
    return least, least if point else counted(high, low)


def cell_bounds(cells: DataFrame, candidates: Candidates, parts: int = 4) -> list[tuple]:
    """``(target, o, low, high)`` of every candidate from the cells. The candidates of a label are dealt to ``parts``
    tasks, each of which reads the label's cells, a bounded table, and orders them once per candidate."""
    shared = {t: [points[p::parts] for p in range(parts)] for t, points in candidates.items()}
    k = len(next(iter(candidates.values()))[0][1])
    sides = [f"{side}{m}" for side in ("low", "high") for m in range(k)]

    def bound(group: pa.Table) -> pa.Table:
        t, part = group.column("target")[0].as_py(), group.column("part")[0].as_py()
        values = {c: group.column(c).to_numpy() for c in ("pos", "neg", *sides)}
        low, high = (np.stack([values[f"{side}{m}"] for m in range(k)], axis=1) for side in ("low", "high"))
        points = bool((low == high).all())
        found: list[tuple] = []
        for o, w in shared[t][part]:
            least = low @ np.array(w, dtype=np.int64)
            most = least if points else high @ np.array(w, dtype=np.int64)
            found.append((o, *pair_bounds(values["pos"], values["neg"], least, most)))
        return pa.table({"target": [t] * len(found), "o": pa.array([f[0] for f in found], pa.int32()),
                         "low": [str(f[1]) for f in found], "high": [str(f[2]) for f in found]})

    flat = [f"{side}[{m}] as {side}{m}" for side in ("low", "high") for m in range(k)]
    dealt = cells.where(F.col("target").isin(*candidates)).selectExpr(
        "target", "pos", "neg", *flat, f"explode(sequence(0, {parts - 1})) as part")
    rows = dealt.groupBy("target", "part").applyInArrow(bound, "target string, o int, low string, high string").collect()
    return [(r["target"], r["o"], int(r["low"]), int(r["high"])) for r in rows]


# -- rank table --------------------------------------------------------------

def rank_table(scores: DataFrame, models: Sequence[str], key: str = "customer_id", salts: int | None = None,
               **lookup) -> DataFrame:
    """``(target, key, n, r[, y])``: one row per key and label with the doubled average
    ranks of all models, staged and stored by label.

    ``scores`` must be aligned (every key has every model); its label value ``y`` is
    kept. Rows are exchanged by label and a bucket of the key, so that later tasks
    each see one label: the state of a weight search on the map side is then one
    label's.
    """
    spark = scores.sparkSession
    extra = [c for c in ("y",) if c in scores.columns]
    ranked = average_ranks(scores, ["model", "target"], "score", key, **lookup)
    if salts is None:
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    ranked = ranked.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(salts)))
    ranked = ranked.repartition("target", "_bucket")
    rows = ranked.groupBy("target", "_bucket", key).agg(
        F.max("n").alias("n"),
        F.array(*[F.max(F.when(F.col("model") == m, F.col("rank2"))) for m in models]).alias("r"),
        *[F.max(c).alias(c) for c in extra])
    return stage(rows.drop("_bucket"), "ranks", ["target"])


def blended(weights: str, ranks: str, k: int) -> str:
    """Whole-number blend of the rank array by the weight array."""
    return "(" + " + ".join(f"{weights}[{m}] * {ranks}[{m}]" for m in range(k)) + ")"


def _scored(ranks: DataFrame, candidates: Candidates) -> DataFrame:
    """``(t, o, n, y, b)``: every row under every candidate of its label; ``t`` is the
    label's place in sorted order (whole-number keys aggregate fastest). The candidate
    table has one row per label."""
    k = len(next(iter(candidates.values()))[0][1])
    rows = [(t, i, [(o, list(w)) for o, w in candidates[t]]) for i, t in enumerate(sorted(candidates))]
    grid = ranks.sparkSession.createDataFrame(rows, "target string, t int, grid array<struct<o:int,w:array<bigint>>>")
    unfolded = ranks.join(F.broadcast(grid), "target").select("t", "n", "y", "r", F.explode("grid").alias("g"))
    return unfolded.selectExpr("t", "g.o as o", "n", "y", f"{blended('g.w', 'r', k)} as b")


def _bounds(ranks: DataFrame, candidates: Candidates, bins: int, rows_per_label: int) -> list:
    """Lowest and highest possible pair count of every candidate when values are
    only known to their bin: pairs inside a bin may fall either way.

    A task keeps one histogram per label it meets, candidates x bins counts, and sends what is not zero in it;
    rows are never multiplied by the candidates.
    """
    order = sorted(candidates)
    weights = {t: (i, np.array([o for o, _ in candidates[t]]), np.array([w for _, w in candidates[t]], dtype=np.int64))
               for i, t in enumerate(order)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            target = batch.column(0).dictionary_encode()
            n, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            r = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1).astype(np.int64)
            place = target.indices.to_numpy(zero_copy_only=False)
            for code, t in enumerate(target.dictionary.to_pylist()):
                if t not in weights:
                    continue
                grid, mine = weights[t][2], place == code
                table = counts.setdefault(t, np.zeros((2, len(grid) * bins), dtype=np.int64))
                ranks_, positive = r[mine], y[mine] > 0
                top = 2 * WHOLE * n[mine].astype(np.int64) + 1
                for o, w in enumerate(grid):
                    slot = ranks_ @ w * bins // top + o * bins
                    np.add.at(table[1], slot, 1)
                    np.add.at(table[0], slot[positive], 1)
        for t, table in counts.items():
            at = np.flatnonzero(table[1])
            i, names, _ = weights[t]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, np.int32)), pa.array(names[at // bins].astype(np.int32)), pa.array(at),
                 pa.array(table[0][at]), pa.array(table[1][at])], names=["t", "o", "slot", "pos", "rows"])

    counts = (ranks.select("target", "n", "r", "y").mapInArrow(count, "t int, o int, slot long, pos long, rows long")
              .groupBy("t", "o", "slot").agg(F.sum("pos").alias("pos"), F.sum("rows").alias("rows"))
              .selectExpr("t", "o", "slot", "pos", "rows - pos as neg"))
    wide = rows_per_label > LONG_PAIR_ROWS
    kind = "decimal(38,0)" if wide else "bigint"
    below = counts.selectExpr("*", "coalesce(sum(neg) OVER (PARTITION BY t, o ORDER BY slot "
                                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) as below")
    return (below.selectExpr("t", "o", f"{pair_product('pos', 'below', wide)} as sure",
                             f"{pair_product('pos', 'neg', wide)} as open")
            .groupBy("t", "o").agg(F.sum("sure").cast(kind).alias("low"),
                                   (F.sum("sure") + F.sum("open")).cast(kind).alias("high")).collect())


def _keep(candidates: Candidates, bounds: list[tuple]) -> Candidates:
    """Candidates that may still win, from ``(target, o, low, high)``."""
    floor: dict[str, int] = {}
    for t, _, low, _ in bounds:
        floor[t] = max(floor.get(t, low), low)
    alive = {(t, o) for t, o, _, high in bounds if high >= floor[t]}
    return {t: [c for c in points if (t, c[0]) in alive] for t, points in candidates.items()}


def prune(ranks: DataFrame, candidates: Candidates, rows_per_label: int,
          levels: Sequence[int] = BIN_LEVELS) -> Candidates:
    """Drop candidates that certainly lose, at rising resolution. Every pass is one
    scan with map-side counts of at most candidates x bins; what cannot be decided
    stays, so the exact count that follows always sees the winner and its ties."""
    for bins in levels:
        if bins * 4 > rows_per_label or max(len(c) for c in candidates.values()) <= 8:
            break
        order = sorted(candidates)
        candidates = _keep(candidates, [(order[r["t"]], r["o"], r["low"], r["high"])
                                        for r in _bounds(ranks, candidates, bins, rows_per_label)])
    return candidates


def exact_areas(ranks: DataFrame, candidates: Candidates, rows_per_label: int | None = None) -> DataFrame:
    """Exact ``(target, o, pos, neg, pairs2, auc)`` of every candidate. With labels
    known to be small a candidate's rows are ordered in one task, in one exchange."""
    keys = ["t", "o"]
    small = rows_per_label is not None and rows_per_label <= DIRECT_ROWS
    scored = _scored(ranks, candidates).select(*keys, "y", "b")
    if small:
        scored = scored.repartition(*keys)
    counts = distinct_values(scored, keys, "b", class_counts(F.col("y")))
    areas = concordance(counts, keys, "b", rows_per_label, direct=small)
    names = "array(" + ", ".join(f"'{t}'" for t in sorted(candidates)) + ")"
    return areas.selectExpr(f"{names}[t] as target", "o", "pos", "neg", "pairs2").withColumn("auc", area())


def first_best(areas: DataFrame) -> dict[str, tuple[int, int, float]]:
    """Per label the earliest candidate with the most ordered pairs: one row per label."""
    w = Window.partitionBy("target").orderBy(F.desc("pairs2"), "o")
    best = areas.withColumn("_r", F.row_number().over(w)).where("_r = 1").collect()
    return {r["target"]: (r["o"], int(r["pairs2"]), r["auc"]) for r in best}


def search_weights(ranks: DataFrame, k: int, step: int | None = None, refine: bool | None = None,
                   levels: Sequence[int] = BIN_LEVELS, grid: Sequence[Weights] | None = None,
                   limit: int = MAX_CELLS) -> dict[str, dict]:
    """Best weights per label: ``{target: {"weights", "auc"}}``, exact over the whole
    grid. One pass collapses the rows to cells of the joint rank space; bounds from the cells rule out weights
    that certainly lose, and decide at once where cells are single points. With ``refine`` (default for four models or more) a fine grid around the
    coarse winner follows; it must be strictly better to replace it. Labels with
    one class get equal weights and AUC 0.5.
    """
    stats = ranks.groupBy("target").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    usable = [r["target"] for r in stats if 0 < r["pos"] < r["n"]]
    out = {r["target"]: {"weights": tuple(WHOLE / k for _ in range(k)), "auc": 0.5}
           for r in stats if r["target"] not in usable}
    if not usable:
        return out
    n = max(r["n"] for r in stats)
    size = {r["target"]: int(r["pos"]) * int(r["n"] - r["pos"]) for r in stats}
    points = list(enumerate(grid if grid is not None else simplex_grid(k, step or default_step(k))))
    live = ranks.where(F.col("target").isin(*usable))
    cells = stage(rank_cells(live, k, limit), "rank_cells")

    def run(candidates: dict) -> tuple[dict, dict]:
        bounds = cell_bounds(cells, candidates)
        kept = _keep(candidates, bounds)
        # cells that are single points give the exact counts; what is not decided by them is looked at in the rows
        exact = {(t, o): low for t, o, low, high in bounds if low == high}
        best, undecided = {}, {}
        for t, alive in kept.items():
            if all((t, o) in exact for o, _ in alive):
                o = min((o for o, _ in alive), key=lambda o: (-exact[t, o], o))
                best[t] = (o, exact[t, o], exact[t, o] / (2.0 * size[t]))
            else:
                undecided[t] = alive
        if undecided:
            rest = live.where(F.col("target").isin(*undecided))
            undecided = prune(rest, undecided, n, levels)
            best.update(first_best(exact_areas(rest, undecided, n)))
        return {**kept, **undecided}, best

    kept, best = run({t: points for t in usable})
    weights = {t: dict(kept[t])[o] if pairs else equal_weights(k) for t, (o, pairs, _) in best.items()}
    if refine if refine is not None else k >= 4:
        around = {t: list(enumerate(fine_grid(weights[t]))) for t in usable}
        fine_kept, fine = run(around)
        for t, (o, pairs, value) in fine.items():
            if pairs > best[t][1]:
                weights[t], best[t] = dict(fine_kept[t])[o], (o, pairs, value)
    for t in usable:
        out[t] = {"weights": weights[t], "auc": best[t][2]}
    return out


def two_model_blend(ranks: DataFrame, solo: dict[str, tuple[float, float]], gate: float = GATE,
                    step: int = 5, **options) -> dict[str, dict]:
    """Weights of two models; where the second is better by more than ``gate`` it is
    used alone."""
    alone = [t for t, (a, b) in solo.items() if a is not None and b is not None and b - a > gate]
    out = {t: {"weights": (0, WHOLE), "auc": solo[t][1]} for t in alone}
    rest = ranks.where(~F.col("target").isin(*alone)) if alone else ranks
    out.update(search_weights(rest, 2, grid=simplex_grid(2, step), refine=False, **options))
    return out


def weights_table(spark: SparkSession, found: dict[str, dict], models: Sequence[str]) -> DataFrame:
    """``(target, model, weight, auc)``: labels x models rows, weights between 0 and 1."""
    rows = [(t, m, float(w) / WHOLE, float(v["auc"])) for t, v in found.items() for m, w in zip(models, v["weights"])]
    return spark.createDataFrame(rows, "target string, model string, weight double, auc double")


def apply_weights(ranks: DataFrame, found: dict[str, dict], key: str = "customer_id") -> DataFrame:
    """``(key, target, score)``: weighted sum of percentile ranks."""
    rows = [(t, [float(w) / WHOLE for w in v["weights"]]) for t, v in found.items()]
    weights = ranks.sparkSession.createDataFrame(rows, "target string, w array<double>")
    joined = ranks.join(F.broadcast(weights), "target")
    value = F.aggregate(F.zip_with("w", "r", lambda w, r: w * r), F.lit(0.0), lambda a, v: a + v)
    return joined.select(key, "target", (value / (2.0 * F.col("n"))).alias("score"))


# -- reports -----------------------------------------------------------------

def blend_report(weights: DataFrame) -> DataFrame:
    """Per model: mean weight over labels better than chance, and the number of
    labels that use it (weight above 0.01)."""
    good = F.when(F.col("auc") > 0.5, F.col("weight"))
    return weights.groupBy("model").agg(
        F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_weight"), F.count(good).alias("n_labels"),
        F.sum((F.col("weight") > 0.01).cast("bigint")).alias("n_used"))


def label_report(weights: DataFrame, solo: DataFrame, models: Sequence[str], used: float = 0.01) -> DataFrame:
    """One row per label: every model's own AUC and weight, the blend's AUC and the number of models in use."""
    both = weights.join(solo.select("target", "model", F.col("auc").alias("_solo")), ["target", "model"], "left")

    def of(m: str, c: str, name: str):
        return F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{name}_{m}")

    return both.groupBy("target").agg(
        *[of(m, "_solo", "solo") for m in models], *[of(m, "weight", "weight") for m in models],
        F.max("auc").alias("blend_auc"), F.sum((F.col("weight") > used).cast("int")).cast("int").alias("n_used"))


def blend_summary(weights: DataFrame, usable: DataFrame, name: str) -> DataFrame:
    """One row for a blend: labels with both classes (``usable``), mean, least and largest AUC over them, and
    the mean over labels better than chance."""
    per_label = weights.select("target", "auc").distinct().join(F.broadcast(usable.select("target")), "target")
    return per_label.agg(
        F.lit(name).alias("blend"), F.count("*").alias("n_labels"), F.avg("auc").alias("mean_auc"),
        F.avg(F.when(F.col("auc") > 0.5, F.col("auc"))).alias("mean_auc_above_half"),
        F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc")).select(
            "blend", "n_labels", "mean_auc", "mean_auc_above_half", "min_auc", "max_auc")


def worst_and_best(per_label: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` labels with the lowest and the highest AUC: ``(side, target, auc)``."""
    known = per_label.where(F.col("auc").isNotNull()).select("target", "auc")
    return (known.orderBy("auc", "target").limit(k).withColumn("side", F.lit("worst"))
            .unionByName(known.orderBy(F.desc("auc"), F.desc("target")).limit(k).withColumn("side", F.lit("best"))))

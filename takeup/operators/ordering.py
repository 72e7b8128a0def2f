"""Exact order statistics over unbounded groups without a one-task window.

Ranks, areas under curves and quantiles all need "how many rows hold a smaller
value". A window over the group would sort the whole group in one task. Instead
the rows are first collapsed to distinct values with their counts (ties, however
many, become one row on the map side), and the values are cut into blocks at two
levels by a monotone code of the value itself. Running totals are taken inside
fine blocks, over the fine blocks of a coarse block, and over the coarse blocks,
and added up. No sampling and no data-dependent cut points: the result is exact
and the same on every retry.

The code is ``sign(x) * (log2|x| + 1100)``: each power of two has 2^8 coarse blocks
and 2^18 fine blocks per coarse block, so a single-precision value never shares
its fine block, and a group has at most a few thousand coarse blocks in practice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

COARSE_BITS = 8
FINE_BITS = 26
# A table known to have at most this many rows is windowed by group directly.
DIRECT_ROWS = 1_000_000
# Up to this many rows per group twice the number of pairs fits 64 bits.
LONG_PAIR_ROWS = 3_000_000_000


def _code(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + F.lit(1100.0)))


def with_blocks(df: DataFrame, value: str) -> DataFrame:
    """Add the coarse and fine block numbers of ``value`` (finite, not null)."""
    code = _code(F.col(value).cast("double"))
    return (df.withColumn("_code", code)
              .withColumns({"_b1": F.floor(F.col("_code") * (1 << COARSE_BITS)),
                            "_b2": F.floor(F.col("_code") * (1 << FINE_BITS))})
              .drop("_code"))


def _before(keys: Sequence[str], order: str):
    return (Window.partitionBy(*keys).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1))


def _running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str]) -> DataFrame:
    w = _before(keys, order)
    return df.withColumns({out: F.coalesce(F.sum(m).over(w), F.lit(0)) for m, out in sums.items()})


def distinct_values(rows: DataFrame, group: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (group, value) with summed measures."""
    return rows.groupBy(*group, value).agg(*[c.alias(n) for n, c in measures.items()])


def cumulate(counts: DataFrame, group: Sequence[str], value: str, measures: Sequence[str],
             rows: int | None = None) -> DataFrame:
    """Add to a table of distinct values, for every measure ``m``, ``below_m``: its
    total over smaller values of the group, and ``all_m``: its group total. ``rows``
    is the table's size if known."""
    if rows is not None and rows <= DIRECT_ROWS:
        table = _running(counts, list(group), value, {m: f"below_{m}" for m in measures})
        whole = Window.partitionBy(*group)
        return table.withColumns({f"all_{m}": F.sum(m).over(whole) for m in measures})
    group = list(group)
    fine = with_blocks(counts, value)
    sums = [F.sum(m).alias(m) for m in measures]
    mid = fine.groupBy(*group, "_b1", "_b2").agg(*sums)
    top = mid.groupBy(*group, "_b1").agg(*sums)

    whole = Window.partitionBy(*group)
    top = _running(top, group, "_b1", {m: f"_c_{m}" for m in measures})
    top = top.select(*group, "_b1", *[f"_c_{m}" for m in measures],
                     *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures])
    mid = _running(mid, [*group, "_b1"], "_b2", {m: f"_m_{m}" for m in measures})
    base = mid.join(top, [*group, "_b1"]).select(
        *group, "_b1", "_b2", *[f"all_{m}" for m in measures],
        *[(F.col(f"_c_{m}") + F.col(f"_m_{m}")).alias(f"_base_{m}") for m in measures])
    fine = _running(fine, [*group, "_b1", "_b2"], value, {m: f"_f_{m}" for m in measures})
    return fine.join(base, [*group, "_b1", "_b2"]).select(
        *group, value, *measures,
        *[(F.col(f"_base_{m}") + F.col(f"_f_{m}")).alias(f"below_{m}") for m in measures],
        *[f"all_{m}" for m in measures])


def pair_product(a: str, b: str, wide: bool) -> str:
    """Twice the product of two counts as a whole number."""
    if wide:
        return f"cast(cast({a} as decimal(19,0)) * cast({b} as decimal(18,0)) * 2 as decimal(38,0))"
    return f"({a} * {b} * 2)"


def concordance(counts: DataFrame, group: Sequence[str], value: str, group_rows: int | None = None,
                direct: bool = False) -> DataFrame:
    """``(group..., pos, neg, pairs2)``: twice the number of correctly ordered
    (positive, negative) pairs, ties counting half, from a table of distinct values
    with ``pos`` and ``neg``.

    Pairs inside a fine block, between fine blocks and between coarse blocks are
    counted one level after the other in a single chain; with ``direct`` (small
    groups) the group is one block. Counts are whole numbers, so equal orderings
    give exactly equal results: 64 bits where ``group_rows``, the most rows a group
    can have, allows it, else decimals.
    """
    group = list(group)
    wide = group_rows is None or group_rows > LONG_PAIR_ROWS
    kind = "decimal(38,0)" if wide else "bigint"

    def inside(t: DataFrame, keys: list[str], order: str, ties: bool) -> DataFrame:
        t = _running(t, keys, order, {"neg": "_below"})
        here = pair_product("pos", "_below", wide)
        rest = f"{pair_product('pos', 'neg', wide)} / 2" if wide else "pos * neg"
        return t.withColumn("pairs2", F.expr(f"cast({here} + {rest if ties else 'pairs2'} as {kind})"))

    def up(t: DataFrame, keys: list[str]) -> DataFrame:
        return t.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                    F.sum("pairs2").cast(kind).alias("pairs2"))

    if direct:
        return up(inside(counts, group, value, True), group)
    table = inside(with_blocks(counts, value), [*group, "_b1", "_b2"], value, True)
    for keys, order in (([*group, "_b1"], "_b2"), (group, "_b1")):
        table = inside(up(table, [*keys, order]), keys, order, False)
    return up(table, group)


def order_statistics(rows: DataFrame, group: Sequence[str], value: str, steps: int) -> DataFrame:
    """Exact quantiles ``k / steps`` for k = 0..steps of every group by linear
    interpolation at ``k * (n - 1) / steps``: rows ``(group, k, q)``.

    Every distinct value covers a run of ranks; whole-number arithmetic gives the
    ks whose lower or upper neighbour lies in that run.
    """
    group = list(group)
    counts = distinct_values(rows.where(F.col(value).isNotNull()), group, value, {"n": F.count("*")})
    return quantiles_of_runs(cumulate(counts, group, value, ["n"]), group, value, steps)


def quantiles_of_runs(runs: DataFrame, group: Sequence[str], value: str, steps: int) -> DataFrame:
    """The same from distinct values with their counts ``n``, the rows below (``below_n``) and in the group (``all_n``).
    Values that are no neighbour of a quantile may be missing."""
    lo, hi = F.col("low"), F.col("high")
    return neighbours_of_runs(runs, group, value, steps).select(*group, "k", (lo + (hi - lo) * F.col("share")).alias("q"))


def neighbours_of_runs(runs: DataFrame, group: Sequence[str], value: str, steps: int) -> DataFrame:
    """``(group..., k, low, high, share)``: the two values that quantile ``k / steps`` lies between and how far along it
    lies. A rising function of the values keeps them neighbours."""
    group = list(group)
    span = F.greatest(F.col("all_n") - 1, F.lit(1))
    first, after = F.col("below_n"), F.col("below_n") + F.col("n")
    m = F.lit(steps)

    # ceil and floor of a * m / span as whole numbers
    def down(a: Column) -> Column:
        return F.floor((a * m - F.pmod(a * m, span)) / span)

    def up(a: Column) -> Column:
        return -down(-a)

    low_from = up(first)
    low_to = F.when(F.col("all_n") == 1, m).otherwise(up(after) - 1)
    high_from, high_to = down(first - 1) + 1, down(after - 1)
    ends = runs.select(
        *group, F.col(value).alias("_v"), (F.col("all_n") - 1).alias("_span"),
        F.greatest(low_from, F.lit(0)).cast("int").alias("_l0"), F.least(low_to, m).cast("int").alias("_l1"),
        F.greatest(high_from, F.lit(0)).cast("int").alias("_h0"), F.least(high_to, m).cast("int").alias("_h1"))

    def ks(a: str, b: str, side: str) -> Column:
        return F.when(F.col(a) <= F.col(b), F.transform(
            F.sequence(F.col(a), F.col(b)), lambda k: F.struct(k.alias("k"), F.lit(side).alias("side"))))

    empty = F.array().cast("array<struct<k:int,side:string>>")
    hit = ends.select(
        *group, "_v", "_span",
        F.explode(F.concat(F.coalesce(ks("_l0", "_l1", "l"), empty),
                           F.coalesce(ks("_h0", "_h1", "h"), empty))).alias("_hit"))
    out = hit.groupBy(*group, F.col("_hit.k").alias("k")).agg(
        F.max(F.when(F.col("_hit.side") == "l", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_hit.side") == "h", F.col("_v"))).alias("_hi"),
        F.max("_span").alias("_span"))
    share = F.pmod(F.col("k") * F.col("_span"), m) / m
    return out.select(*group, "k", F.col("_lo").alias("low"), F.coalesce("_hi", "_lo").alias("high"), share.alias("share"))

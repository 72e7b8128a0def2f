"""Mergeable quantile sketches of many columns, and exact quantiles refined from them.

A sketch keeps sorted samples in levels; a value of level ``h`` stands for ``2 ** h`` rows. When a level is full, every
other value moves one level up. Each such halving shifts any rank by at most half the level's weight either way, and the sketch
keeps the sum of these shifts: an error bound that holds for certain, whatever the order of the data or of the merges.
Which half moves alternates with the number of halvings so far, so equal input gives equal sketches.

One pass fills a sketch per task and column and sends its samples; sketches of a column are merged in a tree. Exact quantiles
come from a second pass that counts the values below the brackets and moves only the values inside them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from takeup.operators.blocks import matrix, with_matrix
from takeup.operators.ordering import cumulate, quantiles_of_runs
from takeup.operators.profile import named
from takeup.session import stage

#: samples a level holds before it is halved
WIDTH = 2048
#: sketches merged by one task at a time
FAN_IN = 64

SKETCH = "ordinal int, n long, error double, halvings long, level array<int>, value array<double>"


class Sketch:
    """Samples by level, rows seen, and the certain bound of the rank error."""

    def __init__(self, width: int = WIDTH):
        self.width, self.n, self.error, self.halvings = width, 0, 0.0, 0
        self.levels: list[np.ndarray] = [np.empty(0)]

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._shrink()

    def merge(self, n: int, error: float, halvings: int, level: np.ndarray, value: np.ndarray) -> None:
        self.n, self.error, self.halvings = self.n + n, self.error + error, self.halvings + halvings
        for h in range(int(level.max(initial=-1)) + 1):
            while len(self.levels) <= h:
                self.levels.append(np.empty(0))
            self.levels[h] = np.concatenate([self.levels[h], value[level == h]])
        self._shrink()

    def _shrink(self) -> None:
        h = 0
        while h < len(self.levels):
            held = self.levels[h]
            if len(held) > self.width:
                held = np.sort(held)
                even = len(held) // 2 * 2
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], held[self.halvings % 2:even:2]])
                self.levels[h] = held[even:]
                self.error += 2.0 ** h
                self.halvings += 1
            h += 1

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.levels)), [len(v) for v in self.levels]), np.concatenate(self.levels)


def column_sketches(df: DataFrame, cols: Sequence[str], width: int = WIDTH, nonzero: bool = False, block: int = 500) -> DataFrame:
    """One row per column (``SKETCH``): rows counted are those with a value (with ``nonzero``, other than zero)."""
    kept = None
    for start in range(0, len(cols), block):
        own = list(cols[start:start + block])

        def fill(batches: Iterator[pa.RecordBatch], start=start, own=len(own)) -> Iterator[pa.RecordBatch]:
            found = [Sketch(width) for _ in range(own)]
            for batch in batches:
                x = matrix(batch.column(0), own)
                for j in range(own):
                    values = x[:, j]
                    found[j].add(values[~np.isnan(values) & (values != 0)] if nonzero else values[~np.isnan(values)])
            yield _rows([(start + j, s) for j, s in enumerate(found) if s.n])

        part = with_matrix(df, own).mapInArrow(fill, SKETCH)
        kept = part if kept is None else kept.unionByName(part)

    def merge(table: pd.DataFrame) -> pd.DataFrame:
        out = Sketch(width)
        for r in table.sort_values(["n", "error", "halvings"]).itertuples():
            out.merge(r.n, r.error, r.halvings, np.asarray(r.level), np.asarray(r.value))
        level, value = out.parts()
        return pd.DataFrame([(int(table["ordinal"].iloc[0]), out.n, out.error, out.halvings, level, value)],
                            columns=["ordinal", "n", "error", "halvings", "level", "value"])

    # a tree: a column's sketches meet ``FAN_IN`` at a time, then all that are left
    kept = kept.groupBy("ordinal", F.floor(F.spark_partition_id() / FAN_IN)).applyInPandas(merge, SKETCH)
    return kept.groupBy("ordinal").applyInPandas(merge, SKETCH)


def _rows(found: list[tuple[int, Sketch]]) -> pa.RecordBatch:
    parts = [s.parts() for _, s in found]
    sizes = np.concatenate([[0], np.cumsum([len(v) for _, v in parts])]).astype(np.int32)

    def lists(k: int, kind) -> pa.ListArray:
        flat = np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind)
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))

    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in found], pa.int32()), pa.array([s.n for _, s in found], pa.int64()),
         pa.array([s.error for _, s in found], pa.float64()), pa.array([s.halvings for _, s in found], pa.int64()),
         lists(0, np.int32), lists(1, np.float64)], names=["ordinal", "n", "error", "halvings", "level", "value"])


def ordered(level: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples in order and the rows that they and those before stand for."""
    order = np.argsort(value, kind="stable")
    return value[order], np.cumsum(np.exp2(np.asarray(level)[order].astype(np.float64)))


def estimate(level: np.ndarray, value: np.ndarray, n: int, steps: int) -> np.ndarray:
    """Values near the ranks ``k * (n - 1) / steps``, from the smallest sample on."""
    samples, upto = ordered(np.asarray(level), np.asarray(value))
    ranks = np.arange(steps + 1) * (n - 1) / steps
    return samples[np.minimum(np.searchsorted(upto, ranks, "right"), len(samples) - 1)]


def brackets(level: np.ndarray, value: np.ndarray, n: int, error: float, steps: int) -> np.ndarray:
    """Disjoint value ranges (rows: low, high; both inclusive) that certainly hold the neighbours of all ranks
    ``k * (n - 1) / steps``. Ranges that touch are one."""
    samples, upto = ordered(np.asarray(level), np.asarray(value))
    ranks = np.arange(steps + 1) * (n - 1) / steps
    low_rank, high_rank = np.floor(ranks) - error - 1, np.floor(ranks) + 1 + error + 1
    # the sample before the rank less the error, and the one after the rank plus the error
    low_at = np.searchsorted(upto, low_rank, "right") - 1
    low = np.where(low_at >= 0, samples[np.maximum(low_at, 0)], -np.inf)
    high_at = np.searchsorted(upto, high_rank, "left") + 1
    high = np.where(high_at < len(samples), samples[np.minimum(high_at, len(samples) - 1)], np.inf)
    out = [[low[0], high[0]]]
    for a, b in zip(low[1:], high[1:]):
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out)


def exact_quantiles(df: DataFrame, cols: Sequence[str], steps: int, width: int = WIDTH, nonzero: bool = False,
                    block: int = 500) -> DataFrame:
    """``(ordinal, feature, k, q, n)``: exact quantiles ``k / steps`` by linear interpolation.

    After the sketches (one row per column is read) a second pass counts the values between the brackets, and the
    distinct values with their counts inside them; only the latter move. Running counts are taken per column
    over intervals and then inside a bracket.
    """
    spark = df.sparkSession
    found = column_sketches(df, cols, width, nonzero, block).collect()  # one bounded sketch per column of the schema
    if not found:
        return spark.createDataFrame([], "ordinal int, feature string, k int, q double, n long")
    ranges = {r["ordinal"]: brackets(r["level"], r["value"], r["n"], r["error"], steps) for r in found}
    kept = None
    for start in range(0, len(cols), block):
        own = list(cols[start:start + block])
        shared = spark.sparkContext.broadcast({j: ranges[start + j] for j in range(len(own)) if start + j in ranges})

        def count(batches: Iterator[pa.RecordBatch], start=start, own=len(own), shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0), own)
                made = []
                for j, limits in shared.value.items():
                    v = x[:, j]
                    v = v[~np.isnan(v) & (v != 0)] if nonzero else v[~np.isnan(v)]
                    if not len(v):
                        continue
                    v, often = np.unique(v + 0.0, return_counts=True)
                    # interval 2 i + 1 is bracket i, interval 2 i lies before it
                    at = np.searchsorted(limits[:, 0], v, "right") * 2 - 1
                    at = np.where(at < 0, 0, at + (v > limits[np.maximum(at // 2, 0), 1]))
                    inside = at % 2 == 1
                    between, n = np.unique(at[~inside], return_inverse=True)
                    made.append((np.full(inside.sum(), start + j), at[inside], v[inside], often[inside]))
                    made.append((np.full(len(between), start + j), between, np.full(len(between), np.nan),
                                 np.bincount(n, often[~inside], len(between)).astype(np.int64)))
                if made:
                    ordinal, interval, value, often = (np.concatenate([m[k] for m in made]) for k in range(4))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ordinal.astype(np.int32)), pa.array(interval.astype(np.int32)),
                         pa.array(value, mask=np.isnan(value)), pa.array(often.astype(np.int64))],
                        names=["ordinal", "interval", "value", "n"])

        part = with_matrix(df, own).mapInArrow(count, "ordinal int, interval int, value double, n long")
        kept = part if kept is None else kept.unionByName(part)
    counts = stage(kept.groupBy("ordinal", "interval", "value").agg(F.sum("n").alias("n")), "bracket_counts")

    def before(*keys: str, order: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    # at most twice as many intervals as quantiles, per column
    sizes = counts.groupBy("ordinal", "interval").agg(F.sum("n").alias("n"))
    base = sizes.select("ordinal", "interval", F.coalesce(F.sum("n").over(before("ordinal", order="interval")), F.lit(0)).alias("_base"),
                        F.sum("n").over(Window.partitionBy("ordinal")).alias("all_n"))
    # a bracket may hold many values: their counts are added up block by block
    inside = cumulate(counts.where(F.col("value").isNotNull()), ["ordinal", "interval"], "value", ["n"]).drop("all_n")
    runs = inside.join(F.broadcast(base), ["ordinal", "interval"]).select(
        "ordinal", F.col("value").alias("x"), "n", (F.col("_base") + F.col("below_n")).alias("below_n"), "all_n")
    table = quantiles_of_runs(runs, ["ordinal"], "x", steps)
    totals = base.select("ordinal", F.col("all_n").alias("n")).distinct()
    return named(table.join(F.broadcast(totals), "ordinal"), cols).select("ordinal", "feature", "k", "q", "n")


def sketched_quantiles(df: DataFrame, cols: Sequence[str], steps: int, width: int = WIDTH, nonzero: bool = False,
                       block: int = 500) -> DataFrame:
    """``(ordinal, feature, k, q, n, error)``: quantiles from one pass, whose rank is wrong by at most ``error`` rows."""
    found = column_sketches(df, cols, width, nonzero, block).collect()
    rows = [(r["ordinal"], k, float(q), r["n"], r["error"] + 1.0) for r in found
            for k, q in enumerate(estimate(r["level"], r["value"], r["n"], steps))]
    table = df.sparkSession.createDataFrame(rows, "ordinal int, k int, q double, n long, error double")
    return named(table, cols).select("ordinal", "feature", "k", "q", "n", "error")

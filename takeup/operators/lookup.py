"""Left lookups into one-row-per-key tables whose size is only known at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from takeup.session import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, stage

# A key holding more than this share of the rows counts as hot; there can be at
# most 1 / HOT_SHARE of them per lookup.
HOT_SHARE = 0.001


def row_bytes(table: DataFrame) -> Column:
    """Bytes of a row: the length of its texts, 16 for every other value."""
    texts = [f.name for f in table.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = F.lit(16 * len(table.columns)).cast("long")
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), fixed)


def fitting(table: DataFrame, by: str, max_rows: int = MAX_BROADCAST_ROWS,
            max_bytes: int = MAX_BROADCAST_BYTES) -> set:
    """Values of ``by`` (few) whose parts of ``table`` may all be broadcast in one plan: each within
    ``max_rows``, together within ``max_bytes``, the smallest first. One job measures all of them."""
    sizes = table.groupBy(by).agg(F.count("*").alias("n"), F.sum(row_bytes(table)).alias("bytes")).collect()
    chosen, used = set(), 0
    for part in sorted(sizes, key=lambda s: (s["bytes"], str(s[by]))):
        used += part["bytes"]
        if used > max_bytes:
            break
        if part["n"] <= max_rows:
            chosen.add(part[by])
    return chosen


def hot_keys(rows: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys without nulls that hold more than ``share`` of ``rows``; counted before they are shuffled."""
    counts = stage(rows.select(*on).dropna().groupBy(*on).agg(F.count("*").alias("_n")), "lookup_keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.where(F.col("_n") > F.lit(total * share)).select(*on)


def keyed_lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str | None = None,
                 spread_by: Sequence[str] = (), max_rows: int = MAX_BROADCAST_ROWS,
                 max_bytes: int = MAX_BROADCAST_BYTES, staged: bool = False, rows_in_table: int | None = None,
                 broadcast: bool | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Left join of ``rows`` with ``table`` on ``on`` (unique in ``table``).

    The table is staged and measured unless the caller has decided about the broadcast (see
    ``fitting``). Up to ``max_rows`` rows and ``max_bytes`` bytes it is broadcast and ``rows`` is not
    moved. Beyond that it is a shuffle join in which hot keys are split: keys above the hot share of
    ``rows``, in the table or not, and those above it by ``weight`` (a column of ``table`` with
    the number of rows per key) are answered from a broadcast of at most 2 / HOT_SHARE rows before the
    shuffle. Their rows, and rows with a null in the key, are then spread over all partitions by
    ``spread_by`` (default: all columns) instead of meeting in one.
    """
    on = list(on)
    if broadcast is None:
        if rows_in_table is None or rows_in_table <= max_rows:
            if not staged:
                table, staged = stage(table, "lookup"), True
            n, size = table.agg(F.count("*"), F.sum(row_bytes(table))).first()
            broadcast = n <= max_rows and (size or 0) <= max_bytes
        else:
            broadcast = False
    if broadcast:
        return rows.join(F.broadcast(table), on, "left")
    if not staged:
        table = stage(table, "lookup")

    values = [c for c in table.columns if c not in on]
    hot = hot_keys(rows, on) if hot is None else hot
    if weight is not None:
        total = table.agg(F.sum(weight)).first()[0] or 0
        hot = hot.union(table.where(F.col(weight) > F.lit(total * HOT_SHARE)).select(*on).dropna()).distinct()
    answers = table.join(F.broadcast(hot), on).select(*on, F.struct(*values).alias("_hot"))
    hot = hot.join(F.broadcast(answers), on, "left").withColumn("_spread", F.lit(True))
    seen = rows.join(F.broadcast(hot), on, "left")
    # such a row gets a salt that no table row has: it is only being spread
    alone = F.col("_spread").isNotNull()
    for c in on:
        alone = alone | F.col(c).isNull()
    salt = F.when(alone, F.lit(1) + F.pmod(F.xxhash64(*(spread_by or rows.columns)), F.lit(4096)))
    seen = seen.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("bigint")))
    # zero, but not as a constant: Spark would take that out of the join keys, and with it the spreading
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("bigint")
    cold = table.select(*on, zero.alias("_salt"), F.struct(*values).alias("_cold"))
    joined = seen.join(cold, [*on, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    kept = [c for c in rows.columns if c not in on]
    return joined.select(*on, *kept, *[found[c].alias(c) for c in values])


def staged_by(table: DataFrame, by: str, name: str) -> DataFrame:
    """The table in the shared folder with a directory per value of ``by`` (few), so that reading it
    value by value reads every file once. Large values are spread over several files."""
    return stage(table.hint("rebalance", by), name, [by])

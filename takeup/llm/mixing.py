"""Mixing sources to target weights along a training curriculum, in DataFrame functions only.

1. *Targets.* A source may give at most ``max_repeat`` times its words; the rest of its share
   goes to the others by weight until none is above. Each round is one aggregate over the
   table of sources, in whole numbers.
2. *Demand.* Within a source documents stand in a keyed random order; whole passes over
   the source and one part of a pass are taken, so the words taken end at the target. Running totals need no window over a source: documents fall into
   hash blocks, block totals are added up first, and a window runs inside a block. The document
   at the edge is taken in part in its last pass (``take_words`` of its words).
3. *Positions.* A source's weight follows a piecewise linear schedule over training time.
   Its integral is the share of the demand met so far; inverting it (a square root per
   segment) turns the words before a document into its training position in [0, 1).
   Documents are range-sorted by position.

Null or empty texts have size 0 and are not taken; null source is a source of its own, last
in order. Repeated rows are documents of their own. Draws are hashes of the id (ties by
size), so reruns and retries agree. Columns of the input travel in one struct, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from takeup.llm.common import WORD, source_key, stage

#: Knots (time, relative weight) by source rank modulo their number: waning, steady, growing.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WEIGHTS = (1, 2, 3)
_WIDE = "decimal(38,0)"


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD + "+")), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0 by code point of the key column, nulls last, without one task for all sources."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(sources.repartitionByRange(parts, F.col(key).asc_nulls_last())
                  .withColumn("part", F.spark_partition_id()), "mix_sources")
    # one row per partition
    before = dealt.groupBy("part").count().selectExpr(
        "part", "coalesce(sum(count) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")
    return dealt.join(before, "part").selectExpr(
        "*", f"before + row_number() over (partition by part order by {key} asc nulls last) - 1 as rank").drop(
        "part", "before")


def targets(sources: DataFrame, key: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """``sources`` (key, ``source_size``) with ``rank``, ``weight`` and ``target``, which sum to all sizes."""
    values = ", ".join(map(str, weights))
    rows = stage(ranked_sources(sources, key).withColumn(
        "weight", F.expr(f"element_at(array({values}), cast(rank % {len(weights)} as int) + 1)")), "mix_ranked")
    total, shares = rows.agg(F.sum(F.col("source_size").cast(_WIDE)), F.sum(F.col("weight").cast(_WIDE))).first()
    left, shares = int(total or 0), int(shares or 0)
    full = "false"
    while shares:
        # full at this level: max_repeat * size <= left / shares * weight
        full = (f"cast({max_repeat} * source_size as {_WIDE}) * cast({shares} as {_WIDE})"
                f" <= cast(weight as {_WIDE}) * cast({left} as {_WIDE})")
        used, rest = rows.agg(
            F.sum(F.expr(f"case when {full} then cast({max_repeat} * source_size as {_WIDE}) end")),
            F.sum(F.expr(f"case when not ({full}) then cast(weight as {_WIDE}) end"))).first()
        now = (int(total) - int(used or 0), int(rest or 0))
        if now[1] == 0 or now == (left, shares):
            break
        left, shares = now
    share = f"{float(left)!r}D * weight / {float(max(shares, 1))!r}D"
    return rows.withColumn("target", F.expr(f"case when {full} then cast({max_repeat} * source_size as double) else {share} end"))


def schedule(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float]]:
    """Segments (start, width, weight at start, slope) of a schedule scaled to integral 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    return [(t0, t1 - t0, w0 / area, (w1 - w0) / area / (t1 - t0)) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]


def invert(share: str, curriculum, rank: str = "rank") -> str:
    """SQL for the time at which a source's integrated weight reaches ``share``."""
    cases = []
    for number, knots in enumerate(curriculum):
        done, steps = 0.0, []
        for start, width, weight, slope in schedule(knots):
            area = width * (weight + slope * width / 2)
            rest = f"greatest({share} - {done!r}D, 0D)"
            if abs(slope) < 1e-12:
                at = f"{start!r}D + {rest} / {weight!r}D"
            else:
                root = f"sqrt(greatest({weight * weight!r}D + {2 * slope!r}D * {rest}, 0D))"
                at = f"{start!r}D + ({root} - {weight!r}D) / {slope!r}D"
            done += area
            steps.append((done, at))
        body = " ".join(f"when {share} < {upto!r}D then {at}" for upto, at in steps[:-1])
        last = steps[-1][1]
        cases.append(f"when {rank} % {len(curriculum)} = {number} then " + (f"case {body} else {last} end" if body else last))
    return f"case {' '.join(cases)} end"


def mix(sized: DataFrame, id_column: str = "doc_id", source_column: str = "source", size_column: str = "size",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, curriculum=CURRICULUM, seed: str = "mix",
        block_rows: int = 8192) -> DataFrame:
    """Each document as struct ``row`` with size, source_size, target, taken, ``passes`` and ``first_position``.

    ``sized`` has the columns to carry and ``size_column``; it is read twice.
    """
    ordered = sized.select(F.struct(*sized.columns).alias("row"), F.col(source_column).alias("source"),
                           source_key(source_column).alias("skey"), F.col(size_column).alias("size"),
                           F.col(id_column).alias("id"),
                           F.expr(f"md5(concat_ws('-', '{seed}', cast(`{id_column}` as string)))").alias("draw"))
    narrow = stage(ordered.select("skey", "source", "size", "draw"), "mix_sizes")
    sources = stage(narrow.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")),
                    "mix_totals")
    most = sources.agg(F.max("docs")).first()[0] or 0
    blocks = -(-most // block_rows) or 1
    block = F.expr(f"cast(conv(substring(draw, 1, 8), 16, 10) as bigint) * {blocks}L div 4294967296L").alias("block")
    plan = targets(sources, "source", weights, max_repeat)
    sums = narrow.groupBy("skey", block).agg(F.sum("size").alias("block_size"))
    offsets = sums.selectExpr("skey", "block", "coalesce(sum(block_size) over (partition by skey order by block "
                              "rows between unbounded preceding and 1 preceding), 0) as block_before")
    offsets = stage(offsets.join(plan.select("skey", "source_size", "target", "rank"), "skey"), "mix_offsets")
    rows = ordered.select("row", "skey", "size", "id", "draw", block).join(offsets, ["skey", "block"])
    rows = rows.withColumn("before", F.expr(
        "block_before + coalesce(sum(size) over (partition by skey, block order by draw, id, size "
        "rows between unbounded preceding and 1 preceding), 0)"))
    rows = rows.withColumn("whole", F.expr("case when source_size > 0 then cast(floor(target / source_size) as long) else 0L end"))
    rows = rows.withColumn("part", F.expr(
        "least(size, greatest(cast(floor(target - whole * source_size + 0.5D) as long) - before, 0L))"))
    rows = rows.withColumn("passes", F.expr("case when size = 0 then 0L else whole + if(part > 0, 1L, 0L) end"))
    share = "(before / target)"
    return rows.select("row", "size", "source_size", "target", F.expr("size * whole + part").alias("taken"), "passes",
                       "whole", "part",
                       "before", "rank", F.expr(f"case when passes > 0 then {invert(share, curriculum)} end").alias("first_position"))


def positions(mixed: DataFrame, curriculum=CURRICULUM) -> DataFrame:
    """One row per pass over a document, range-sorted by training ``position``."""
    rows = mixed.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    share = "least((before + pass * source_size) / target, 1D)"
    rows = rows.withColumn("position", F.expr(invert(share, curriculum)))
    rows = rows.withColumn("take_words", F.expr("if(pass < whole, size, part)"))
    return rows.orderBy("position", "rank", "pass", "before")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                  **options) -> DataFrame:
    """The mixed corpus in training order: the columns of ``docs``, then ``pass``, ``position`` and
    ``take_words`` (all words but in the last pass at a source's edge)."""
    sized = docs.withColumn("_size", word_count(text_column))
    rows = positions(mix(sized, id_column, source_column, "_size", **options), options.get("curriculum", CURRICULUM))
    return rows.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns], "pass", "position", "take_words")


def mix_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
               **options) -> DataFrame:
    """What the mix takes of every document, range-sorted by first position."""
    sized = stage(docs.select(id_column, source_column, word_count(text_column).alias("size")), "mix_input")
    rows = mix(sized, id_column, source_column, "size", **options)
    return rows.select(F.col(f"row.{id_column}").alias(id_column), "size", "source_size", "target", "taken",
                       "first_position").orderBy("first_position", id_column)

"""Quality rules with thresholds taken from the data, per language and source.

Each text gives a few counts. Their rates (per mille, whole numbers) go into mergeable
quantile sketches: a histogram whose cells keep the leading six bits of the value, so a
quantile is known to 1/32 of itself. Sketches are plain counts per
``(lang, source, rule, cell)``: they merge by addition, do not depend on the order of
rows or retries, and a source with any share of the rows is reduced before the shuffle.
A group with fewer than ``min_group`` measured documents uses the merged sketch of its
language, and if that is small too the merged sketch of everything.

A document fails when a rate lies beyond its group's fence
``quartile +- reach * interquartile range`` (at least ``slack`` from the quartile, so that
groups without any spread do not reject the slightest deviation). Thresholds are joined
back to the documents; they are never collected.

Null text has no words; null language and null source are groups of their own. Base
failures (too short, mostly repeated) take no part in the sketches. Repeated rows count
as often as they occur. Other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from takeup.llm.common import bounded_batches, source_key, stage

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"

#: rule: (rate per mille, uses a lower fence as well, least distance of a fence from its quartile)
RULES = {
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", True, 900),
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", False, 80),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", False, 420),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", False, 230),
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    size = len(number)
    if size == n:
        return 0
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    often = np.zeros(n - 2, dtype=bool)
    often[order[1:][equal]] = True
    often[order[:-1][equal]] = True
    mark = np.zeros(n, dtype=bool)
    for shift in range(3):
        mark[shift:n - 2 + shift] |= often
    return int(mark.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return (0, 0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes split at exactly the ASCII white space
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), len(lines), repeated_words(words))


def measure(texts: pd.Series) -> pd.DataFrame:
    names = [part.split()[0] for part in COUNTS.split(", ")]
    return pd.DataFrame([text_counts(t) for t in texts], columns=names)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> str:
    return f"n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words"


def cell(value: str) -> str:
    """Lower end of the sketch cell of a whole number."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return f"shiftleft(shiftright({value}, {shift}), {shift})"


def sketch(measured: DataFrame) -> DataFrame:
    """Counts per ``(lang_key, source_key, rule, cell)`` of documents that pass the base."""
    rates = ", ".join(f"named_struct('rule', '{name}', 'rate', {rate})" for name, (rate, _, _) in RULES.items())
    return (measured.where("not base_failed")
            .select("lang_key", "source_key", F.expr(f"inline(array({rates}))"))
            .groupBy("lang_key", "source_key", "rule", F.expr(cell("rate")).alias("cell"))
            .agg(F.count("*").alias("n")))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "rule", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``documents`` and the quartiles of each rule; a window holds the cells of one
    sketch, at most 32 per power of two."""
    over = f"over (partition by {', '.join([*keys, 'rule'])} order by cell)"
    whole = f"over (partition by {', '.join([*keys, 'rule'])})"
    ranked = sketches.selectExpr(*keys, "rule", "cell", f"sum(n) {over} as upto", f"sum(n) {whole} as documents")
    return ranked.groupBy(*keys, "rule").agg(
        F.max("documents").alias("documents"),
        F.min(F.expr("case when 4 * upto >= documents then cell end")).alias("q1"),
        F.min(F.expr("case when 4 * upto >= 3 * documents then cell end")).alias("q3"))


def thresholds(measured: DataFrame, reach: int = 4, min_group: int = 100) -> DataFrame:
    """``low`` and ``high`` of every rule for each language and source that occurs."""
    cells = stage(sketch(measured), "quality_sketches")
    levels = [("own", ["lang_key", "source_key"]), ("lang", ["lang_key"]), ("all", [])]
    table = quartiles(cells, levels[0][1])
    for name, keys in levels[1:]:
        merged = quartiles(merge(cells, keys), keys)
        merged = merged.select(*keys, "rule", *[F.col(c).alias(f"{name}_{c}") for c in ("documents", "q1", "q3")])
        table = table.join(merged, [*keys, "rule"])
    pick = "case when documents >= {m} then {q} when lang_documents >= {m} then lang_{q} else all_{q} end"
    table = table.selectExpr("lang_key", "source_key", "rule",
                             *[f"{pick.format(m=min_group, q=q)} as {q}" for q in ("q1", "q3")])
    fences = []
    for name, (_, both, slack) in RULES.items():
        width = f"greatest({reach} * (q3 - q1), {slack})"
        own = f"rule = '{name}'"
        fences.append(F.max(F.expr(f"case when {own} then q3 + {width} end")).alias(f"{name}_high"))
        if both:
            fences.append(F.max(F.expr(f"case when {own} then q1 - {width} end")).alias(f"{name}_low"))
    return stage(table.groupBy("lang_key", "source_key").agg(*fences), "quality_thresholds")


def verdict() -> str:
    """True where no rate lies beyond a fence; a group without a sketch has only base failures."""
    tests = []
    for name, (rate, both, _) in RULES.items():
        tests.append(f"{rate} <= {name}_high")
        if both:
            tests.append(f"{rate} >= {name}_low")
    return f"not base_failed and coalesce({' and '.join(tests)}, false)"


def measured(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
             min_words: int = 50, max_repeat_percent: int = 50, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) with keys, counts and ``base_failed``, written once.

    Carried columns sit in one struct, so that their names cannot clash.
    """
    bounded_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), source_key(lang_column).alias("lang_key"),
                       source_key(source_column).alias("source_key"), F.pandas_udf(measure, COUNTS)(F.col(text_column)).alias("m"))
    rows = rows.select("row", "lang_key", "source_key", "m.*")
    return stage(rows.withColumn("base_failed", F.expr(base_failed(min_words, max_repeat_percent))), "quality_rows")


def judge(rows: DataFrame, reach: int = 4, min_group: int = 100) -> DataFrame:
    """``measured`` rows with ``kept``. The thresholds are one row per group: Spark broadcasts
    them when their files are small and otherwise splits a hot group on the other side."""
    fences = thresholds(rows, reach, min_group)
    return rows.join(fences, ["lang_key", "source_key"], "left").withColumn("kept", F.expr(verdict()))


def quality_report(docs: DataFrame, id_column: str = "doc_id", reach: int = 4, min_group: int = 100,
                   **options) -> DataFrame:
    """Counts and verdict of every document."""
    rows = judge(measured(docs, carry=[id_column], **options), reach, min_group)
    names = [part.split()[0] for part in COUNTS.split(", ")]
    return rows.select(F.col(f"row.{id_column}").alias(id_column), *names, "base_failed", "kept")


def keep_good(docs: DataFrame, reach: int = 4, min_group: int = 100, **options) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    return judge(measured(docs, **options), reach, min_group).where("kept").select("row.*")

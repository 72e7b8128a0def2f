"""Benchmark decontamination by winnowing, in DataFrame functions only.

A shared span of ``window`` words holds ``window - k + 1`` k-grams. Both sides keep the
smallest k-gram hash of every such span, so two equal spans keep the same one: joining
training and test fingerprints finds every span. Hits are then extended: the whole
window around a common k-gram is compared word by word, so a hash never decides.
An item shorter than a window is one window of its own length; each length that occurs
among the items gets its own winnowing.

Fingerprints are taken from fully lower-cased words (with one form of sigma, as the other
depends on its neighbours), which equal words in lower-cased A-Z always share; the
comparison itself uses A-Z only. The first pass over the documents emits fingerprints
and keeps none of the text. Only documents with a common fingerprint are read again.
Fingerprints of the items are written first, so Spark knows their size and broadcasts
them only below its threshold; beyond it the join is a shuffle on the hash.

Null and empty texts have no words and are never hit; empty items have no window.
Rows are told apart by id and text (:func:`takeup.llm.common.row_key`), so repeated ids and null ids
are judged by their own text and repeated rows all get their row. Item ids are compared as
text; items with a null id count as one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from takeup.llm.common import row_key, stage

DELIMITER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
GRAM = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once under a name. (The optimizer would copy
    the expression of a plain column into a lambda and compute it per element.)"""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words(text: str) -> str:
    """SQL for the words of a text (delimiters are the same before and after lower-casing)."""
    return f"filter(split(coalesce({text}, ''), r'{DELIMITER}'), x -> x <> '')"


def exact_case(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def loose_case(text: str) -> str:
    return f"replace(lower({text}), 'ς', 'σ')"


def _shortened(array: str, by: int) -> str:
    return f"slice({array}, 1, greatest(size({array}) - {by}, 0))"


def grams(words_name: str, k: int, body: str) -> str:
    """``body`` with ``g``, the hashes of all runs of ``k`` (up to four) words, built from halves."""
    w = words_name
    if k == 1:
        return let("g", f"transform({w}, x -> xxhash64(x))", body)
    pairs = f"transform({_shortened(w, 1)}, (x, i) -> xxhash64(x, get({w}, i + 1)))"
    if k == 2:
        return let("g", pairs, body)
    other = "get(g2, i + 2)" if k == 4 else f"get({w}, i + 2)"
    return let("g2", pairs, let("g", f"transform({_shortened('g2', k - 2)}, (x, i) -> xxhash64(x, {other}))", body))


def window_minima(width: int, reach: int = 1, name: str = "g") -> str:
    """Smallest hash of every run of ``width`` values of ``g``, doubling the run each step."""
    if reach == width:
        return name
    step = min(reach, width - reach)
    here = f"m{reach + step}"
    return let(here, f"transform({_shortened(name, step)}, (x, i) -> least(x, get({name}, i + {step})))",
               window_minima(width, reach + step, here))


def _gram_size(length: int) -> int:
    return min(GRAM, length)


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """Distinct windows of the items: ``length``, ``window`` (words), ``hash``, ``at`` (place
    of the k-gram in the window), and ``window_id``; with ``item_id`` one row per item."""
    rows = items.select(F.col(id_column).cast("string").alias("item_id"),
                        F.expr(words(exact_case(f"`{text_column}`"))).alias("w"))
    rows = rows.where("size(w) > 0").withColumn("length", F.expr(f"least(size(w), {window})"))
    rows = rows.select("item_id", "length", F.expr(
        "explode(transform(sequence(1, size(w) - length + 1), i -> slice(w, i, length)))").alias("window"))
    return rows.distinct().withColumn("window_id", F.md5(F.array_join("window", " ").cast("binary")))


def item_fingerprints(windows: DataFrame, length: int) -> DataFrame:
    """Winnowed k-gram of every distinct window of one length."""
    rows = windows.where(F.col("length") == length).select("window_id", "window").dropDuplicates(["window_id"])
    least = "struct(array_min(g) as hash, filter(transform(g, (x, i) -> if(x = array_min(g), i, null)), i -> i is not null) as at)"
    found = let("w", f"transform(window, v -> {loose_case('v')})", grams("w", _gram_size(length), least))
    rows = rows.select("window_id", "window", F.expr(f"inline(array({found}))"))
    return rows.select(F.lit(length).alias("length"), "hash", F.explode("at").alias("at"), "window", "window_id")


def doc_fingerprints(text: str, lengths: list[int]) -> str:
    """SQL for ``n_words`` and ``prints``, the winnowed (length, hash) of a text."""
    parts = [grams("w", _gram_size(n), f"transform(array_distinct({window_minima(n - _gram_size(n) + 1)}), "
                   f"x -> struct({n} as length, x as hash))") for n in lengths]
    prints = f"concat({', '.join(parts)})" if parts else "cast(array() as array<struct<length int, hash bigint>>)"
    return let("w", words(loose_case(text)), f"struct(cast(size(w) as bigint) as n_words, {prints} as prints)")


def extended(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Places where a whole window occurs in the texts of ``rows`` (``text``, ``candidates``).

    Gives ``n_hit`` and ``found``, the sorted ids of the windows found.
    """
    parts = []
    for k in sorted({_gram_size(length) for length in lengths}):
        near = ("filter(transform(g, (x, i) -> struct(x as x, i as i)), "
                "s -> array_contains(hashes, s.x))")
        places = f"""flatten(transform(filter(candidates, c -> least(c.length, {GRAM}) = {k}), c -> transform(
            filter(near, s -> s.x = c.hash and s.i >= c.at
                and slice(w, greatest(s.i - c.at, 0) + 1, c.length) = c.window),
            s -> struct(s.i - c.at as start, c.length as length, c.window_id as window_id))))"""
        parts.append(grams("loose", k, let("near", near, places)))
    hits = let("w", words(exact_case("text")), let("loose", words(loose_case("text")), let(
        "hashes", "array_distinct(transform(candidates, c -> c.hash))", f"array_distinct(concat({', '.join(parts)}))")))
    report = let("hits", hits, """struct(
        cast(size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.length - 1))))) as long) as n_hit,
        array_sort(array_distinct(transform(hits, h -> h.window_id))) as found)""")
    return rows.select("_k1", "_k2", F.expr(f"inline(array({report}))")).where("n_hit > 0")


def items_of(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """``n_items`` and ``items_sha256`` of every distinct set of windows, so that a passage in very
    many documents is looked up once."""
    sets = hits.select("found_id", "found").dropDuplicates(["found_id"])
    pairs = sets.select("found_id", F.explode("found").alias("window_id")).join(
        windows.select("window_id", F.coalesce("item_id", F.lit("")).alias("item_id")), "window_id")
    ids = pairs.groupBy("found_id").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    return ids.select("found_id", F.size("ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_id_column: str = "item_id", item_text_column: str = "text", window: int = 10) -> DataFrame:
    """One row per document: ``_k1``, ``_k2``, id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = stage(item_windows(items, item_id_column, item_text_column, window), "item_windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``window`` numbers
    keyed = docs.select(F.col(id_column).alias("id"), *row_key(id_column, text_column), F.col(text_column).alias("text"))
    scanned = keyed.select("_k1", "_k2", "id", F.expr(f"inline(array({doc_fingerprints('text', lengths)}))"))
    if not lengths:
        hits = None
    else:
        scanned = stage(scanned, "doc_prints")
        prints = item_fingerprints(windows, lengths[0])
        for length in lengths[1:]:
            prints = prints.unionByName(item_fingerprints(windows, length))
        prints = stage(prints, "item_prints")
        both = scanned.select("_k1", "_k2", F.explode("prints").alias("p")).select("_k1", "_k2", "p.*").join(
            prints.select("length", "hash").distinct(), ["length", "hash"])
        candidates = stage(both.distinct().join(prints, ["length", "hash"]).groupBy("_k1", "_k2").agg(
            F.collect_list(F.struct("length", "hash", "at", "window", "window_id")).alias("candidates")), "candidates")
        hits = extended(keyed.drop("id").join(candidates, ["_k1", "_k2"]), lengths)
        hits = stage(hits.dropDuplicates(["_k1", "_k2"]).withColumn(
            "found_id", F.sha2(F.array_join("found", ","), 256)), "hits")
        hits = hits.select("_k1", "_k2", "n_hit", "found_id").join(items_of(hits, windows), "found_id").drop("found_id")
    rows = scanned.select("_k1", "_k2", F.col("id").alias(id_column), "n_words")
    if hits is None:
        hits = rows.sparkSession.createDataFrame([], "_k1 long, _k2 long, n_hit long, n_items long, items_sha256 string")
    return rows.join(hits, ["_k1", "_k2"], "left").select(
        "_k1", "_k2", id_column, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               **options) -> DataFrame:
    """The documents without any window of an item, with the columns of ``docs``."""
    hit = contamination(docs, items, id_column, text_column, **options).where("contaminated")
    hit = stage(hit.select("_k1", "_k2"), "contaminated")
    k1, k2 = row_key(id_column, text_column)
    # the keys are compared as expressions: no column of ``docs`` is hidden or renamed
    return docs.alias("d").join(hit.alias("h"), (k1 == F.col("h._k1")) & (k2 == F.col("h._k2")), "left_anti")

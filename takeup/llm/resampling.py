"""Importance resampling towards a target distribution over hashed word n-grams.

Method: prefix CRCs. A text's words are joined by single spaces and scanned once; the running CRC-32 at
every word's end is kept, the one at the next word's start is a table step away. The CRC of any run of words follows from
two of them, as ``crc(ab) = shift(crc(a), len(b)) xor crc(b)``, where the shift by ``n`` zero bytes is a
linear map over GF(2), put together from the maps of the powers of two in ``n``. So an n-gram is
never cut out or hashed by itself.

One pass stages the buckets of every text's features. Bucket totals of documents and target texts are summed
in the executors (one row per partition and bucket moves); the gain table has ``buckets`` rows and goes to the
executors. A document's weight is the floored mean gain; with Gumbel noise keyed by
its id, the highest scores are a draw without replacement in proportion to ``exp(weight / 1000)``.
Ranks come from counts over coarse scores, over scores and blocks of the id, and within a block;
no task orders more than a block. Rows that are equal in all results are one row with a count there,
so a repeated row of any size is no hot group; their ranks follow each other.

Null and empty texts have no words, no features and weight 0. A null id is hashed as the empty
text and comes last among equal scores. Ids are whole numbers. Repeated rows each count, as
documents and in the draw. With no target text, all target counts are zero. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from takeup.llm.common import bounded_batches, stage

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: characters of text handled at a time (a longer text is handled alone)
_CHUNK = 1 << 20
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


_BYTE = _byte_table()


class ZeroShift:
    """Effect of zero bytes on a CRC: for every power of two of them four tables of 256 values, one per byte of the CRC."""

    def __init__(self, powers: int = 40):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = _BYTE[bits & 255] ^ (bits >> 8)  # image of every bit under one zero byte
        self.tables = []
        for _ in range(powers):
            self.tables.append(self._tables(columns))
            columns = self._apply(self.tables[-1], columns)

    @staticmethod
    def _tables(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), dtype=np.uint32)
        values = np.arange(256)
        for bit in range(32):
            out[bit // 8] ^= np.where(values >> (bit % 8) & 1, columns[bit], np.uint32(0)).astype(np.uint32)
        return out

    @staticmethod
    def _apply(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        return (tables[0][crcs & 255] ^ tables[1][crcs >> 8 & 255] ^ tables[2][crcs >> 16 & 255] ^ tables[3][crcs >> 24])

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Every CRC after as many zero bytes as its length says."""
        out = crcs.copy()
        for power in range(int(lengths.max(initial=0)).bit_length()):
            at = np.flatnonzero(lengths >> power & 1)
            out[at] = self._apply(self.tables[power], out[at])
        return out


def word_parts(text: str | None) -> list[bytes]:
    """Words of a text, all but the first with the space before them."""
    found = _WORD.findall((text or "").translate(_LOWER))
    return " ".join(found).encode().replace(b" ", b"\n ").split(b"\n") if found else []


def gram_crcs(texts: list[str | None], most: int, shift: ZeroShift) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of one to ``most`` words, the text each belongs to, and the words per text."""
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    ends: list[int] = []
    for i, text in enumerate(texts):
        own = word_parts(text)
        counts[i] = len(own)
        parts += own
        ends += list(accumulate(own, lambda crc, part: crc32(part, crc), initial=0))[1:]
    owner = np.repeat(np.arange(len(texts)), counts)
    end = np.array(ends, dtype=np.uint32)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    first = np.ones(len(parts), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    # running CRC at every word's start: one more byte, a space, after the end of the word before
    state = ~np.concatenate([np.zeros(1, dtype=np.uint32), end[:-1]]) if len(end) else end
    start = np.where(first, np.uint32(0), ~(_BYTE[(state ^ 32) & 255] ^ (state >> 8))).astype(np.uint32)
    length = size - ~first  # bytes of the word alone
    crcs, owners = [end ^ shift(start, length)], [owner]
    span = length
    for n in range(2, most + 1):
        if len(end) < n:
            break
        inside = owner[n - 1:] == owner[:-(n - 1)]
        span = span[:-1] + size[n - 1:]  # sizes after the first word include the space
        crcs.append((end[n - 1:] ^ shift(start[:len(end) - n + 1], span))[inside])
        owners.append(owner[n - 1:][inside])
    return np.concatenate(crcs), np.concatenate(owners), counts


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= _CHUNK:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def bucketed(texts: DataFrame, id_column: str, text_column: str, most: int, buckets: int) -> DataFrame:
    """``id``, ``n_words`` and ``found``, the buckets of all features with repeats, of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = ZeroShift()
        for batch in batches:
            ids, values = batch.column(0), batch.column(1).to_pylist()
            for begin, end in _chunks(values):
                crcs, owners, counts = gram_crcs(values[begin:end], most, shift)
                order = np.argsort(owners, kind="stable")
                sizes = np.bincount(owners, minlength=end - begin)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array((crcs[order] % np.uint32(buckets)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(counts), found],
                                                 names=["id", "n_words", "found"])

    bounded_batches(texts.sparkSession)
    rows = texts.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, n_words long, found array<int>")


def bucket_counts(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """``bucket`` and its number of features; a task sends one row per bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", name])

    return (rows.select("found").mapInArrow(count, f"bucket int, {name} long")
            .groupBy("bucket").agg(F.sum(name).alias(name)))


def gain_table(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket, ``buckets`` numbers: floored 1000 times the log ratio of the smoothed shares."""
    spark = documents.sparkSession
    counts = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
              .join(bucket_counts(documents, buckets, "s"), "bucket", "left")
              .join(bucket_counts(target, buckets, "t"), "bucket", "left").fillna(0, ["s", "t"]))
    counts = stage(counts, "bucket_counts")
    sums = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    all_s, all_t = (float((sums[c] or 0) + buckets) for c in "st")
    gain = F.floor(F.lit(1000.0) * F.ln((F.col("t") + F.lit(1.0)) * F.lit(all_s) / ((F.col("s") + F.lit(1.0)) * F.lit(all_t))))
    table = counts.select("bucket", gain.alias("gain")).toPandas()
    gains = np.zeros(buckets, dtype=np.int64)
    gains[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    return gains


def weighted(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain (no features: 0)."""
    shared = rows.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            offsets = found.offsets.to_numpy().astype(np.int64)
            values = found.values.to_numpy(zero_copy_only=False)
            running = np.concatenate([[0], np.cumsum(shared.value[values])])
            sizes = np.diff(offsets)
            sums = running[offsets[1:]] - running[offsets[:-1]]
            mean = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(mean)],
                                             names=["id", "n_words", "n_features", "weight"])

    return rows.select("id", "n_words", "found").mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """``rows`` (``id``, ``score`` and others) with ``rank`` by falling score and rising id, null beyond ``drawn``.

    Coarse scores are few whatever the input; a coarse score's scores and id blocks are a bounded table;
    what is left to order is one block of ids with one score.
    """
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    size = F.floor(F.log2(F.abs("id") + F.lit(1.0)) * 64)
    rows = rows.withColumns({"_coarse": F.floor(F.col("score") / 16),
                             "_block": F.coalesce(F.when(F.col("id") < 0, -size).otherwise(size), F.lit(1 << 20))})
    rows = stage(rows, "scored")

    def before(keys: list, *order):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_copies").over(w), F.lit(0))

    cells = rows.groupBy("_coarse", "score", "_block").agg(F.sum("_copies").alias("_copies"))
    coarse = cells.groupBy("_coarse").agg(F.sum("_copies").alias("_copies"))
    coarse = coarse.select("_coarse", before([F.lit(0)], F.desc("_coarse")).alias("_above"))
    cells = cells.withColumn("_inside", before(["_coarse"], F.desc("score"), "_block")).drop("_copies")
    # one row per 16 values of the score
    cells = cells.join(F.broadcast(coarse), "_coarse").select("score", "_block", (F.col("_above") + F.col("_inside")).alias("_base"))
    others = sorted(c for c in rows.columns if c not in ("id", "score") and c[0] != "_")
    out = rows.join(cells, ["score", "_block"]).withColumn("_own", before(["score", "_block"], F.col("id").asc_nulls_last(), *others))
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rank = F.col("_base") + F.col("_own") + F.col("_n")
    return out.withColumn("rank", F.when(rank <= drawn, rank)).drop(*[c for c in out.columns if c[0] == "_"])


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             target_id_column: str = "item_id", target_text_column: str = "text", most: int = 2, buckets: int = 10_000,
             percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every document; ``percent`` of those with
    ``min_words`` words are drawn and have a rank."""
    rows = stage(bucketed(docs, id_column, text_column, most, buckets), "features")
    wanted = stage(bucketed(target.withColumn(target_id_column, F.lit(0)), target_id_column, target_text_column, most, buckets),
                   "target_features")
    rows = weighted(rows, gain_table(rows, wanted, buckets))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))
    rows = stage(rows.withColumn("score", F.col("weight") + noise), "weights")
    able = rows.where(F.col("n_words") >= min_words)
    short = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ranked(able, able.count() * percent // 100).unionByName(short)
    return out.select(F.col("id").alias(id_column), "n_words", "n_features", "weight", "score", "rank")

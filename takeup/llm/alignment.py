"""Alignment of two tokenizers' tokens over the same bytes, and how well token pairs agree across the corpus.

Method: diagonal run skipping. Both token sequences are arrays of byte ends. From a place where both begin
together, the arrays are compared at the current index shift by slices of doubling, then halving length: a
stretch of one-to-one tokens is jumped in a logarithmic number of comparisons, and every end in it is compared, so none is
assumed. Where the ends differ, both sides are stepped until they meet; that group is irregular and its
tokens change the shift. Token pairs whose bytes overlap are linked.

How many documents hold an id pair linked is counted over the whole corpus. Pairs that many documents share are
answered from a broadcast of at most ``frequent`` rows (the cut is a count that keeps it so, found from
a histogram by powers of the count); the others, none of which more documents hold than that cut, are answered by a
shuffle join, so that no key is hot. The results do not depend on the cut.

Texts that are null or empty, or whose joined tokens differ from a space and the text in either
tokenizer, have no tokens: zeros and an empty digest. Every row counts as a document, repeated rows and null ids as well.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from takeup.llm.common import bounded_batches, stage
from takeup.llm.pieces import Encoder, read_model

FREQUENT = 400_000
_FIRST_PROBE = 4
_NAMES = 200_000
_LONG_SPACE = 5000
_SPACES = re.compile(r"\s{%d}" % _LONG_SPACE)


def run_length(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many ends from the ``i``-th of ``a`` and the ``j``-th of ``b`` on are equal one to one; both hold 8 bytes an end.

    Widths double while whole slices agree, then halve to the first end that differs.
    """
    at, to, width = i * 8, j * 8, _FIRST_PROBE * 8
    while True:
        part = a[at:at + width]
        if len(part) < width or part != b[to:to + width]:
            break
        at, to, width = at + width, to + width, width * 2
    width //= 2
    while width >= 8:
        part = a[at:at + width]
        if len(part) == width and part == b[to:to + width]:
            at, to = at + width, to + width
        width //= 2
    return at // 8 - i


def irregular_groups(a: np.ndarray, b: np.ndarray) -> list[int]:
    """``a begin, a end, b begin, b end`` of every token group that is not one token on both sides, one after the other, the
    ends exclusive; groups are cut where both sequences end, and what lies between these groups is one to one."""
    packed_a, packed_b, a, b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    i = j = 0
    out: list[int] = []
    while i < len(a):
        if a[i] == b[j]:
            same = run_length(packed_a, i, packed_b, j)
            i, j = i + same, j + same
            if i == len(a):
                break
        x, y = i, j
        first, second = a[x], b[y]
        while first != second:
            if first < second:
                x += 1
                first = a[x]
            else:
                y += 1
                second = b[y]
        x, y = x + 1, y + 1
        out += (i, x, j, y)
        i, j = x, y
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _fast_byte_level(text: str, letters: dict[str, int]):
    """A quicker reader of the same vocabulary, for the kind of file that it can stand for: byte-level words without any
    normalisation, merges in the order of their ids. None for other files."""
    import public_tokenizers
    import tiktoken

    spec = json.loads(text)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex")
             and not before.get("add_prefix_space") and model["type"] == "BPE" and not model.get("ignore_merges")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and model.get("dropout") is None)
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if not plain or merged != sorted(merged):
        return None
    ranks = {bytes(letters[c] for c in token): at for token, at in model["vocab"].items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers, their tokens' bytes, and the alignment of a text."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = Encoder(pieces)
        letters = _byte_letters()
        self.fast = _fast_byte_level(byte_level.decode(), letters)
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, at in self.a.get_vocab().items():
            self.a_bytes[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = self.b.token_bytes
        self.a_size, self.b_size = (np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes))
        self.pair_names: dict[int, str] = {}
        self.group_names: dict[tuple, str] = {}

    def first_ids(self, line: str) -> list[int]:
        # very long white space is beyond the quick reader's pattern matcher
        if self.fast is not None and not (len(line) > _LONG_SPACE and _SPACES.search(line)):
            return self.fast.encode_ordinary(line)
        return self.a.encode(line, add_special_tokens=False).ids

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides per text, none where the joined bytes differ."""
        lines = [" " + (text or "") for text in texts]
        second = self.b.texts_ids([text or "" for text in texts])
        out = []
        for text, line, b in zip(texts, lines, second):
            a, whole = self.first_ids(line) if text else [], line.encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                a, b = [], []
            out.append((a, b))
        return out

    def align(self, tokens: list[tuple[list[int], list[int]]]) -> "Aligned":
        """Alignment of several texts' tokens in one go: texts end on both sides, so groups never cross from one to the next."""
        a, b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), dtype=np.int64) for k in (0, 1))
        texts_a, texts_b = (np.cumsum([0, *[len(t[k]) for t in tokens]]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        rest = np.array(irregular_groups(ends_a, ends_b), dtype=np.int64).reshape(-1, 4)
        # a group ends at every token of the first side, but for those inside irregular groups
        single = np.ones(len(a) + 1, dtype=np.int64)
        single[0] = 0
        inner = spread(rest[:, 0], rest[:, 1] - 1)
        single[inner + 1] = 0
        plain = np.ones(len(a), dtype=bool)
        plain[spread(rest[:, 0], rest[:, 1])] = False
        plain_b = np.ones(len(b), dtype=bool)
        plain_b[spread(rest[:, 2], rest[:, 3])] = False
        link_a, link_b = walk(ends_a, ends_b, rest)
        link_a, link_b = np.concatenate([np.flatnonzero(plain), link_a]), np.concatenate([np.flatnonzero(plain_b), link_b])
        codes = a[link_a] * len(self.b_bytes) + b[link_b]
        groups = np.cumsum(single)[texts_a]
        order = np.argsort(link_a, kind="stable")
        cuts = np.searchsorted(link_a[order], texts_a)
        return Aligned(a, b, texts_a, texts_b, rest, plain, plain_b, codes, int(plain.sum()), groups, codes[order], cuts)

    def _names(self, codes: list[int]) -> list[str]:
        """How one-to-one groups are written, a bounded number of them remembered."""
        known = self.pair_names
        found = list(map(known.get, codes))
        if None in found:
            if len(known) > _NAMES:
                known.clear()
            b_ids = len(self.b_bytes)
            known.update((code, "%d|%d" % divmod(code, b_ids)) for code in {c for c, name in zip(codes, found) if name is None})
            found = [known.get(c) or "%d|%d" % divmod(c, b_ids) for c in codes]
        return found

    def written(self, found: "Aligned") -> list[str]:
        """``a1,a2|b1;a3|b2,b3``: ids of all groups of every text in order."""
        names = self._names(found.codes[:found.n_plain].tolist())
        parts: list[str] = []
        at = before = 0
        a, b, known = found.a.tolist(), found.b.tolist(), self.group_names
        if len(known) > _NAMES:
            known.clear()
        for i, x, j, y in found.rest.tolist():
            if i > before:
                parts += names[at:at + i - before]
                at += i - before
            key = (*a[i:x], -1, *b[j:y])
            name = known.get(key)
            if name is None:
                name = ",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y]))
                if len(key) < 12:
                    known[key] = name
            parts.append(name)
            before = x
        parts += names[at:]
        ends = found.groups.tolist()
        return [";".join(parts[ends[k]:ends[k + 1]]) for k in range(len(ends) - 1)]


class Aligned(NamedTuple):
    """Several texts' tokens (``a``, ``b``, cut at ``texts_a``, ``texts_b``), the irregular groups, which tokens are in none, the
    linked id pairs (``codes``, those of the ``n_plain`` one-to-one groups first), groups before every text's end, and the pairs by text."""

    a: np.ndarray
    b: np.ndarray
    texts_a: np.ndarray
    texts_b: np.ndarray
    rest: np.ndarray
    plain: np.ndarray
    plain_b: np.ndarray
    codes: np.ndarray
    n_plain: int
    groups: np.ndarray
    by_text: np.ndarray
    cuts: np.ndarray

    def ends(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ends of every text's groups in both sequences, counted from the text's begin."""
        out = []
        for plain, texts, last in ((self.plain, self.texts_a, 1), (self.plain_b, self.texts_b, 3)):
            ends = np.sort(np.concatenate([np.flatnonzero(plain) + 1, self.rest[:, last]]))
            cuts = np.searchsorted(ends, texts, "right")
            out.append([ends[cuts[k]:cuts[k + 1]] - texts[k] for k in range(len(texts) - 1)])
        return out[0], out[1]


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    size = last - first
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def walk(ends_a: np.ndarray, ends_b: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked places of all irregular groups. Inside a group no two ends agree but the last, so from one link to the next
    the side that ends first steps on, and a group of n and m tokens has n + m - 1 links."""
    count = rest[:, 1] - rest[:, 0] + rest[:, 3] - rest[:, 2] - 1
    linked = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    # all ends but each group's last, of both sides, in order: group by group, as ends rise through the text
    at_a, at_b = spread(rest[:, 0], rest[:, 1] - 1), spread(rest[:, 2], rest[:, 3] - 1)
    order = np.argsort(np.concatenate([ends_a[at_a], ends_b[at_b]]), kind="stable")
    steps = np.zeros(len(linked), dtype=np.int64)
    steps[linked > 0] = order < len(at_a)
    taken = np.cumsum(steps)
    own = taken - np.repeat(taken[linked == 0], count)
    return np.repeat(rest[:, 0], count) + own, np.repeat(rest[:, 2], count) + linked - own


def _lists(values: list, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, dtype=kind) for v in values]) if values else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _aligner(spark, byte_level: str, pieces: str):
    """Maker of an aligner in a task; the two vocabulary files are read on the driver and broadcast."""
    shared = spark.sparkContext.broadcast((read_model(byte_level), read_model(pieces)))
    return lambda: Aligner(*shared.value)


def _each(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple]:
    aligner = make()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for begin in range(0, len(texts), 64):
            yield aligner, batch.column(0).slice(begin, 64), aligner.tokens(texts[begin:begin + 64])


def align_texts(rows: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ``a_ids``, ``b_ids``, and per group ``a_ends`` and ``b_ends``: how many tokens of each side it and those before it hold."""
    spark = rows.sparkSession
    bounded_batches(spark, 4)
    make = _aligner(spark, byte_level, pieces)

    def run(batches):
        for aligner, ids, tokens in _each(batches, make):
            columns = [[t[0] for t in tokens], [t[1] for t in tokens], *aligner.align(tokens).ends()]
            yield pa.RecordBatch.from_arrays([ids, *[_lists(c, np.int32) for c in columns]],
                                             names=[id_column, "a_ids", "b_ids", "a_ends", "b_ends"])

    chosen = rows.select(id_column, F.col(text_column).cast("string").alias("_text"))
    kind = chosen.schema[id_column].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_column}` {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def linked(rows: DataFrame, make, id_column: str, text_column: str) -> DataFrame:
    """Counts and digest of every row's alignment, its distinct id pairs and their occurrences."""

    def run(batches):
        for aligner, ids, tokens in _each(batches, make):
            found = aligner.align(tokens)
            digests = [sha256(w.encode()).hexdigest() if t[0] else "" for t, w in zip(tokens, aligner.written(found))]
            numbers = [(len(a), len(b), int(g), int(n)) for (a, b), g, n in zip(tokens, np.diff(found.groups), np.diff(found.cuts))]
            counted = [np.unique(found.by_text[found.cuts[k]:found.cuts[k + 1]], return_counts=True) for k in range(len(tokens))]
            pairs, times = [c[0] for c in counted], [c[1] for c in counted]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array([n[k] for n in numbers], pa.int64()) for k in range(4)], pa.array(digests, pa.string()),
                 _lists(pairs, np.int64), _lists(times, np.int32)],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    chosen = rows.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("_text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                  "pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame, b_ids: int) -> DataFrame:
    """``pair``, ``n_docs`` and ``best`` (1 where no pair of the same first id has more documents)."""
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pair_counts")
    first = F.floor(F.col("pair") / b_ids)
    # one row per id of the first vocabulary
    most = counts.groupBy(first.alias("first")).agg(F.max("n_docs").alias("most"))
    found = counts.withColumn("first", first).join(most, "first")
    return stage(found.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best")), "pairs")


def frequent_cut(counts: DataFrame, frequent: int) -> int:
    """Least count such that at most ``frequent`` pairs have it or more."""
    step = F.floor(F.log2("n_docs") * 8)
    bins = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("n_docs").alias("least")).collect()  # 8 per power of two
    cut, held = 1 << 62, 0
    for row in sorted(bins, key=lambda r: -r["step"]):
        held += row["n"]
        if held > frequent:
            break
        cut = row["least"]
    return cut


def alignment_report(docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text",
                     frequent: int = FREQUENT) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    bounded_batches(spark, 4)
    b_ids = len(Encoder(read_model(pieces)).token_bytes)
    rows = linked(docs, _aligner(spark, byte_level, pieces), id_column, text_column)
    # a number per row that is fixed once it is written
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "linked")
    counts = pair_counts(rows, b_ids)
    cut = frequent_cut(counts, frequent)
    table = counts.where(F.col("n_docs") >= cut).toPandas().sort_values("pair")  # at most ``frequent`` rows
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy(dtype=np.int64) for c in ("pair", "n_docs", "best")))

    plain = ["_row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches):
        known, n_docs, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            ends = pairs.offsets.to_numpy().astype(np.int64)
            values, often = (v.values.to_numpy(zero_copy_only=False).astype(np.int64) for v in (pairs, times))
            at = np.searchsorted(known, values)
            at[at == len(known)] = 0
            hit = known[at] == values if len(known) else np.zeros(len(values), dtype=bool)
            sums = []
            for numbers in (best, n_docs):
                running = np.zeros(len(values) + 1, dtype=np.int64)
                if len(known):
                    np.cumsum(np.where(hit, often * numbers[at], 0), out=running[1:])
                sums.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
            missed = np.concatenate([[0], np.cumsum(~hit)])
            offsets = pa.array((missed[ends] - missed[ends[0]]).astype(np.int32))
            kept = slice(ends[0], ends[-1])
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[kept][~hit[kept]])) for v in (values, often)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *sums, *rest],
                                             names=[*plain, "n_best", "count_sum", "rest", "rest_times"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select(*plain, "pairs", "times").mapInArrow(
        look_up, f"_row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                 "n_best long, count_sum long, rest array<long>, rest_times array<long>")
    if cut > 1:
        out = stage(out, "frequent_sums")
        rest = out.where(F.size("rest") > 0).select("_row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r"))
        rest = rest.select("_row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times")).join(
            counts.where(F.col("n_docs") < cut), "pair")
        rest = rest.groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("_best"),
                                        F.sum(F.col("times") * F.col("n_docs")).alias("_sum"))
        out = out.join(rest, "_row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

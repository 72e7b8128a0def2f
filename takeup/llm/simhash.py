"""SimHash near-duplicates: fingerprints, Gray-order index, components.

Documents link when their 64-bit fingerprints differ in at most ``max_distance``
bits. The index is a hierarchy of *nodes*; a node is a mask and the bit pattern that
its members share under it.

* Upper nodes are spread over the cluster. Cut into ``max_distance + 1`` blocks, two
  linked fingerprints agree on a whole block, so every distinct fingerprint is filed
  under one node per block. A node with more than ``leaf_size`` members is replaced by
  its children: the remaining bits are cut again in the same way, the pattern grows,
  and no link is lost. Members of a node are distinct, so a node with ``b`` free bits has
  at most ``2 ** b`` of them: a hot pattern always ends in bounded nodes.
* Within a node the members are sorted by Gray rank (neighbours share long patterns),
  runs of eight get a parent holding the bits on which all agree, and so on up to a
  root. A query walks down adding up its differences to the bits each level adds, and
  leaves a whole group as soon as they exceed the distance.

A node reports a spanning forest of its links, never all pairs. Components come from
alternating large-star and small-star rounds, each written to the shared folder.

Nulls and empty texts have fingerprint zero, which links like any other. Repeated rows
and copies share a fingerprint; copies are never paired with each other. A null id never
represents its group unless all ids of the group are null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from takeup.llm.common import bounded_batches, row_key, stage

BITS = 64
FANOUT = 8
SHORT_GROUP = 32
HASHES_AT_ONCE = 1 << 16
_FULL = (1 << BITS) - 1


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined shingles, repeats included; the whole sequence if it is shorter."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(parts) for parts in zip(*(words[i:] for i in range(size)))]


def simhash(text: str | None, size: int) -> int:
    """Unsigned fingerprint of one text: majority of the bits of its shingles' XXH64."""
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    # bytes change case and split in ASCII only
    items = shingles(text.encode("utf-8", "replace").lower().split(), size)
    if not items:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(items), HASHES_AT_ONCE):
        hashes = np.array([xxh64_intdigest(s, 42) for s in items[at:at + HASHES_AT_ONCE]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(items), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprint(text: Column | str, shingle_words: int = 3) -> Column:
    """Fingerprint as a signed long."""
    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle_words) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprints(F.col(text) if isinstance(text, str) else text)


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# -- the index ------------------------------------------------------------------

def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def child_masks(mask: int, max_distance: int) -> list[int]:
    """Masks of a node's children: its bits and one block of those still free."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    step = -(-len(free) // (max_distance + 1))
    return [mask | sum(1 << b for b in free[i:i + step]) for i in range(0, len(free), step)]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Rank of each value in the Gray sequence."""
    rank = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def build_levels(ordered: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of every node, members first and the root last."""
    levels = [(ordered, np.full(len(ordered), _FULL, dtype=np.uint64))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FANOUT)
        common = np.bitwise_and.reduceat(mask, starts)
        differ = np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts)
        common &= ~differ
        levels.append((pattern[starts] & common, common))
    return levels


def search(ordered: np.ndarray, queries: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) positions within the distance, walking down from the root."""
    levels = build_levels(ordered)
    pattern, mask = levels[-1]
    who = np.arange(len(queries))
    node = np.zeros(len(queries), dtype=np.int64)
    total = np.bitwise_count((queries ^ pattern[0]) & mask[0]).astype(np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        near = total <= max_distance
        who, node, total = who[near], node[near], total[near]
        parent_mask = levels[depth + 1][1]
        pattern, mask = levels[depth]
        children = node[:, None] * FANOUT + np.arange(FANOUT)
        inside = children < len(pattern)
        who, total = np.repeat(who, FANOUT)[inside.ravel()], np.repeat(total, FANOUT)[inside.ravel()]
        above = np.repeat(parent_mask[node], FANOUT)[inside.ravel()]
        node = children.ravel()[inside.ravel()]
        total = total + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node] & ~above)
    near = total <= max_distance
    return who[near], node[near]


def _unite(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the sets of the given pairs; a label is the smallest position known so far."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def spanning_links(members: np.ndarray, groups: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group of distinct fingerprints.

    ``groups`` numbers the node of every member in ascending order.
    """
    order = np.lexsort((gray_rank(members), groups))
    members, groups = members[order], groups[order]
    label = np.arange(len(members))
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    short = np.repeat(sizes <= SHORT_GROUP, sizes)
    for shift in range(1, min(SHORT_GROUP, int(sizes.max(initial=0)))):
        near = ((groups[shift:] == groups[:-shift]) & short[shift:]
                & (np.bitwise_count(members[shift:] ^ members[:-shift]) <= max_distance))
        at = np.flatnonzero(near)
        _unite(label, at, at + shift)
    for start, size in zip(starts[sizes > SHORT_GROUP], sizes[sizes > SHORT_GROUP]):
        own = members[start:start + size]
        for at in range(0, size, 256):
            who, found = search(own, own[at:at + 256], max_distance)
            _unite(label, start + at + who, start + found)
    linked = label != np.arange(len(label))
    return members[label[linked]], members[linked]


def _link_batches(max_distance: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if len(lists) == 0:
                continue
            members = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            a, b = spanning_links(members, np.repeat(np.arange(len(sizes)), sizes), max_distance)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def links(values: DataFrame, max_distance: int = 2, leaf_size: int = 4096) -> DataFrame:
    """Spanning links ``(a, b)``, ``a < b``, of a column ``fp`` of distinct fingerprints."""
    def filed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        table = F.create_map(*[x for m, subs in masks.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        return (rows.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
                .withColumn("pattern", F.expr("fp & mask")))

    found, level = None, [0]
    rows = values.select("fp", F.lit(0).cast("long").alias("mask"))
    while level:
        masks = {m: child_masks(m, max_distance) for m in level}
        rows = filed(rows, masks)
        sizes = stage(rows.groupBy("mask", "pattern").count().where("count > 1"), "simhash_nodes")
        members = rows.join(sizes, ["mask", "pattern"])
        # a node without room for more members than a leaf is a leaf
        level = [m for subs in masks.values() for m in subs if 1 << (BITS - m.bit_count()) > leaf_size]
        leaf = F.col("count") <= leaf_size
        groups = (members.where(leaf).groupBy("mask", "pattern").agg(F.collect_list("fp").alias("members"))
                  .select("members"))
        pairs = groups.mapInArrow(_link_batches(max_distance), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if not level or sizes.where(~leaf).isEmpty():
            break
        rows = stage(members.where(~leaf).select("fp", "mask"), "simhash_hot")
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``; root is the smallest node.

    Alternates large-star and small-star until the edges are stars. Both are a minimum
    per node and a join with it, so a node with very many neighbours is one row of
    the small side; nothing gathers its neighbours.
    """
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"),
                  "components_0")
    state = None
    for step in range(1, max_rounds + 1):
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select("a", "b"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest one
        large = (both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .distinct())
        # small star: smaller neighbours and the node itself move to the smallest one
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(lowest, "b")
        small = (moved.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
                 .union(lowest.select(F.col("m").alias("a"), "b")).distinct())
        edges = stage(small, f"components_{step}")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select("a", "a").distinct())
        state = seen
    raise RuntimeError("components did not settle")


def cluster(rows: DataFrame, id_column: str = "doc_id", max_distance: int = 2, leaf_size: int = 4096) -> DataFrame:
    """``rows`` (id, ``fp``) with ``component_id``, the smallest id of the component."""
    values = stage(rows.groupBy("fp").agg(F.min(id_column).alias("first_id")), "simhash_values")
    roots = components(links(values, max_distance, leaf_size))
    linked = roots.join(values, F.col("node") == F.col("fp")).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    merged = stage(linked.join(smallest, "root").select("fp", "linked_id"), "simhash_components")
    class_ids = values.join(merged, "fp", "left").select(
        "fp", F.coalesce("linked_id", "first_id").alias("component_id"))
    return rows.join(class_ids, "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3,
                    max_distance: int = 2, leaf_size: int = 4096, keys: bool = False) -> DataFrame:
    """One row per document: id, ``fp`` (signed long) and ``component_id``; on request the row's keys."""
    bounded_batches(docs.sparkSession)
    extra = row_key(id_column, text_column) if keys else []
    rows = stage(docs.select(F.col(id_column), *extra, fingerprint(text_column, shingle_words).alias("fp")), "simhash_rows")
    return cluster(rows, id_column, max_distance, leaf_size)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that represent their group, with the columns of ``docs``.

    Of rows that share the representing id one stays. Rows of a group without any id
    are kept: nothing tells them apart.
    """
    found = near_duplicates(docs, id_column, text_column, keys=True, **options).where("component_id is not null")
    rows = stage(found.groupBy("_k1", "_k2", "component_id", (F.col(id_column) == F.col("component_id")).alias("first"))
                 .agg(F.count("*").alias("n")), "simhash_keys")
    chosen = rows.where("first").groupBy("component_id").agg(F.min(F.struct("_k1", "_k2", "n")).alias("c")).select("c.*")
    dropped = stage(rows.join(chosen, ["_k1", "_k2"], "left_anti").select("_k1", "_k2"), "simhash_dropped")
    repeated = stage(chosen.where("n > 1").select("_k1", "_k2"), "simhash_repeated")
    k1, k2 = row_key(id_column, text_column)

    def without(df: DataFrame, keys: DataFrame) -> DataFrame:
        return df.join(keys.alias("x"), (k1 == F.col("x._k1")) & (k2 == F.col("x._k2")), "left_anti")

    kept = without(docs, dropped)
    if repeated.isEmpty():
        return kept
    keyed = kept.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), k1, k2)
    once = keyed.join(repeated, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row.*")
    return without(kept, repeated).unionByName(once)

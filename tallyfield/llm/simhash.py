"""SimHash near-dedup: fingerprints, BK-trees over bounded shards, connected components.

Fingerprints within ``radius`` bits are linked. Of radius + k blocks of the 64 bits,
any two linked fingerprints share k; each choice of k blocks and their value is a
shard. A shard's BK-tree has children keyed by their integer Hamming distance to the
parent, and a search follows the edges within the radius of its own distance only.
Shards with more than ``SHARD`` fingerprints are dealt into parts, each pair of parts
being a shard of its own, so that no task holds an unbounded tree. Each shard sends on a
spanning forest of its links, never all pairs.

The trees are built where their shard is: all trees together grow with the data, so
broadcasting them would have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import pinned
from .common import LAST, batches, column, table, text_key, unused
from .components import components

RADIUS = 4
WORDS = 4
SHARD = 16_000
#: Fingerprints that a shard should hold on average; decides the number of blocks.
FULL = 64


def shingles(body: bytes, width: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``width`` words; fewer words are one shingle, no words none."""
    words = body.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    w = min(width, n)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(start[: n - w + 1].tolist(), end[w - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(body: bytes, width: int = WORDS) -> int:
    """A bit is 1 if more than half of the shingle hashes have it."""
    return majority(shingles(body, width))


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, key, fp), one row a document; fp is the unsigned fingerprint as a signed long.

    Null and empty texts have fingerprint 0; texts of fewer words than a shingle are one shingle.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            fp = np.array([fingerprint(b, width) for b in batch.column("body").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fp)], names=["doc_id", "key", "fp"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"),
    ).mapInArrow(run, "doc_id bigint, key bigint, fp bigint")


class Forest:
    """BK-trees of several shards at once: node i is fingerprint i, roots are each shard's first."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        self.root = np.searchsorted(shard, shard)  # shards are sorted
        n = len(fps)
        parent, key = np.full(n, -1), np.zeros(n, np.int64)
        moving, at = np.flatnonzero(self.root != np.arange(n)), None
        at = self.root[moving]
        while len(moving):
            d = np.bitwise_count(fps[moving] ^ fps[at]).astype(np.int64)
            slot = at * 65 + d
            _, first, which = np.unique(slot, return_index=True, return_inverse=True)
            child = moving[first]
            parent[child], key[child] = at[first], d[first]
            rest = np.ones(len(moving), bool)
            rest[first] = False
            moving, at = moving[rest], child[which[rest]]
        nodes = np.flatnonzero(parent >= 0)
        slots = parent[nodes] * 65 + key[nodes]
        order = np.argsort(slots)
        self.slots, self.children = slots[order], nodes[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of indices within the radius, level by level."""
        q, at = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[at]).astype(np.int64)
            near = (d <= radius) & (q != at)
            if near.any():
                yield q[near], at[near]
            lo = np.searchsorted(self.slots, at * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.slots, at * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            q = np.repeat(q, n)
            at = self.children[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; label[x] stays the smallest index of x's group."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def spanning_links(fps: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the smallest index of those it is connected with inside its shard."""
    forest, label = Forest(fps, shard), np.arange(len(fps))
    for at in range(0, len(fps), 2048):
        for q, node in forest.search(np.arange(at, min(at + 2048, len(fps))), radius):
            connect(label, q, node)
    return label


def _link_shards(radius: int):
    """Rows come sorted by shard; whole shards are searched a few ten thousand fingerprints at a time."""

    def links(fps, nodes, shard):
        label = spanning_links(fps.view(np.uint64), shard, radius)
        tied = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[label[tied]])], names=["u", "v"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[list[np.ndarray]] = []
        for batch in rows:
            columns = [batch.column(c).to_numpy() for c in ("choice", "value", "one", "two", "fp", "node")]
            left.append(columns)
            if sum(len(x[0]) for x in left) < 2 * SHARD:
                continue
            columns = [np.concatenate(x) for x in zip(*left)]
            same = np.ones(len(columns[0]), bool)
            for c in columns[:4]:
                same &= c == c[-1]
            to = int(len(same) - same.sum())  # the last shard may go on in the next batch
            yield links(columns[4][:to], columns[5][:to], _numbered(columns, to))
            left = [[c[to:] for c in columns]]
        if left:
            columns = [np.concatenate(x) for x in zip(*left)]
            yield links(columns[4], columns[5], _numbered(columns, len(columns[0])))

    return run


def _numbered(columns: list[np.ndarray], to: int) -> np.ndarray:
    new = np.zeros(to, np.int64)
    for c in columns[:4]:
        new[1:] |= c[1:to] != c[: to - 1] if to else 0
    return np.cumsum(new)


def block_choices(n: int, radius: int) -> list[int]:
    """Masks of the bits to agree on: all choices of k among radius + k blocks, k as large as n needs."""
    k = 1
    while k < 8 and n >> (64 * k // (radius + k)) > FULL:
        k += 1
    edges = [64 * i // (radius + k) for i in range(radius + k + 1)]
    blocks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, k)]


def linked(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between ``node`` numbers that connect all ``fp`` within the radius, none of them lost."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_choices(n, radius)]
    rows = distinct.select("fp", "node", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("choice", "mask")).select(
        "fp", "node", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("value")
    )
    return linked_in_shards(rows, radius)


def in_parts(rows: DataFrame, key: list[str], by: str, most: int) -> DataFrame:
    """``rows`` with (one, two): groups of over ``most`` rows are cut by ``by``, and each pair of parts meets once."""
    hot = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(
        *key, F.ceil(F.col("n") * 2 / most).cast("int").alias("cuts")
    )
    own = F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("cuts")).cast("int"))
    others = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, cuts - 1), x -> x != own)"))
    return rows.join(hot, key, "left").withColumn("own", own).withColumn("other", F.explode(others)).select(
        *rows.columns, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    )


def linked_in_shards(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that connect, in each shard (choice, value), all ``fp`` within the radius."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["choice", "value", "one", "two"]
    dealt = in_parts(rows, key[:2], "fp", SHARD).select(*key, "fp", "node")
    return dealt.repartition(parts, *key).sortWithinPartitions(*key, "node").mapInArrow(_link_shards(radius), "u bigint, v bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """(doc_id, key, fp, component_id, root), one row a document.

    component_id is the smallest doc_id that can be reached over links of at most
    ``radius`` bits, root the smallest fingerprint. Documents of one fingerprint are one node, however many they
    are. A null doc_id counts as the largest, and stands as null; repeated rows give
    repeated rows; other columns are left behind; an empty table gives no rows.
    """
    prints = pinned(fingerprints(docs, width), "fingerprints")
    number = F.coalesce("doc_id", F.lit(LAST))
    distinct = pinned(prints.groupBy("fp").agg(F.min(number).alias("least")), "distinct-fingerprints")
    found = components(linked(distinct.select("fp", F.col("fp").alias("node")), distinct.count(), radius))
    rooted = distinct.join(found, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of_print = rooted.drop("least").join(least, "root")
    return prints.join(of_print, "fp").select("doc_id", "key", "fp", F.when(F.col("least") != LAST, F.col("least")).alias("component_id"), "root")


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """One document of each group: that of the smallest doc_id, all columns unchanged, whatever their names.

    Null and empty texts have fingerprint 0 and are one group with all that lies near it. Of repeated rows
    of the chosen doc_id one stays; a null doc_id counts as the largest. An empty table gives no rows.
    """
    doc, key = unused(docs.columns, "_llm_doc", "_llm_key")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "key")).alias("one")
    chosen = near_groups(docs, radius, width).groupBy("root").agg(one)
    marked = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), key: text_key(F.col("text"))})
    stay = chosen.select(F.col("one.doc").alias(doc), F.col("one.key").alias(key))
    kept = marked.join(stay, [doc, key], "left_semi")
    return kept.dropDuplicates([doc, key]).select(*map(column, docs.columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

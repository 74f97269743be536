"""Conversation prefix trie by a splitter skeleton.

A conversation is a path: 20 bytes a turn, an MD5 of role and text and the text's length.
Paths are dealt into shards by range. The trie of the splitters, the skeleton, is broadcast:
conversations that share a prefix are neighbours in the order of paths, so a node whose members
lie in several shards is a prefix of a splitter. Every other node is finished by the one shard
that holds it, which streams its sorted paths with a stack of open nodes. Skeleton nodes leave
partial aggregates, which a reduction combines.

Equal paths are packed before the shuffle: a row holds the ids of up to ``PACK`` conversations
of one path, and packs of one path have disjoint ranges of ids, so a path of a third of all
conversations is a few rows that one task streams in order; SHA-256 is sequential by nature.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import pinned
from .common import table

STEP = 20
#: The longest prefix of another conversation's turns that a conversation can take over, and how ids fall into families.
HISTORY, FAMILY = 8, 5
#: Conversations, and bytes of their paths, whose equal paths are packed together in a task.
PACK, PACK_BYTES = 1 << 16, 32 << 20
#: Turns in a shard, on average, and the bounds of the broadcast skeleton: splitters and bytes of all of them.
SHARD_TURNS, SPLITTERS, SKELETON_BYTES = 100_000, 4096, 4 << 20
#: Paths sampled for each splitter. They balance shards; results do not depend on them.
SAMPLED = 20

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_PARTIAL = f"{NODE}, node binary, parent binary, ends binary"
_PATHS = "path binary, first bigint, ids binary, n_ids bigint"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, step): a row a turn, with the step it makes in a path. Rows without conv_id are no conversation's."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0")
    # the role's length keeps (a, bc) and (ab, c) apart
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.concat(F.md5(said.cast("binary")), size)).alias("step"),
    )


def history(conv_id: int) -> int:
    """How many turns of its family's first conversation a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % (HISTORY + 1)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as compressed differences."""
    return zstandard.compress(np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes(), 1)


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), "<i8"))


def more_ids(digest, ids: np.ndarray):
    """A digest of comma-joined decimal ids (None: of none yet) with further ids."""
    listed = ",".join(map(str, ids.tolist())).encode()
    if digest is None:
        return hashlib.sha256(listed)
    digest.update(b"," + listed)
    return digest


def _packed(held: dict[bytes, list[int]]) -> pa.RecordBatch:
    ids = [np.array(sorted(x), np.int64) for x in held.values()]
    return pa.RecordBatch.from_arrays([
        pa.array(list(held), pa.binary()), pa.array([int(x[0]) for x in ids], pa.int64()),
        pa.array([pack_ids(x) for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
    ], names=["path", "first", "ids", "n_ids"])


def _rebuild(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (base, conv_id, step) sorted by base, the base's own conversation first, then conv_id and turn."""
    held: dict[bytes, list[int]] = {}
    waiting = size = 0
    base = conv = None
    opening: list[bytes] = []  # the first turns of conversation ``base``
    own: list[bytes] = []

    def close() -> None:
        if conv is not None:
            h = history(conv)
            held.setdefault(b"".join(opening[:h] + own[h:]), []).append(conv)

    for batch in rows:
        for b, c, step in zip(*(batch.column(x).to_pylist() for x in ("base", "conv_id", "step")), strict=True):
            if c != conv or b != base:
                close()
                waiting += 1
                if b != base:
                    opening = []
                    if waiting >= PACK or size >= PACK_BYTES:  # between families, so that ranges of ids stay disjoint
                        yield _packed(held)
                        held, waiting, size = {}, 0, 0
                base, conv, own = b, c, []
            own.append(step)
            size += STEP
            if c == b and len(opening) < HISTORY:
                opening.append(step)
    close()
    if held:
        yield _packed(held)


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(path, first, ids, n_ids): the paths of all rebuilt conversations with packs of their ids.

    A conversation begins with the first ``history`` turns of conversation c - c % 5 (the remainder
    has the sign of c, as in SQL), and goes on with its own turns after as many. Turns are ordered by
    ``turn``, null first, ties by the MD5 of role and text; repeated rows are turns of their own.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns_of(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    # by range, so that the packs of different tasks hold disjoint ranges of ids
    return turns.repartitionByRange(parts, "base").sortWithinPartitions(
        "base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "step"
    ).select("base", "conv_id", "step").mapInArrow(_rebuild, _PATHS)


def splitters(paths: DataFrame, shards: int) -> list[bytes]:
    """Paths, cut to a bounded length, that deal a bounded sample of paths, by their turns, into equal ranges."""
    if shards < 2:
        return []
    longest = SKELETON_BYTES // (shards * STEP) * STEP
    turns = F.greatest(F.octet_length("path") / STEP, F.lit(1.0))
    total = paths.agg(F.sum(turns)).first()[0] or 1.0
    luck = (F.shiftrightunsigned(F.xxhash64("path", "first"), 1) / float(1 << 63)).alias("luck")
    picked = paths.select(F.substring("path", 1, longest).alias("path"), "first", turns.alias("turns"), luck).where(
        F.col("luck") * total < SAMPLED * shards * F.col("turns")
    )
    weighted = F.greatest(F.lit(1), F.floor(SAMPLED * shards * F.col("turns") / total)).cast("int")
    order = picked.groupBy("path").agg(F.sum(weighted).alias("weight")).orderBy("path").limit(4 * SAMPLED * shards)
    found, at = [], 0
    ranked = [(bytes(r.path), r.weight) for r in order.toLocalIterator()]
    step = sum(w for _, w in ranked) / shards
    for path, weight in ranked:
        if at // step < (at + weight) // step and path:
            found.append(path)
        at += weight
    return found


class Node:
    """An open node of the stream: sums over what was seen of its subtree."""

    __slots__ = ("digest", "first", "leaves", "members", "n_children", "saved", "waiting")

    def __init__(self):
        self.members = self.n_children = self.leaves = self.saved = 0
        self.first: int | None = None
        self.digest = None  # of the ids that end here
        self.waiting: list[tuple] = []  # rows of closed children, until this node's smallest member is known


def _shard(skeleton: Callable[[], set[bytes]]):
    """Streams rows sorted by (path, first); gives the nodes of each trie and the parts of skeleton nodes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = skeleton()
        out: list[tuple] = []
        path, stack = None, []

        def emit() -> pa.RecordBatch:
            names = [x.split()[0] for x in _PARTIAL.split(", ")]
            kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            made = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(list(zip(*out)) or [[]] * len(names), _PARTIAL.split(", "), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        def close(depth: int) -> None:
            """The deepest open node, of that depth, is over."""
            node = stack.pop()
            name = path[: STEP * depth]
            inner = name in shared
            parent = stack[-1] if stack else None
            above = path[: STEP * (depth - 1)] if depth else None
            if not inner:
                node.leaves = node.leaves or 1
                size = int.from_bytes(name[-4:], "big") if depth else 0
                node.saved += (node.members - 1) * size
                ends = (node.digest or hashlib.sha256()).hexdigest()
                for child in node.waiting:
                    out.append((*child[:2], node.first, *child[3:]))
                row = (node.first, depth, None, node.members, node.n_children, node.leaves, node.saved, ends)
                if above in shared:
                    out.append((*row, None, above, None))
                elif parent is not None:
                    parent.waiting.append((*row, None, None, None))
                else:  # a root that is in no skeleton, as there is one shard
                    out.append((*row, None, None, None))
            else:
                out.append((node.first, depth, None, node.members, node.n_children, node.leaves, node.saved, None, name, above, None))
            if parent is not None:
                parent.members += node.members
                parent.first = node.first if parent.first is None else min(parent.first, node.first)
                if not inner:  # a skeleton node is counted once, where its parts are combined
                    parent.n_children += 1
                    parent.leaves += node.leaves
                    parent.saved += node.saved

        for batch in rows:
            for new, ids in zip(*(batch.column(x).to_pylist() for x in ("path", "ids")), strict=True):
                if new != path:
                    same = 0
                    if path is not None:
                        most = min(len(new), len(path))
                        while same < most and new[same : same + STEP] == path[same : same + STEP]:
                            same += STEP
                        same //= STEP
                        for depth in range(len(stack) - 1, same, -1):
                            close(depth)
                    else:
                        stack.append(Node())
                    path = new
                    while len(stack) <= len(new) // STEP:
                        stack.append(Node())
                numbers = unpack_ids(ids)
                node = stack[-1]
                node.members += len(numbers)
                node.first = int(numbers[0]) if node.first is None else min(node.first, int(numbers[0]))
                if path in shared:
                    out.append((None, None, None, 0, 0, 0, 0, None, path, None, ids))
                else:
                    node.digest = more_ids(node.digest, numbers)
            if len(out) > 10_000:
                yield emit()
        for depth in range(len(stack) - 1, -1, -1):
            close(depth)
        yield emit()

    return run


def _ends_digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ends) sorted by (node, smallest id): a digest a node, pack by pack."""
    node = digest = None
    for batch in rows:
        out = []
        for name, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = name, None
            digest = more_ids(digest, unpack_ids(ends))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.string()))], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def _first_id(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        first = [int(unpack_ids(x)[0]) for x in batch.column("ends").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("ends"), pa.array(first, pa.int64())], names=["node", "ends", "first"])


def combined_skeleton(parts: DataFrame) -> DataFrame:
    """(node, parent, and the columns of ``NODE``) of the skeleton nodes that have members, from the parts the shards sent.

    A shard sends one part a node. Sums of subtrees add what each skeleton node has of its own to all its prefixes.
    """
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = parts.where("node IS NOT NULL AND ends IS NULL").groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    # nodes below that are skeleton nodes themselves
    own = own.withColumn("parent", F.when(F.col("depth") > 0, F.expr(f"substring(node, 1, octet_length(node) - {STEP})")))
    below = own.groupBy("parent").agg(F.count("*").alias("inner")).select(F.col("parent").alias("node"), "inner")
    size = F.conv(F.hex(F.expr("substring(node, octet_length(node) - 3, 4)")), 16, 10).cast("bigint")
    whole = own.join(below, "node", "left").withColumns({
        "n_children": F.col("n_children") + F.coalesce("inner", F.lit(0)),
    }).withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")),
        "saved_tokens": F.col("saved_tokens") + F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * size).otherwise(0),
    })
    # subtree sums: each node adds its own share to itself and to all its prefixes
    up = whole.select(
        F.explode(F.expr("sequence(0, depth)")).alias("k"), "node", "n_leaves", "saved_tokens"
    ).groupBy(F.md5(F.expr(f"substring(node, 1, cast(k * {STEP} as int))")).alias("key")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = parts.where("ends IS NOT NULL").select("node", "ends").mapInArrow(_first_id, "node binary, ends binary, first bigint").repartition(
        n, "node").sortWithinPartitions("node", "first").select("node", "ends").mapInArrow(_ends_digest, "node binary, ends_sha256 string")
    none = hashlib.sha256().hexdigest()
    summed = whole.drop("n_leaves", "saved_tokens").withColumn("key", F.md5("node")).join(up, "key").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    above = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return summed.join(above, "parent", "left")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations, with the columns of ``NODE``.

    See ``rebuilt_paths`` for the conversations. The root has depth 0 and no text; of an empty table there are
    no conversations and no nodes. Null roles and texts count as empty. Other columns are left behind. A conversation's
    path, 20 bytes a turn, has to fit a task's memory; that of a group of equal paths need not.
    """
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = pinned(rebuilt_paths(conversations), "conversation-paths")
    turns = paths.agg(F.sum(F.octet_length("path") / STEP + 1)).first()[0] or 0
    found = splitters(paths, min(SPLITTERS, max(n if turns > SHARD_TURNS // 10 else 1, int(turns // SHARD_TURNS))))
    sent = spark.sparkContext.broadcast(found)

    def skeleton() -> set[bytes]:
        return {s[:k] for s in sent.value for k in range(0, len(s) + 1, STEP)}

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            shard = [bisect_right(sent.value, p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    dealt = paths.mapInArrow(deal, f"{_PATHS}, shard int").repartition(max(n, len(found) + 1), "shard").sortWithinPartitions("path", "first")
    made = pinned(dealt.select("path", "ids").mapInArrow(_shard(skeleton), _PARTIAL), "trie-nodes")
    names = [x.split()[0] for x in NODE.split(", ")]
    inner = pinned(combined_skeleton(made).select("node", *names), "trie-skeleton")
    done = made.where("node IS NULL")
    # a node just below the skeleton; the skeleton's size is bounded by SKELETON_BYTES
    known = F.broadcast(inner.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent")))
    edge = done.where("parent IS NOT NULL").drop("parent_conv_id").join(known, "parent").withColumnRenamed("of_parent", "parent_conv_id")
    return done.where("parent IS NULL").select(names).unionByName(edge.select(names)).unionByName(inner.select(names))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal number, bit by bit, as DuckDB has no function for it.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11_SQL = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos, size, said
    FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
        md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS pos, size, said FROM (
        SELECT c.conv_id, 0 AS own, t.pos, t.size, t.said FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL
        SELECT c.conv_id, 1, t.pos, t.size, t.said FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h)
), prefixes AS (
    SELECT conv_id, pos AS depth, size, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos) AS node FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (
    SELECT conv_id, max(depth) AS n FROM prefixes GROUP BY conv_id
), nodes AS (
    SELECT node, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
        sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256
    FROM prefixes p JOIN lengths USING (conv_id) GROUP BY node, depth
), children AS (
    SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)
), below AS (
    SELECT substr(node, 1, 32 * k) AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = substr(n.node, 1, 32 * (n.depth - 1))
"""

"""Sharding by a two-pass external shuffle.

Pass one writes every record, with a bucket from a seeded hash, to the shared
folder; the number of buckets follows from the bytes, so each fits into memory. Pass
two brings each bucket together, permutes it with a seeded Fisher-Yates shuffle and
writes it. Buckets stand one after the other in the final order, and shards are
equal stretches of it, so neither pass moves a record a third time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import pinned
from .common import column, mapped, table, total_bytes, unused

SHARDS = 40
SEED = 17
BUCKET_BYTES = 24 << 20
#: Bytes counted for a record besides its text.
RECORD = 16


def _fisher_yates(names: list[str], at: str, place: str, seed: int):
    """Rows come sorted by bucket ``at``, in each first one that tells its ``place``; buckets are gathered, permuted and sent on with places."""

    def shuffled(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        start, n = rows.column(place)[0].as_py(), rows.num_rows - 1
        order = np.random.default_rng([seed, bucket]).permutation(n)
        rows = rows.slice(1).take(pa.array(order)).select(names).append_column(place, pa.array(np.arange(start, start + n)))
        yield from rows.combine_chunks().to_batches(max_chunksize=4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            bucket = batch.column(at).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and bucket[a] != now:
                    yield from shuffled(now, parts)
                    parts = []
                now = int(bucket[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from shuffled(now, parts)

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows in shuffled order, with ``_shard`` (0 to shards - 1) and ``_slot`` (gapless from 0).

    Where the documents have such columns, underscores are added to these two. Shards' counts differ by one at most. Every row counts by itself, so null or
    repeated ids, equal texts and equal rows spread like others. An empty table
    gives no rows; with fewer rows than shards some shards are empty.
    """
    names = docs.columns
    row, at, place, n, shard, slot = unused(names, "_llm_row", "_llm_bucket", "_llm_place", "_llm_n", "_shard", "_slot")
    n_buckets = 1 + total_bytes(docs) // bucket_bytes
    scattered = pinned(
        docs.withColumn(row, F.monotonically_increasing_id()).withColumn(
            at, F.pmod(F.xxhash64(F.lit(seed), row), F.lit(n_buckets))
        ), "shard-buckets",
    )
    counts = scattered.groupBy(at).agg(F.count("*").alias(n))
    ahead = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    # a row a bucket tells how many rows stand in buckets before it; it goes the way of the bucket's rows, so nothing is joined
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]
    starts = counts.select(*nothing, F.lit(-1).cast("bigint").alias(row), at, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(place))
    rows = max(1, scattered.count())
    kinds = StructType([*docs.schema, StructField(place, LongType())])
    both = scattered.withColumn(place, F.lit(None).cast("bigint")).unionAll(starts)
    buckets = mapped(both.repartition(int(n_buckets), at).sortWithinPartitions(at, row), _fisher_yates(names, at, place, seed), kinds)
    of = F.expr(f"(({place} + 1) * {shards} - 1) div {rows}")
    return buckets.withColumn(shard, of.cast("int")).withColumn(
        slot, F.expr(f"{place} - ({shard} * {rows}L) div {shards}")
    ).select(*map(column, names), shard, slot)


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write one folder a shard; its files hold whole stretches of the shuffled order, numbered by ``_slot``."""
    made = shuffle_into_shards(docs, **how)
    made.write.partitionBy(made.columns[-2]).parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    return shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.length(body) + RECORD).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

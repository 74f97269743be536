"""Chunks of documents that ask hashed parts of the key space, and get answers back.

Several operators must learn something global about very many small keys: has this
window another document, which ids has this word? One row a key would cost more than
the texts. So documents are dealt into chunks of bounded size; a chunk sends each
distinct key once, packed into one row for each part of the key space; a part joins
what all chunks sent and answers with one row a chunk; and the chunk, with its texts,
reads the answers. A key that stands in a third of all documents costs one entry a chunk.
If parts outnumber a chunk's keys, rows hold single keys: no worse than a plain shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, text_key, total_bytes

CHUNK_BYTES = 12 << 20
ASKED = "chunk int, part int, keys binary"
ANSWERED = "chunk int, part int, answer binary"


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    return 1 + total_bytes(docs) // chunk_bytes


def part_bits(chunks: int) -> int:
    """As many parts as chunks, as a power of two; what a part gets is of a chunk's size."""
    return max(chunks - 1, 0).bit_length()


def chunk_of(chunks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(chunks)).cast("int")


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, docs): documents dealt by a hash of id and text, and packed, compressed, by chunk and record batch."""

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 32 << 20):
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            made = [_frozen(batch.take(pa.array(order[a:b])).drop_columns(["chunk"])) for a, b in zip(edges, np.append(edges[1:], len(order)))]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order[edges]], pa.int32()), pa.array(made, pa.binary())], names=["chunk", "docs"])

    return docs.select(
        chunk_of(chunks).alias("chunk"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"),
    ).mapInArrow(pack, "chunk int, docs binary")


def _frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: pa.Table) -> pa.Table:
    """The chunk's (doc_id, key, body, chunk) in one order, whatever the order of arrival."""
    whole = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows.column("docs")])
    whole = whole.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    return whole.append_column("chunk", pa.array(np.full(whole.num_rows, rows.column("chunk")[0].as_py(), np.int32)))


def ask(chunked: DataFrame, keys: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """For each chunk the (part, keys) that ``keys`` makes of its documents."""

    def run(rows: pa.Table) -> pa.Table:
        return _packed(rows.column("chunk")[0].as_py(), keys(_unpacked(rows)))

    return chunked.groupBy("chunk").applyInArrow(run, ASKED)


def ask_again(chunked: DataFrame, answers: DataFrame, keys: Callable[[pa.Table, dict[int, bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """As ``ask``, with the answers to an earlier question at hand."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _packed(0, [])
        return _packed(rows.column("chunk")[0].as_py(), keys(_unpacked(rows), _by_part(told)))

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ASKED)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``reply`` gets what all chunks sent to a part, and gives one answer for each. A chunk's note to itself comes back as it is."""

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("part")[0].as_py() < 0:
            return rows.rename_columns({"keys": "answer"})
        rows = rows.sort_by("chunk")  # the same whatever the order of arrival
        return pa.table({
            "chunk": rows.column("chunk"), "part": rows.column("part"),
            "answer": pa.array(reply(rows.column("keys").to_pylist()), pa.binary()),
        })

    return asked.groupBy("part").applyInArrow(run, ANSWERED)


def read_answers(chunked: DataFrame, answers: DataFrame, result: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """What ``result`` makes of each chunk's documents and answers."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        return result(_unpacked(rows), _by_part(told))

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def note(rows: pa.Table) -> int:
    """The part under which a chunk sends something to itself."""
    return -1 - rows.column("chunk")[0].as_py()


def _by_part(told: pa.Table) -> dict[int, bytes]:
    return dict(zip(told.column("part").to_pylist(), told.column("answer").to_pylist(), strict=True))


def _packed(chunk: int, made) -> pa.Table:
    made = list(made)
    return pa.table({
        "chunk": pa.array([chunk] * len(made), pa.int32()), "part": pa.array([k for k, _ in made], pa.int32()),
        "keys": pa.array([v for _, v in made], pa.binary()),
    })


def slices(rows: pa.Table, limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts) in runs of about ``limit`` bytes, to bound the arrays made of them."""
    at, size, bodies = 0, 0, []
    column = rows.column("body")
    for i in range(rows.num_rows):
        body = column[i].as_py()
        if bodies and size + len(body) > limit:
            yield at, bodies
            at, size, bodies = i, 0, []
        bodies.append(body)
        size += len(body)
    if bodies:
        yield at, bodies

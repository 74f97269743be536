"""Line dedup: hashes dealt by range, sorted by document, streamed for first occurrences.

Each record batch sends every line key once, with the smallest document that holds
it there; lines of larger documents of the batch are lost already. So a line that
stands in a third of all documents costs one row a batch. Each partition holds one
range of the hash, which is uniform, so equal ranges need no sample; rows are sorted by
hash and document, and one pass keeps the first document of each hash. What comes back
is a compressed bitmap a document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LAST, column, doc_ids, mapped, signed, table, text_key, texts, unused

MIN_CHARS = 10
_SENT = "hi bigint, lo bigint, doc bigint, key bigint, lost boolean, lines binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and lower-cased (A-Z); None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _batch_firsts(min_chars: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            docs, bodies = doc_ids(batch).tolist(), batch.column("body").to_pylist()
            keys = [signed(xxhash.xxh64_intdigest(b, 42)) for b in bodies]
            holder: dict[int, int] = {}
            seen: set[tuple[int, int]] = set()
            held = []
            for doc, key, body in zip(docs, keys, bodies, strict=True):
                own: dict[int, list[int]] = {}
                if (doc, key) not in seen:  # a repeated row has the same lines
                    seen.add((doc, key))
                    for at, line in enumerate(body.split(b"\n")):
                        if (k := line_key(line, min_chars)) is not None:
                            own.setdefault(xxhash.xxh3_128_intdigest(k), []).append(at)
                    for h in own:
                        if holder.get(h, LAST) >= doc:
                            holder[h] = doc
                held.append(own)
            out = {"hi": [], "lo": [], "doc": [], "key": [], "lost": [], "lines": []}

            def put(*row, out=out):
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)

            for doc, key, own in zip(docs, keys, held, strict=True):
                gone: list[int] = []
                for h, at in own.items():
                    if holder[h] < doc:
                        gone += at
                    else:
                        put(signed(h >> 64), signed(h & (1 << 64) - 1), doc, key, False, np.array(at, "<u4").tobytes())
                if gone:
                    put(signed(xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True))), 0, doc, key, True, np.array(gone, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(out[c], pa.int64()) for c in ("hi", "lo", "doc", "key")), pa.array(out["lost"], pa.bool_()), pa.array(out["lines"], pa.binary())],
                names=list(out),
            )

    return run


def _stream_losers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hi, lo, doc): all but those of each hash's first document are lost."""
    hash_now, first_doc = None, 0
    for batch in rows:
        if not batch.num_rows:
            continue
        hi, lo, doc = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc"))
        lost = batch.column("lost").to_numpy(zero_copy_only=False)
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | lost[1:] | lost[:-1]
        new[0] = (hi[0], lo[0]) != hash_now or lost[0]
        start = np.maximum.accumulate(np.where(new, np.arange(len(hi)), -1))
        first = np.where(start >= 0, doc[np.maximum(start, 0)], first_doc)
        hash_now, first_doc = None if lost[-1] else (hi[-1], lo[-1]), first[-1]
        mask = pa.array(lost | (doc > first))
        yield batch.select(["doc", "key", "lines"]).filter(mask)


def _to_bitmaps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        maps = []
        for parts in batch.column("parts").to_pylist():
            gone = np.frombuffer(b"".join(parts), "<u4")
            keep = np.ones((int(gone.max()) | 7) + 1, np.uint8)  # whole bytes
            keep[gone] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(maps, pa.binary())], names=["doc", "key", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, key, keep) for each document that loses lines.

    keep is a zlib-compressed bitmap, one bit a line; lines beyond its end stay.
    doc is doc_id (LAST if null) and key the text's 64-bit key. A line key found in
    two or more documents stays only in the smallest doc_id, there with all its lines.
    Rows of one doc_id are one document; a null doc_id is the largest document. Null
    or empty texts have one empty line, too short to count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts(docs).mapInArrow(_batch_firsts(min_chars), _SENT)
    lost = (
        sent.repartitionById(n, (F.shiftrightunsigned("hi", 32) * n / (1 << 32)).cast("int"))
        .sortWithinPartitions("hi", "lo", "doc")
        .mapInArrow(_stream_losers, "doc bigint, key bigint, lines binary")
    )
    return lost.groupBy("doc", "key").agg(F.collect_list("lines").alias("parts")).mapInArrow(_to_bitmaps, "doc bigint, key bigint, keep binary")


def kept_lines(body: bytes, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and the lines that stay, joined."""
    lines = body.split(b"\n")
    if keep is None:
        return len(lines), 0, body
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    stay = [line for at, line in enumerate(lines) if at >= len(bits) or bits[at]]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their other columns as they were, ``text`` without its lost lines.

    Two columns follow, the lines before and those dropped: ``_n_lines`` and ``_n_dropped``, with
    underscores added where the documents have such columns. A null text stays null and has one
    line, as an empty one; repeated rows give repeated rows; an empty table gives no rows.
    """
    names = docs.columns
    doc, key, keep, *counts = unused(names, "_llm_doc", "_llm_key", "_llm_keep", "_n_lines", "_n_dropped")
    joined = docs.withColumns({
        doc: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), key: text_key(F.col("text")),
    }).join(keep_bitmaps(docs, min_chars).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("keep").alias(keep)), [doc, key], "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            old = batch.column("text").cast(pa.binary()).to_pylist()
            made = [kept_lines(b or b"", k) for b, k in zip(old, batch.column(keep).to_pylist(), strict=True)]
            new = pa.array([None if b is None else m[2] for b, m in zip(old, made, strict=True)], pa.binary()).cast(pa.string())
            columns = [new if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())],
                names=[*names, *counts],
            )

    kinds = StructType([*docs.schema, *(StructField(c, LongType()) for c in counts)])
    return mapped(joined.select(*map(column, names), keep), run, kinds)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
    SELECT k.*, f.first IS NOT NULL AND f.first < k.doc_id AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

"""What the operators of this subpackage share: inputs, keys, byte-level words, packed arrays."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Order value of a missing doc_id: such rows count as one document after all others.
LAST = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Workers get the package's folder in their PYTHONPATH, as the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, have)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text as UTF-8 bytes ``body`` (null: empty); other columns are left behind."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"),
    )


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores after those that are taken, as Spark compares them, without case."""
    have, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names; those with dots or backticks it would not take itself."""
    names = df.columns

    def renamed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in rows):
            yield batch.rename_columns([f"c{i}" for i in range(len(kinds))])

    out = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(kinds)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, out).toDF(*kinds.names)


def text_key(text: Column) -> Column:
    """64-bit key of a text; with doc_id it names a document row, so repeated rows share results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from one aggregate."""
    return docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0


def batches(rows: Iterator[pa.RecordBatch], limit: int = 4 << 20, body: str = "body") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the bytes of each one's texts stay near ``limit`` (one row at least)."""
    for batch in rows:
        size = np.cumsum([0, *map(len, (x.as_buffer() or b"" for x in batch.column(body)))]) if batch.num_rows else [0]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def doc_ids(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """doc_id as int64, missing ones as LAST."""
    return np.array([LAST if d is None else d for d in batch.column("doc_id").to_pylist()], dtype=np.int64)


def id_or_null(values) -> list:
    return [None if int(v) == LAST else int(v) for v in values]


def signed(x: int) -> int:
    """A 64-bit unsigned number as the signed number of the same bits."""
    return x - (1 << 64) if x >> 63 else x


# --- hashing of words and windows, vectorised -------------------------------------------------

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: spreads each bit over all bits."""
    moved = h >> _U(30)
    h = h ^ moved
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, _U(27), out=moved)
    h *= _U(0x94D049BB133111EB)
    h ^= np.right_shift(h, _U(31), out=moved)
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64 (odd bases can be inverted)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16, 2 * (0 if have is None else len(have[0])))
        up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        have = _POWERS[base] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return have


def prefix_sums(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Sums of the first values, each times its power: what polynomials of runs are worked out from."""
    up, _ = _powers(_BASES[base], len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, base: int = 0) -> np.ndarray:
    """The polynomial modulo 2**64 of the values from each start to its end (exclusive). Equal runs agree, see ``window_hashes`` for others."""
    out = sums[end] - sums[start]
    out *= _powers(_BASES[base], len(sums))[1][start]
    return out


def window_hashes(values: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` values: a polynomial modulo 2**64 from prefix sums, then mixed.

    For values that are random themselves and runs of fixed, short width only: such polynomials collide by
    construction on long runs of two values in the Thue-Morse order.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums = prefix_sums(values, base)
    return mix(span_hashes(sums, slice(0, n), slice(width, width + n), base))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts, as arrays.

    hashes: 64-bit word hashes; doc: the text's index; start, end: bytes in ``raw``,
    where texts follow each other with one separator; first: index of each text's first word.
    """

    def __init__(self, bodies: list[bytes]):
        joined = b"\n".join(bodies) + b"\n"
        self.raw = np.frombuffer(joined, np.uint8)
        self.joined = joined
        space = _SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        self.offset = np.cumsum([0, *(len(b) + 1 for b in bodies)])
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(bodies)), np.diff(self.first))
        known: dict[bytes, int] = {}
        number = [known.setdefault(w, len(known)) for w in joined.split()]
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), _U, len(known))[number] if number else np.zeros(0, _U)


# --- arrays as bytes -----------------------------------------------------------------------------


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte position by byte position (sorted ones compress well)."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)

"""Substring dedup with fixed-block anchors.

Every document is cut into blocks of half a window, none overlapping, and every rolling
window of block length probes them. A repeat of a whole window holds one of the
blocks, so windows without an anchor (a block hash that another document has, too)
need no more thought. Around each anchor the repeat is extended: all windows that hold
the anchor are compared with their equals in other documents, and what the equal ones
cover together are the maximal repeats. Equal windows are never paired; each
part of the hash space tells only whether a smaller document has the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import Words, doc_ids, id_or_null, planes, table, unplanes, window_hashes

WINDOW = 50
_U = np.uint64


class Chunk:
    """Word arrays of a chunk's documents. Rows of one doc_id are one document."""

    def __init__(self, rows: pa.Table):
        self.ids = doc_ids(rows)
        self.names, self.same = np.unique(self.ids, return_inverse=True)
        parts = [(at, Words(bodies)) for at, bodies in exchange.slices(rows)]
        self.hashes = np.concatenate([w.hashes for _, w in parts])
        self.row = np.concatenate([w.doc + at for at, w in parts])
        self.doc = self.same[self.row]
        self.first = np.searchsorted(self.row, np.arange(len(self.ids) + 1))

    def starts(self, width: int) -> np.ndarray:
        """First words of all windows that stay inside one text."""
        n = max(0, len(self.row) - width + 1)
        return np.flatnonzero(self.row[:n] == self.row[width - 1 :]) if n else np.zeros(0, np.int64)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Sorted 64-bit keys, cut by their first bits: part k is keys[cuts[k]:cuts[k + 1]]."""
    if not bits:
        return np.array([0, len(keys)])
    edges = (np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else []
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


class Anchors:
    """A chunk's distinct block-length windows by hash: which are blocks, and which stand in two documents."""

    def __init__(self, chunk: Chunk, block: int):
        self.at = chunk.starts(block)
        h = window_hashes(chunk.hashes, block)[self.at]
        self.order = np.argsort(h)
        s, doc = h[self.order], chunk.doc[self.at][self.order]
        self.group = _groups(s)
        self.keys = s[self.group]
        aligned = ((self.at - chunk.first[chunk.row[self.at]]) % block == 0)[self.order]
        if len(s):
            self.block = np.logical_or.reduceat(aligned, self.group)
            self.several = np.minimum.reduceat(doc, self.group) != np.maximum.reduceat(doc, self.group)
        else:
            self.block = self.several = np.zeros(0, bool)

    def packed(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """40 bits of each hash beyond the part's, the last two of them for the flags. Equal bits of unequal hashes give needless candidates only."""
        short = (self.keys << _U(bits)) >> _U(24)
        short = (short & ~_U(3)) | self.block.astype(_U) << _U(1) | self.several.astype(_U)
        cuts = _cuts(self.keys, bits)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            yield part, planes(short[cuts[part] : cuts[part + 1]], 5)

    def shared(self, told: dict[int, bytes], bits: int, n: int) -> np.ndarray:
        """For each word whether the block-length window there is an anchor."""
        cuts, flags = _cuts(self.keys, bits), np.zeros(len(self.keys), bool)
        for part, blob in told.items():
            a, b = cuts[part], cuts[part + 1]
            flags[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
        out = np.zeros(n, bool)
        out[self.at[self.order]] = np.repeat(flags, np.diff(np.append(self.group, len(self.order))))
        return out


def find_anchors(blobs: list[bytes]) -> list[bytes]:
    """An anchor is a block somewhere and stands in two documents."""
    sent = [unplanes(b, 5) for b in blobs]
    every = np.concatenate(sent)
    order = np.argsort(every, kind="stable")
    s = every[order]
    group = _groups(s >> _U(2))
    size = np.diff(np.append(group, len(s)))
    anchor = (np.bitwise_or.reduceat(s & _U(2), group) > 0) & ((size > 1) | (np.bitwise_or.reduceat(s & _U(1), group) > 0))
    flags = np.zeros(len(s), bool)
    flags[order] = np.repeat(anchor, size)
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum([len(x) for x in sent])[:-1])]


class Windows:
    """A chunk's distinct candidate windows, each with the smallest document of the chunk that has it."""

    def __init__(self, chunk: Chunk, anchor: np.ndarray, width: int, block: int):
        at = chunk.starts(width)
        before = np.concatenate(([0], np.cumsum(anchor)))
        self.at = at[before[at + width - block + 1] > before[at]]
        h = window_hashes(chunk.hashes, width)[self.at]
        check = window_hashes(chunk.hashes, width, 1)[self.at] & _U(0xFFFFFFFF)
        doc = chunk.ids[chunk.row[self.at]]
        self.order = np.lexsort((doc, check, h))
        s, c, self.doc = h[self.order], check[self.order], doc[self.order]
        self.group = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]) | (c[1:] != c[:-1]))))
        self.keys, self.check, self.lowest = s[self.group], c[self.group], self.doc[self.group]

    def packed(self, bits: int) -> Iterator[tuple[int, bytes]]:
        cuts = _cuts(self.keys, bits)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[part], cuts[part + 1]
            yield part, planes(self.keys[a:b], 8) + planes(self.check[a:b], 4) + planes(self.lowest[a:b].astype(_U), 8)

    def lost(self, told: dict[int, bytes], bits: int, n: int, width: int) -> np.ndarray:
        """For each word whether a window over it also starts in a smaller document."""
        cuts, smaller = _cuts(self.keys, bits), np.zeros(len(self.keys), bool)
        for part, blob in told.items():
            a, b = cuts[part], cuts[part + 1]
            smaller[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
        size = np.diff(np.append(self.group, len(self.order)))
        gone = np.repeat(smaller, size) | (self.doc > np.repeat(self.lowest, size))
        start = self.at[self.order[gone]]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + width, -1)
        return np.cumsum(cover[:n]) > 0


def find_smaller(blobs: list[bytes]) -> list[bytes]:
    """For each window sent whether another chunk has it in a document smaller than the sender's smallest."""
    sizes = [len(b) // 20 for b in blobs]
    key = np.concatenate([unplanes(b[: 8 * n], 8) for b, n in zip(blobs, sizes)])
    check = np.concatenate([unplanes(b[8 * n : 12 * n], 4) for b, n in zip(blobs, sizes)])
    doc = np.concatenate([unplanes(b[12 * n :], 8) for b, n in zip(blobs, sizes)]).astype(np.int64)
    order = np.lexsort((doc, check, key))
    k, c, d = key[order], check[order], doc[order]
    group = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
    flags = np.zeros(len(k), bool)
    flags[order] = d > np.repeat(d[group], np.diff(np.append(group, len(k))))
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row a document.

    A word goes if a run of ``window`` words over it also starts in a document of
    smaller doc_id, in the texts as given. kept holds the other words, joined by one
    space. Null and empty texts have no words; texts shorter than a window keep all; a
    null doc_id counts as the largest; rows of one doc_id are one document. Other columns,
    whatever their names, are left behind; an empty table gives no rows.
    """
    block = (window + 1) // 2
    chunks = exchange.chunk_count(docs)
    bits = exchange.part_bits(chunks)
    chunked = exchange.in_chunks(docs, chunks)

    def probes(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        return Anchors(Chunk(rows), block).packed(bits)

    def candidates(rows: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        chunk = Chunk(rows)
        anchor = Anchors(chunk, block).shared(told, bits, len(chunk.row))
        yield exchange.note(rows), np.packbits(anchor).tobytes()
        yield from Windows(chunk, anchor, window, block).packed(bits)

    def kept(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        chunk = Chunk(rows)
        n = len(chunk.row)
        anchor = np.unpackbits(np.frombuffer(told.pop(exchange.note(rows)), np.uint8), count=n).astype(bool)
        lost = Windows(chunk, anchor, window, block).lost(told, bits, n, window)
        texts, removed = [], []
        for body, a, b in zip(rows.column("body").to_pylist(), chunk.first, chunk.first[1:]):
            words, gone = body.split(), lost[a:b]
            removed.append(int(gone.sum()))
            texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words))
        return pa.table({
            "doc_id": pa.array(id_or_null(chunk.ids), pa.int64()), "n_words": pa.array(np.diff(chunk.first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.binary()).cast(pa.string()),
        })

    anchors = exchange.answer(exchange.ask(chunked, probes), find_anchors)
    asked = exchange.ask_again(chunked, anchors, candidates)
    smaller = exchange.answer(asked, find_smaller)
    return exchange.read_answers(chunked, smaller, kept, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP4_SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)
), judged AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM judged
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs
), marked AS (
    SELECT words.doc_id, word, words.pos, gone.pos IS NOT NULL AS lost FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos
), left_over AS (
    SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT lost) AS kept FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
"""

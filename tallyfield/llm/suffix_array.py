"""Suffix-array dedup: a distributed difference-cover sort of suffixes, up to the repeat length.

Positions whose number modulo 3 is 1 or 2 are the sample. (1) Their triples of 8-byte letters are
sorted and named by rank. (2) The recursion sorts pairs of names, 24 bytes apart, and
names those: the order of all sampled suffixes by 48 bytes. (3) Every window of 50
bytes is a sampled suffix with two bytes, or one or two bytes with a sampled suffix, so
remaining suffixes are merged in by comparing such tuples; in the merged order equal
windows stand next to each other, and each run of equal prefixes tells its smallest document.
The order is cut off at the repeat length, so two levels of recursion are enough.

Sorting happens in range partitions of the first eight bytes. Two exact steps keep
suffixes out that cannot matter. Texts are cut where their content says so; of equal
pieces only that of the smallest document is sorted, as all windows of the others start
there, too. And a window enters only if its smallest 34-byte hash, by which equal
windows agree, stands in two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import LAST, doc_ids, id_or_null, mix, planes, table
from .substring_dedup import _cuts, find_anchors, find_smaller

LENGTH = 50
LETTER, TRIPLE = 8, 24
KMER = 34
#: Mean length of a content-defined piece.
PIECE = 64
CHUNK_BYTES = 8 << 20
#: Sampled eight-byte strings from which the range partitions are balanced; results do not depend on them.
SPLIT_SAMPLE = 20_000
#: An odd number whose bits look random.
_MIXED = 0x9E3779B97F4A7C15
_U = np.uint64


def freeze(*arrays: np.ndarray) -> bytes:
    """Columns of unsigned numbers as compressed bytes, each as narrow as its largest value."""
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        a = a.astype("<u8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out += [np.array([len(a), width], "<u4").tobytes(), planes(a, width)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def thaw(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 4, []
    for _ in range(int(np.frombuffer(raw, "<u4", 1)[0])):
        n, width = map(int, np.frombuffer(raw, "<u4", 2, at))
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n).T
        out.append(a.view("<u8").reshape(n))
        at += 8 + n * width
    return out


def pack_rows(columns: list[np.ndarray]) -> bytes:
    """Sorted rows of numbers as compressed bytes: how many first half letters each row shares with the one before, and its others."""
    rows = np.stack(columns, 1).astype(">u8").view("<u4")
    same, alike = np.zeros(len(rows), np.uint8), np.ones(max(0, len(rows) - 1), bool)
    for c in columns:
        apart = c[1:] ^ c[:-1]
        for bits in (32, 0):
            alike &= apart < _U(1 << bits)
            same[1:] += alike
    rest = rows[np.arange(rows.shape[1], dtype=np.uint8) >= same[:, None]]
    return zstandard.ZstdCompressor(level=4).compress(np.array([len(rows)], "<u4").tobytes() + same.tobytes() + rest.tobytes())


def unpack_rows(blob: bytes, width: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    same, place = np.frombuffer(raw, np.uint8, n, 4), np.arange(n, dtype=np.int32)
    rows = np.zeros((n, 2 * width), "<u4")
    rows[np.arange(2 * width, dtype=np.uint8) >= same[:, None]] = np.frombuffer(raw, "<u4", offset=4 + n)
    for at in range(2 * width):
        rows[:, at] = rows[np.maximum.accumulate(place * (same <= at)), at]  # of the last row that has its own
    return [c.astype(_U) for c in rows.view(">u8").T]


def ordered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of rows by all columns, and where in it a row differs from the one before.

    Rows are sorted by as many leading bits as fit a number beside their place, then those that tie by the next
    bits, with their group's number before these: sorting plain numbers is several times as fast as an argsort.
    """
    n = len(columns[0])
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    left = [(c, int(c.max()).bit_length()) for c in columns] if n else []
    tied, group, groups = np.arange(n), np.zeros(n, _U), 1  # places in the order, of rows whose group is not yet one row
    while left and len(tied):
        place_bits = len(tied).bit_length()
        room = 64 - place_bits - groups.bit_length()
        key, rest = group, []
        for c, width in left:
            take = min(room, width)
            key = (key << _U(take)) | ((c >> _U(width - take)) if take else _U(0))
            room -= take
            if take < width:
                rest.append((c & _U((1 << (width - take)) - 1), width - take))
        key = (key << _U(place_bits)) | np.arange(len(tied), dtype=_U)
        key.sort()
        was = (key & _U((1 << place_bits) - 1)).astype(np.int64)
        key >>= _U(place_bits)
        order[tied] = order[tied[was]]
        fresh = np.ones(len(key) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
        new[tied] = fresh[:-1]
        still = ~(fresh[:-1] & fresh[1:])
        number = np.cumsum(fresh[:-1][still])
        groups = int(number[-1]) if len(number) else 0
        tied, group, was = tied[still], number.astype(_U) - _U(1), was[still]
        left = [(c[was], width) for c, width in rest]
    return order, new


def sorting(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows, by the first column, then the next."""
    return ordered(columns)[0]


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows, each row's number among them, the sort order and the groups' starts."""
    order, new = ordered(columns)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    group = np.flatnonzero(new)
    first = order[group]
    return [c[first] for c in columns], number, order, group


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out, have = op(out[:-have], out[have:]), 2 * have
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def sampled(at: np.ndarray) -> np.ndarray:
    """For each byte whether the windows that start at ``at`` need the sampled suffix there by 48 bytes; long enough to tell where the next triples are."""
    size = int(at.max()) + 4 + TRIPLE if len(at) else 0
    need, kind = np.zeros(size, bool), at % 3
    for ahead in ((1, 0, 0), (2, 1, 2)):
        need[at + np.array(ahead)[kind]] = True
    return need


def places(chosen: np.ndarray) -> np.ndarray:
    """For each chosen byte where it stands among these; 0 for others."""
    out, at = np.zeros(len(chosen), np.int32), np.flatnonzero(chosen)
    out[at] = np.arange(len(at), dtype=np.int32)
    return out


class Texts:
    """A chunk's texts as one byte array, one separator after each."""

    def __init__(self, rows: pa.Table):
        bodies = rows.column("body").to_pylist()
        self.ids = doc_ids(rows)
        self.size = np.array([len(b) for b in bodies])
        self.offset = np.cumsum([0, *(self.size + 1)])
        self.joined = b"\n".join([*bodies, bytes(64)])
        self.raw = np.frombuffer(self.joined, np.uint8)
        self.hashed: dict[tuple[int, int, int], np.ndarray] = {}

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offset, at, "right") - 1]

    def letters(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each position, as numbers in the bytes' order."""
        return np.ndarray(len(self.raw) - LETTER + 1, ">u8", self.joined, 0, (1,))[at].astype(_U)

    def hashes(self, lo: int, hi: int, width: int) -> np.ndarray:
        """An odd number of 32 bits for each ``width`` bytes of a run: short, so that minima over them are cheap. Equal bytes agree; worked out once."""
        if (lo, hi, width) not in self.hashed:
            letters = np.ndarray(hi - lo - LETTER + 1, "<u8", self.joined, lo, (1,))
            out, have, factor = ((letters * _U(_MIXED)) >> _U(32)).astype(np.uint32), LETTER, _MIXED & 0xFFFFFFFF
            while have < width:
                step = min(have, width - have)
                ahead = out[step:]
                out = out[:-step] * np.uint32(factor)
                out += ahead
                have, factor = have + step, factor * factor & 0xFFFFFFFF
            self.hashed[lo, hi, width] = out | np.uint32(1)
        return self.hashed[lo, hi, width]

    def keys(self, at: np.ndarray, short: np.ndarray, width: int) -> np.ndarray:
        """64 bits for the ``width`` bytes at each position: the given hashes of these, as they are (smallest ones pack well), then 32 bits of three letters."""
        out = self.letters(at)
        for ahead in ((width - LETTER) // 2, width - LETTER):
            out = (out ^ (out >> _U(32))) * _U(_MIXED) + self.letters(at + ahead)
        return short.astype(_U) << _U(32) | (out * _U(_MIXED)) >> _U(32)

    def runs(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """By runs of texts of about 256 KB, so that arrays of a run stay in a core's cache: first byte, last (exclusive), where windows may start."""
        edges = [0]
        while edges[-1] < len(self.size):
            edges.append(max(edges[-1] + 1, int(np.searchsorted(self.offset, self.offset[edges[-1]] + (1 << 18), "right")) - 1))
        for a, b in zip(edges, edges[1:]):
            lo, hi = int(self.offset[a]), int(self.offset[b])
            n = hi - lo - length + 1
            if n > 0 and (self.size[a:b] >= length).any():
                valid = np.zeros(n, bool)
                for at, size in zip((self.offset[a:b] - lo).tolist(), self.size[a:b].tolist()):
                    if size >= length:
                        valid[at : at + size - length + 1] = True
                yield lo, hi, valid

    def pieces(self, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window starts (end exclusive) of content-defined pieces, and a hash of each piece's bytes.

        Equal pieces have equal hashes, so a piece whose hash stands in one document has no equal elsewhere; others are compared by name.
        """
        found = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, _U)]]
        long = np.flatnonzero(self.size >= length)
        offset, size = self.offset[long], self.size[long]
        for lo, hi, valid in self.runs(length):
            kmers = self.hashes(lo, hi, width)
            cut = kmers[: len(valid)] < np.uint32((1 << 32) // PIECE)
            of_run = slice(*np.searchsorted(offset, (lo, hi)))
            cut[offset[of_run] - lo] = True
            start, stop = np.flatnonzero(cut & valid), offset[of_run] + size[of_run] - length + 1 - lo
            end = np.minimum(np.append(start[1:], len(valid)), stop[np.searchsorted(stop, start, "right")])
            last = end + length - 1 - width  # of the piece's k-mers, whose sum stands for them, with the first and the last
            sums = np.cumsum(kmers, dtype=_U)
            total = sums[last] - sums[start] + kmers[start]
            found.append([start + lo, end + lo, mix(total * _U(_MIXED) + (kmers[start].astype(_U) << _U(32) | kmers[last]))])
        return tuple(np.concatenate(x) for x in zip(*found))

    def names(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """96 bits of a hash of each span's bytes, in two columns."""
        name = b"".join([xxhash.xxh3_128_digest(self.joined[a:b]) for a, b in zip(start.tolist(), end.tolist())])
        one, two = np.frombuffer(name, "<u8").reshape(-1, 2).T.astype(_U)
        return [one, two & _U(0xFFFFFFFF)]

    def anchors(self, lost: np.ndarray, length: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By runs of texts: offset, k-mer hashes, each window's smallest, windows that are not lost, where k-mers are that one of these chooses."""
        w = length - width + 1
        for lo, hi, valid in self.runs(length):
            h = self.hashes(lo, hi, width)
            del self.hashed[lo, hi, width]  # nothing asks for it again
            valid &= ~lost[lo : lo + len(valid)]
            low = sliding(np.minimum, h, w)
            # chosen if it is the smallest of some window: then the largest of its windows' minima is itself
            minima = np.zeros(len(low) + 2 * (w - 1), np.uint32)
            np.multiply(low, valid, out=minima[w - 1 : w - 1 + len(low)])
            yield lo, h, low, valid, np.flatnonzero(sliding(np.maximum, minima, w) == h)


def name_parts(sent: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Ranks of the rows that all chunks sent to a range: equal rows have one rank."""
    columns = [np.concatenate(c) for c in zip(*sent)]
    _, number, _, _ = distinct(columns)
    return np.split(number.astype(_U), np.cumsum([len(s[0]) for s in sent])[:-1])


def _name(blobs: list[bytes]) -> list[bytes]:
    sent = [thaw(b) for b in blobs]
    for columns in sent:
        columns[0] = np.cumsum(columns[0], dtype=_U)
    return [freeze(np.diff(x, prepend=_U(0))) for x in name_parts(sent)]  # they ascend, as the rows do


def _name_triples(blobs: list[bytes]) -> list[bytes]:
    return [freeze(np.diff(x, prepend=_U(0))) for x in name_parts([unpack_rows(b, 3) for b in blobs])]


def _by_parts(columns: list[np.ndarray], part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows sorted by part and first column, one blob a part; of the first column the differences."""
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
    for a, b in zip(edges, np.append(edges[1:], len(part))):
        yield int(part[a]), freeze(np.diff(columns[0][a:b], prepend=_U(0)), *(c[a:b] for c in columns[1:]))


def _names_back(told: dict[int, bytes]) -> np.ndarray:
    """Names of the rows sent, in their order: the part, then the rank inside it."""
    return np.concatenate([np.zeros(0, _U), *((_U(p) << _U(32)) | np.cumsum(thaw(told[p])[0], dtype=_U) for p in sorted(p for p in told if p >= 0))])


def merge_windows(kinds: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Smallest document of each row's window, over all three kinds of positions.

    Rows of kind 1 and 2 are (rank48, two bytes, first bytes, rank48 further on, doc); of kind 0
    (first byte, rank48 at +1, last byte, second byte, rank48 at +2, doc).
    """
    zero, one, two = kinds
    n0, n1, n2 = (len(k[0]) for k in kinds)
    # sampled suffixes, by 48 bytes and two more
    _, sampled, _, _ = distinct([np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1]))])
    # remaining suffixes against kind 1 by (byte, rank, byte), against kind 2 by (byte, byte, rank)
    _, with1, _, _ = distinct([np.concatenate((one[2], zero[0])), np.concatenate((one[3], zero[1])), np.concatenate((one[4], zero[2]))])
    _, with2, _, _ = distinct([np.concatenate((two[2], zero[0])), np.concatenate((two[3], zero[3])), np.concatenate((two[4], zero[4]))])
    groups = int(sampled.max()) + 1 if len(sampled) else 0
    own = groups + with1[n1:]  # a remaining suffix that meets no sampled one has its own run
    for ranks, theirs in ((with1, sampled[:n1]), (with2, sampled[n1:])):
        n = len(theirs)
        if n:
            run = np.full(int(ranks.max()) + 1, -1)
            run[ranks[:n]] = theirs
            met = run[ranks[n:]]
            own = np.where(met >= 0, met, own)
    number = np.concatenate((own, sampled))
    doc = np.concatenate([k[-1] for k in kinds]).astype(np.int64)
    lowest = np.full(int(number.max()) + 1 if len(number) else 0, LAST)
    np.minimum.at(lowest, number, doc)
    return np.split(lowest[number], [n0, n0 + n1])


def _merge(blobs: list[bytes]) -> list[bytes]:
    """Each chunk's windows of a range: whether a smaller document than the chunk's own smallest has them."""
    sent = [thaw(b) for b in blobs]  # 6 columns of kind 0, then of 1, then of 2
    kinds = [[np.concatenate([s[6 * k + c] for s in sent]) for c in range(6)] for k in range(3)]
    smaller = [low < kind[-1].astype(np.int64) for low, kind in zip(merge_windows(kinds), kinds)]
    back = [np.split(x, np.cumsum([len(s[6 * k]) for s in sent])[:-1]) for k, x in enumerate(smaller)]
    return [freeze(*(back[k][i].astype(_U) for k in range(3))) for i in range(len(sent))]


def splitters(docs: DataFrame, parts: int, seed: int = 3) -> np.ndarray:
    """First letters that cut a bounded sample of all texts into equal ranges."""
    sized = docs.select(F.col("text").cast("binary").alias("b"), F.xxhash64("doc_id", F.lit(seed)).alias("h")).where(F.length("b") >= LENGTH)
    n = sized.count()
    if parts < 2 or not n:
        return np.zeros(0, _U)
    picked = sized.where(F.pmod("h", F.lit(max(1, n // SPLIT_SAMPLE))) == 0).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring(
            F.col("b"), 1 + F.pmod(F.hash("h", k), F.length("b") - LETTER), F.lit(LETTER)))).alias("s")
    )
    found = np.sort(np.array([int.from_bytes(r.s, "big") for r in picked.limit(8 * SPLIT_SAMPLE).collect()], _U))
    return found[np.arange(1, parts) * len(found) // parts]


def dedup_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row a document; kept is binary.

    A byte goes if a string of 50 bytes over it also starts in a document of smaller
    doc_id, in the texts as given. Matches never cross texts. Null and empty texts have
    no bytes; shorter texts keep all; a null doc_id counts as the largest; rows of one
    doc_id are one document. Other columns, whatever their names, are left behind; an
    empty table gives no rows.
    """
    if length != LENGTH:
        raise ValueError("two levels of names order suffixes by 50 bytes")
    chunks = exchange.chunk_count(docs, CHUNK_BYTES)
    bits = exchange.part_bits(chunks)
    chunked = exchange.in_chunks(docs, chunks)
    split = splitters(docs, 1 << bits)
    width = KMER

    def ask_short(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        """40 bits of each piece's hash: most pieces stand nowhere else and need no name."""
        texts = Texts(rows)
        start, _, key = texts.pieces(length, width)
        (key,), _, order, group = distinct([key])
        if len(key):
            doc = texts.doc(start)[order]
            yield from short_keys(key, np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group))

    def named(texts: Texts, start: np.ndarray, end: np.ndarray):
        """Pieces' documents, distinct names, each piece's place among these, the smallest document of each."""
        (key, check), number, order, group = distinct(texts.names(start, end + length - 1))
        doc = texts.doc(start)
        return doc, key, check, number, np.minimum.reduceat(doc[order], group) if len(group) else doc

    def ask_pieces(rows: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        texts = Texts(rows)
        start, end, key = texts.pieces(length, width)
        (key,), number, _, _ = distinct([key])
        twice = flags_of(told, key)[number]
        yield exchange.note(rows), np.packbits(twice).tobytes()
        _, key, check, _, low = named(texts, start[twice], end[twice])
        cuts = _cuts(key, bits)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[part], cuts[part + 1]
            yield part, zstandard.compress(planes(key[a:b], 8) + planes(check[a:b], 4) + planes(low[a:b].astype(_U), 8), 1)

    def short_keys(keys: np.ndarray, several: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """40 bits of each sorted key beyond the part's, the last of them for whether it stands in two documents of the chunk."""
        short = (((keys << _U(bits)) >> _U(24)) & ~_U(3)) | _U(2) | several.astype(_U)
        cuts = _cuts(keys, bits)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            yield part, zstandard.compress(planes(short[cuts[part] : cuts[part + 1]], 5), 1)

    def flags_of(told: dict[int, bytes], keys: np.ndarray) -> np.ndarray:
        cuts, flags = _cuts(keys, bits), np.zeros(len(keys), bool)
        for part in (p for p in told if p >= 0):
            flags[cuts[part] : cuts[part + 1]] = np.unpackbits(np.frombuffer(told[part], np.uint8), count=cuts[part + 1] - cuts[part])
        return flags

    def chosen(texts: Texts, lost: np.ndarray):
        parts = list(texts.anchors(lost, length, width))
        at = np.concatenate([np.zeros(0, np.int64), *(p[4] + p[0] for p in parts)])
        short = np.concatenate([np.zeros(0, np.uint32), *(p[1][p[4]] for p in parts)])
        keys, number, order, group = distinct([texts.keys(at, short, width)])
        return parts, at, keys[0], number, order, group

    def ask_anchors(rows: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        texts = Texts(rows)
        start, end, _ = texts.pieces(length, width)
        twice = np.unpackbits(np.frombuffer(told[exchange.note(rows)], np.uint8), count=len(start)).astype(bool)
        start, end = start[twice], end[twice]
        doc, key, _, number, low = named(texts, start, end)
        gone = flags_of(told, key)[number] | (doc > low[number])
        step = np.zeros(len(texts.raw) + 1, np.int8)
        step[start[gone]] += 1  # pieces do not overlap: one may start where another ends
        step[end[gone]] -= 1
        lost = np.cumsum(step[:-1], dtype=np.int8) > 0
        _, at, keys, number, order, group = chosen(texts, lost)
        yield exchange.note(rows), freeze(np.packbits(lost))
        if len(keys):
            doc = texts.doc(at)[order]
            yield from short_keys(keys, np.minimum.reduceat(doc, group) != np.maximum.reduceat(doc, group))

    def windows(texts: Texts, lost: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
        """Starts of the windows whose smallest k-mer stands in two documents."""
        parts, at, keys, number, _, _ = chosen(texts, lost)
        shared = np.zeros(len(texts.raw), bool)
        shared[at] = flags_of(told, keys)[number]
        out = []
        for lo, kmers, low, valid, _ in parts:
            known = np.where(shared[lo : lo + len(kmers)], kmers, ~np.uint32(0))
            out.append(np.flatnonzero(valid & (sliding(np.minimum, known, length - width + 1) == low)) + lo)
        return np.concatenate([np.zeros(0, np.int64), *out])

    def triples_of(texts: Texts, at: np.ndarray):
        """Distinct triples of the windows' sampled suffixes in order, and the places among these of each suffix's triple and of the next."""
        need = sampled(at)
        suffix = np.flatnonzero(need)
        need[TRIPLE:] |= need[:-TRIPLE].copy()
        triple, before = np.flatnonzero(need), places(need)
        rank, number, _, _ = distinct([texts.letters(triple + LETTER * k) for k in range(3)])
        return rank, [number[before[suffix + ahead]] for ahead in (0, TRIPLE)]

    def ask_triples(rows: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        texts = Texts(rows)
        lost = np.unpackbits(thaw(told[exchange.note(rows)])[0].astype(np.uint8), count=len(texts.raw)).astype(bool)
        at = windows(texts, lost, told)
        yield exchange.note(rows), freeze(np.packbits(lost), np.diff(at, prepend=0).astype(_U))
        rank, _ = triples_of(texts, at)
        cuts = [0, *np.searchsorted(rank[0], split).tolist(), len(rank[0])]
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield part, pack_rows([c[a:b] for c in rank])

    def ask_pairs(rows: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        lost, step = thaw(told[exchange.note(rows)])
        # sorting the triples again is cheaper than sending each suffix's two places among them
        _, numbers = triples_of(Texts(rows), np.cumsum(step.astype(np.int64)))
        name = _names_back(told)
        columns, number, _, _ = distinct([name[x] for x in numbers])
        yield exchange.note(rows), freeze(lost, step, number.astype(_U))
        yield from _by_parts([columns[0] & _U(0xFFFFFFFF), columns[1]], (columns[0] >> _U(32)).astype(np.int64))

    few = np.min_scalar_type(1 << bits)  # for numbers of parts: the narrower, the faster they are sorted

    def place_of(texts: Texts, p: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk's distinct windows, numbered as they come: part, order in which they are sent, smallest document."""
        part = np.searchsorted(split, texts.letters(p[first]), "right").astype(few)
        low = np.full(len(first), LAST)
        np.minimum.at(low, number, texts.doc(p))
        return part, np.argsort(part, kind="stable"), low

    def ask_windows(rows: pa.Table, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        texts = Texts(rows)
        lost, step, number = thaw(told[exchange.note(rows)])
        at = np.cumsum(step.astype(np.int64))
        before = places(sampled(at))
        name = _names_back(told)[number.astype(np.int64)]  # of each sampled suffix, by 48 bytes

        def rank(p: np.ndarray) -> np.ndarray:
            return name[before[p]]

        def byte(p: np.ndarray) -> np.ndarray:
            return texts.raw[p].astype(_U)

        kinds, order_of = [], []
        for kind in range(3):
            p = at[at % 3 == kind]
            tail = (byte(p + 48) << _U(8)) | byte(p + 49)
            if kind == 0:
                columns = [byte(p), rank(p + 1), byte(p + 49), byte(p + 1), rank(p + 2)]
            elif kind == 1:
                columns = [rank(p) & _U(0xFFFFFFFF), tail, byte(p), rank(p + 1), byte(p + 49)]
            else:
                columns = [rank(p) & _U(0xFFFFFFFF), tail, byte(p), byte(p + 1), rank(p + 2)]
            # 48 bytes by rank and the other two are the whole window
            whole = [rank(p + 1), (byte(p) << _U(8)) | byte(p + 49)] if kind == 0 else [rank(p), tail]
            _, number, order, group = distinct(whole)
            first, turn = order[group], np.empty(len(group), np.int64)  # the sort is stable: where each distinct window comes first
            come = np.argsort(first)
            turn[come] = np.arange(len(first))
            first, number = first[come], turn[number]
            part, place, low = place_of(texts, p, number, first)
            kinds.append((part[place], [*(c[first[place]] for c in columns), low[place].astype(_U)]))
            turn = np.diff(number, prepend=0)
            order_of.append(np.where(turn < 0, -2 * turn - 1, 2 * turn).astype(_U))
        counts = [np.bincount(k[0], minlength=1 << bits) for k in kinds]
        yield exchange.note(rows), freeze(lost, step, *order_of)
        edges = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        for part in np.flatnonzero(sum(counts)).tolist():
            yield part, freeze(*(c[e[part] : e[part + 1]] for e, (_, columns) in zip(edges, kinds) for c in columns))

    def kept(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        texts = Texts(rows)
        bits_lost, step, *rest = thaw(told[exchange.note(rows)])
        at = np.cumsum(step.astype(np.int64))
        replies = [thaw(told[p]) for p in sorted(p for p in told if p >= 0)]
        started = np.unpackbits(bits_lost.astype(np.uint8), count=len(texts.raw)).astype(bool)  # windows of lost pieces
        for kind in range(3):
            p = at[at % 3 == kind]
            turn = rest[kind].astype(np.int64)
            number = np.cumsum(np.where(turn & 1, -(turn + 1) // 2, turn // 2))
            first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1) > 0)
            _, place, low = place_of(texts, p, number, first)
            smaller = np.zeros(len(first), bool)
            smaller[place] = np.concatenate([np.zeros(0, _U), *(r[kind] for r in replies)]).astype(bool)
            started[p[smaller[number] | (texts.doc(p) > low[number])]] = True
        lost = sliding(np.logical_or, np.concatenate((np.zeros(length - 1, bool), started)), length)
        edges = texts.offset  # windows end before the separators, which are not lost
        starts = np.flatnonzero(lost & ~np.concatenate(([False], lost[:-1])))
        spans = np.diff(np.searchsorted(starts, edges))
        removed = np.add.reduceat(lost, edges[:-1], dtype=np.int64)
        left = ~lost
        left[edges[1:] - 1], left[edges[-1] :] = False, False
        ends = np.concatenate(([0], np.cumsum(texts.size - removed))).astype(np.int32)
        return pa.table({
            "doc_id": pa.array(id_or_null(texts.ids), pa.int64()), "n_bytes": pa.array(texts.size, pa.int64()), "n_removed": pa.array(removed),
            "n_spans": pa.array(spans, pa.int64()), "kept": pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(texts.raw[left])]),
        })

    def unpacked(reply):
        return lambda blobs: reply([zstandard.decompress(b) for b in blobs])

    seen = exchange.answer(exchange.ask(chunked, ask_short), unpacked(find_anchors))
    first = exchange.answer(exchange.ask_again(chunked, seen, ask_pieces), unpacked(find_smaller))
    anchors = exchange.answer(exchange.ask_again(chunked, first, ask_anchors), unpacked(find_anchors))
    triples = exchange.answer(exchange.ask_again(chunked, anchors, ask_triples), _name_triples)
    pairs = exchange.answer(exchange.ask_again(chunked, triples, ask_pairs), _name)
    merged = exchange.answer(exchange.ask_again(chunked, pairs, ask_windows), _merge)
    return exchange.read_answers(chunked, merged, kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


OP6_SQL = r"""
WITH docs AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs)
), starts AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id
), runs AS (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM starts)
), spans AS (
    SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p
    FROM (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run)
), removed AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS front, max(b) AS last
    FROM spans JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id)
"""

"""BPE encoding and decoding over a table of distinct words.

A byte-pair model that never merges across white space gives a word the same ids
wherever it stands. Chunks of documents send their distinct words, parts of the word
table encode each word once, and the ids join back by the words' positions. Decoding
joins each id to its piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import doc_ids, id_or_null, table

CHUNK_BYTES = 20 << 20
_LOADED: dict[int, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON; its size is that of the vocabulary, so it can go along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(definition: str):
    """The tokenizer, loaded once in each Python worker, with truncation and padding off."""
    key = zlib.crc32(definition.encode())
    if key not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[key] = tokenizer
    return _LOADED[key]


def words_of(body: bytes) -> list[bytes]:
    """Words between ASCII white space; case is folded (A-Z) unless a special token may stand in the text.

    Words with combining marks (U+0300 to U+037F, bytes CC and CD) stay as they are: the tokenizer
    composes first and folds afterwards, and some letters compose in one case only.
    """
    if b"<|" in body:
        return body.split()
    if b"\xcc" not in body and b"\xcd" not in body:
        return body.lower().split()
    return [w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in body.split()]


def _distinct(rows: pa.Table) -> dict[bytes, int]:
    seen: dict[bytes, int] = {}
    for body in rows.column("body"):
        seen.update(dict.fromkeys(words_of(body.as_py())))
    return seen


def _dealt(words, bits: int) -> dict[int, list[bytes]]:
    parts: dict[int, list[bytes]] = {}
    mask = (1 << bits) - 1
    for word in words:
        parts.setdefault(zlib.crc32(word) & mask, []).append(word)
    return parts


def _encode_parts(definition: str):
    """Each distinct word of the part is encoded once; an answer has the number of ids of each word, then the ids."""

    def reply(blobs: list[bytes]) -> list[bytes]:
        sent = [b.split(b"\n") for b in blobs]
        index = {w: i for i, w in enumerate(dict.fromkeys(w for words in sent for w in words))}
        words = list(index)
        tokenizer, ids = load(definition), []
        for at in range(0, len(words), 4096):
            texts = [w.decode("utf-8", "replace") for w in words[at : at + 4096]]
            ids += [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)),
            pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))),
        )
        out = []
        for words in sent:
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            got = lists.take(pa.array(at))
            values = got.flatten().to_numpy().astype("<u4")
            out.append(np.uint32(len(at)).tobytes() + count[at].astype("<u4").tobytes() + values.tobytes())
        return out

    return reply


def pieces(definition: str) -> pa.Array:
    """The piece of each id, as the join's table: one row an id."""
    vocabulary = load(definition).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        out[at] = piece
    return pa.array(out, pa.string())


def decode_ids(ids: pa.ListArray, table_of_pieces: pa.Array) -> pa.Array:
    """Texts of id lists: ids join to their pieces, which a space sets apart (the tokenizer has no decoder)."""
    joined = pa.ListArray.from_arrays(ids.offsets, table_of_pieces.take(ids.values))
    return pc.binary_join(joined, " ")


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row a document; without ``decoded`` that column is left out.

    ids are those of the tokenizer without added special tokens; special tokens that
    stand in a text become their ids. Null and empty texts have no ids and decode to an
    empty text. Repeated rows give repeated rows; other columns, whatever their names, are
    left behind; an empty table gives no rows.
    """
    definition = read_tokenizer(tokenizer or default_tokenizer())
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(definition)
    chunks = exchange.chunk_count(docs, CHUNK_BYTES)
    bits = exchange.part_bits(chunks)
    chunked = exchange.in_chunks(docs, chunks)

    def ask_words(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        for part, words in sorted(_dealt(_distinct(rows), bits).items()):
            yield part, b"\n".join(words)

    def assemble(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        index: dict[bytes, int] = {}
        counts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for part, words in sorted(_dealt(_distinct(rows), bits).items()):
            blob = np.frombuffer(told[part], "<u4")
            n = int(blob[0])
            for word in words:
                index[word] = len(index)
            counts.append(blob[1 : n + 1].astype(np.int64))
            values.append(blob[n + 1 :].astype(np.int32))
        count = np.concatenate(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(np.concatenate(values)))
        known = pieces(sent.value) if decoded else None
        ids, tokens, texts = [], [], []
        for _, bodies in exchange.slices(rows):
            split = [words_of(b) for b in bodies]
            n = np.fromiter(map(len, split), np.int64, len(split))
            at = np.fromiter((i for words in split for i in map(index.__getitem__, words)), np.int64, int(n.sum()))
            total = np.concatenate(([0], np.cumsum(count[at])))
            ends = total[np.concatenate(([0], np.cumsum(n)))]
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lists.take(pa.array(at)).flatten())
            ids.append(made)
            tokens.append(np.diff(ends))
            if decoded:
                texts.append(decode_ids(made, known))
        columns = {
            "doc_id": pa.array(id_or_null(doc_ids(rows)), pa.int64()), "n_tokens": pa.array(np.concatenate(tokens), pa.int64()),
            "ids": pa.chunked_array(ids, pa.list_(pa.int32())),
        }
        if decoded:
            columns["decoded"] = pa.chunked_array(texts, pa.string())
        return pa.table(columns)

    answers = exchange.answer(exchange.ask(chunked, ask_words), lambda blobs: _encode_parts(sent.value)(blobs))
    return exchange.read_answers(chunked, answers, assemble, "doc_id bigint, n_tokens bigint, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids): each id joins its piece; null ids decode to an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(sent.value)
        for batch in rows:
            lists = pa.array([x or [] for x in batch.column("ids").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decode_ids(lists, known)], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_and_decode(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )

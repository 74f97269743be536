"""Language ID by nearest centroids.

A text is a vector: its letters in lower case, other characters as one space, byte pairs and
triples hashed into ``DIMENSIONS`` places, 1 + ln of their counts times the inverse document
frequency, normalised. Document frequencies are counted over all labelled texts. Each language has
several centroids, by spherical k-means over a bounded sample of its texts, one language a task.
A text belongs to the language of the centroid with the largest cosine; it is rejected if it is
further away than nearly all sampled texts of that language were from their own centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, table, text_key

DIMENSIONS = 4096
#: Centroids of a language, rounds of k-means, sampled texts of a language, and languages at most.
CENTROIDS, ROUNDS, SAMPLE, LANGUAGES = 4, 10, 1000, 200
#: The share of sampled texts that are as far from their centroids as a rejected text.
REJECTED = 0.001
#: Vectors that are made at once, and bytes of a text whose places are.
BLOCK, SLICE = 64, 1 << 20

#: What is predicted for texts without a letter.
UNKNOWN = "und"
_U = np.uint32


def place_counts(body: bytes) -> np.ndarray:
    """How often a cleaned text (lower case, one space for all but letters) holds the places of its byte pairs and triples."""
    raw = np.frombuffer(b" " + body.strip() + b" ", np.uint8)
    shift, out = _U(32 - (DIMENSIONS - 1).bit_length()), np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw) - 1, SLICE):
        part = raw[at : at + SLICE + 2].astype(_U)
        pair = (part[:-1] << _U(8)) | part[1:]
        triple = (pair[:-1] << _U(8)) | part[2:]
        pair = pair[:SLICE]  # the last of a whole slice begins the next
        out += np.bincount(((pair + _U(0x10000000)) * _U(0x9E3779B1)) >> shift, minlength=DIMENSIONS)
        out += np.bincount((triple * _U(0x85EBCA77)) >> shift, minlength=DIMENSIONS)
    return out


def cleaned(text: Column) -> Column:
    """Lower case, each run of other characters than letters and marks as one space; null: no text."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "), F.lit("")).cast("binary")


def vectors(bodies: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, a row a text."""
    tf = np.array([place_counts(b) for b in bodies], float)
    held = tf > 0
    tf[held] = 1 + np.log(tf[held])
    tf *= idf
    return tf / np.linalg.norm(tf, axis=1, keepdims=True)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def inverse_frequencies(labelled: DataFrame) -> np.ndarray:
    """ln((1 + n) / (1 + df)) + 1 of each place, over all rows (body)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in rows:
            for body in batch.column("body").to_pylist():
                df += place_counts(body) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.append(n, df))], names=["place", "n"])

    found = dict(labelled.select("body").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).collect())  # a row a place
    n = found.get(-1, 0)
    return np.log((1 + n) / (1 + np.array([found.get(k, 0) for k in range(DIMENSIONS)]))) + 1


def spherical_kmeans(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; begins with the means of rows at like distance from the mean of all, as single odd rows make poor centroids."""
    order = np.argsort(x @ x.mean(0), kind="stable")
    centres = np.array([x[part].mean(0) for part in np.array_split(order, min(k, len(x)))])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for _ in range(rounds):
        which = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, which, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)  # a cluster without rows stays where it is
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


@dataclass
class Model:
    """idf of each place; centroids, with the number of each one's language; the least cosine of each language."""

    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid's language, the first of equal ones, and the cosine, to 9 decimals."""
        near = np.round(vectors(bodies, self.idf) @ self.centres.T, 9)
        best = near.argmax(1)
        return self.owner[best], np.clip(near[np.arange(len(best)), best], 0, 1)


def sampled(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` rows (lang, body) of each language, those of the smallest hashes of doc_id and text.

    Equal rows count once, so copies of one row cannot crowd out the others.
    """
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    luck = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 1) / float(1 << 63)
    # about twice as many as are wanted, so that few texts meet; then exactly the first
    some = labelled.join(F.broadcast(sizes), "lang").withColumn("luck", luck).where(F.col("luck") * F.col("n") < 2 * most + 100)
    order = F.row_number().over(W.partitionBy("lang").orderBy("luck", "doc_id", "key"))
    return some.dropDuplicates(["lang", "doc_id", "key"]).withColumn("at", order).where(F.col("at") <= most).select("lang", "at", "body")


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, rejected: float = REJECTED) -> Model:
    """A model from the rows (doc_id, text, lang) that have a lang and a letter.

    Frequencies are of all of them; centroids of at most ``sample`` texts of each language. More than ``LANGUAGES``
    languages raise an error, as the centroids of all are broadcast. Without rows there are no languages.
    """
    labelled = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), cleaned(F.col("text")).alias("body")
    )
    known = labelled.select("lang").distinct().limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    idf = inverse_frequencies(labelled)

    def centres_of(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        bodies = rows.column("body").to_pylist()
        x = np.concatenate([vectors(bodies[a : a + BLOCK], idf) for a in range(0, len(bodies), BLOCK)])
        centres = spherical_kmeans(x, centroids)
        least = float(np.quantile((x @ centres.T).max(1), rejected))
        return pa.table({"lang": rows.column("lang")[:1], "centres": pa.array([centres.tobytes()], pa.binary()), "least": pa.array([least])})

    made = sampled(labelled, sample).groupBy("lang").applyInArrow(centres_of, "lang string, centres binary, least double").collect()  # a row a language
    made.sort(key=lambda r: r.lang)
    each = [np.frombuffer(bytes(r.centres)).reshape(-1, DIMENSIONS) for r in made]
    return Model(
        [r.lang for r in made], idf, np.concatenate([np.zeros((0, DIMENSIONS)), *each]),
        np.repeat(np.arange(len(made)), [len(x) for x in each]), np.array([r.least for r in made]),
    )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row a document.

    score is the cosine with the nearest centroid, from 0 to 1. A null text, a text without a letter, and any text
    if no language is known is ``und`` with score 0, and rejected. Of equally near centroids that of the first language
    in the order of their names decides. Whole texts count; repeated rows give repeated rows; other columns
    are left behind; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches(rows):
            bodies = batch.column("body").to_pylist()
            letters = [x and bool(model.languages) for x in batch.column("letters").to_pylist()]
            told = [(UNKNOWN, 0.0, True)] * len(bodies)
            at = [i for i, x in enumerate(letters) if x]
            for a in range(0, len(at), BLOCK):
                own = at[a : a + BLOCK]
                which, near = model.predict([bodies[i] for i in own])
                for i, w, c in zip(own, which.tolist(), near.tolist(), strict=True):
                    told[i] = (model.languages[w], c, bool(c < model.least[w]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([t[0] for t in told]), pa.array([t[1] for t in told]), pa.array([t[2] for t in told]),
            ], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), cleaned(F.col("text")).alias("body"), has_letter(F.col("text")).alias("letters")
    ).mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a missing doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

"""Quality classifier: a Gaussian kernel over document statistics through random Fourier features.

Statistics of a text go through ``D`` random cosines whose inner products approximate a
Gaussian kernel. Partitions sum the normal equations, so the driver solves one D x D
system however many rows are labelled; isotonic regression over binned training scores
turns ridge scores into probabilities. Labels, language, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import pinned
from .common import batches, mapped, table

FEATURES = 256
RIDGE = 1e-2
BINS = 2000
THRESHOLD = 0.7
SEED = 20240229
STATISTICS = (
    "log_words", "log_lines", "word_length", "word_length_spread", "upper", "digits", "symbols", "bars", "exclaim",
    "stops", "commas", "odd_marks", "non_ascii", "distinct", "same_as_last", "top_word", "repeated_lines", "closed_lines",
    "letters",
)
_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b".?", b",;:", b"@=_/\\{}[]~^+", bytes(range(128, 256)), b"abcdefghijklmnopqrstuvwxyz"), 1):
    _CLASS[list(_members)] = _k


def statistics(body: bytes) -> list[float]:
    """Numbers that describe a text by its whole bytes, words and lines; all 0 for an empty one."""
    words = body.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    of = np.bincount(_CLASS[np.frombuffer(body, np.uint8)], minlength=11)
    size = np.fromiter(map(len, words), np.int64, n)
    chars = int(size.sum())
    lines = [x for x in body.split(b"\n") if x.strip()]
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    closed = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), chars / n, float(size.std()), of[1] / chars, of[2] / chars, of[3] / chars,
        of[4] / n, of[5] / n, of[6] / n, of[7] / n, of[8] / chars, of[9] / chars, len(counts) / n, same / n,
        counts.most_common(1)[0][1] / n, 1 - len(set(lines)) / len(lines), closed / len(lines), of[10] / chars,
    ]


def _statistics_column(bodies: list[bytes]) -> np.ndarray:
    return np.array([statistics(b) for b in bodies], np.float64).reshape(-1, len(STATISTICS))


def _as_lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each text as an array; null counts as empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            x = _statistics_column(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _as_lists(x)], names=["doc_id", "x"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body")
    ).mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Model:
    """Everything that scoring needs; its size is set by the number of features and bins alone."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack((np.ones((len(x), 1)), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.weights + self.phases)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def held_out(doc_id: str = "doc_id"):
    """True where no label may be learned: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit: neighbours that break the order are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _normal_equations(model: Model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            if batch.num_rows:
                c = model.cosines(np.array(batch.column("x").to_pylist()))
                part = c.T @ np.hstack((c, np.array(batch.column("y").to_pylist(), np.float64)[:, None]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    return run


def _add_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in rows:
        for blob in batch.column("sums").to_pylist():
            part = np.frombuffer(blob)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES) -> Model:
    """Fit on every labelled row that is not held out.

    Rows with a null id, null label or without statistics are left out. Without any
    training row each score is 0.5; with one class only, it is that class.
    """
    marks = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    train = pinned(stats.join(marks, "doc_id").select("x", "y"), "quality-train")
    k = len(STATISTICS)
    first = train.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)]).first()
    rng = np.random.default_rng(SEED)
    mean = np.array([v or 0.0 for v in first[1 : 1 + k]])
    spread = np.array([v if v and v > 1e-9 else 1.0 for v in first[1 + k :]])
    model = Model(
        mean, spread, rng.normal(0, 1 / np.sqrt(k), (k, features)), rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.array([0.0]), np.array([0.5]),
    )
    if not first[0]:
        return model
    sums = train.mapInArrow(_normal_equations(model), "sums binary").repartition(8).mapInArrow(_add_up, "sums binary").collect()
    whole = sum(np.frombuffer(r.sums) for r in sums).reshape(features + 1, features + 2)
    model.beta = np.linalg.solve(whole[:, :-1] + RIDGE * np.eye(features + 1), whole[:, -1])

    def binned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column("x").to_pylist()))
                at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    bins = train.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    model.knots = (np.array([r.bin for r in bins]) + 0.5) * 2 / BINS - 0.5
    model.levels = isotonic(np.array([r.y for r in bins]), np.array([r.n for r in bins], np.float64))
    return model


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row a document, from 0 to 1; empty texts have a score as well, repeated rows repeated scores."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                s = model.score(np.array(batch.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, all columns unchanged, whatever their names.

    A score on the threshold stays. Null texts are scored as empty ones; repeated rows stay or go together; an empty
    table gives no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            bodies = [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]
            if bodies:
                yield batch.filter(pa.array(model.score(_statistics_column(bodies)) >= threshold))

    return mapped(docs, run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pinned(document_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, table(spark, sf_dir, "labels"))
    return score_statistics(stats, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

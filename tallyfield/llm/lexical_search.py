"""Ranked lexical search in reverse: the items are indexed, the documents are streamed through.

The inverted index over the items' terms is broadcast. One pass cuts each document into terms
once and writes its length and the counts of the terms that some item has; N, L and df are sums
over what is written. A second pass streams these counts through the index, now with weights:
each term of a document adds to the scores of the items that hold it, and each task keeps a
bounded heap an item. Heaps are merged in two steps, first salted, then by item.

An index holds at most about ``POSTINGS`` (item, term) pairs of ``ITEMS`` items; more make several indexes,
each built, sent and searched alone, so what is broadcast and held in heaps has a bound however many items there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import pinned
from .common import batches, table, text_key

TOP = 20
#: (item, term) pairs in an index, and items.
POSTINGS, ITEMS = 250_000, 10_000
#: Scores that are held at once (documents times items), and additions to them.
CELLS = 1 << 20
#: Heaps that are merged at once in the first step.
MERGED = 64

_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_COUNTED = "doc_id bigint, key bigint, n bigint, terms array<int>, tfs array<bigint>"
_SCORED = "item int, doc_id bigint, key bigint, score bigint"


def terms_of(body: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    return body.translate(_CLEAN).split()


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term, times): how often each item holds each term.

    Rows of one item_id are one item; equal rows count once. A null item_id is an item, too.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [(i, t, n) for i, body in enumerate(batch.column("body").to_pylist()) for t, n in Counter(terms_of(body)).items()]
            at = pa.array([i for i, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(at), pa.array([t for _, t, _ in out], pa.binary()), pa.array([n for _, _, n in out], pa.int64())],
                names=["item_id", "term", "times"],
            )

    kind = dict(benchmark.dtypes)["item_id"]
    each = benchmark.select("item_id", F.col("text").cast("binary").alias("body")).where("body IS NOT NULL").distinct()
    return each.mapInArrow(run, f"item_id {kind}, term binary, times bigint").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Index:
    """An inverted index: term k, of ``terms[k]``, stands in items ``item[first[k] : first[k + 1]]``, so many ``times``."""

    def __init__(self, pairs: list[tuple[int, bytes, int]]):
        number: dict[bytes, int] = {}
        for _, term, _ in pairs:
            number.setdefault(term, len(number))
        self.number = number
        which = np.array([number[t] for _, t, _ in pairs], np.int64)
        order = np.argsort(which, kind="stable")
        self.item = np.array([i for i, _, _ in pairs], np.int64)[order]
        self.times = np.array([n for _, _, n in pairs], np.int64)[order]
        self.first = np.searchsorted(which[order], np.arange(len(number) + 1))
        self.n_items = int(self.item.max()) + 1 if len(pairs) else 0
        #: Set once N and df are known.
        self.weight = np.zeros(len(number), np.int64)
        self.n_docs = self.n_terms = 0

    def count(self, body: bytes) -> tuple[int, list[int], list[int]]:
        """The document's terms with repeats, and the numbers and counts of those that are indexed."""
        words = terms_of(body)
        counts = Counter(words)
        known = sorted((self.number[t], counts[t]) for t in counts.keys() & self.number.keys())
        return len(words), [k for k, _ in known], [c for _, c in known]

    def scores(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Score of each (document, item) of a block; (doc, term, tf) are its counts, n the documents' lengths."""
        m = 100 - 25 + (25 * n * self.n_docs) // max(self.n_terms, 1)
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        many = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.zeros(len(n) * self.n_items, np.int64)
        np.add.at(out, np.repeat(doc, many) * self.n_items + self.item[at], np.repeat(part, many) * self.times[at])
        return out.reshape(len(n), self.n_items)


class Heaps:
    """For each item its best ``top`` rows (score, doc_id, key), highest score first, ties by the smaller id."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)  # scores under this cannot enter
        self.rows: list[list[tuple]] = [[] for _ in range(n_items)]

    def add(self, scores: np.ndarray, ids: list, keys: list) -> None:
        docs, items = np.nonzero(scores >= self.least)
        touched = set()
        for d, i, s in zip(docs.tolist(), items.tolist(), scores[docs, items].tolist(), strict=True):
            self.rows[i].append((-s, ids[d] is None, ids[d] or 0, keys[d]))
            touched.add(i)
        for i in touched:
            if len(self.rows[i]) > self.top:
                self.rows[i] = sorted(self.rows[i])[: self.top]
            if len(self.rows[i]) == self.top:
                self.least[i] = -max(self.rows[i])[0]

    def batch(self) -> pa.RecordBatch:
        rows = [(i, None if none else d, key, -s) for i, held in enumerate(self.rows) for s, none, d, key in held]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["item", "doc_id", "key", "score"])


def _count_with(docs: DataFrame, sent) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches(rows):
            made = [index.count(b) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array([m[0] for m in made], pa.int64()),
                pa.array([m[1] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made], pa.list_(pa.int64())),
            ], names=["doc_id", "key", "n", "terms", "tfs"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"),
    ).mapInArrow(run, _COUNTED)


def _search_with(counted: DataFrame, sent, top: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        heaps = Heaps(index.n_items, top)
        adds = np.diff(index.first)
        block = max(1, CELLS // max(index.n_items, 1))
        for batch in rows:
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            n, ids, keys = batch.column("n").to_numpy(), batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            edge = np.concatenate(([0], np.cumsum(batch.column("terms").value_lengths().to_numpy())))
            work = np.concatenate(([0], np.cumsum(adds[term])))[edge]
            a = 0
            while a < batch.num_rows:  # at least a document, whose additions are no more than the index has pairs
                b = max(a + 1, min(a + block, int(np.searchsorted(work, work[a] + CELLS, "right")) - 1))
                own = slice(edge[a], edge[b])
                heaps.add(index.scores(np.repeat(np.arange(b - a), np.diff(edge[a : b + 1])), term[own], tf[own], n[a:b]), ids[a:b], keys[a:b])
                a = b
        yield heaps.batch()

    return counted.mapInArrow(run, _SCORED)


def merged(heaps: DataFrame, top: int) -> DataFrame:
    """(item, rank, doc_id, score): the heaps of all tasks, merged by item and salt, then by item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")]
    salted = heaps.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, most_postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents by score, of those above 0.

    Null and empty texts have no terms: such documents are not counted in N, such items have no rows.
    Equal scores are ranked by ascending doc_id, a null doc_id last; every row is a document of its own, so
    repeated rows take ranks of their own. Of an empty table nothing is found. Other columns are left behind.
    ``top`` is the feature; it limits nothing else.
    """
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    pairs = pinned(item_terms(benchmark), "item-terms")
    items, size = pairs.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = 1 + max(size // most_postings, items // ITEMS)
    shard = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n_shards))
    found = []
    for k in range(n_shards):
        rows = pairs.where(shard == k).orderBy("item_id", "term").toLocalIterator()
        names: list = []
        listed: list[tuple[int, bytes, int]] = []
        for r in rows:
            if not names or names[-1] != r.item_id:
                names.append(r.item_id)
            listed.append((len(names) - 1, bytes(r.term), r.times))
        if not listed:
            continue
        index = Index(listed)
        sent = spark.sparkContext.broadcast(index)
        counted = pinned(_count_with(docs, sent), "term-counts")
        index.n_docs, index.n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # as many rows as the index has terms
        df = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator()}
        held = np.array([df.get(t, 0) for t in range(len(index.number))])
        index.weight = np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * held + 1))).astype(np.int64)
        weighted = spark.sparkContext.broadcast(index)
        best = merged(_search_with(counted.select("doc_id", "key", "n", "terms", "tfs"), weighted, top), top)
        of_item = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind}")
        found.append(pinned(best.join(of_item, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        sent.destroy()
        weighted.destroy()
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
WITH items AS (
    SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term
), docs AS (
    SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0
), stats AS (
    SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs
), counts AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY doc_id, n, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), stats
), parts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // l)))) AS part FROM counts JOIN weights USING (term), stats
), scores AS (
    SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM items JOIN parts USING (term) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""

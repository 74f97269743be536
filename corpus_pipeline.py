"""Corpus pipeline: from documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import bpe, decontaminate, line_dedup, quality_classifier, simhash
from tallyfield.llm.common import table
from tallyfield.sources.scratch import pinned


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not reject.

    Null and empty texts are scored as empty ones, repeated rows alike; without labels all scores
    are 0.5, under the threshold, and no document stays.
    """
    labels = table(spark, sf_dir, "labels")
    marked = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")  # statistics of these only
    model = quality_classifier.fit(quality_classifier.document_statistics(marked), labels)
    return quality_classifier.keep_good(docs, model)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of smaller id has; those left without text go, null and empty texts stay."""
    out = line_dedup.dedup_lines(docs)
    n_lines, n_dropped = out.columns[-2:]
    left = out.where((F.col(n_dropped) == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return with_size(left.drop(n_lines, n_dropped))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that SimHash near-dedup links: four-word shingles, four bits.

    Texts without words are one group; of repeated rows one stays.
    """
    return simhash.keep_one(docs, simhash.RADIUS, simhash.WORDS)


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those of which more than half the words are such passages go.

    Null and empty texts stay as they are.
    """
    return with_size(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token ids and the text decoded from them; null and empty texts have none."""
    return bpe.encode_and_decode(docs).select("doc_id", "n_tokens", "ids", "decoded")


def with_size(docs: DataFrame) -> DataFrame:
    """n_chars as the changed text has it."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(kind))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", new_lines),
    ("SimHash near-dedup", unlike_documents),
    ("benchmark decontamination", unseen_tests),
    ("BPE encoding and decoding", token_ids),
]

#: A fitted model and connected components decide, which SQL does not express; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = pinned(docs, "stage-" + name.replace(" ", "-"))
    return docs

"""The corpus pipeline, stage by stage, and the registered queries' SQL."""

import os
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfield.llm import bpe, decontaminate, line_dedup, queries, sharding, simhash
from tests.compare import differences, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert differences(spark_rows(queries.QUERIES[name](spark, SF)), duck_rows(con, queries.SQL[name])) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    assert all(d.columns == docs.columns for d in seen[1:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert all(labels[d] == 0 for d in ids[0] - ids[1] if d in labels) and not any(labels.get(d) == 0 for d in ids[1])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.scan(seen[3], bench).where("size(items) > 0").count() > 0
    assert decontaminate.scan(seen[4], bench).where("size(items) > 0").count() == 0
    tokenizer = bpe.load(bpe.read_tokenizer(bpe.default_tokenizer()))
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    assert all(r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids for r in seen[5].collect())
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()} == {(r.doc_id, r.n_tokens) for r in seen[5].collect()}


def test_near_copies_stage_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for changed in [0, 1, 2, 9] * 8:
        first = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(200, 400))]
        copy = list(first)
        for at in rng.sample(range(len(copy)), changed):
            copy[at] = f"new{rng.randrange(10**9)}"
        texts += [first, copy]
    texts += [[], ["one"], ["one"], ["two"], []]
    prints = [simhash.fingerprint(" ".join(t).encode()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert len(set(group)) < len(texts) - 9
    rows = [(i, " ".join(t), "k") for i, t in enumerate(texts)] + [(2, " ".join(texts[2]), "k"), (None, "no id", "k"), (None, "nor this", "k")]
    got = corpus_pipeline.unlike_documents(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[i] for i in set(group)] + rows[-2:], key=str)


ODD = "doc_id bigint, text string, lang string, n_chars bigint, `a.b``c` int, _n_dropped int, _llm_doc string, _LLM_KEY int, _shard int, _llm_keep int"
EXTRA = (1, 2, "x", 3, 4, 5)


def test_stages_on_nulls_repeated_rows_and_clashing_names(spark):
    plain = "A plain sentence of some words that nobody would reject."
    rows = [(1, plain, "en", 9, *EXTRA), (1, plain, "en", 9, *EXTRA), (2, None, None, None, *EXTRA), (3, "", "en", 0, *EXTRA), (None, "no id here", "en", 1, *EXTRA)]
    docs = spark.createDataFrame(rows, ODD)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {r[4:] for r in got.collect()} == {EXTRA}
    assert sorted((r[0], r[1]) for r in corpus_pipeline.new_lines(spark, docs, SF).collect() if r[0]) == [(1, plain)] * 2 + [(2, None), (3, "")]
    assert corpus_pipeline.good_documents(spark, docs, SF).columns == docs.columns
    assert {(r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.token_ids(spark, docs, SF).collect()} == {(1, True), (2, False), (3, False), (None, True)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_operators_leave_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", i, *EXTRA) for i in range(9)], ODD)
    out = sharding.shuffle_into_shards(docs, shards=2, bucket_bytes=20)
    assert out.columns == [*docs.columns, "_shard_", "_slot"] and {r["_shard"] for r in out.collect()} == {4}
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "_n_lines", "_n_dropped_"]
    kept = simhash.keep_one(docs.withColumn("text", F.lit("one and the same")))
    assert [tuple(r)[4:] for r in kept.collect()] == [EXTRA]
    bench = spark.createDataFrame([(k, f"text {k}") for k in range(3)], "item_id int, text string")
    automata = decontaminate.automata
    for most in (1, 1_000_000):
        decontaminate.automata = lambda b, w=10, most=most: automata(b, w, most)
        try:
            assert decontaminate.decontaminate(docs, bench).columns == docs.columns
        finally:
            decontaminate.automata = automata

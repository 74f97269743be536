"""The conversation trie, lexical search and language identification against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyfield.llm import language_id, lexical_search, prefix_trie

TALK = "conv_id bigint, turn bigint, role string, text string, node binary, path string, step int"


def brute_trie(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of each node, by definition."""
    said = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
    talks = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, said(role or "", text or ""), role or "", text or ""))
    original = {c: [x[3:] for x in sorted(t)] for c, t in talks.items()}
    rebuilt = {}
    for c, own in original.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        rebuilt[c] = original.get(base, [])[:h] + own[h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        return [node, *(x for c in children.get(node, []) for x in below(c))]

    out = []
    for node, convs in members.items():
        tree = below(node)
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
            sum(x not in children for x in tree), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def talks(rng):
    rows = []
    for c in [*range(-12, 60), 10**12]:
        for turn in range(rng.choice([1, 2, 3, 9, 30] if c == 7 else [1, 2, 3, 9])):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["hi", "hé", ""]), b"x", "p", 1))
    copied = [(turn, "user", f"copy {turn}") for turn in range(12)]
    rows += [(c, *t, None, None, None) for c in range(100, 190, 5) for t in copied]  # families whose first conversation is long
    rows += [(c + 1, *t, None, None, None) for c in range(100, 190, 5) for t in copied]
    rows += [(200, None, "user", "no turn", b"", "", 0), (200, None, None, None, b"", "", 0), (200, 0, "user", "x" * 5000, b"", "", 0)]
    return rows + rows[:5] + [(None, 1, "user", "no id", b"", "", 0)]


@pytest.mark.parametrize(("shard", "pack", "skeleton"), [(10**6, 1 << 16, 4 << 20), (20, 1 << 16, 4 << 20), (5, 1, 4 << 20), (20, 10, 1000)])
def test_trie_against_brute_force(spark, monkeypatch, shard, pack, skeleton):
    for name, value in (("SHARD_TURNS", shard), ("PACK", pack), ("SKELETON_BYTES", skeleton)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talks(random.Random(4))
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_trie(rows), key=str)
    assert got.dtypes == [(x.split()[0], x.split()[1]) for x in prefix_trie.NODE.split(", ")]


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TALK)
    assert prefix_trie.prefix_trie(none).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], TALK)).count() == 0


def test_trie_of_one_path_and_of_turnless_conversations(spark):
    rows = [(c, 0, "user", "same", None, None, None) for c in range(0, 400, 5)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_trie(rows), key=str)
    lost = next(c for c in range(1, 99) if c % 5 and prefix_trie.history(c) > 1)  # it has one turn only, and its base none
    assert [tuple(r)[:6] for r in prefix_trie.prefix_trie(spark.createDataFrame([(lost, 0, "user", "x", None, None, None)], TALK)).collect()] == [(lost, 0, None, 1, 0, 1)]


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    texts = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    query = {}
    for item, t in set(items):
        query.setdefault(item, []).extend(terms(t))
    df = {}
    for _, t in texts:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, wanted in query.items():
        found = []
        for d, t in texts:
            m = 75 + (25 * len(t) * n_docs) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t.count(w)) // (1000 * t.count(w) + 12 * m))
                for w in wanted if w in t
            )
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


@pytest.mark.parametrize(("postings", "items_most", "cells"), [(250_000, 10_000, 1 << 20), (5, 10_000, 50), (250_000, 1, 1)])
def test_search_against_brute_force(spark, monkeypatch, postings, items_most, cells):
    monkeypatch.setattr(lexical_search, "ITEMS", items_most)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rng = random.Random(6)
    words = ["the", "The", "of", "Über", "ÜBER", "naïve", "x1", "日本", "don't", "a_b", "42", "rare", "end."]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, say(rng.randrange(1, 40))) for i in range(60)] + [(100 + i, "the same text") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "- _ !"), (None, "no id the rare"), (None, "no id the rare"), (3, docs[3][1]), (204, "of " * 30_000)]
    items = [(1, say(12)), (2, "the the the same"), (3, None), (4, "unseenterm"), (5, ""), (None, "rare"), (2, "the the the same"), (2, "of"), (6, "日本 naïve")]
    left = spark.createDataFrame([(*d, "k", 1, 2) for d in docs], "doc_id bigint, text string, key string, n int, score int").repartition(4)
    got = lexical_search.search(left, spark.createDataFrame(items, "item_id bigint, text string"), most_postings=postings)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_search(docs, items), key=str)


def test_search_of_nothing(spark):
    docs, items = "doc_id bigint, text string", "item_id int, text string"
    some, one = spark.createDataFrame([(1, "a b")], docs), spark.createDataFrame([(1, "a b")], items)
    for d, i in ((some.limit(0), one), (some, one.limit(0)), (some, spark.createDataFrame([(1, None)], items)), (spark.createDataFrame([(1, None)], docs), one)):
        got = lexical_search.search(d, i)
        assert got.count() == 0 and got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_more_heaps_than_one_merge_takes_at_once(spark):
    rows = [(i, "word" + " x" * (i % 7)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(150)
    got = lexical_search.search(docs, spark.createDataFrame([(1, "x")], "item_id int, text string"), top=25)
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(rows, [(1, "x")], 25))


LANGS = {"en": ["the", "and", "thing", "which", "other"], "de": ["der", "und", "nicht", "schön", "über"], "el": ["και", "το", "είναι", "που"]}


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


def labelled(rng, n=150):
    return [(i, prose(rng, lang, rng.randrange(3, 40)), lang) for i, lang in zip(range(n), sorted(LANGS) * n)]


ROWS = "doc_id bigint, text string, lang string, source string, body string, score string"


def test_language_of_unseen_texts(spark):
    rng = random.Random(9)
    train = [(*r, "s", "b", "x") for r in labelled(rng)] + [(500, None, "en", "s", "b", "x"), (501, "the", None, "s", "b", "x"), (502, "12 34", "en", "s", "b", "x"), (0, *labelled(random.Random(9))[0][1:], "s", "b", "x")]
    model = language_id.fit(spark.createDataFrame(train, ROWS))
    assert model.languages == ["de", "el", "en"]
    unseen = [(i, prose(rng, lang, 20), lang) for i, lang in enumerate(sorted(LANGS) * 5)]
    odd = [(90, None, "en"), (91, "", "en"), (92, " 12 -- 34\n", "en"), (None, "THE AND THING", "en"), (93, "the " * 400_000, "en"), (94, "z", None), (0, unseen[0][1], None)]
    got = language_id.identify(spark.createDataFrame([(*r, None, None, None) for r in unseen + odd], ROWS), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got if r.doc_id is not None and r.doc_id < 90) == sorted([(i, lang) for i, _, lang in unseen] + [(0, unseen[0][2])])
    told = {r.doc_id: r for r in got}
    assert all(told[d].lang_pred == "und" and told[d].score == 0 and told[d].rejected for d in (90, 91, 92))
    assert told[None].lang_pred == told[93].lang_pred == "en" and told[94].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(unseen) + len(odd)


def brute_vector(text, idf):
    body = re.sub(r"[\W\d_]+", " ", text.lower()).strip() if text else ""
    raw, tf = b" " + body.encode() + b" ", {}
    for i in range(len(raw) - 1):
        spots = [((raw[i] << 8 | raw[i + 1]) + 0x10000000) * 0x9E3779B1 % 2**32 >> 20]
        if i + 2 < len(raw):
            spots.append((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x85EBCA77 % 2**32 >> 20)
        for k in spots:
            tf[k] = tf.get(k, 0) + 1
    out = np.zeros(4096)
    for k, n in tf.items():
        out[k] = (1 + math.log(n)) * idf[k]
    return out / np.linalg.norm(out), set(tf)


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_language_vectors_and_rule_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(language_id, "SLICE", piece)
    rows = labelled(random.Random(2), 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    df = np.zeros(4096)
    for _, t, _ in rows:
        for k in brute_vector(t, np.ones(4096))[1]:
            df[k] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    np.testing.assert_allclose(model.idf, idf)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for d, t, _ in rows:
        near = model.centres @ brute_vector(t, idf)[0]
        assert got[d].lang_pred == model.languages[model.owner[near.argmax()]] and got[d].score == pytest.approx(near.max())
    for number in range(len(model.languages)):  # each text is next to the centroid it helped to make
        x = np.array([brute_vector(t, idf)[0] for _, t, lang in rows if lang == model.languages[number]])
        own = model.centres[model.owner == number]
        which = (x @ own.T).argmax(1)
        for k in set(which.tolist()):
            mean = x[which == k].sum(0)
            np.testing.assert_allclose(own[k], mean / np.linalg.norm(mean), atol=1e-9)
        assert model.least[number] == pytest.approx(np.quantile((x @ own.T).max(1), language_id.REJECTED))


def test_language_sample_is_bounded_and_copies_count_once(spark):
    rows = [(1, "the and", "en")] * 50 + [(i, f"the {i}", "en") for i in range(100, 400)] + [(None, "und der", "de")] * 20
    docs = spark.createDataFrame(rows, "doc_id bigint, body string, lang string").selectExpr("*", "xxhash64(body) AS key")
    got = language_id.sampled(docs, 40).collect()
    assert sum(r.lang == "en" for r in got) == 40 and sum(r.lang == "de" for r in got) == 1
    assert language_id.sampled(docs, 40).count() == len(got)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "42", "en")], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs)
    assert [(r.lang_pred, r.score, r.rejected) for r in language_id.identify(docs, model).collect()] == [("und", 0.0, True)] * 2
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_a_text_unlike_all_is_rejected(spark):
    rows = labelled(random.Random(1))
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    odd = spark.createDataFrame([(1, "qxzj wvkq zzxq jjqx"), (2, rows[0][1])], "doc_id bigint, text string")
    got = {r.doc_id: r.rejected for r in language_id.identify(odd, model).collect()}
    assert got == {1: True, 2: False}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = language_id.op13_language_id(spark, sf).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    unseen = [r for r in got if r.held_out]
    assert {r.doc_id for r in unseen} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in unseen) >= 0.98 * len(unseen)

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is over words. Each document's words stream through it; the state
tells the longest piece of any item that ends at the word. Where that length
reaches a window, the window's words are hit, and the state names the items that
hold it. Most words need no automaton: a match of n words has n - 1 consecutive
word pairs that also follow each other in an item, so only runs of such pairs, long
enough for the shortest window, are streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import pinned
from .common import LAST, batches, column, mapped, table, text_key, unused

WINDOW = 10
#: Words of test items in one automaton, which takes about 0.6 kB a word in the driver and in each worker; more items go into
#: further automata. Words are taken to have six bytes, so texts of short ones make an automaton up to three times as large.
AUTOMATON_WORDS = 100_000

_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(body: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and all other non-ASCII characters."""
    return body.translate(_CLEAN).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word lists, with the windows' items at their states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for word in words:
                last = self._append(last, word)
        self.shortest = min((min(len(w), window) for w in coded if w), default=0)
        self._mark(coded)
        pairs = {a * len(self.vocabulary) + b for words in coded for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _append(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._new(self.length[last] + 1, {}, -1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            goal = self.next[at][word]
            self.link[state] = goal if self.length[goal] == self.length[at] + 1 else self._split(at, word, goal)
        return state

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int, goal: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.next[goal]), self.link[goal])
        self.link[goal] = copy
        while at >= 0 and self.next[at].get(word) == goal:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, coded: list[list[int]]) -> None:
        """items[state]: items with the window that ends there; short[state]: whole items shorter than a window."""
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, set[int]] = {}
        for item, words in enumerate(coded):
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at + 1 >= self.window:
                    self.items.setdefault(self._suffix(state, self.window), set()).add(item)
            if words and len(words) < self.window:
                self.short.setdefault(self._suffix(state, len(words)), set()).add(item)

    def _suffix(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what ``state`` has matched."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(end, window length, items) of each window among the words."""
        state = matched = 0
        following, link, length, window = self.next, self.link, self.length, self.window
        for at, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
            if matched >= window:
                yield at + 1, window, self.items[self._suffix(state, window)]
            if self.short:
                below = state
                while below > 0:
                    if below in self.short and length[below] <= matched:
                        yield at + 1, length[below], self.short[below]
                    below = link[below]

    def scan(self, bodies: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: its number of words, the runs of hit words, the items."""
        split = [words_of(b) for b in bodies]
        count = [len(w) for w in split]
        if not self.shortest:
            return [(n, [], set()) for n in count]
        ids = np.fromiter(
            (i for words in split for i in map(self.vocabulary.get, words, repeat(-1))), np.int64, sum(count)
        )
        edges = np.cumsum([0, *count])
        known = ids >= 0
        pair = np.zeros(len(ids), bool)  # word i and word i + 1 stand together in an item and in one text
        if len(ids) > 1:
            pair[:-1] = known[:-1] & known[1:]
            inner = edges[1:-1]
            pair[inner[inner > 0] - 1] = False
            maybe = np.flatnonzero(pair)
            codes = ids[maybe] * len(self.vocabulary) + ids[maybe + 1]
            at = np.searchsorted(self.pairs, codes)
            found = np.zeros(len(codes), bool)
            inside = at < len(self.pairs)
            found[inside] = self.pairs[at[inside]] == codes[inside]
            pair[maybe[~found]] = False
        # runs of words: a run's words are known, and each but the last has its pair
        start = known & ~np.concatenate(([False], pair[:-1]))
        end = known & ~pair
        first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
        long = last - first >= self.shortest
        out: list[tuple[int, list[tuple[int, int]], set[int]]] = [(n, [], set()) for n in count]
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            text = int(np.searchsorted(edges, a, "right")) - 1
            _, runs, items = out[text]
            for stop, width, which in self.stream(ids[a:b].tolist()):
                items |= which
                s, e = a + stop - width - int(edges[text]), a + stop - int(edges[text])
                while runs and runs[-1][1] >= s:  # runs stay apart; ends never go back
                    s = min(s, runs[-1][0])
                    runs.pop()
                runs.append((s, e))
        return out


class Automata:
    """Automata of one shard of items each; each is built when the iteration comes to it, and not kept."""

    def __init__(self, rows: DataFrame, n: int, window: int):
        self.rows, self.n, self.window = rows, n, window

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[SuffixAutomaton]:
        shard = F.pmod(F.xxhash64("item", "body"), F.lit(self.n))
        for k in range(self.n):
            items = self.rows.where(shard == k).sort("item", "body").toLocalIterator()
            yield SuffixAutomaton([(r.item, words_of(bytes(r.body))) for r in items], self.window)


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> Automata:
    """Automata of at most about ``most_words`` words each, over all items.

    The items' size is counted first and decides the number of automata, so what is
    built at once and broadcast is bounded however large the benchmark gets. Items
    without words have no window; null ids count as the text 'null'.
    """
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"),
    )
    size = rows.agg(F.sum(F.length("body").cast("bigint"))).first()[0] or 0
    return Automata(rows, 1 + size // (6 * most_words), window)


def _scan_with(docs: DataFrame, sent: Broadcast) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = sent.value
        for batch in batches(rows, 1 << 20):
            found = auto.scan(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[x for run in runs for x in run] for _, runs, _ in found], pa.list_(pa.int32())),
                pa.array([sorted({auto.names[i] for i in items}) for _, _, items in found], pa.list_(pa.string())),
            ], names=["doc_id", "key", "n_words", "runs", "items"])

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"),
    ).mapInArrow(run, "doc_id bigint, key bigint, n_words bigint, runs array<int>, items array<string>")


def merge_runs(runs: list[int]) -> list[int]:
    """Sorted, disjoint [start, end) runs of overlapping or touching ones, flat."""
    out: list[int] = []
    for s, e in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        runs = [merge_runs(x) for x in batch.column("runs").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("runs"), "runs", pa.array(runs, pa.list_(pa.int32())))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, runs, items): one row a document, hit words as flat [start, end) word runs.

    Null and empty texts have no words and no hits; repeated rows give repeated rows;
    an empty benchmark hits nothing.
    """
    return _scan(docs, automata(benchmark, window))


def _scan(docs: DataFrame, parts: Automata) -> DataFrame:
    """Findings of all automata on the texts as they are; of several, each one's are written before the next is built."""
    union = None
    for k, automaton in enumerate(parts):
        sent = docs.sparkSession.sparkContext.broadcast(automaton)
        del automaton
        found = _scan_with(docs, sent)
        if len(parts) == 1:
            return found
        found = found.where(F.size("runs") > 0) if k else found  # the first has all rows
        found = pinned(found.withColumn("part", F.lit(k)), "benchmark-hits")
        sent.destroy()
        union = found if union is None else union.unionByName(found)
    # equal rows give equal findings, so each (doc_id, key) is merged once and repeated rows are counted
    once = union.groupBy("doc_id", "key", "part", "n_words", "runs", "items").agg(F.count("*").alias("copies"))
    merged = once.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies"),
    )
    return merged.select(
        "doc_id", "key", "n_words", "runs", "items", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")
    ).drop("copy").mapInArrow(_merged, "doc_id bigint, key bigint, n_words bigint, runs array<int>, items array<string>")


def without_runs(body: bytes, runs: list[int]) -> bytes:
    """The text without its hit words; the separators between removed words go with them."""
    clean = np.frombuffer(body.translate(_CLEAN), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], clean.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        out.append(body[at : start[s]])
        at = int(end[e - 1])
    out.append(body[at:])
    return b"".join(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The documents without the spans that benchmark windows cover.

    A span is removed once it is ``window`` words long (or a whole shorter item); a
    document goes if more than ``max_coverage`` of its words are hit. Other columns
    stay as they are, whatever their names, and documents without hits are unchanged, null texts
    included; repeated rows give repeated rows; an empty table gives no rows.
    """
    names, parts, kinds = docs.columns, automata(benchmark, window), docs.schema
    of_doc, of_key, of_words, of_runs = unused(names, "_llm_doc", "_llm_key", "_llm_words", "_llm_runs")
    if len(parts) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(next(iter(parts)))

        def found_in(batch: pa.RecordBatch, bodies: list[bytes]) -> list[tuple[int, list[int]]]:
            return [(n, [x for r in runs for x in r]) for n, runs, _ in sent.value.scan(bodies)]

        return mapped(docs, _cut(found_in, names, max_coverage), kinds)
    # hits of all automata are found on the whole texts, so what is cut does not depend on how items are dealt
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias(of_doc)
    hits = _scan(docs, parts).where(F.size("runs") > 0).select(
        doc, F.col("key").alias(of_key), F.col("n_words").alias(of_words), F.col("runs").alias(of_runs)
    ).dropDuplicates([of_doc, of_key])
    joined = docs.withColumns({of_doc: doc, of_key: text_key(F.col("text"))}).join(hits, [of_doc, of_key], "left")

    def joined_to(batch: pa.RecordBatch, bodies: list[bytes]) -> list[tuple[int, list[int]]]:
        return [(n or 0, runs or []) for n, runs in zip(batch.column(of_words).to_pylist(), batch.column(of_runs).to_pylist(), strict=True)]

    return mapped(joined.select(*map(column, names), of_words, of_runs), _cut(joined_to, names, max_coverage), kinds)


def _cut(found_in, names: list[str], max_coverage: float):
    """Batches without the words that ``found_in(batch, bodies)`` gives as (n_words, runs), and without documents that are hit too much."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20, "text"):
            bodies = batch.column("text").cast(pa.binary()).to_pylist()
            keep, new = [], []
            for body, (n, runs) in zip(bodies, found_in(batch, [b or b"" for b in bodies]), strict=True):
                hit = sum(runs[1::2]) - sum(runs[::2])
                keep.append(hit <= max_coverage * n)
                new.append(without_runs(body, runs) if hit else body)
            cut = pa.array(new, pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([cut if n == "text" else batch.column(n) for n in names], names=names)
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("runs", F.lit(0), lambda a, x: x - a)  # ends less starts, as starts come first
    return found.select(
        "doc_id", "n_words", hit.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), spans AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))
), hits AS (
    SELECT doc_id, i, n, item FROM spans JOIN windows USING (n, s)
), words AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

"""Quality rules, line first: judge every line, remove those that fail, then reject documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batches, table, window_hashes

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
TERMINAL = re.compile(r"[.!?:;…。！？؟।][\"'”’»)\]]*(\s|$)")
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "lorem ipsum",
    "enable javascript", "click here", "sign up", "subscribe to our", "copyright ©", "powered by",
)
#: A line may have this share of symbols among its characters, separators a word, upper-case letters.
MAX_SYMBOLS, MAX_BARS, MAX_UPPER = 0.1, 0.25, 0.7
#: Words from which a line of one or few repeated words, or without the end of any sentence, is judged.
LONG_LINE = 10
#: Share of a document's words that may go with its failed lines.
MAX_LOSS = 0.4
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LETTERS = re.compile(r"[^\W\d_]")


def line_fault(line: str) -> str | None:
    """The rule that a line fails: symbols, navigation, shouting, repetition, boilerplate or punctuation."""
    words = line.split()
    if not words:
        return None
    n, chars = len(words), sum(map(len, words))
    if chars >= 20 and sum(map(line.count, "#*$%&<>")) > MAX_SYMBOLS * chars:
        return "symbols"
    bars = line.count("|") + line.count("»") + line.count("›")
    if bars >= 3 and bars > MAX_BARS * n:
        return "navigation"
    if n >= 5 and line.upper() == line:
        if len(_LETTERS.findall(line)) > MAX_UPPER * 0.5 * chars:
            return "shouting"
    elif n >= 5 and sum(map(str.isupper, words)) > MAX_UPPER * n:
        return "shouting"
    if n >= LONG_LINE and len(set(words)) < 0.3 * n:
        return "repetition"
    if n <= 3 * LONG_LINE and _BOILER.search(line.lower()):
        return "boilerplate"
    if n >= LONG_LINE and not TERMINAL.search(line):
        return "punctuation"
    return None


def _repeat_words(words: Words) -> np.ndarray:
    """For each text, the words inside 8-word windows that the text holds twice or more."""
    n_texts, width = len(words.first) - 1, 8
    out = np.zeros(n_texts, np.int64)
    if len(words.hashes) < width:
        return out
    h = window_hashes(words.hashes, width)
    at = np.flatnonzero(words.doc[: len(h)] == words.doc[width - 1 :])
    # windows of one text that are equal get equal numbers; the text is part of the number
    h = h[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = at[order[twice]]
    cover = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + width, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.doc[inside], minlength=n_texts)


def measure(bodies: list[bytes], max_loss: float) -> dict[str, list]:
    words = Words(bodies)
    n_words = np.diff(words.first)
    not_tail = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
    chars = np.bincount(words.doc, weights=not_tail[words.end] - not_tail[words.start], minlength=len(bodies)).astype(np.int64)
    repeated = _repeat_words(words)
    symbols, dup, lost, clean = [], [], [], []
    for body in bodies:
        symbols.append(sum(map(body.count, (bytes([b]) for b in SYMBOLS))))
        seen: set[bytes] = set()
        n_dup, n_lost, stay = 0, 0, []
        for line in body.split(b"\n"):
            n = len(line.split())
            if not n:
                stay.append(line)
                continue
            again = line in seen
            n_dup += again
            seen.add(line)
            if again or line_fault(line.decode("utf-8", "replace")):
                n_lost += n
            else:
                stay.append(line)
        dup.append(n_dup)
        lost.append(n_lost)
        clean.append(b"\n".join(stay))
    failed = (n_words < 20) | (100 * repeated > 30 * n_words)
    kept = ~failed & (np.array(lost) <= max_loss * n_words)
    return {
        "n_words": n_words.tolist(), "word_chars": chars.tolist(), "n_symbols": symbols, "n_dup_lines": dup,
        "n_repeat_words": repeated.tolist(), "n_lost_words": lost, "base_failed": failed.tolist(), "kept": kept.tolist(), "clean": clean,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def apply_rules(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """(doc_id, clean_text, counts, base_failed, kept), one row a document.

    clean_text is the text without the lines that fail a rule or repeat an earlier line.
    A document is kept if the base rules hold and at most ``max_loss`` of its words went.
    Null and empty texts have no words, so they fail; repeated rows give repeated rows; other
    columns, whatever their names, are left behind; an empty table gives no rows.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1 << 20):
            m = measure(batch.column("body").to_pylist(), max_loss)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(m["clean"], pa.binary()).cast(pa.string()), *(pa.array(m[c], pa.int64()) for c in _COUNTS), pa.array(m["base_failed"], pa.bool_()), pa.array(m["kept"], pa.bool_())],
                names=["doc_id", "clean_text", *_COUNTS, "base_failed", "kept"],
            )

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, clean_text string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, kept boolean"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("clean_text")

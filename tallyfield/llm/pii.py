"""PII by bootstrapped contextual extraction, with DataFrame functions only.

Matches of fixed patterns are the seeds, with or without digits, each one span. The two
words before a seed or any other token are its lexical pattern. Patterns and tokens form
a graph: a pattern is as good as the mean of its tokens, a token as good as its best
trusted pattern, seeds are 1; a few rounds of this score all of them. Unseen tokens
after patterns of high score are added.

Only patterns with a share of all seeds can be trusted, ``SUPPORT``, and three seeds at least, so there
are never more than 1 / ``SUPPORT`` of them. The words of all texts are streamed past these once; only
the distinct (pattern, token) edges are shuffled, without documents and positions. Positions are worked
out for the patterns that came to be trusted, in the texts that hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import pinned
from .common import table, text_key

# Fixed patterns of the base kinds, in the order in which they are listed. Possessive
# repeats and the look-behinds change no match; they keep long runs from being tried
# from every position and Java's matcher from recursing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"\S+"
#: Characters before a span in which its two words are looked for first.
REACH = 96
ROUNDS = 3
MIN_SCORE, MIN_SEEDS, MIN_DIGITS = 0.6, 3, 3
#: The share of all distinct (pattern, seed) that a pattern needs.
SUPPORT = 0.001
#: Stands for each character of a base span where words are cut; a word that holds it, of itself too, is no candidate.
MASK = "\ufdd0"
ADDED = "context"

_SPANS = "array<struct<start:int,end:int,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, hit): code points, end exclusive.

    The pieces between matches give the offsets, so texts are scanned twice however many matches there are.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.char_length(x["0"])
        end = begin + F.char_length(x["1"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["1"].alias("hit"))
        return F.when(x["1"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out")))

    return F.aggregate(zipped, start, step, lambda a: a["out"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits pass Luhn's check."""

    def step(total: Column, at: Column) -> Column:
        d = F.substring(F.reverse(number), at, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' matches that pass their checks; one that fails is dropped and not tried again."""
    none = F.array().cast(_SPANS)
    passes = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["hit"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
        "card": lambda s: F.when(F.char_length(digits(s["hit"])).between(16, 19), luhn(digits(s["hit"]))).otherwise(False),
        "phone": lambda s: F.char_length(digits(s["hit"])).between(8, 15),
    }
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    return {k: F.when(needs[k], F.filter(matches(text, p), passes[k])).otherwise(none) for k, p in PATTERNS.items()}


def words_before(text: Column, start: Column) -> Column:
    """The two words before a place, lower-cased; null if there are fewer. Quotes and brackets right before it are no word."""

    def words(piece: Column) -> Column:
        return F.regexp_extract_all(F.regexp_replace(piece, r"""(?<!\S)[("'\[<{]+$""", ""), F.lit(WORD), F.lit(0))

    # the first word of a piece may be cut, so the piece needs a third one
    near = words(F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH))))
    found = F.when((F.size(near) > 2) | (start <= REACH), near).otherwise(words(F.substring(text, F.lit(1), start)))
    return F.when(F.size(found) >= 2, F.lower(F.array_join(F.slice(found, -2, 2), " ")))


def keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text_key(body).alias("key"), body.alias("body"))


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, seeds), one row a document; null texts count as empty.

    seeds are the spans of all kinds as (token, pattern), those without two words before them left out.
    """
    plain = keyed(docs)
    spans = plain.select("*", *[c.alias(k) for k, c in base_spans(F.col("body")).items()])
    seeds = F.transform(F.concat(*[F.col(k) for k in PATTERNS]), lambda s: F.struct(
        F.lower(s["hit"]).alias("token"), words_before(F.col("body"), s["start"]).alias("pattern"),
    ))
    return spans.select("doc_id", "key", *PATTERNS, F.filter(seeds, lambda s: s["pattern"].isNotNull()).alias("seeds"))


def masked(text: Column, spans: Column) -> Column:
    """The text with the characters of all spans but white space masked, one for one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        begin = F.greatest(a["at"], s["start"])
        own = F.regexp_replace(F.substring(text, begin + 1, s["end"] - begin), r"\S", MASK)
        return F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, begin - a["at"]), own)).alias("out"))
        )

    def whole(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), start, step, whole)).otherwise(text)


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, words, seen): the words of each text, and the same with base spans masked."""
    spans = keyed(docs).withColumn("spans", F.concat(*base_spans(F.col("body")).values()))
    return spans.withColumns({
        "words": F.regexp_extract_all("body", F.lit(WORD), F.lit(0)),
        "seen": F.regexp_extract_all(masked(F.col("body"), F.col("spans")), F.lit(WORD), F.lit(0)),
    })


_LEAD, _TAIL = r"""^[("'\[<{]*""", r"""[)"'\]>},.;:!?]*$"""


def bare(word: Column) -> Column:
    """The word in lower case without quotes and punctuation at its ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, _LEAD, ""), _TAIL, ""))


def followers(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, key, pattern, word): the words after one of the ``patterns`` that no base span touches. No positions."""
    size = F.size("words") - 2
    each = words_of(docs).where(size > 0).select("doc_id", "key", F.explode(F.arrays_zip(
        F.slice("words", F.lit(1), size).alias("a"), F.slice("words", F.lit(2), size).alias("b"), F.slice("seen", F.lit(3), size).alias("word")
    )).alias("w"))
    paired = each.select("doc_id", "key", F.lower(F.concat_ws(" ", "w.a", "w.b")).alias("pattern"), F.col("w.word").alias("word"))
    return paired.join(patterns, "pattern").where(~F.col("word").contains(MASK)).select("doc_id", "key", "pattern", "word")


def edges_of(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct (pattern, token) of the words after the ``patterns``, made so before the shuffle."""
    return followers(docs, patterns).select("pattern", bare(F.col("word")).alias("token")).where("token != ''").distinct()


def placed(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, key, start, end, pattern) of the words after the ``patterns``, cut bare, that no base span touches.

    One running sum a text gives the positions, in texts that hold such a word only; equal rows count once.
    """
    same = [F.col("doc_id").eqNullSafe(F.col("_doc")), F.col("key") == F.col("_key")]
    holders = followers(docs, patterns).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct()
    texts = words_of(docs).join(holders, same, "left_semi").dropDuplicates(["doc_id", "key"])
    each = texts.select("doc_id", "key", F.posexplode(F.arrays_zip(
        F.col("words").alias("word"), F.col("seen").alias("seen"), F.slice(F.split("body", WORD, -1), F.lit(1), F.size("words")).alias("gap")
    )).alias("at", "w")).select("doc_id", "key", "at", "w.*")
    order = W.partitionBy("doc_id", "key").orderBy("at")
    ends = F.sum(F.char_length("gap") + F.char_length("word")).over(order).cast("int")
    found = each.withColumns({"_end": ends, "pattern": F.lower(F.concat(F.lag("word", 2).over(order), F.lit(" "), F.lag("word", 1).over(order)))}).join(
        patterns, "pattern").where(~F.col("seen").contains(MASK))
    lead = F.char_length(F.regexp_extract("word", _LEAD, 0))
    tail = F.char_length(F.regexp_extract(F.substr(F.col("word"), lead + 1), _TAIL, 0))
    return found.select(
        "doc_id", "key", (F.col("_end") - F.char_length("word") + lead).alias("start"), (F.col("_end") - tail).alias("end"), "pattern", bare(F.col("word")).alias("token")
    ).where(F.col("end") > F.col("start"))


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS, support: float = 0.0) -> DataFrame:
    """(pattern, score) of the patterns that may discover tokens, scored over all documents' (pattern, token, seed).

    They need a score of ``MIN_SCORE`` and, of their own seeds, ``MIN_SEEDS`` and the ``support``.
    """
    edges = pinned(edges.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "pii-edges")
    tokens = edges.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("worth"))
    for at in range(rounds):
        patterns = edges.join(tokens, "token").groupBy("pattern").agg(
            F.avg("worth").alias("score"), F.sum(F.col("seed").cast("int")).alias("seeds")
        ).where((F.col("score") >= MIN_SCORE) & (F.col("seeds") >= max(MIN_SEEDS, support)))
        if at + 1 < rounds:
            tokens = edges.join(patterns, "pattern", "left").groupBy("token").agg(
                F.greatest(F.max(F.col("seed").cast("double")), F.max(F.coalesce("score", F.lit(0.0)))).alias("worth")
            )
            tokens = pinned(tokens, "pii-tokens")
    return patterns.select("pattern", "score")


def find_pii(docs: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, context): arrays of spans (start, end), one row a document.

    The first four are the base kinds. context holds the identifiers that trusted
    patterns discover: words that no base span touches, those with digits only from
    three digits on. Null and empty texts have no spans; repeated rows give repeated rows;
    other columns are left behind; an empty table gives no rows.
    """
    found = pinned(find_base(docs), "pii-base")
    seeds = pinned(found.select(F.inline("seeds")).groupBy("pattern", "token").agg(F.lit(True).alias("seed")), "pii-seeds")
    least = support * seeds.count()
    often = pinned(seeds.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= max(MIN_SEEDS, least)).select("pattern"), "pii-patterns")
    unseen = edges_of(docs, often).select("pattern", "token", F.lit(False).alias("seed"))
    trusted = pinned(trusted_patterns(seeds.unionByName(unseen), rounds, least), "pii-trusted")
    ends = {k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in PATTERNS}
    none = F.array().cast("array<struct<start:int,end:int>>")
    if trusted.isEmpty():
        return found.select("doc_id", "key", *[c.alias(k) for k, c in ends.items()], none.alias(ADDED))
    n = F.char_length(digits(F.col("token")))
    added = placed(docs, trusted.select("pattern")).where((n == 0) | (n >= MIN_DIGITS)).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found")
    ).withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", "key", *[c.alias(k) for k, c in ends.items()], F.coalesce("found", none).alias(ADDED))


def written(kinds) -> Column:
    """kind:start:end of the kinds' spans, one after the other, comma-joined."""
    def lines(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[lines(k) for k in kinds]), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(written(PATTERNS).cast("binary"), 256).alias("base_sha256"), written([*PATTERNS, ADDED]).alias("spans"),
    )

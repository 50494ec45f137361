"""Extractive summaries: sentences scored by place, key words, subject and facts; the best ones in order.

Weights of place and of facts are parameters of the score. Texts without sentences give their first 250 characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomar.functions.sequential import sentences, split_sentences
from tomar.functions.text import FACT, STOP_WORDS, bound, facts, simplified_safely, tr_lower, words

KEY_WORDS, SHORT = 12, 250
#: Spark's white space and digits are those of ASCII. Words that a task keeps.
_WORD, _FACT, _KEPT = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile(FACT, re.A), 500_000


def _plain(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    bare = F.transform(words(tr_lower(c)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def scored_sentences(documents: DataFrame) -> DataFrame:
    """(id, pos, n, sentence, score) of documents(id, text, subject)."""
    split = documents.select("id", _plain(F.coalesce("subject", F.lit(""))).alias("subject"), F.posexplode(sentences("text")).alias("pos", "sentence"))
    whole = split.where(F.col("sentence").rlike(r"^[\p{Lu}0-9\"“(]") & ~F.col("sentence").rlike(r"[:;]\s*$"))
    own = Window.partitionBy("id")
    placed = whole.withColumn("i", F.row_number().over(own.orderBy("pos"))).withColumn("n", F.count("*").over(own)).withColumn("t", _plain(F.col("sentence")))
    terms = placed.select("id", F.posexplode("t").alias("at", "term"), "pos").groupBy("id", "term").agg(F.count("*").alias("tf"), F.min(F.struct("pos", "at")).alias("first"))
    keys = terms.withColumn("r", F.row_number().over(own.orderBy(F.desc("tf"), "first"))).where(F.col("r") <= KEY_WORDS).groupBy("id").agg(F.collect_list("term").alias("keys"))
    joined = placed.join(keys, "id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    place = F.when(F.col("i") == 1, 1.0).when(F.col("i") == 2, 0.85).otherwise(0.6)
    place = F.when(F.col("i") == F.col("n"), F.greatest(place, F.lit(0.75))).otherwise(place)
    overlap = F.size(F.filter("t", lambda w: F.array_contains("keys", w))) / (F.size("t") + 1)
    about = F.least(F.size(F.filter("t", lambda w: F.array_contains("subject", w))), F.lit(2)) * 0.35
    told = F.least(F.size(facts("sentence")), F.lit(3)) * 0.4
    length = F.when(F.size(words("sentence")).between(6, 40), 1.0).otherwise(0.6)
    return joined.select("id", "pos", "n", "sentence", ((place + 2.0 * overlap + about + told) * length).alias("score"))


def summaries(documents: DataFrame) -> DataFrame:
    """(id, summary): the best two to four sentences in their order, simplified where no fact is lost."""
    wanted = F.when(F.col("n") <= 4, F.least(F.lit(2), F.col("n"))).when(F.col("n") <= 10, 3).otherwise(4)
    ranked = scored_sentences(documents).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))).where(F.col("r") <= wanted)
    joined = ranked.withColumn("s", _closed(F.col("sentence"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("x")).select("id", F.array_join(F.transform("x", lambda y: y["s"]), " ").alias("summary"))
    return documents.select("id", "text").join(joined, "id", "left").select("id", F.coalesce("summary", _beginning(F.col("text"))).alias("summary"))


def _closed(sentence: Column) -> Column:
    one_line = F.trim(F.regexp_replace(sentence, r"\s+", " "))
    return bound(F.regexp_replace(bound(one_line, simplified_safely), r"[ ;:,-]+$", ""), lambda tidy: F.when(tidy.rlike(r"[.!?]$"), tidy).otherwise(F.concat(tidy, F.lit("."))))


def _beginning(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, SHORT)


class Terms(dict):
    """The term of each word in lower case; empty where it has none."""

    def __missing__(self, word: str) -> str:
        able = [i for i, c in enumerate(word) if unicodedata.category(c)[0] in "LN"]
        bare = word[able[0] : able[-1] + 1] if able else ""
        term = bare if len(bare) > 3 and bare not in STOP_WORDS else ""
        if len(self) < _KEPT:
            self[word] = term
        return term


def _terms(text: str, terms: Terms) -> list[str]:
    return [t for t in map(terms.__getitem__, _WORD.findall(text.replace("İ", "i").replace("I", "ı").lower())) if t]


def best_sentences(text: str, subject: str | None, terms: Terms) -> list[str]:
    """The sentences of ``summaries`` for one text, with the scores of ``scored_sentences``."""
    whole = [s for s in split_sentences(text) if (s[0] in '0123456789"“(' or unicodedata.category(s[0]) == "Lu") and s[-1] not in ":;"]
    own = [_terms(s, terms) for s in whole]
    # The count keeps the order of first occurrence, which decides between equal counts.
    keys = {t for t, _ in sorted(Counter(t for x in own for t in x).items(), key=lambda x: -x[1])[:KEY_WORDS]}
    about, n, scored = set(_terms(subject or "", terms)), len(whole), []
    for i, (s, x) in enumerate(zip(whole, own, strict=True), 1):
        place = 1.0 if i == 1 else 0.85 if i == 2 else 0.6
        if i == n:
            place = max(place, 0.75)
        overlap = sum(t in keys for t in x) / (len(x) + 1)
        score = place + 2.0 * overlap + min(sum(t in about for t in x), 2) * 0.35 + min(len(set(_FACT.findall(s))), 3) * 0.4
        scored.append((-score * (1.0 if 6 <= len(_WORD.findall(s)) <= 40 else 0.6), i))
    best = sorted(scored)[: min(2, n) if n <= 4 else 3 if n <= 10 else 4]
    return [whole[i - 1] for i in sorted(i for _, i in best)]


def summary(text: Column, subject: Column) -> Column:
    """The summary of ``summaries`` from the row itself: no sentence is a row and no text is shuffled. Null stays null."""
    terms = Terms()

    @F.arrow_udf("array<string>")
    def chosen(texts: pa.Array, subjects: pa.Array) -> pa.Array:
        return pa.array([None if t is None else best_sentences(t, s, terms) for t, s in zip(texts.to_pylist(), subjects.to_pylist(), strict=True)], pa.list_(pa.string()))

    joined = lambda x: F.when(F.size(x) > 0, F.array_join(F.transform(x, _closed), " ")).otherwise(_beginning(text))
    return F.when(text.isNotNull(), bound(chosen(text, subject), joined))

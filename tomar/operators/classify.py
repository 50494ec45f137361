"""Rule classifiers whose rules are data: weighted key words, first-match rules, score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomar.functions.text import bound, keyword_count, tr_lower

from .metrics import softmax

NO_SIGNAL = 0.1


def keyword_scores(c: Column | str, rules: dict[str, dict[str, float]]) -> Column:
    """A map from class to the sum of the weights of its key words that the folded text holds."""

    def scores(low: Column) -> Column:
        pairs = []
        for name, words in rules.items():
            total = reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w)), F.lit(float(x))).otherwise(F.lit(0.0)) for w, x in words.items()])
            pairs += [F.lit(name), total]
        return F.create_map(*pairs)

    return bound(tr_lower(c), scores)


def damped_scores(c: Column | str, rules: dict[str, dict[str, float]], more: float = 0.25, most: int = 3) -> Column:
    """A map from class to the sum of w (1 + more min(n - 1, most)) over its key words that occur n times at word starts."""
    pairs = []
    for name, words in rules.items():
        parts = []
        for w, x in words.items():
            n = keyword_count(c, w)
            parts.append(F.when(n > 0, x * (1 + more * F.least(n - 1, F.lit(most)))).otherwise(F.lit(0.0)))
        pairs += [F.lit(name), reduce(lambda a, b: a + b, parts)]
    return F.create_map(*pairs)


def decided(scores: Column | str, default: str, temperature: float = 2.0) -> Column:
    """(class, confidence): the greatest score of a map by softmax, the first name where tied; the default without signal."""
    m = F.col(scores) if isinstance(scores, str) else scores
    best = F.element_at(F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct((-x["value"]).alias("s"), x["key"].alias("k")))), 1)
    signal = F.array_max(F.map_values(m)) > 0
    p = softmax(m, temperature)
    return F.struct(F.when(signal, best["k"]).otherwise(default).alias("class"), F.when(signal, F.round(F.element_at(p, best["k"]), 3)).otherwise(NO_SIGNAL).alias("confidence"))


def first_match(rules: list[tuple[Column, Column]]) -> Column:
    """The value of the first rule whose condition holds; null where none does."""
    return F.coalesce(*[F.when(condition, value) for condition, value in rules])


def separation(scores: Column | str, low: float = 0.3, high: float = 0.97) -> Column:
    """Confidence of a decision from the lead of the best score over the next."""
    m = F.col(scores) if isinstance(scores, str) else scores
    own = F.sort_array(F.map_values(m), asc=False)
    first, second = F.try_element_at(own, F.lit(1)), F.coalesce(F.try_element_at(own, F.lit(2)), F.lit(0.0))
    return F.when(first > 0, F.greatest(F.lit(low), F.least(F.lit(high), (first - second) / first)))


def gate(confidence: Column | str, threshold: float = 0.6) -> Column:
    """Whether a decision is too unsure to go on without a person."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.coalesce(c < threshold, F.lit(True))


def nearest(queries: DataFrame, candidates: DataFrame, threshold: float = 0.75, similarity=None, others: bool = False) -> DataFrame:
    """(q, candidate, similarity): the most similar of candidates(c) to each of queries(q) above a threshold, the first where tied.

    Candidates are compared where they share two neighbouring letters, the first or the last letter with the query, which
    any pair of a similarity of 0.75 or more does (one edit leaves one end, and more edits mean longer words); the equality join takes
    the place of a cross join. Lower thresholds are refused. With others, a query isn't its own candidate.
    """
    from tomar.functions.sequential import osa_similarity

    if threshold < 0.75:
        raise ValueError("the keys are exact from 0.75 on")

    def pairs_of(c: str) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(2)))
        return F.array_distinct(F.concat(inner, F.array(F.concat(F.lit("^"), F.left(c, F.lit(1))), F.concat(F.right(c, F.lit(1)), F.lit("$")))))

    a = queries.select("q").distinct().select("q", F.explode(pairs_of("q")).alias("g"))
    b = candidates.select("c").distinct().select("c", F.explode(pairs_of("c")).alias("g"))
    both = a.join(b, "g").where("q <> c" if others else "true").select("q", "c").distinct().withColumn("s", (similarity or osa_similarity)("q", "c")).where(F.col("s") >= threshold)
    return both.groupBy("q").agg(F.min_by(F.struct("c", "s"), F.struct((-F.col("s")).alias("s"), "c")).alias("x")).select("q", F.col("x.c").alias("candidate"), F.col("x.s").alias("similarity"))

"""Rule tables over texts: structural signals, ranked alternatives, weighted validation, citations, step traces.

Every rule is data: a name, a pattern or a test, and a weight. Null texts meet no rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomar.functions.text import tokens, tr_lower

OK, MOST_NOTES = 0.8, 6
#: Words and endings of the first person.
FIRST_PERSON = "ben benim bana beni bende benden biz bizim bize bizi".split()
FIRST_ENDINGS = r"(?:[ıiuü]yorum|[ıiuü]yoruz|[dt][ıiuü]m|[dt][ıiuü]k|ac[ae]ğ[ıi]m|eceğim|ederim|ederiz)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: Column | str, pattern: str) -> Column:
    return F.coalesce(_col(c).rlike(pattern), F.lit(False))


def signal_scores(c: Column | str, signals: list[tuple[str, str, str, float]]) -> Column:
    """A map from class to the sum of the weights of its signals (name, pattern, class, weight) that the text meets."""
    pairs = []
    for name in dict.fromkeys(k for _, _, k, _ in signals):
        own = [F.when(matches(c, p), F.lit(w)).otherwise(F.lit(0.0)) for _, p, k, w in signals if k == name]
        pairs += [F.lit(name), reduce(lambda a, b: a + b, own)]
    return F.create_map(*pairs)


def ranked(scores: DataFrame, key: str, first: int = 2, last: int = 4) -> DataFrame:
    """(key, sinif, skor, sira): the classes of scores(key, skorlar) from one rank to another; only scores above 0, ties by name."""
    long = scores.select(key, F.explode("skorlar").alias("sinif", "skor")).where("skor > 0")
    order = Window.partitionBy(key).orderBy(F.desc("skor"), "sinif")
    return long.withColumn("sira", F.row_number().over(order)).where(F.col("sira").between(first, last))


def with_bonus(scores: Column | str, favoured: list[str], share: float = 0.1) -> Column:
    """The scores with a share of the greatest one added to the favoured classes."""
    m = _col(scores)
    most = F.coalesce(F.array_max(F.map_values(m)), F.lit(0.0))
    return F.transform_values(m, lambda k, v: v + F.when(k.isin(*favoured), share * most).otherwise(F.lit(0.0)))


def covered_confidence(scores: Column | str, coverage: Column, low: float = 0.3, high: float = 0.97) -> Column:
    """Separation of the best two scores times (0.6 + 0.4 coverage), within bounds; the lower bound without any score."""
    own = F.reverse(F.array_sort(F.map_values(_col(scores))))
    best, second = F.element_at(own, 1), F.coalesce(F.try_element_at(own, F.lit(2)), F.lit(0.0))
    gap = F.when(best > 0, (best - second) / best).otherwise(F.lit(0.0))
    return F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), gap * (0.6 + 0.4 * coverage))), F.lit(low))


def validated(c: Column | str, rules: list[tuple[str, str, float, Column | None]], placeholder: str = r"\[[A-ZÇĞİÖŞÜ _]+\]") -> Column:
    """(skor, uygun, eksikler) of a text by rules (name, pattern, weight, condition): the share of the weights of the rules that apply and hold.

    A text with a placeholder left in it is never right. Without any rule that applies the score is 0.
    """
    applies = [F.lit(True) if on is None else F.coalesce(on, F.lit(False)) for *_, on in rules]
    holds = [matches(c, p) for _, p, _, _ in rules]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    whole = add([F.when(on, F.lit(w)).otherwise(F.lit(0.0)) for on, (_, _, w, _) in zip(applies, rules)])
    got = add([F.when(on & ok, F.lit(w)).otherwise(F.lit(0.0)) for on, ok, (_, _, w, _) in zip(applies, holds, rules)])
    score = F.when(whole > 0, F.round(got / whole, 4)).otherwise(F.lit(0.0))
    failed = F.array_compact(F.array(*[F.when(on & ~ok, F.lit(name)) for on, ok, (name, *_) in zip(applies, holds, rules)]))
    return F.struct(score.alias("skor"), ((score >= OK) & ~matches(c, placeholder)).alias("uygun"), failed.alias("eksikler"))


def note(failed: Column | str, most: int = MOST_NOTES) -> Column:
    """One line for the failed rules, the first few of them; empty where none failed."""
    return F.array_join(F.slice(_col(failed), 1, most), "; ")


def best_candidate(*candidates: tuple[str, Column, Column]) -> Column:
    """The name of the candidate (name, text, score) with the highest score; where tied the first; null texts don't count."""
    own = [F.struct(F.coalesce(score, F.lit(0.0)).alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("ad")) for i, (name, _, score) in enumerate(candidates)]
    able = F.array_compact(F.array(*[F.when(text.isNotNull(), x) for x, (_, text, _) in zip(own, candidates)]))
    return F.array_max(able)["ad"]


def law_numbers(c: Column | str) -> Column:
    """The numbers of the laws that a text cites ('4734 sayılı')."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?:^|[^0-9])([0-9]{3,4}) sayılı"), F.lit(1)))


def unsupported(cited: Column, allowed: Column) -> Column:
    """The citations that no suggestion has."""
    return F.array_except(cited, F.coalesce(allowed, F.array().cast("array<string>")))


def contained(citation: Column, titles: Column) -> Column:
    """The first title that holds the citation or is held by it, whatever the letter case; null where there is none."""
    own = tr_lower(citation)
    return F.try_element_at(F.filter(titles, lambda t: F.contains(tr_lower(t), own) | F.contains(own, tr_lower(t))), F.lit(1))


def by_priority(values: Column, ranks: dict[str, int], other: int = 9) -> Column:
    """The values in the order of their ranks, then by name."""
    of = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.transform(F.array_sort(F.transform(values, lambda v: F.struct(F.coalesce(F.try_element_at(of, v), F.lit(other)).alias("r"), v.alias("v")))), lambda x: x["v"])


def first_person(c: Column | str) -> Column:
    """Whether a text speaks in the first person: a pronoun, or a word with such an ending."""
    own = F.regexp_extract_all(F.coalesce(tr_lower(c), F.lit("")), F.lit(r"[a-zçğıöşüâîû]+"), F.lit(0))
    return F.exists(own, lambda w: w.isin(*FIRST_PERSON) | w.rlike(FIRST_ENDINGS))


def holds_any(c: Column | str, phrases: list[str]) -> Column:
    """Whether a text holds one of the phrases, whatever the letter case."""
    low = F.coalesce(tr_lower(c), F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def unknown_share(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, n, bilinmeyen, oran): the distinct tokens of each text and the share that vocabulary(term) lacks; texts without tokens give no row."""
    own = texts.select(key, F.explode(F.array_distinct(tokens(text))).alias("term"))
    known = own.join(vocabulary.select("term").distinct().withColumn("var", F.lit(1)), "term", "left")
    return known.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("var").isNull()).alias("bilinmeyen")).withColumn("oran", F.round(F.col("bilinmeyen") / F.col("n"), 6))


def traced(steps: list[tuple[str, Column, Column]], reasons: list[tuple[Column, str]]) -> Column:
    """(adimlar, tamam, atlanan, nedenler) of steps (name, whether done, confidence) and reasons (condition, text) for a review, each reason once."""
    own = F.array(*[F.struct(F.lit(name).alias("adim"), F.coalesce(done, F.lit(False)).alias("tamam"), conf.cast("double").alias("guven")) for name, done, conf in steps])
    why = F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(text)) for when, text in reasons])))
    return F.struct(own.alias("adimlar"), F.size(F.filter(own, lambda x: x["tamam"])).alias("tamam"), F.transform(F.filter(own, lambda x: ~x["tamam"]), lambda x: x["adim"]).alias("atlanan"), why.alias("nedenler"))

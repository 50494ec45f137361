"""Triage as mechanisms: urgency stamps, deadlines named in a text, one score from several signals. Weights are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomar.functions.dates import MONTHS, TENS, UNITS, business_day, number_word, parse_date
from tomar.functions.text import tr_lower

#: An example table of stamps that stand alone on a line, the strongest first: name, pattern, weight, and the stamp that it makes void.
STAMPS = [("cok_acele", "ÇOK (?:ACELE|İVEDİ)", 1.0, "acele"), ("acele", "(?:ACELE|İVEDİ)", 0.85, ""), ("gunlu", "GÜNLÜ", 0.8, ""), ("sureli", "SÜRELİ", 0.6, ""), ("tekit", "TEKİT", 0.55, "")]
EXPLICIT = r"([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}) (?:tarihine|gününe|günü mesai bitimine) kadar"
RELATIVE = r"([0-9]{1,3}) (gün|hafta|ay|iş günü) içinde"
#: Score of a deadline by the days that are left, and the scores from which a priority is high or middle.
NEAR = [(3, 0.9), (7, 0.7), (15, 0.55)]
FAR, HIGH, MIDDLE = 0.2, 0.8, 0.55


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stamp_pattern(body: str) -> str:
    return rf"(?m)^[ \t]*{body}[ \t]*$"


def stamps(c: Column | str, rules=STAMPS) -> Column:
    """The stamps of a text in the order of the rules; one that a stronger stamp makes void is left out. Null has none."""
    has = {name: F.coalesce(_col(c).rlike(stamp_pattern(body)), F.lit(False)) for name, body, _, _ in rules}
    void = {weak: name for name, _, _, weak in rules if weak}
    return F.array_compact(F.array(*[F.when(has[name] & ~has[void[name]] if name in void else has[name], F.lit(name)) for name, *_ in rules]))


def explicit_deadlines(c: Column | str) -> Column:
    """The dates up to which something is asked for ('5.3.2025 tarihine kadar'); dates that don't exist are left out."""
    found = F.regexp_extract_all(F.coalesce(tr_lower(c), F.lit("")), F.lit(EXPLICIT), F.lit(1))
    return F.array_compact(F.transform(F.array_distinct(found), lambda x: parse_date(x)))


def relative_deadlines(c: Column | str, start: Column | str) -> Column:
    """(n, birim, son) of periods such as '10 gün içinde' from a date on; working days skip weekends and holidays."""
    base = _col(start).cast("date")
    low = F.coalesce(tr_lower(c), F.lit(""))
    both = F.array_distinct(F.arrays_zip(F.regexp_extract_all(low, F.lit(RELATIVE), F.lit(1)).alias("n"), F.regexp_extract_all(low, F.lit(RELATIVE), F.lit(2)).alias("birim")))

    def due(x: Column) -> Column:
        n, unit = x["n"].cast("int"), x["birim"]
        son = F.when(unit == "gün", F.date_add(base, n)).when(unit == "hafta", F.date_add(base, n * 7)).when(unit == "ay", F.add_months(base, n)).otherwise(business_day(base, n))
        return F.struct(n.alias("n"), unit.alias("birim"), son.alias("son"))

    return F.transform(both, due)


def deadline_score(days_left: Column | str) -> Column:
    """The signal of a deadline; null for none."""
    d = _col(days_left)
    steps = reduce(lambda a, s: a.when(d <= s[0], F.lit(s[1])), NEAR[1:], F.when(d <= NEAR[0][0], F.lit(NEAR[0][1])))
    return F.when(d.isNotNull(), steps.otherwise(F.lit(FAR)))


def stamp_score(own: Column | str, rules=STAMPS) -> Column:
    """The signal of the strongest stamp; null for none."""
    return F.array_max(F.array(*[F.when(F.array_contains(_col(own), name), F.lit(weight)) for name, _, weight, _ in rules]))


def priority(*signals: Column) -> Column:
    """(skor, oncelik): the greatest signal and its class; without signals 0 and the lowest."""
    score = F.coalesce(F.array_max(F.array(*signals)), F.lit(0.0))
    return F.struct(score.alias("skor"), F.when(score >= HIGH, "yuksek").when(score >= MIDDLE, "orta").otherwise("dusuk").alias("oncelik"))


def document_date(*chain: Column) -> Column:
    """The first date of a chain of texts that is one."""
    return F.coalesce(*[parse_date(c) for c in chain])


_ORDINAL = "|".join([*UNITS, *TENS, "dörd"])


def worded_date(c: Column | str) -> Column:
    """A date in words: '2025 yılı mart ayının on ikinci günü', with the year in the text before or after; null where there is none."""
    low = F.coalesce(tr_lower(c), F.lit(""))
    named = rf"({'|'.join(MONTHS)}) ayının ((?:(?:{_ORDINAL}) ?){{1,2}}|[0-9]{{1,2}})(?:['’]?[ıiuü]?nc[ıiuü]|[ıiuü]nc[ıiuü])? günü"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, named, 1))
    # The ending of the ordinal belongs to the last number word.
    day = number_word(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(low, named, 2)), r"dörd$", "dört"), r"[ıiuü]?nc[ıiuü]$", ""))
    year = F.coalesce(F.nullif(F.regexp_extract(low, r"((?:19|20)[0-9]{2}) yılı", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")))
    return F.when((month > 0) & day.isNotNull() & year.isNotNull(), F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))

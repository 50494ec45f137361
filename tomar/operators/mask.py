"""Star masks for personal data that keep the text's shape, and an independent audit for what is left.

Masks go in a fixed order, from the longest number to the shortest. Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomar.functions.text import bound

from . import extract

#: Patterns of the audit, kept apart from those of the masks.
AUDIT = {
    "eposta": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"TR[0-9]{2}(?:[ ]?[0-9]{4}){5}[ ]?[0-9]{2}",
    "telefon": r"(?:\+90|0)[ ]?\(?5[0-9]{2}\)?[ ]?[0-9]{3}[ ]?[0-9]{2}[ ]?[0-9]{2}",
    "on_bir_hane": r"(?:^|[^0-9])[1-9][0-9]{10}(?:[^0-9]|$)",
}
_Mask = Callable[[Column], Column]


def _each(c: Column, values: Column, mask: _Mask) -> Column:
    """The text with each of the values replaced by its mask, the longest first."""
    longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, c, lambda text, v: F.replace(text, v, mask(v)))


def _stars(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "*")


def emails(c: Column | str) -> Column:
    """The first letter and the domain of an address stay."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.contains(c, F.lit("@")), c).otherwise(F.regexp_replace(c, r"([A-Za-z0-9])[A-Za-z0-9._%+-]{0,63}+@((?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z]{2,15})", "$1***@$2"))


def ibans(c: Column | str) -> Column:
    """The country and the last four digits of an account number stay."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.array_distinct(F.regexp_extract_all(c, F.lit(extract.IBAN), F.lit(0)))
    return _each(c, plain, lambda v: F.concat(F.lit("TR"), _stars(F.substr(v, F.lit(3), F.length(v) - 6)), F.right(v, F.lit(4))))


def national_numbers(c: Column | str) -> Column:
    """The first two digits of a valid national number stay."""
    c = F.col(c) if isinstance(c, str) else c
    return _each(c, extract.national_numbers(c), lambda v: F.concat(F.left(v, F.lit(2)), F.lit("*********")))


def phones(c: Column | str) -> Column:
    """The first two digits and the separators of a phone number stay."""
    c = F.col(c) if isinstance(c, str) else c
    return _each(c, extract.phones(c), lambda v: F.concat(F.regexp_extract(v, "^[^0-9]*[0-9][^0-9]*[0-9]", 0), _stars(F.regexp_replace(v, "^[^0-9]*[0-9][^0-9]*[0-9]", ""))))


def plates(c: Column | str) -> Column:
    """The province code of a vehicle plate stays."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?=[0-8])(?<![0-9A-Z])(0[1-9]|[1-7][0-9]|8[01]) ?[A-Z]{1,3} ?[0-9]{2,4}(?![0-9A-Z])", "$1 *** ***")


def birth_dates(c: Column | str) -> Column:
    """The digits of a date after a birth label become stars."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"[Dd]oğum [Tt]arihi\s*:?\s*([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})"), F.lit(1)))
    return _each(c, found, _stars)


def names(c: Column | str, known: Column) -> Column:
    """Known names become initials, the longest first."""
    c = F.col(c) if isinstance(c, str) else c
    able = F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda v: F.length(v) > 3)
    return _each(c, able, lambda v: F.array_join(F.transform(F.split(v, r"\s+"), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("***"))), " "))


def masked(c: Column | str, known_names: Column | None = None) -> Column:
    """All masks in order."""
    for mask in (ibans, national_numbers, phones, plates, birth_dates, emails):
        c = bound(c, mask)
    return names(c, known_names) if known_names is not None else c


def counts(c: Column | str) -> Column:
    """How many items of each kind a text has."""
    return F.struct(F.size(extract.emails(c)).alias("eposta"), F.size(extract.ibans(c)).alias("iban"), F.size(extract.phones(c)).alias("telefon"), F.size(extract.national_numbers(c)).alias("kimlik_no"))


def audit(c: Column | str) -> Column:
    """How many items of each kind the audit still finds; 0 for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(*[F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)).alias(k) for k, p in AUDIT.items()])


#: What names a registry number, and the words before it that make it the number of a company or an institution.
REGISTRY = r"((?:[Ss]icil|SİCİL)\s*(?:[Nn]o|NO|[Nn]umarası)\s*[:.]?\s*)([0-9]{3,12})"
CORPORATE = "(?:[Tt]icaret|TİCARET|[Tt]apu|TAPU|[Ff]irma|FİRMA)"
#: An address: a quarter or a street and a door number, with what is given of floor and flat.
ADDRESS = r"[A-ZÇĞİÖŞÜ][A-Za-zçğıöşüÇĞİÖŞÜ]* (?:Mahallesi|Mah\.|Mh\.|Caddesi|Cad\.|Cd\.|Sokağı|Sok\.|Sk\.)[^\n:;]{0,60}?[Nn][Oo]\s*[:.]?\s*[0-9]{1,5}(?:[ ,]+(?:[Kk]at|[Dd]aire|K|D)\s*[:.]?\s*[0-9]{1,3}){0,2}"


def registry_numbers(c: Column | str) -> Column:
    """The digits of a registry number become stars, unless it is that of a company or an institution."""
    c = F.col(c) if isinstance(c, str) else c
    kept = F.regexp_replace(c, rf"({CORPORATE}\s+){REGISTRY}", "$1$2#$3#")
    return F.regexp_replace(F.regexp_replace(kept, REGISTRY + "(?![0-9#])", "$1***"), r"#([0-9]{3,12})#", "$1")


def addresses(c: Column | str) -> Column:
    """Every address becomes one fixed token."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, ADDRESS, "[ADRES]")

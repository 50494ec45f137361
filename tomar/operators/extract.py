"""Fields from the text of official correspondence.

Patterns that a regular expression can state are columns; what depends on the lines before and after is one Arrow
function over the lines. Every array is in order of first occurrence without repeats; null and empty texts give empty arrays and nulls.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomar.functions.dates import MONTHS, parse_date
from tomar.functions.text import tr_lower

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z]{2,15}"
IBAN = r"TR[0-9]{2}(?:\s?[0-9]{4}){5}\s?[0-9]{2}"
AMOUNT = r"[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{1,2})?\s?(?:TL|₺|lira|Türk Lirası)"
PHONE = r"(?=[+02-5\s.(-])(?:\+90|0090|0)?[\s.-]?\(?[2-5][0-9]{2}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{2}[\s.-]?[0-9]{2}"
NUMERIC_DATE = r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}"
NAMED_DATE = rf"[0-9]{{1,2}}\s(?:{'|'.join(MONTHS)}|{'|'.join(m.capitalize() for m in MONTHS)})\s[0-9]{{4}}"
DOCUMENT_NUMBER = r"[EZO]-[0-9]{5,9}-[0-9]{2,3}(?:\.[0-9]{2,3})*-[0-9]+"


def _all(c: Column | str, pattern: str, group: int = 0) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group)))


def emails(c: Column | str) -> Column:
    return _all(c, EMAIL)


def ibans(c: Column | str) -> Column:
    """Account numbers without white space."""
    return F.array_distinct(F.transform(_all(c, IBAN), lambda x: F.regexp_replace(x, r"\s", "")))


def amounts(c: Column | str) -> Column:
    return _all(c, AMOUNT)


def phones(c: Column | str) -> Column:
    """Phone numbers of ten to twelve digits."""
    return F.filter(F.transform(_all(c, PHONE), lambda x: F.trim(x)), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(10, 14))


def national_number_valid(c: Column | str) -> Column:
    """Whether eleven digits have right check digits and aren't all equal; null is not."""
    c = F.col(c) if isinstance(c, str) else c
    digit = lambda i: F.substring(c, i, 1).try_cast("int")
    odd, even = (sum((digit(i) for i in r), F.lit(0)) for r in (range(1, 10, 2), range(2, 9, 2)))
    first_ten = sum((digit(i) for i in range(1, 11)), F.lit(0))
    good = c.rlike("^[1-9][0-9]{10}$") & (F.pmod(odd * 7 - even, F.lit(10)) == digit(10)) & (F.pmod(first_ten, F.lit(10)) == digit(11)) & ~c.rlike("^([0-9])\\1{10}$")
    return F.coalesce(good, F.lit(False))


#: The subject line and the indented lines after it, which hold no label of their own.
SUBJECT = r"(?md)^[ \t]*Konu[ \t]*:[ \t]*([^\n]+(?:\n[ \t]{2,}[^\n:]+$){0,3})"


def national_numbers(c: Column | str) -> Column:
    """Eleven-digit numbers with right check digits."""
    return F.filter(_all(c, r"[1-9](?<![0-9].)[0-9]{10}(?![0-9])"), national_number_valid)


def dates(c: Column | str) -> Column:
    """Dates that exist, as written: numeric, then with the month's name."""
    return F.filter(F.array_distinct(F.concat(_all(c, NUMERIC_DATE), _all(c, NAMED_DATE))), lambda x: parse_date(x).isNotNull())


def document_numbers(c: Column | str) -> Column:
    """Every document number of a text."""
    return _all(c, DOCUMENT_NUMBER)


def own_number(c: Column | str) -> Column:
    """The number on the line that starts with 'Sayı'; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_extract(c, r"(?md)^[ \t]*Say[ıi][ \t]*:[ \t]*(\S+)", 1)), F.lit(""))


def subject(c: Column | str) -> Column:
    """The subject with up to three indented lines that go on with it, in one line; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    whole = F.regexp_extract(c, SUBJECT, 1)
    return F.nullif(F.trim(F.regexp_replace(whole, r"[ \t\n]+", " ")), F.lit(""))


def document_date(c: Column | str) -> Column:
    """The date on the line that starts with 'Tarih', else the first date that isn't in a reference line."""
    c = F.col(c) if isinstance(c, str) else c
    labelled = F.nullif(F.regexp_extract(c, rf"(?md)^[ \t]*Tarih[ \t]*:[ \t]*({NUMERIC_DATE})", 1), F.lit(""))
    rest = F.regexp_replace(c, r"(?md)^[ \t]*İlgi[ \t]*:[^\n]*$", "")
    return F.coalesce(parse_date(labelled), parse_date(F.try_element_at(dates(rest), F.lit(1))))


def reference_lines(c: Column | str) -> Column:
    """The texts of the reference lines: 'İlgi : ...' and lettered items after it."""
    return F.transform(_all(c, r"(?md)^[ \t]*(?:İlgi[ \t]*:[ \t]*(?:[a-zç]\)[ \t]*)?|[a-zç]\)[ \t]+)([^\n]*(?:sayılı|tarihli)[^\n]*)", 1), lambda x: F.trim(x))


def recipient(c: Column | str) -> Column:
    """The addressee: a line in capitals in the dative, else the name after 'Sayın'; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    capitals = F.regexp_extract(c, r"(?md)^[ \t]*([A-ZÇĞİÖŞÜÂÎÛ][A-ZÇĞİÖŞÜÂÎÛ .&-]{6,}(?:NA|NE|YA|YE|A|E))[ \t]*$", 1)
    dear = F.regexp_extract(c, r"(?md)^[ \t]*Sayın[ \t]+([^\n,]{3,60})", 1)
    return F.coalesce(F.nullif(F.trim(capitals), F.lit("")), F.nullif(F.trim(dear), F.lit("")))


def secrecy(c: Column | str) -> Column:
    """The secrecy stamp that stands alone on a line; null where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_extract(c, r"(?md)^[ \t]*(ÇOK GİZLİ|GİZLİ|HİZMETE ÖZEL|KİŞİYE ÖZEL)[ \t]*$", 1)), F.lit(""))


def places(c: Column | str, gazetteer: list[str]) -> Column:
    """The names of a gazetteer that a text holds as words, in its order, whatever their endings."""
    low = tr_lower(c)
    own = F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(F.array(*[F.lit(g) for g in gazetteer]), lambda g: F.array_contains(own, F.lower(F.translate(g, "İIÇÖÜŞĞ", "iıçöüşğ"))))


#: The provinces.
PROVINCES = """
Adana Adıyaman Afyonkarahisar Ağrı Aksaray Amasya Ankara Antalya Ardahan Artvin Aydın Balıkesir Bartın Batman Bayburt Bilecik Bingöl Bitlis Bolu Burdur Bursa Çanakkale Çankırı Çorum Denizli Diyarbakır Düzce
Edirne Elazığ Erzincan Erzurum Eskişehir Gaziantep Giresun Gümüşhane Hakkari Hatay Iğdır Isparta İstanbul İzmir Kahramanmaraş Karabük Karaman Kars Kastamonu Kayseri Kırıkkale Kırklareli Kırşehir Kilis Kocaeli
Konya Kütahya Malatya Manisa Mardin Mersin Muğla Muş Nevşehir Niğde Ordu Osmaniye Rize Sakarya Samsun Siirt Sinop Sivas Şanlıurfa Şırnak Tekirdağ Tokat Trabzon Tunceli Uşak Van Yalova Yozgat Zonguldak
""".split()
#: A place by what follows its name.
PLACE = r"([A-ZÇĞİÖŞÜ][a-zçğıöşü]+) (?:ilçesi|ilinde|iline|ilinin|köyü|beldesi|mahallesinde)"


def places_of(c: Column | str) -> Column:
    """The provinces that a text names, as written with a capital, and the names that a word for a kind of place follows; each once, provinces first."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    capital = F.regexp_extract_all(c, F.lit(r"[A-ZÇĞİÖŞÜ][a-zçğıöşü]+"), F.lit(0))
    return F.array_distinct(F.concat(F.array_intersect(F.array(*[F.lit(x) for x in PROVINCES]), capital), F.regexp_extract_all(c, F.lit(PLACE), F.lit(1))))


_BODY_KINDS = r"(?:Müdürlüğü|Başkanlığı|Belediyesi|Kaymakamlığı|Valiliği|Bakanlığı|Kurumu|Dairesi|Müşavirliği|Odası|Hastanesi|Kütüphanesi|İdaresi|Bölgesi|Öğretmenevi|Yüksekokulu|Üniversitesi)"
_BODY = re.compile(rf"^[ \t]*(?:T\.C\.[ \t]+)?((?:[A-ZÇĞİÖŞÜ][\wâîû.]*[ \t]+(?:ve[ \t]+)?){{1,6}}{_BODY_KINDS})[ \t]*$", re.M)
_SIGNED = re.compile(r"^(?:[A-ZÇĞİÖŞÜ][\wçğıöşü]+|[A-ZÇĞİÖŞÜ]\.)(?:[ \t]+(?:[A-ZÇĞİÖŞÜ][\wçğıöşüÇĞİÖŞÜ]+|[A-ZÇĞİÖŞÜ]\.)){1,3}$")
#: Words of the posts that stand below a signature.
POSTS = frozenset("müdür müdürü başkan başkanı şef uzman memur sekreter raportör sorumlusu vekili yardımcısı imza (e-imzalıdır)".split())
_DISTRIBUTION = re.compile(r"^\s*(?:DAĞITIM|Dağıtım)\s*:?\s*(.*)$")


def bodies_of(text: str) -> list[str]:
    """Institutions named on a line of their own, by spelling of their first occurrence."""
    out: dict[str, str] = {}
    for m in _BODY.finditer(text):
        name = " ".join(m[1].split())
        out.setdefault(name.translate(str.maketrans("İI", "iı")).lower(), name)
    return list(out.values())


def signers_of(text: str) -> list[str]:
    """Names in the last lines that a post or a signature mark follows."""
    lines = [x.strip() for x in text.split("\n") if x.strip()][-15:]
    out = []
    for line, following in zip(lines, [*lines[1:], ""]):
        low = following.translate(str.maketrans("İI", "iı")).lower().split()
        if _SIGNED.match(line) and any(w in POSTS for w in low) and line not in out:
            out.append(line)
    return out


def distribution_of(text: str) -> list[str]:
    """The units of the distribution list: what follows its heading up to a blank line."""
    out: list[str] = []
    inside = False
    for line in text.split("\n"):
        m = _DISTRIBUTION.match(line)
        if m:
            inside = True
            line = m[1]
        elif inside and not line.strip():
            if out:
                break
            continue
        if inside:
            out += [x.strip(" -•\t") for x in re.split(r"[,;]", line) if x.strip(" -•\t")]
    return list(dict.fromkeys(out))


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("kurumlar", "imzalayanlar", "dagitim")]))
def line_fields(texts: pd.Series) -> pd.DataFrame:
    """Institutions, signers and distribution of each text."""
    own = texts.fillna("")
    return pd.DataFrame({"kurumlar": own.map(bodies_of), "imzalayanlar": own.map(signers_of), "dagitim": own.map(distribution_of)})


#: The pattern fields of a text by name.
FIELDS = {
    "tarihler": dates, "evrak_tarihi": document_date, "evrak_sayisi": own_number, "referanslar": document_numbers, "konu": subject, "muhatap": recipient,
    "ilgi": reference_lines, "kimlik_numaralari": national_numbers, "telefonlar": phones, "epostalar": emails, "ibanlar": ibans, "tutarlar": amounts, "gizlilik": secrecy,
}


def fields(c: Column | str) -> Column:
    """All pattern fields of a text as one struct."""
    return F.struct(*[of(c).alias(name) for name, of in FIELDS.items()])


def missing_fields(extracted: Column | str, required: list[str]) -> Column:
    """The required fields of a struct that are null or empty; every field of the list is a scalar or an array of it."""
    x = F.col(extracted) if isinstance(extracted, str) else extracted
    return F.array_compact(F.array(*[F.when(F.coalesce(F.length(F.array_join(F.array(x[f].cast("string")), "")), F.lit(0)).isin(0, 2) & F.coalesce(x[f].cast("string"), F.lit("[]")).isin("", "[]"), F.lit(f)) for f in required]))

"""Problem 2: personal items in free text, found by type and replaced by linked placeholders.

Detection: e-mail addresses, phone numbers, national numbers (check digits) and addresses (grammar of quarter,
street, door and place) come from patterns over the text in plain characters; so do account numbers (IBAN), number plates, registry
numbers and birth dates, which are replaced but are no kind of p2_found. Names come from given names, one slip allowed, in any order and case,
with middle names and initials. A fixed list of given names is only the seed: learned is what stands with a surname of a listed given name in
extracted_info.kisi_adlari or after a label of a text, and any capitalised word that the texts of the corpus write before ``LEAST_SURNAMES``
such surnames or more and before hardly anything else (``SHARE``). A given name
written right before a capitalised surname is sure. Forms with an initial only, with a slip in the given name, in
capitals, in lower case or in reverse order are doubtful: they count if the surname occurs in a sure name anywhere in the corpus, which is
decided by a join. Things named after persons are left out by the word that follows.

Method of replacement: format-preserving Feistel pseudonyms. The digits of phone and national numbers are
permuted by a keyed Feistel network within their format (grouping kept, check digits made right again), so are
account numbers within their bank, plates and registry numbers, and birth dates within the calendar; names, addresses and e-mail addresses get a keyed code of their folded form. Equal values get equal
pseudonyms in every document, and each stands in a typed placeholder. The key comes from spark.tomar.pseudonymKey or
TOMAR_PSEUDONYM_KEY; where neither is set each query draws one of its own, so that no pseudonym can be undone with a known key.

Defined cases: null texts give nothing, empty texts stay empty; a text without items is returned unchanged; rows delivered twice
count once; overlapping items are settled for the longer, addresses before names; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import checked_broadcast, cut, spread, table

from .folding import fold
from .lookalike import IMITATORS, INVISIBLE, SPACES
from .names import ADDRESS, NO_SURNAME, given, thing
from .rows import flat_map

#: The key of the pseudonyms in tests of single functions; queries take secret_key.
KEY = os.environ.get("TOMAR_PSEUDONYM_KEY", "tomar")
KINDS = ("eposta", "telefon", "kimlik_no", "adres", "ad_soyad")
#: Surnames that a word must stand before to be learned as a given name, and the share of its capitalised followers that they must be.
LEAST_SURNAMES, SHARE = 2, 0.8


def secret_key(spark: SparkSession) -> str:
    """The configured key of the pseudonyms, or a new one."""
    return spark.conf.get("spark.tomar.pseudonymKey", None) or os.environ.get("TOMAR_PSEUDONYM_KEY") or secrets.token_hex(16)

# ---------------------------------------------------------------- plain characters

_SUSPECT = re.compile(f"[{INVISIBLE}{SPACES}̀-ͯ！-￮Ͱ-ϿЀ-ԯ]")
_PLAIN = {c: "" for c in INVISIBLE} | {c: " " for c in SPACES} | {a: b for foreign, latin in IMITATORS.values() for a, b in zip(foreign, latin)}


def aligned(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and for each the place it has in the text (none if all stay in place)."""
    if not _SUSPECT.search(text):
        return text, None
    out: list[str] = []
    place: list[int] = []
    for i, c in enumerate(text):
        if "̀" <= c <= "ͯ":
            if out:
                joined = unicodedata.normalize("NFC", out[-1] + c)
                if len(joined) == 1:
                    out[-1] = joined
            continue
        new = _PLAIN.get(c)
        if new is None:
            new = unicodedata.normalize("NFKC", c) if "！" <= c <= "￮" else c
            new = new if len(new) == 1 else c
        if new:
            out.append(new)
            place.append(i)
    return "".join(out), [*place, len(text)]


# ---------------------------------------------------------------- patterns

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT|@|et|ET)\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|nokta|NOKTA|\.)\s?[\])}>]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9çğıöşüÇĞİÖŞÜ][\w.+-]{{0,63}}{_AT}(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}}){_DOT}){{1,6}}[A-Za-z]{{2,15}}(?![\w-])")
_EMAIL_HINT = re.compile(r"@|[\[({<]\s?(?:at|AT|et|ET)\s?[\])}>]")
_IBAN = re.compile(r"\bTR\s?\d{2}(?:\s?\d){18,26}")
_DIGITS = re.compile(r"(?<![\w@/])(?<![\d][.,-])(?:\+|\()?\d(?:[ \t\n.()/-]{0,3}\d){6,15}(?!\d)")
_ELEVEN = re.compile(r"(?<![\w@/+])(?<!\d[.,-])[1-9](?:[ \t\n.-]{0,2}\d){10}(?![.,-]?\d|\w)")
_PHONE = re.compile(
    r"(?<![\w@/+(])(?<!\d[.,-])(?:(?:\+|00)\s?90|0)?[\s.-]{0,2}(?:\(\s?0?\s?([2-5]\d{2})\s?\)|([2-5]\d{2}))[\s.\-/]{0,3}(\d{3})[\s.\-]{0,2}(\d{2})[\s.\-]{0,2}(\d{2})(?!\d|[.,-]\d)"
)
_BIRTH = re.compile(
    r"(?:[dD]oğum\s+[tT]arihi|DOĞUM\s+TARİHİ|[dD]\.\s?[tT]\.)\s*:?\s*(?P<a>\d{1,2}\s?[./-]\s?\d{1,2}\s?[./-]\s?\d{4})|(?P<b>\d{1,2}\s?[./-]\s?\d{1,2}\s?[./-]\s?\d{4})(?=\s+(?:[dD]oğumlu|DOĞUMLU))"
)
_PLATE = re.compile(r"(?<![\w/.-])(?:0[1-9]|[1-7]\d|8[01])[ -]?[A-PR-VYZ]{1,3}[ -]?\d{2,4}(?![\w/-]|\.\d)")
_REGISTRY = re.compile(r"\b(?:[Ss]icil|SİCİL|[Pp]ersonel|PERSONEL|[Ee]sas\s+[Dd]efter)\s*(?:[Nn]o|NO|[Nn]umarası|[Nn]umara)\s?[.:]?\s*(\d{3,12})\b")

_NAME = r"(?:[A-ZÇĞİÖŞÜÂÎÛ][\wâîû]*(?:['’-][A-ZÇĞİÖŞÜ]\w*)?)"
_LABEL = r"(?:[Aa]dres[İIiı]?|ADRES[İI]?|[İi]kametg[âa]hı)"
_QUARTER = rf"(?:{_NAME}(?:\s+{_NAME}){{0,2}}\s+(?:[Mm]ahallesi|[Mm]ah\b\.?|[Mm]h\b\.?|MAHALLES[İI]|MAH\b\.?|MH\b\.?))"
_STREET = rf"(?:(?:{_NAME}(?:\s+{_NAME}){{0,3}}|\d{{1,5}}\s?\.?)\s+(?:[Cc]addesi|[Cc]ad\b\.?|[Cc]d\b\.?|[Ss]okağı|[Ss]okak|[Ss]ok\b\.?|[Ss]k\b\.?|[Bb]ulvarı|[Bb]ulv\b\.?|[Bb]lv\b\.?|[Mm]eydanı|[Yy]olu|CADDES[İI]|CAD\b\.?|CD\b\.?|SOKA[KĞ]I?|SOK\b\.?|SK\b\.?|BULVARI|BLV\b\.?))"
_BUILDING = rf"(?:(?:{_NAME}(?:\s+{_NAME}){{0,2}}|[A-Z]\d?)\s+(?:[Aa]pt\b\.?|[Aa]partmanı|[Aa]p\b\.?|[Ss]itesi|[Ss]it\b\.?|[Bb]lok|[Bb]l\b\.?|[İi]ş\s+(?:[Hh]anı|[Mm]erkezi)))"
_DOOR = r"(?:(?:[Kk]apı\s+)?(?:[Nn]o|NO|[Nn]u|[Nn]umara)\s?[:.]?\s?\d{1,5}(?:\s?[/-]\s?(?:\d{1,4}|[A-Z]\b(?!\s?[:.]?\s?\d)))?(?:[A-Z]\b(?!\s?[:.]?\s?\d))?)"
_FLAT = r"(?:(?:[Dd]aire|[Dd]|DA[İI]RE|[Kk]at|[Kk]t|KAT|K|[Bb]lok)\s?[:.]?\s?\d{1,4})"
_SEP = r"(?:\s*[,;]\s*|\s+)"
_PLACE = rf"(?:{_NAME}(?:\s+{_NAME}){{0,1}})"
_ADDRESS = re.compile(
    rf"(?<!\w)(?:{_QUARTER}{_SEP})?(?:{_STREET}{_SEP}){{0,2}}(?:{_BUILDING}{_SEP})?{_DOOR}(?:{_SEP}{_FLAT}){{0,3}}(?:\s*[,]?\s*{_NAME}(?:\s*/\s*{_NAME}){{0,2}})?"
)
_HAS_STREET = re.compile(rf"{_QUARTER}|{_STREET}")
_ADDRESS_HINT = re.compile(r"[Nn][Oo]\s?[:.]?\s?\d|[Nn]umara\s?:?\s?\d|[Nn]u\s?[:.]\s?\d")
_NOT_PLACE = re.compile(r"(?:Tel|Telefon|TEL|Cep|Faks|E-?[Pp]osta|T\.?C|Kimlik|Adres|İmza|Ben|Bu|Dahili|Konu|Tarih|Sayı|Talep)\b")


def national_number(digits: str) -> bool:
    """Whether eleven digits are a national number: both check digits are right."""
    d = [int(c) for c in digits]
    return len(d) == 11 and d[0] != 0 and (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


# ---------------------------------------------------------------- names

# A digit between letters is a misread letter of a scan.
_TOKEN = re.compile(r"[^\W\d_]+(?:[0-9!|]{1,2}[^\W\d_]+)*")
_caches: dict[frozenset[str], dict[str, tuple[str, str, int, bool]]] = {}


def _word(word: str, more: frozenset[str], cache: dict) -> tuple[str, str, int, bool]:
    """(case, folded form, given name, surname may be) of a word."""
    known = cache.get(word)
    if known is None:
        if len(cache) > 300_000:
            cache.clear()
        folded = fold(word)
        if len(word) == 1:
            case = "I" if word.isupper() else "l"
        elif word.isupper():
            case = "U"
        elif word[0].isupper():
            case = "T"
        else:
            case = "l"
        known = cache[word] = (case, folded, given(folded, more), len(folded) > 2 and folded not in NO_SURNAME and not thing(folded))
    return known


def names(text: str, more: frozenset[str] = frozenset()) -> list[tuple[int, int, str, bool]]:
    """(start, end, folded surname, sure) of what may be names; more has given names beyond the lists."""
    cache = _caches.setdefault(more, {})
    tokens = [(m.start(), m.end(), *_word(m[0], more, cache)) for m in _TOKEN.finditer(text)]
    out: list[tuple[int, int, str, bool]] = []
    n, i = len(tokens), 0

    def gap(a: int, b: int) -> str:
        return text[tokens[a][1] : tokens[b][0]]

    def near(a: int, b: int) -> bool:
        """Only white space between two words, on one line or over one line end."""
        g = gap(a, b)
        return 0 < len(g) < 30 and not g.strip() and g.count("\n") < 2 and "\f" not in g

    def initial(a: int) -> bool:
        """A single capital with its full stop."""
        return 0 <= a < n and tokens[a][2] == "I" and text[tokens[a][1] : tokens[a][1] + 1] == "."

    def after_initial(a: int, b: int) -> bool:
        g = gap(a, b)
        return b < n and g.startswith(".") and not g[1:].strip() and g.count("\n") < 2 and len(g) < 8

    def alike(a: str, b: str) -> bool:
        return (a in "TU" and b in "TU" and not (a == "U" and b == "T")) or (a == b == "l")

    def named_thing(last: int, end: int) -> bool:
        """Whether what follows makes it the name of a thing."""
        k = last + 1
        return k < n and not text[end : tokens[k][0]].strip() and thing(tokens[k][3]) and not text[end : tokens[k][0]].count("\n\n")

    while i < n:
        start, end, case, folded, is_given, able = tokens[i]
        found = None
        if is_given and (case in "TU" or (case == "l" and is_given == 2)) and len(folded) > 2:
            j, middle_sure = i + 1, True
            # Middle names and initials, then the surname.
            for _ in range(2):
                if j + 1 < n and initial(j) and near(i if j == i + 1 else j - 1, j) and after_initial(j, j + 1):
                    j += 1
                elif j + 1 < n and near(j - 1, j) and tokens[j][3] in ADDRESS and near(j, j + 1) and tokens[j + 1][5]:
                    j += 1
                elif j + 1 < n and near(j - 1, j) and tokens[j][4] == 2 and alike(case, tokens[j][2]) and near(j, j + 1) and tokens[j + 1][5] and alike(case, tokens[j + 1][2]) and not thing(tokens[j + 1][3]):
                    j += 1
                else:
                    break
            joined = j < n and (near(j - 1, j) if not initial(j - 1) else after_initial(j - 1, j))
            if joined and tokens[j][5] and alike(case, tokens[j][2]) and not (case == "l" and len(tokens[j][3]) < 5):
                sure = is_given == 2 and case == "T" and "\n" not in gap(j - 1, j)
                found = (start, tokens[j][1], tokens[j][3], sure, j)
            # Surname before the given name, with or without a comma.
            back = i - 1
            if back >= 0 and tokens[back][2] in "TU" and tokens[back][5] and case in "TU" and not tokens[back][4] == 2:
                g = gap(back, i)
                comma = re.fullmatch(r",\s{1,3}", g) is not None
                if comma or (near(back, i) and not found) or (near(back, i) and found and not found[3]):
                    if not (out and out[-1][1] > tokens[back][0]):
                        if found:
                            out.append((found[0], found[1], found[2], found[3]))
                        found = (tokens[back][0], end, tokens[back][3], False, i)
        elif case == "I" and initial(i) and i + 1 < n and after_initial(i, i + 1):
            # Initials before a surname.
            j = i + 1
            if initial(j) and j + 1 < n and after_initial(j, j + 1):
                j += 1
            if tokens[j][2] in "TU" and tokens[j][5] and (i == 0 or not (initial(i - 1) and gap(i - 1, i) == ".")):
                found = (start, tokens[j][1], tokens[j][3], False, j)
        if not found and case in "TU" and able and i + 1 < n and initial(i + 1) and near(i, i + 1) and len(folded) > 3:
            # A surname before an initial.
            found = (start, tokens[i + 1][1] + 1, folded, False, i + 1)
        if found:
            if not named_thing(found[4], found[1]):
                out.append(found[:4])
            if found[3]:
                i = found[4]
        i += 1
    return out


# ---------------------------------------------------------------- items

_TITLE_PLACE = re.compile(r"[\s,/]+$")


def items(text: str, more: frozenset[str] = frozenset(), more_kinds: bool = False) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, tur, folded surname, sure) of the personal items of a text, in places of the text; more_kinds beyond KINDS."""
    plain, place = aligned(text)
    taken: list[tuple[int, int, str, str, bool]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, *_ in taken)

    if _EMAIL_HINT.search(plain):
        for m in _EMAIL.finditer(plain):
            taken.append((m.start(), m.end(), "eposta", "", True))
    ibans = [(m.start(), m.end()) for m in _IBAN.finditer(plain)] if "TR" in plain else []
    if _DIGITS.search(plain):
        for m in _ELEVEN.finditer(plain):
            if national_number(re.sub(r"\D", "", m[0])) and free(*m.span()) and all(m.end() <= a or m.start() >= b for a, b in ibans):
                taken.append((*m.span(), "kimlik_no", "", True))
        for m in _PHONE.finditer(plain):
            a, b = m.span()
            a += len(m[0]) - len(m[0].lstrip(" \t\n.-/"))
            if all(b <= x or a >= y for x, y in ibans) and free(a, b) and plain[a:b].count("(") == plain[a:b].count(")"):
                body = re.sub(r"\D", "", plain[a:b])
                # Ten digits without any sign of a phone are some other number.
                if len(body) > 10 or plain[a] in "+(0" or re.search(r"\D", plain[a:b]):
                    taken.append((a, b, "telefon", "", True))
    if _ADDRESS_HINT.search(plain):
        for m in _ADDRESS.finditer(plain):
            a, b = m.span()
            street = _HAS_STREET.search(plain, a, b)
            if not street:
                continue
            a = street.start()
            # A place that is a label, or that the next word makes a name or a label of its own, is none.
            tail = re.search(rf"\s*,?\s*({_NAME}(?:\s*/\s*{_NAME})*)$", plain[a:b])
            if tail and _NOT_PLACE.match(tail[1]):
                b = a + tail.start()
            label = re.match(rf"{_LABEL}\s*:?\s+", plain[a:b])
            if label:
                a += label.end()
            if free(a, b):
                taken.append((a, b, "adres", "", True))
    numbers = [x for x in taken]
    spans = [(a, b, s, sure) for a, b, s, sure in names(plain, more) if all(b <= x or a >= y for x, y, *_ in numbers)]
    taken += [(a, b, "ad_soyad", s, sure) for a, b, s, sure in spans]
    if more_kinds:
        for kind, found in (
            ("iban", ibans),
            ("dogum_tarihi", [m.span("a" if m["a"] else "b") for m in _BIRTH.finditer(plain)]),
            ("sicil_no", [m.span(1) for m in _REGISTRY.finditer(plain)]),
            ("plaka", [m.span() for m in _PLATE.finditer(plain)]),
        ):
            taken += [(a, b, kind, "", True) for a, b in found if free(a, b)]
    out = []
    for a, b, kind, s, sure in taken:
        while a < b and plain[b - 1] in " \t\n,;:":
            b -= 1
        out.append((a, b, kind, s, sure) if place is None else (place[a], place[b - 1] + 1, kind, s, sure))
    return sorted(out)


def value(text: str) -> str:
    """An item as it stands, runs of white space made one space."""
    return " ".join(text.split())


def settled(found: list[tuple[int, int, str, str, bool]]) -> list[tuple[int, int, str, str, bool]]:
    """The items without overlaps: sure before doubtful, then the longer."""
    out: list = []
    for x in sorted(found, key=lambda x: (not x[4], x[0] - x[1], x[0])):
        if all(x[1] <= y[0] or x[0] >= y[1] for y in out):
            out.append(x)
    return sorted(out)


# ---------------------------------------------------------------- pseudonyms


def _round(key: bytes, n: int, half: int, tweak: str) -> int:
    return int.from_bytes(hmac.new(key, f"{tweak}:{n}:{half}".encode(), hashlib.sha256).digest()[:8], "big")


def feistel(number: int, digits: int, tweak: str, key: str = KEY, back: bool = False) -> int:
    """A keyed permutation of the numbers of so many digits: eight rounds over two halves."""
    a, b = 10 ** (digits // 2), 10 ** (digits - digits // 2)
    left, right = number // b, number % b
    secret = key.encode()
    for n in range(7, -1, -1) if back else range(8):
        sign = -1 if back else 1
        if n % 2 == 0:
            left = (left + sign * _round(secret, n, right, tweak)) % a
        else:
            right = (right + sign * _round(secret, n, left, tweak)) % b
    return left * b + right


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _account(digits: str, key: str) -> str:
    """The digits of an account number: those of the bank stay, the account is permuted, the check digits are right again."""
    bank, account = digits[2:7], digits[7:]
    account = f"{feistel(int(account), len(account), 'iban', key):0{len(account)}d}"
    # T and R count as 29 and 27 behind the number, with 00 for the check digits.
    return f"{98 - int(f'{bank}{account}292700') % 97:02d}{bank}{account}"


def _plate(text: str, digits: str, key: str) -> str:
    """A number plate of the same province and form."""
    letters = [c for c in text if c.isalpha()]
    base = "ABCDEFGHIJKLMNOPRSTUVYZ"
    number = 0
    for c in letters:
        number = number * len(base) + base.index(c)
    width, size = len(str(len(base) ** len(letters) - 1)), len(base) ** len(letters)
    number = feistel(number, width, "plaka", key)
    while number >= size:
        number = feistel(number, width, "plaka", key)
    new = ""
    for _ in letters:
        new, number = base[number % len(base)] + new, number // len(base)
    tail = digits[2:]
    row = iter(digits[:2] + f"{feistel(int(tail), len(tail), 'plaka', key):0{len(tail)}d}")
    own = iter(new)
    return "".join(next(row) if c.isdigit() else next(own) if c.isalpha() else c for c in text)


def pseudonym(kind: str, text: str, key: str = KEY) -> str:
    """What stands for an item: of the same format for numbers and dates, else a code."""
    digits = "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())
    if kind == "kimlik_no":
        n = feistel(int(digits[:9]), 9, "kimlik", key)
        while n < 10**8:  # the first digit isn't zero: walk on within the format
            n = feistel(n, 9, "kimlik", key)
        d = [int(c) for c in str(n)]
        tenth = (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10
        return _refill(text, f"{n}{tenth}{(sum(d) + tenth) % 10}")
    if kind == "telefon":
        body = digits[-10:]
        return _refill(text, digits[:-10] + body[:3] + f"{feistel(int(body[3:]), 7, body[:3], key):07d}")
    if kind == "dogum_tarihi":
        first = date(1900, 1, 1)
        d, m, y = (int(x) for x in re.findall(r"\d+", text))
        try:
            n = (date(y, m, d) - first).days
        except ValueError:
            return re.sub(r"\d", "0", text)
        span = (date(2030, 1, 1) - first).days
        if not 0 <= n < span:
            return re.sub(r"\d", "0", text)
        n = feistel(n, 5, "tarih", key)
        while n >= span:
            n = feistel(n, 5, "tarih", key)
        new = first + timedelta(days=n)
        return _refill(re.sub(r"\d+", lambda k: "0" * (4 if len(k[0]) == 4 else 2), text), f"{new.day:02d}{new.month:02d}{new.year:04d}")
    if kind == "iban":
        return _refill(text, _account(digits, key))
    if kind == "sicil_no":
        return _refill(text, f"{feistel(int(digits), len(digits), kind, key):0{len(digits)}d}")
    if kind == "plaka":
        return _plate(text, digits, key)
    words = " ".join(sorted(re.findall(r"\w+", fold(text)))) if kind == "ad_soyad" else fold(text)
    start = int.from_bytes(hashlib.sha256(words.encode()).digest()[:8], "big") % 10**12
    return f"{feistel(start, 12, kind, key):012d}"


def masked(text: str, found: list[tuple[int, int, str]], key: str = KEY) -> str:
    """The text with a typed placeholder in place of each (start, end, kind)."""
    out, at = [], 0
    for a, b, kind in sorted(found):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()} {pseudonym(kind, value(text[a:b]), key)}]"]
            at = b
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- plans


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tablo, kayit_id, alan, metin) of the three fields."""
    state = spread(table(spark, sf_dir, "agent_state").select("evrak_id", "raw_text"))
    register = spread(table(spark, sf_dir, "islemler").select("id", "metin_ozu", "ozet_ilk_200"))
    one = lambda df, name, key, field: df.select(F.lit(name).alias("tablo"), F.col(key).alias("kayit_id"), F.lit(field).alias("alan"), F.col(field).alias("metin"))
    return one(state, "agent_state", "evrak_id", "raw_text").unionByName(one(register, "islemler", "id", "metin_ozu")).unionByName(one(register, "islemler", "id", "ozet_ilk_200")).where("metin <> ''")


_ITEMS = "tablo string, kayit_id bigint, alan string, ozet bigint, bas int, son int, tur string, deger string, soyad string, kesin boolean"


#: Labels that a person's name follows, and the two words after one.
_LABELLED = r"\b(?=[BbAaTtSsD])(?:[Bb]ilgi için\s*:|BİLGİ İÇİN\s*:|[Aa]dı [Ss]oyadı\s*:|ADI SOYADI\s*:|[Tt]eslim alan|[Bb]aşvuru sahibi|[Tt]anık olarak dinlenen|[Ss]ayın|Dr\.)\s+(\p{Lu}\p{L}{2,},?[ \t]+\p{Lu}\p{L}{2,})"


#: Runs of capitalised words in a text.
_RUN = r"\b[A-ZÇĞİÖŞÜÂÎÛ][a-zçğıöşüâîû]{2,}+(?:[ \t]++[A-ZÇĞİÖŞÜÂÎÛ][a-zçğıöşüâîû]{2,}+)++"


def learned(persons: DataFrame, rows: DataFrame) -> frozenset[str]:
    """The folded given names beyond the lists that persons(ad), the labels and the words before surnames in rows(metin) hold.

    A word of a name without a listed given name is one if its partner is the surname of a listed given name, and so is a word that
    texts write before several such surnames and hardly before other capitalised words. Given names are a
    closed class, whose size follows the language and not the rows: only they come to the driver.
    """
    labelled = F.transform(F.regexp_extract_all("metin", F.lit(_LABELLED), F.lit(1)), lambda x: F.struct(F.lit("etiket").alias("tur"), x.alias("ad")))
    # Neighbours within a run, so that few different pairs are left to look at.
    neighbours = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    runs = F.flatten(F.transform(F.regexp_extract_all("metin", F.lit(_RUN), F.lit(0)), lambda x: neighbours(F.split(x, "[ \t]+"))))
    runs = F.transform(runs, lambda x: F.struct(F.lit("dizi").alias("tur"), x.alias("ad")))
    # explode would evaluate the patterns once more to ask for empty arrays.
    texts_ = rows.select(F.explode_outer(F.concat(labelled, runs)).alias("x")).select("x.tur", "x.ad")
    own = cut(persons.select(F.lit("kisi").alias("tur"), "ad").unionByName(texts_).where("ad is not null").groupBy("tur", "ad").agg(F.count("*").alias("n")))

    def make():
        cache = _caches.setdefault(frozenset(), {})

        def run(batch):
            for r in batch:
                words = [_word(m[0], frozenset(), cache) for m in _TOKEN.finditer(aligned(r["ad"])[0])]
                if r["tur"] == "dizi":
                    for (_, f, g, able), (_, h, _, next_able) in zip(words, words[1:]):
                        if not g and able and f not in ADDRESS:
                            yield "dizi", f, h if next_able else "", r["n"]
                    continue
                full = [(f, g) for _, f, g, able in words if f not in ADDRESS and (able or g == 2 and len(f) > 2)]
                if len(full) < 2:
                    continue
                (first, g), (last, h) = full[0], full[-1]
                if (g == 2) != (h == 2):
                    yield "kesin", None, last if g == 2 else first, r["n"]
                elif not g and not h:
                    yield "aday", first, last, r["n"]
                    yield "aday", last, first, r["n"]

        return run

    pairs = cut(flat_map(own, make, "tur string, ad string, soyad string, n bigint").groupBy("tur", "ad", "soyad").agg(F.sum("n").alias("n")))
    sure = pairs.where("tur = 'kesin'").select("soyad").distinct()
    known = pairs.where("tur = 'aday'").select("ad", "soyad").distinct().join(sure, "soyad", "left_semi").select("ad")
    before = pairs.where("tur = 'dizi'").join(sure.withColumn("var", F.lit(1)), "soyad", "left").groupBy("ad").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("var") == 1, F.col("n")).otherwise(0)).alias("m"), F.count("var").alias("k"))
    written = before.where((F.col("k") >= LEAST_SURNAMES) & (F.col("m") >= SHARE * F.col("n"))).select("ad")
    found = known.unionByName(written).distinct().join(sure.select(F.col("soyad").alias("ad")), "ad", "left_anti")
    return frozenset(r.ad for r in found.collect())


def given_names(spark: SparkSession, sf_dir: str, rows: DataFrame) -> frozenset[str]:
    """The given names learned from the names and texts of the corpus."""
    return learned(table(spark, sf_dir, "agent_state").select(F.explode("extracted_info.kisi_adlari").alias("ad")), rows)


def detected(rows: DataFrame, more: frozenset[str] = frozenset(), more_kinds: bool = False) -> DataFrame:
    """Every item of rows(tablo, kayit_id, alan, metin) with its place, doubtful names included; ozet is a hash of the text."""

    def make():
        def run(batch):
            for r in batch:
                text = r["metin"]
                for a, b, kind, surname, sure in items(text, more, more_kinds):
                    yield r["tablo"], r["kayit_id"], r["alan"], r["ozet"], a, b, kind, value(text[a:b]), surname, sure

        return run

    return flat_map(rows.select("tablo", "kayit_id", "alan", F.xxhash64("metin").alias("ozet"), "metin"), make, _ITEMS)


def confirmed(found: DataFrame) -> DataFrame:
    """The sure items, and the doubtful names whose surname some sure name has; with the columns of found."""
    own = cut(found)
    evidence = own.where("kesin and tur = 'ad_soyad'").select("soyad").distinct()
    doubtful = own.where("not kesin").join(checked_broadcast(evidence), "soyad", "left_semi")
    return own.where("kesin").unionByName(doubtful.select(*own.columns))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each personal item."""
    rows = texts(spark, sf_dir)
    return confirmed(detected(rows, given_names(spark, sf_dir, rows))).select("tablo", "kayit_id", "alan", "tur", "deger").distinct()


def placeholders(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(tablo, kayit_id, alan, metin, oge_sayisi): rows(tablo, kayit_id, alan, metin) with the items of found replaced, each row once."""
    record = ["tablo", "kayit_id", "alan", "ozet"]
    known = found.groupBy(*record).agg(F.collect_set(F.struct("bas", "son", "tur", "kesin")).alias("ogeler"))
    both = rows.withColumn("ozet", F.xxhash64("metin")).dropDuplicates(record).join(known, record, "left")

    def make():
        def run(batch):
            for r in batch:
                own = settled([(x["bas"], x["son"], x["tur"], "", x["kesin"]) for x in r["ogeler"] or ()])
                yield r["tablo"], r["kayit_id"], r["alan"], masked(r["metin"], [x[:3] for x in own], key), len(own)

        return run

    return flat_map(both, make, "tablo string, kayit_id bigint, alan string, metin string, oge_sayisi int")


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders, and how many. The patterns are read once; their places come back by a join."""
    rows = texts(spark, sf_dir)
    found = confirmed(detected(rows, given_names(spark, sf_dir, rows), more_kinds=True))
    return placeholders(rows, found, secret_key(spark))


QUERIES = {"p2_found": p2_found, "p2_masked": p2_masked}
SQL: dict[str, str] = {}

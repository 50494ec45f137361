"""Comparable forms of words: without letter case, accents, punctuation and look-alike characters."""

from __future__ import annotations

import re
import unicodedata

from .lookalike import IMITATORS, INVISIBLE

_TABLE = {ord(c): None for c in INVISIBLE}
_TABLE |= {c: None for c in range(0x300, 0x370)}
_TABLE |= {ord(a): b.lower() for foreign, latin in IMITATORS.values() for a, b in zip(foreign, latin)}
_TABLE |= {ord("ı"): "i", ord("ə"): "e", ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("đ"): "d", ord("ł"): "l"}
_MARKS = re.compile("[\u0300-\u036f]+")
_RARE = re.compile("[" + "".join(sorted(chr(c) for c in _TABLE if not 0x300 <= c < 0x370 and c != ord("ı"))).replace("-", "\\-") + "]")
_WORD = re.compile(r"[^\W_]+")
_GAPS = re.compile(r"[^\w\n ]+|_")


def fold(text: str) -> str:
    """Lower case without accents, in compatibility form; punctuation and white space stay."""
    if text.isascii():
        return text.lower()
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", text).lower()).replace("ı", "i")
    # Only texts with rarer characters pay for a look at each character.
    return plain.translate(_TABLE) if _RARE.search(plain) else plain


def words(text: str) -> list[str]:
    """The runs of letters and digits of a folded text."""
    return _WORD.findall(text)


def squeezed(text: str) -> list[str]:
    """What white space separates, folded and without punctuation; what has no letter or digit is left out."""
    return [w for w in _GAPS.sub("", fold(text).replace("\n", " ")).split() if w]

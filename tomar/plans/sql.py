"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from tomar.functions.text import SHARED_STOP_WORDS, STOP_WORDS


def listed(words) -> str:
    """A list literal."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP, TELLING = listed(STOP_WORDS), listed([w for w in STOP_WORDS if w not in SHARED_STOP_WORDS])


def low(c: str) -> str:
    return f"lower(translate({c}, 'İIÇÖÜŞĞ', 'iıçöüşğ'))"


def tok(c: str) -> str:
    return f"list_filter(regexp_extract_all({low(c)}, '[a-zçğıöşüâîû0-9]+'), lambda t: length(t) >= 2 and not list_contains({STOP}, t))"


def facts(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(coalesce({c}, ''), '\d[\d.,/:\-]*\d|\d'))"


def count_words(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> ''))"

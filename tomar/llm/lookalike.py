"""Problem 6: text that looks the same but is made of other characters.

Method: look-alike classes are the connected classes (union-find) over strings and code points that are
joined by a rule: full-width and compatibility forms (mathematical letters, ligatures) with what Unicode says they stand for, a letter and its
separate marks with the composed letter, spaces with the space, characters of no width with nothing, letters of
another alphabet with the Latin letter that they imitate, and signs that are drawn alike (apostrophes, quotation marks, hyphens,
dashes, three dots) with each other. The representative of a class is the member that
the corpus writes most often, counted over all texts, among those that no rule calls another form of something; of the signs any can
represent. Ties and unseen classes go to the plainest form. Texts are
rewritten greedily, leftmost and longest first, by one multi-pattern automaton, again until nothing changes. Letters of other alphabets
are rewritten only inside words that hold Latin letters, and only if every foreign letter of the word is an
imitator, so that foreign words and unit signs stay; superscripts, fractions and squared units stay too.

Defined cases: null stays null, empty stays empty; text without deviations is returned unchanged; an
unknown combining sequence is composed as far as Unicode composes it, a mark left over after an i or a j that has its dot
already is dropped, any other stays; repeated rows are handled alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import spread, table

from .rows import flat_map

#: Letters of the Cyrillic and Greek alphabets beside the Latin letters that they imitate.
IMITATORS = {
    "Cyrillic": ("аеорсухѕіјһԁԛԝѵАВЕКМНОРСТУХЅІЈԌԚԜѴ", "aeopcyxsijhdqwvABEKMHOPCTYXSIJGQWV"),
    "Greek": ("ονϲϳικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ovcjikuABEZHIKMNOPTYXCC"),
}
#: Characters of no width (soft hyphen, joiners, marks of direction, byte-order mark).
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Spaces other than the ordinary one.
SPACES = "               　"
KINDS = ("tam_genislik", "birlesen", "gorunmez", "bosluk", "benzer_harf")
#: Signs that are drawn alike; the corpus decides which one stays.
ALIKE = ("' ’ ‘ ʼ ʹ ′ ‛".split(), '" “ ” „ ‟ ″'.split(), "- ‐ ‑ −".split(), "– ‒".split(), "— ―".split(), "... …".split())


@cache
def compatible() -> list[tuple[str, str]]:
    """(plain form, other form) of letters and digits that Unicode has once more as fonts or ligatures, from its own tables."""
    out = []
    for code in range(0x80, 0x20000):
        c = chr(code)
        if unicodedata.decomposition(c).startswith(("<font>", "<compat>")) and unicodedata.category(c)[0] in "LN":
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and all(x.isalnum() and "LATIN" in unicodedata.name(x, "") or x in "0123456789" for x in plain):
                out.append((plain, c))
    return out


def pairs() -> list[tuple[str, str, str]]:
    """(kind, plain form, other form) of every rule; generated but for the fixed values above."""
    out = [("gorunmez", "", c) for c in INVISIBLE] + [("bosluk", " ", c) for c in SPACES]
    out += [("tam_genislik", unicodedata.normalize("NFKC", chr(c)), chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.east_asian_width(chr(c)) == "F"]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        apart = unicodedata.normalize("NFD", chr(code))
        if len(apart) > 1:
            out.append(("birlesen", chr(code), apart))
            if len(apart) == 3:
                out.append(("birlesen", chr(code), unicodedata.normalize("NFC", apart[:2]) + apart[2]))
                out.append(("birlesen", chr(code), apart[0] + apart[2] + apart[1]))
    out += [("birlesen", "i", "i̇"), ("birlesen", "j", "j̇"), ("birlesen", "İ", "İ̇")]
    for foreign, latin in IMITATORS.values():
        out += [("benzer_harf", b, a) for a, b in zip(foreign, latin)]
    known = {b for _, _, b in out}
    out += [("uyumluluk", a, b) for a, b in compatible() if b not in known]
    out += [("", first, other) for first, *others in ALIKE for other in others]
    return out


class Classes:
    """Transitive look-alike classes over strings."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.parent: dict[str, str] = {}
        self.kind: dict[str, str] = {}
        for kind, a, b in rules:
            if kind:
                self.kind.setdefault(b, kind)
            self.union(a, b)

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def rewrites(self, counts: dict[str, int]) -> dict[str, tuple[str, str]]:
        """other form -> (representative, kind); representatives by frequency, then by plainness."""
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        out = {}
        for members in groups.values():
            # Only characters that some rule calls plain can represent: an invisible character never wins over nothing.
            able = [m for m in members if m not in self.kind] or members
            best = max(able, key=lambda m: (counts.get(m, 0), -len(m), [-ord(c) for c in m]))
            out.update({m: (best, self.kind.get(m, "isaret")) for m in members if m != best and (m in self.kind or m in _SIGNS)})
        return out


_SIGNS = frozenset(x for group in ALIKE for x in group)
_STRINGS = [x for x in sorted(_SIGNS) if len(x) > 1]


def character_counts(texts: DataFrame, column: str) -> DataFrame:
    """(bicim, n): how often each character, and each sign of several, occurs in the corpus; counted per batch, then summed."""

    def make():
        def run(rows):
            joined = "\n".join(r[column] or "" for r in rows)
            units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            for code, n in zip(*np.unique(units, return_counts=True)):
                if not 0xD800 <= code < 0xE000:
                    yield chr(code), int(n)
            for form in _STRINGS:
                yield form, joined.count(form)

        return run

    return flat_map(texts.select(column), make, "bicim string, n bigint").groupBy("bicim").agg(F.sum("n").alias("n"))


_WORD = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")


class Rewriter:
    """One consistent form of a text and the kinds of deviating characters in it."""

    def __init__(self, counts: dict[str, int]):
        import ahocorasick

        rewrites = Classes(pairs()).rewrites(counts)
        self.letters = {a for a, (_, kind) in rewrites.items() if kind == "benzer_harf"}
        self.automaton = ahocorasick.Automaton()
        for other, (plain, kind) in rewrites.items():
            self.automaton.add_word(other, (len(other), plain, kind))
        self.automaton.make_automaton()
        self.strings = [x for x in rewrites if len(x) > 1 and x.isascii()]
        self.table = np.zeros(0x110000, bool)
        self.table[[*(ord(x) for x in rewrites if len(x) == 1), *range(0x300, 0x370)]] = True

    def suspect(self, text: str) -> bool:
        """Whether a text may hold a form that is rewritten."""
        return bool(self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any()) or any(x in text for x in self.strings)

    def __call__(self, text: str | None) -> tuple[str | None, set[str]]:
        kinds: set[str] = set()
        if not text or not self.suspect(text):
            return text, kinds
        # Invisible characters and forms may stand between a letter and its mark: rewrite until nothing changes.
        while self.suspect(text):
            out, at = [], 0
            imitating = self._imitating(text) if _FOREIGN.search(text) else []
            for end, (length, plain, kind) in self.automaton.iter_long(text):
                start = end - length + 1
                if kind == "benzer_harf" and not any(a <= start < b for a, b in imitating):
                    continue
                out += [text[at:start], plain]
                at = end + 1
                kinds.add(kind)
            if not at:
                break
            text = "".join([*out, text[at:]])
        if re.search(r"[^\W\d_][̀-ͯ]", text):
            kinds.add("birlesen")
            text = unicodedata.normalize("NFC", text)
        return text, kinds

    def _imitating(self, text: str) -> list[tuple[int, int]]:
        """The words with Latin letters all of whose foreign letters are imitators."""
        out = []
        for m in _WORD.finditer(text):
            foreign = _FOREIGN.findall(m[0])
            if foreign and len(foreign) < len(m[0]) and self.letters.issuperset(foreign):
                out.append(m.span())
        return out


def canonical(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text, kinds): each text in one consistent form. One count over all texts chooses the forms.

    The counts that reach the driver, and the table broadcast, are those of the forms of the rules only, some thousand rows.
    """
    known = texts.sparkSession.createDataFrame([(x,) for x in sorted({x for _, a, b in pairs() for x in (a, b) if x})], "bicim string")
    counts = {r.bicim: r.n for r in character_counts(texts, column).join(F.broadcast(known), "bicim").collect()}

    def make():
        rewrite = Rewriter(counts)

        def run(rows):
            for r in rows:
                text, kinds = rewrite(r[column])
                yield r[key], text, sorted(kinds)

        return run

    return flat_map(texts.select(key, column), make, "evrak_id bigint, metin string, turler array<string>")


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw_text in its consistent form, with the kinds of characters that were replaced."""
    return canonical(spread(table(spark, sf_dir, "agent_state").select("evrak_id", "raw_text")), "evrak_id", "raw_text").where("metin is not null")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and kind of deviating character."""
    return p6_canonical(spark, sf_dir).select("evrak_id", F.explode("turler").alias("tur")).where(F.col("tur").isin(*KINDS)).distinct()


QUERIES = {"p6_found": p6_found, "p6_canonical": p6_canonical}
SQL: dict[str, str] = {}

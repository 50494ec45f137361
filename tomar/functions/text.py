"""Text functions as Spark columns: Turkish case, tokens, counts, language signals, n-grams, facts.

Null in, null out, unless a function says otherwise; empty text has no tokens, facts or grams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop-words of the tokeniser, and those that other languages share.
STOP_WORDS = """
bir ve bu da de ile için olan olarak gibi veya ancak fakat ama çünkü hem ne ya ki daha en çok az her tüm hiç bazı diğer aynı böyle şu o ben sen biz siz onlar
ise olup olduğu üzere kadar sonra önce arasında içinde üzerinde altında yanında tarafından hakkında ilgili göre karşı rağmen
""".split()
SHARED_STOP_WORDS = "de da en o ne ya her ben sen az".split()
TOKEN = "[a-zçğıöşüâîû0-9]+"
FACT = r"\d[\d.,/:\-]*\d|\d"
#: Shares of special letters and of stop-words from which a text counts as Turkish, and the letters needed to tell.
SPECIAL_SHARE, STOP_SHARE, LEAST_LETTERS = 0.01, 0.05, 20
#: Fixed value: letters and digits that a readable text has.
READABLE = 30


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column | str, function) -> Column:
    """function of a value that is evaluated once, however often the function refers to it."""
    return F.element_at(F.transform(F.array(_col(c)), lambda x: function(x)), 1)


def tr_lower(c: Column | str) -> Column:
    """Turkish lower case: dotted and dotless i keep their kind."""
    return F.lower(F.replace(F.replace(_col(c), F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def tr_upper(c: Column | str) -> Column:
    """Turkish upper case."""
    return F.upper(F.translate(_col(c), "iıçöüşğ", "İIÇÖÜŞĞ"))


def ascii_fold(c: Column | str) -> Column:
    """Lower-case Turkish letters without their marks."""
    return F.translate(_col(c), "çğıöşüâîû", "cgiosuaiu")


def fold_marks(c: Column | str) -> Column:
    """Both cases of Turkish letters without their marks."""
    return F.translate(_col(c), "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")


def squeeze(c: Column | str) -> Column:
    """Turkish lower case with runs of white space made one space."""
    return F.trim(F.regexp_replace(tr_lower(c), r"[ \t\n\r\f]+", " "))


def tokens(c: Column | str) -> Column:
    """Tokens of two characters or more without stop-words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    found = F.regexp_extract_all(tr_lower(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def words(c: Column | str) -> Column:
    """What white space separates."""
    return F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """How many words a text has."""
    return F.size(words(c))


def without_stop_words(c: Column | str) -> Column:
    """The words of a text that are no stop-words, in one line."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_join(F.filter(words(c), lambda w: ~F.array_contains(stop, F.lower(F.translate(w, "İIÇÖÜŞĞ", "iıçöüşğ")))), " ")


def cleaned(c: Column | str) -> Column:
    """No control characters, at most one blank line in a row, no white space at line ends."""
    plain = F.regexp_replace(_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    lines = F.split(F.regexp_replace(plain, r"\n{3,}", "\n\n"), "\n")
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), "\n")
    return F.regexp_replace(joined, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def letters(c: Column | str) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(_col(c), r"[^\p{L}]+", ""))


def _special(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^çğıöşüÇĞİÖŞÜ]+", ""))


def language_signals(c: Column | str) -> Column:
    """Letters, words, share of special letters, share of telling stop-words."""
    c = _col(c)
    telling = [w for w in STOP_WORDS if w not in SHARED_STOP_WORDS]
    own = F.regexp_extract_all(tr_lower(c), F.lit(r"\p{L}+"), F.lit(0))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))

    def signals(x: Column) -> Column:
        hits = F.size(F.filter(x["w"], lambda w: w.isin(telling)))
        return F.struct(x["n"].alias("harf_sayisi"), F.size(x["w"]).alias("kelime_sayisi"), share(x["s"], x["n"]).alias("turkce_karakter_orani"), share(hits, F.size(x["w"])).alias("durak_kelime_orani"))

    return bound(F.struct(letters(c).alias("n"), _special(c).alias("s"), own.alias("w")), signals)


def is_turkish(c: Column | str) -> Column:
    """Whether a text looks Turkish; texts too short to tell do."""
    c = _col(c)
    # Special letters are letters, so a share of the whole text that is enough is enough of the letters; only else are letters and words counted.
    enough = bound(_special(c), lambda s: (s > 0) & (s / F.length(c) >= SPECIAL_SHARE))
    signals = bound(language_signals(c), lambda s: (s["harf_sayisi"] < LEAST_LETTERS) | (s["turkce_karakter_orani"] >= SPECIAL_SHARE) | (s["durak_kelime_orani"] >= STOP_SHARE))
    return F.when(enough, F.lit(True)).otherwise(signals)


def readable(c: Column | str) -> Column:
    """Whether a text has letters and digits enough to work with; null doesn't."""
    return F.coalesce(_col(c).rlike(rf"\A(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){{{READABLE}}}"), F.lit(False))


def capped(c: Column | str, most: int = 200_000) -> Column:
    """The text up to the input limit, and whether it was cut."""
    c = _col(c)
    return F.struct(F.substring(c, 1, most).alias("metin"), F.coalesce(F.length(c) > most, F.lit(False)).alias("kesildi"))


def features(c: Column | str) -> Column:
    """Tokens and the boundary-marked character 3-grams of each, prefixed c3:."""
    own = tokens(c)

    def grams(t: Column) -> Column:
        marked = F.concat(F.lit("<"), t, F.lit(">"))
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.lit("c3:"), F.substr(marked, i, F.lit(3))))

    return F.concat(own, F.flatten(F.transform(own, grams)))


def facts(c: Column | str) -> Column:
    """The distinct numbers, dates and references of a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(FACT), F.lit(0)))


def faithfulness(summary: Column | str, source: Column | str) -> Column:
    """The share of the summary's facts that the source has; 1 if it has none."""
    own = facts(summary)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(own, facts(source))) / F.size(own), 4))


def source_coverage(summary: Column | str, source: Column | str) -> Column:
    """The share of the source's facts that the summary has; null if the source has none."""
    own = facts(source)
    return F.when(F.size(own) > 0, F.round(F.size(F.array_intersect(own, facts(summary))) / F.size(own), 4))


def compression(summary: Column | str, source: Column | str) -> Column:
    """Words of the summary to words of the source; 0 for an empty source."""
    n = F.coalesce(word_count(source), F.lit(0))
    return F.when(n > 0, F.round(F.coalesce(word_count(summary), F.lit(0)) / n, 4)).otherwise(F.lit(0.0))


def simplified(c: Column | str) -> Column:
    """A sentence without brackets that hold no digit and without a filler at its start."""
    plain = F.regexp_replace(_col(c), r"\s*\([^)0-9]*\)", "")
    plain = F.regexp_replace(plain, r"^(?iu)(ayrıca|bununla birlikte|bu bağlamda|ilaveten|öte yandan|ancak|fakat)[,\s]+", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def simplified_safely(c: Column | str) -> Column:
    """The simplified sentence, or the sentence as it is where a fact would be lost."""
    c = _col(c)
    return bound(simplified(c), lambda new: F.when((new != "") & (F.sort_array(facts(new)) == F.sort_array(facts(c))), new).otherwise(c))


def snippet(c: Column | str, most: int = 300) -> Column:
    """The beginning of a text up to a word's end, with dots if it was cut."""
    c = _col(c)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), r"\s\S*$", ""), F.lit("...")))


def article_references(c: Column | str) -> Column:
    """The article numbers that a text cites ('madde 5', 'm. 7', 'MADDE 3'), each once in order."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"(?:[Mm]adde|MADDE|\bm\.)\s*([0-9]+)"), F.lit(1)))


def article_label(c: Column | str) -> Column:
    """'m. 3, m. 5' for an array of article numbers."""
    return F.array_join(F.transform(_col(c), lambda x: F.concat(F.lit("m. "), x)), ", ")


def code_of(c: Column | str) -> Column:
    """An eight-digit code of a name, the same everywhere."""
    n = F.conv(F.substring(F.sha2(_col(c), 256), 1, 12), 16, 10).cast("bigint")
    return F.pmod(n, F.lit(90_000_000)) + 10_000_000


def valid_number(c: Column | str) -> Column:
    """Whether a text has the form of a document number."""
    return F.coalesce(_col(c).rlike(r"^[EZO]-[0-9]{8}-[0-9.]+-[0-9]+$"), F.lit(False))


def html_escape(c: Column | str) -> Column:
    """Text made safe for HTML; null becomes empty."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(_col(c).cast("string"), F.lit("")))


def contains_literal(c: Column | str, text: str) -> Column:
    """Whether a field holds a text as it stands, whatever its ASCII letter case; wildcards have no meaning."""
    return F.contains(F.lower(_col(c)), F.lower(F.lit(text)))


def safe_number(c: Column | str) -> Column:
    """A number, or null where the text is none."""
    return _col(c).try_cast("double")


def stem_pattern(word: str) -> str:
    """A pattern that finds a word's stem at a word start, with its last consonant softened or not."""
    soft = {"p": "[pb]", "ç": "[çc]", "t": "[td]", "k": "[kğg]"}
    import re

    body = re.escape(word[:-1]) + soft.get(word[-1], re.escape(word[-1]))
    return f"(?:^|[^a-zçğıöşüâîû0-9]){body}"


def keyword_count(c: Column | str, word: str) -> Column:
    """How often a keyword begins a word of a folded text."""
    return F.regexp_count(tr_lower(c), F.lit(stem_pattern(word)))


def keyword_present(c: Column | str, word: str) -> Column:
    """Whether a keyword begins a word of a folded text."""
    return F.coalesce(tr_lower(c).rlike(stem_pattern(word)), F.lit(False))

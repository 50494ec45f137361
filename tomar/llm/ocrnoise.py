"""Problem 4: noise in texts from scanned pages.

Method: noisy-channel correction. Page numbers and running lines are told from the layout and taken out, and words
divided at line ends are joined. What remains is read as words that a channel of character confusions may have changed. Which
confusions there are is given (``CONFUSIONS``); how likely each is beside the others is estimated from the scanned texts themselves, from words
that no other text has and that one right word only explains, with the given probabilities as prior of weight ``PRIOR``. The language model is
the normalised bigram likelihood, interpolated with single words, from the counts of words and pairs of words in all texts that were not scanned. Words of one skeleton, in which characters that scans exchange are written
alike, are candidates for each other, so candidates come from an equality join; each line is decoded by
Viterbi over its candidate words: channel times bigram likelihood.

Those of the ``FREQUENT`` most frequent words that have no candidate are held as known and aren't looked up again, which changes no
result; that bounded list is all that reaches the driver. Words are corrected inside a token; the token keeps its letter case.

Defined cases: null and empty texts give nothing; texts that were not scanned are left as they are; without any
unscanned text there is no language model, and only words with a digit or sign between letters are changed, to the letters
that these most often stand for; a text of one page has no running line; repeated
rows give their findings once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import cut, spread, table

from .rows import flat_map
from .scan import body_lines, divided, layout

FREQUENT = 20_000
#: Weight of an unseen word beside one seen occurrence, of one with a digit or sign inside, and of the single-word model.
UNSEEN, BROKEN, MIX = 0.02, 0.0002, 2.0
#: How many expected readings the prior of a confusion weighs; the least and the greatest probability of one.
PRIOR, LEAST, MOST = 2000.0, 1e-4, 0.3

#: What is read, what stands there, and how likely that is.
CONFUSIONS = [
    *((a, b, 0.02) for a, b in ("1l", "0o", "5s", "6b", "8b", "9g", "2z", "!i", "|l", "ce", "lı", "!ı", "1ı", "1i", "!l", "|ı", "|i", "0ö", "5ş", "9ğ")),
    *((a, b, 0.02) for a, b in (("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("lc", "k"), ("ii", "ü"), ("ii", "u"), ("vv", "w"), ("tl", "d"), ("in", "m"))),
    *((a, b, 0.004) for a, b in ("il", "li", "ıl", "ıi", "iı", "ec", "oa", "ao", "uü", "oö", "sş", "gğ", "cç", "nu", "un", "hb", "ft", "tf")),
    *((a, b, 0.002) for a, b in (("m", "rn"), ("d", "cl"), ("h", "li"), ("n", "ri"), ("k", "lc"))),
]
_BY_READ: dict[str, list[tuple[str, str, float]]] = {}
for _read, _right, _p in CONFUSIONS:
    _BY_READ.setdefault(_read[0], []).append((_read, _right, math.log(_p)))

# Skeleton: characters that scans exchange are written alike, compounds in parts.
_SKELETON = str.maketrans(
    {**dict.fromkeys("lı1!|İ", "i"), "0": "o", "ö": "o", "a": "o", "5": "s", "ş": "s", "6": "b", "8": "b", "9": "g", "ğ": "g", "2": "z", "e": "c", "ç": "c", "m": "rri", "n": "ri", "d": "ci", "h": "ii", "k": "ic", "ü": "ii", "u": "ii", "w": "vv", "f": "t", "â": "o", "î": "i", "û": "ii"}
)
#: The letter that a digit or sign inside a word most often stands for.
_LETTER = str.maketrans("1056892!|", "losbbgzil")
_UPPER = str.maketrans("iı", "İI")
_TOKEN = re.compile(r"\S+")
_PART = re.compile(r"[!|]?[^\W_]+(?:[!|]+[^\W_]+)*\|?")
_EDGE = re.compile(r"^(?:(?![!|][^\W\d_])\W)+|[^\w|]+$")


def lower(word: str) -> str:
    """Turkish lower case."""
    return word.replace("İ", "i").replace("I", "ı").lower()


def skeleton(word: str) -> str:
    """The form that a word shares with its misread forms."""
    return word.translate(_SKELETON).replace("ri", "u").replace("ii", "u")


def recased(word: str, like: str) -> str:
    """A word in lower case with the letter case of another."""
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) > len(letters) / 2:
        return word.translate(_UPPER).upper()
    if letters and (letters[0].isupper() and like[0] == letters[0] or (not like[0].isalpha() and like[1:2].isupper())):
        return word[0].translate(_UPPER).upper() + word[1:]
    return word


def explained(read: str, right: str) -> tuple[float, list[str]] | None:
    """(logarithm of the probability that a word is read so, confusions as 'read>right'), or None if no confusions explain it."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    frontier = [(0, 0)]
    while frontier:
        new = set()
        for i, j in frontier:
            p = best[i, j][0]
            steps = []
            if i < len(read) and j < len(right) and read[i] == right[j]:
                steps.append((1, 1, 0.0, None))
            if i < len(read):
                steps += [(len(a), len(b), lp, f"{a}>{b}") for a, b, lp in _BY_READ.get(read[i], ()) if read.startswith(a, i) and right.startswith(b, j)]
            for x, y, lp, name in steps:
                key = (i + x, j + y)
                if key not in best or p + lp > best[key][0]:
                    best[key] = (p + lp, (i, j, name))
                    new.add(key)
        frontier = sorted(new)
    at = (len(read), len(right))
    if at not in best:
        return None
    score, names = best[at][0], []
    while best[at][1]:
        i, j, name = best[at][1]
        if name:
            names.append(name)
        at = (i, j)
    return score, names[::-1]


def channel(read: str, right: str) -> float | None:
    """The logarithm of the prior probability that a word is read so, or None if no confusions explain it."""
    found = explained(read, right)
    return found and found[0]


def plain_variant(read: str, right: str) -> bool:
    """Whether a word is only written without its accents, as people type it."""
    return read == right.translate(str.maketrans("çğıöşüâîû", "cgiosuaiu")) and any(c in "çğöşü" for c in right)


def parts(token: str) -> list[tuple[int, str]]:
    """(place, word) of the parts of a token that may be words."""
    if "@" in token or "www." in token:
        return []
    return [(m.start(), m[0]) for m in _PART.finditer(token) if sum(c.isalpha() for c in m[0]) >= 2]


def counts_of(texts: list[str]) -> tuple[Counter, Counter]:
    """Words and pairs of neighbouring words, in lower case; numbers are '#'."""
    words: Counter = Counter()
    pairs: Counter = Counter()
    for text in texts:
        own = ["#" if w.isdigit() else w for w in re.findall(r"[^\W_]+", lower(text))]
        words.update(own)
        pairs.update(zip(own, own[1:]))
    return words, pairs


def language(texts: DataFrame) -> DataFrame:
    """(a, b, n): counts of words (b null) and of pairs of words over all texts(metin)."""

    def make():
        def run(rows):
            words, pairs = counts_of([r["metin"] for r in rows])
            for w, n in words.items():
                yield w, None, n
            for (a, b), n in pairs.items():
                yield a, b, n

        return run

    return flat_map(texts.select("metin"), make, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def read_lines(text: str) -> tuple[list[list[tuple[str, bool]]], list[str], list[str]]:
    """(lines of (token, divided), page-number lines, running lines) of a scanned text."""
    found = layout(text)
    at = lambda i: " ".join(text[slice(*found.lines[i])].split())
    numbers, running = [at(i) for i in sorted(found.numbers)], [at(i) for i in sorted(found.running)]
    lines: list[list[tuple[str, bool]]] = []
    for a, b in body_lines(text, found):
        line = text[a:b]
        own = [(t, False) for t in _TOKEN.findall(line)]
        if not own:
            continue
        previous = next((x for x in reversed(lines) if x), None)
        cut_ = divided(previous[-1][0], line) if previous and previous[-1] else None
        if previous and previous[-1][0].endswith("!") and own[0][0][0].islower():
            previous[-1] = (previous[-1][0][:-1] + "|", previous[-1][1])
        # A sign before a word that goes on in lower case ends no sentence: it is a misread letter.
        own = [(t[:-1] + "|", s) if t[-1] == "!" and following[0].islower() else (t, s) for (t, s), following in zip(own, [*(t for t, _ in own[1:]), " "])]
        if cut_:
            whole = re.sub(r"[-‐‑¬­]+$", "", previous[-1][0]) + own[0][0]
            previous[-1] = (whole, True)
            own = own[1:]
        lines.append(own)
    return lines, numbers, running


def bare(token: str) -> str:
    """A token without adjacent punctuation; signs that are misread letters stay."""
    return _EDGE.sub("", token)


_ROWS = "evrak_id bigint, alan string, tur string, satir int, sira int, yer int, belirtec string, kelime string, onceki string, sonraki string"


def readings(scanned: DataFrame, known: frozenset[str]) -> DataFrame:
    """The page-number and running lines, the divided words and the words to look up of scanned(evrak_id, alan, metin), and as toplam the words of each text."""
    shared = scanned.sparkSession.sparkContext.broadcast(known)

    def make():
        frequent = shared.value
        seen: dict[str, tuple[str, list[tuple[int, str]]]] = {}

        def look(token: str) -> tuple[str, list[tuple[int, str]]]:
            """A token without its edges, and its words with their places; kept for the next time."""
            found = seen.get(token)
            if found is None:
                if len(seen) > 200_000:
                    seen.clear()
                own = bare(token)
                found = seen[token] = own, [(at, lower(p)) for at, p in parts(own)]
            return found

        def run(rows):
            for r in rows:
                lines, numbers, running = read_lines(r["metin"])
                head = (r["evrak_id"], r["alan"])
                yield *head, "toplam", sum(map(len, lines)), -1, -1, None, None, None, None
                for kind, own in (("sayfa_no", numbers), ("ustbilgi", running)):
                    for line in dict.fromkeys(own):
                        yield *head, kind, -1, -1, -1, line, None, None, None
                for n, line in enumerate(lines):
                    words = [(k, at, w) for k, (t, _) in enumerate(line) for at, w in look(t)[1]]
                    for i, (k, at, w) in enumerate(words):
                        if w not in frequent:
                            before = words[i - 1][2] if i else "<s>"
                            after = words[i + 1][2] if i + 1 < len(words) else "</s>"
                            yield *head, "kelime", n, k, at, look(line[k][0])[0], w, before, after
                    for k, (t, split) in enumerate(line):
                        if split:
                            yield *head, "heceleme", n, k, -1, bare(t), None, None, None

        return run

    return flat_map(scanned, make, _ROWS)


def possible(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(kelime, m, t, aday, n, islem): the right words that each of words(kelime, t) may be a misreading of, and the confusions that make it so."""
    sized = words.join(lexicon.select(F.col("a").alias("kelime"), F.col("n").alias("m")), "kelime", "left").select("kelime", F.coalesce("m", F.lit(0)).alias("m"), "t")

    def make():
        def run(rows):
            for r in rows:
                yield skeleton(r["kelime"]), r["kelime"], r["m"], r["t"]

        return run

    wanted = flat_map(sized, make, "iskelet string, kelime string, m bigint, t bigint")
    right = flat_map(lexicon.where("a <> '#'").select(F.col("a").alias("kelime"), F.col("n").alias("m"), F.lit(0).cast("bigint").alias("t")), make, "iskelet string, aday string, n bigint, t bigint").drop("t")
    both = wanted.join(right, "iskelet").where("kelime <> aday and n > 3 * m")

    def weigh():
        def run(rows):
            for r in rows:
                if any(c.isdigit() for c in r["aday"]) or plain_variant(r["kelime"], r["aday"]):
                    continue
                found = explained(r["kelime"], r["aday"])
                if found:
                    yield r["kelime"], r["m"], r["t"], r["aday"], r["n"], found[1]

        return run

    def straight():
        """Digits and signs between letters stand for letters even in words that no other text has."""

        def run(rows):
            for r in rows:
                word = r["kelime"]
                if re.fullmatch(r"[^\W\d_]+(?:[0-9!|][^\W\d_]+)+", word):
                    yield word, r["m"], r["t"], word.translate(_LETTER), 1, [f"{c}>{c.translate(_LETTER)}" for c in word if not c.isalpha()]

        return run

    schema = "kelime string, m bigint, t bigint, aday string, n bigint, islem array<string>"
    every = flat_map(both.select("kelime", "m", "t", "aday", "n"), weigh, schema).unionByName(flat_map(sized, straight, schema))
    return every.groupBy("kelime", "m", "t", "aday").agg(F.max("n").alias("n"), F.min_by("islem", F.size("islem")).alias("islem"))


def estimated(pairs: DataFrame, lexicon: DataFrame, tokens: int) -> dict[str, float]:
    """The logarithm of the probability of each confusion, beside the others as often as the scanned texts show it.

    The common level of all stays that of the prior, which ``UNSEEN`` and ``BROKEN`` are set to. What reaches the driver is a row a confusion.
    """
    prior = {f"{a}>{b}": p for a, b, p in CONFUSIONS}
    single = pairs.where("m = 0").groupBy("kelime").agg(F.count("*").alias("k"), F.first("islem").alias("islem"), F.first("t").alias("t")).where("k = 1")
    seen = {r.islem: r.t for r in single.select(F.explode("islem").alias("islem"), "t").groupBy("islem").agg(F.sum("t").alias("t")).collect()}
    rights = sorted({b for _, b, _ in CONFUSIONS})

    def make():
        def run(rows):
            total = dict.fromkeys(["", *rights], 0)
            for r in rows:
                total[""] += r["n"]
                for b in rights:
                    if b in r["a"]:
                        total[b] += r["n"] * r["a"].count(b)
            yield from total.items()

        return run

    there = {r.b: r.n for r in flat_map(lexicon.select("a", "n"), make, "b string, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()}
    scale = tokens / max(1, there.get("", 0))
    out = {}
    for name, p in prior.items():
        expected = there.get(name.split(">")[1], 0) * scale
        out[name] = math.log(min(MOST, max(LEAST, (seen.get(name, 0) + PRIOR * p) / (expected + PRIOR))))
    weight = {name: seen.get(name, 0) + 1 for name in prior}
    level = sum(weight[x] * (math.log(prior[x]) - out[x]) for x in prior) / sum(weight.values())
    return {name: value + level for name, value in out.items()}


def candidates(words: DataFrame, lexicon: DataFrame, tokens: int) -> DataFrame:
    """(kelime, m, adaylar): the right words that each of words(kelime, t) may stand for, with their counts and channel."""
    pairs = cut(possible(words, lexicon))
    logs = estimated(pairs, lexicon, tokens)
    of = F.create_map(*[F.lit(x) for pair in logs.items() for x in pair])
    total = F.aggregate("islem", F.lit(0.0), lambda a, x: a + F.coalesce(F.element_at(of, x), F.lit(math.log(0.02))))
    return pairs.groupBy("kelime", "m").agg(F.collect_list(F.struct("aday", "n", total.alias("kanal"))).alias("adaylar"))


def decode(line: list[dict], pair: dict[tuple[str, str], int], total: float) -> list[str]:
    """The best path over the words of a line that have candidates; line is ordered by place."""
    paths: list[tuple[float, list[str], float]] = [(0.0, [], 0.0)]
    weight = MIX * 1000
    last: dict | None = None
    for x in line:
        own = x["kelime"]
        odd = any(not c.isalpha() for c in own)
        options = [(own, max(x["m"], BROKEN if odd else UNSEEN), math.log(0.98))] + [(a["aday"], a["n"], a["kanal"]) for a in x["adaylar"]]
        joined = last is not None and last["satir_son"] == (x["sira"], x["yer"])
        new = []
        for word, n, channel_ in options:
            best = None
            for score, path, seen in paths:
                before = path[-1] if joined else x["onceki"]
                # P(word | word before); a word before that is the same on all paths needs no division.
                ahead = (pair.get((before, word), 0) + weight * n / total) / ((seen + weight) if joined else 1.0)
                value_ = score + channel_ + math.log(ahead)
                if best is None or value_ > best[0]:
                    best = (value_, path)
            after = math.log((pair.get((word, x["sonraki"]), 0) + MIX * 0.001) / (n + MIX)) if not x["baglanir"] else 0.0
            new.append((best[0] + after, [*best[1], word], n))
        paths = new
        last = x
    return max(paths, key=lambda p: p[0])[1]


def corrections(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(evrak_id, alan, satir, sira, yer, belirtec, kelime, dogru): the words of readings that the decoder changes."""
    words = rows.where("tur = 'kelime'")
    lexicon = model.where("b is null")
    tokens = rows.where("tur = 'toplam'").agg(F.sum("satir")).first()[0] or 0
    found = candidates(words.groupBy("kelime").agg(F.count("*").alias("t")), lexicon, tokens)
    place = ["evrak_id", "alan", "satir"]
    open_ = words.join(found, "kelime").select(*place, "sira", "yer", "belirtec", "kelime", "onceki", "sonraki", "m", "adaylar")
    options = F.concat(F.array("kelime"), F.transform("adaylar", lambda a: a.aday))
    around = cut(open_).withColumn("secenek", options)
    needed = (
        around.select(*place, F.explode("secenek").alias("c"), "onceki", "sonraki").select(*place, F.explode(F.array(F.struct(F.col("onceki").alias("a"), F.col("c").alias("b")), F.struct(F.col("c").alias("a"), F.col("sonraki").alias("b")))).alias("p"))
    )
    left, right = around.select(*place, "sira", "yer", "secenek", "sonraki"), around.select(*place, F.col("sira").alias("sira2"), F.col("yer").alias("yer2"), F.col("secenek").alias("secenek2"), F.col("kelime").alias("k2"))
    chains = left.join(right, place).where("(sira2 = sira + 1 or (sira2 = sira and yer2 > yer)) and k2 = sonraki")
    chained = chains.select(*place, F.explode("secenek").alias("a"), "secenek2").select(*place, "a", F.explode("secenek2").alias("b")).select(*place, F.struct("a", "b").alias("p"))
    asked = needed.unionByName(chained).select(*place, F.col("p.a").alias("a"), F.col("p.b").alias("b")).distinct()
    pairs = model.where("b is not null").join(asked, ["a", "b"]).groupBy(*place).agg(F.collect_list(F.struct("a", "b", "n")).alias("ciftler"))
    lines = around.drop("secenek").groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("sira", "yer", "belirtec", "kelime", "onceki", "sonraki", "m", "adaylar"))).alias("kelimeler"))
    total = float(lexicon.agg(F.sum("n")).first()[0] or 1)

    def make():
        def run(batch):
            for r in batch:
                line = r["kelimeler"]
                for x, y in zip(line, [*line[1:], None]):
                    x["baglanir"] = y is not None and y["kelime"] == x["sonraki"] and y["onceki"] == x["kelime"]
                    x["satir_son"] = (y["sira"], y["yer"]) if x["baglanir"] else None
                pair = {(p["a"], p["b"]): p["n"] for p in r["ciftler"] or ()}
                for x, word in zip(line, decode(line, pair, total)):
                    if word != x["kelime"]:
                        yield r["evrak_id"], r["alan"], r["satir"], x["sira"], x["yer"], x["belirtec"], x["kelime"], word

        return run

    schema = "evrak_id bigint, alan string, satir int, sira int, yer int, belirtec string, kelime string, dogru string"
    return flat_map(lines.join(pairs, place, "left"), make, schema)


def _right_form():
    """The token with its corrected part, in its letter case."""

    def make():
        def run(rows):
            for r in rows:
                token = r["belirtec"]
                for at, word in sorted(((x["yer"], x["dogru"]) for x in r["duzeltmeler"] or ()), reverse=True):
                    own = next((p for a, p in parts(token) if a == at), None)
                    if own is not None:
                        token = token[:at] + recased(word, own) + token[at + len(own) :]
                yield r["evrak_id"], r["alan"], r["satir"], r["sira"], r["tur"], r["belirtec"], token

        return run

    return make


def scanned_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the texts that were scanned, the others) as (evrak_id, alan, metin)."""
    state = table(spark, sf_dir, "agent_state").select("evrak_id", "raw_text", F.col("ocr_result.metin").alias("metin"), F.col("ocr_result.engine_used").alias("motor"))
    state = spread(state)
    scanned = F.coalesce(F.col("motor") != "direct", F.lit(False))
    fields = F.explode(F.array(F.struct(F.lit("raw_text").alias("alan"), F.col("raw_text").alias("metin")), F.struct(F.lit("ocr_result").alias("alan"), F.col("metin").alias("metin")))).alias("x")
    return (
        state.where(scanned).select("evrak_id", fields).select("evrak_id", "x.alan", "x.metin").where("metin <> ''"),
        state.where(~scanned).select("evrak_id", F.lit("raw_text").alias("alan"), F.col("raw_text").alias("metin")).where("metin <> ''"),
    )


def repairs(scanned: DataFrame, clean: DataFrame) -> DataFrame:
    """(evrak_id, alan, satir, sira, tur, belirtec, deger): every finding in scanned texts, by the language of clean ones."""
    model = cut(language(clean))
    lexicon = model.where("b is null")
    frequent = lexicon.orderBy(F.desc("n"), "a").limit(FREQUENT).select(F.col("a").alias("kelime"))
    known = frozenset(r.kelime for r in frequent.join(possible(frequent.withColumn("t", F.lit(0).cast("bigint")), lexicon).select("kelime").distinct(), "kelime", "left_anti").collect())
    rows = cut(readings(scanned, known).distinct())
    fixed = corrections(rows, model)
    by_token = fixed.groupBy("evrak_id", "alan", "satir", "sira", "belirtec").agg(F.collect_list(F.struct("yer", "dogru")).alias("duzeltmeler"))
    place = ["evrak_id", "alan", "satir", "sira", "belirtec"]
    words = by_token.withColumn("tur", F.lit("karakter")).select(*place, "tur", "duzeltmeler")
    split = rows.where("tur = 'heceleme'").select(*place, "tur").join(by_token, place, "left").select(*place, "tur", "duzeltmeler")
    formed = flat_map(words.unionByName(split), _right_form(), "evrak_id bigint, alan string, satir int, sira int, tur string, belirtec string, deger string")
    lines = rows.where("tur in ('ustbilgi', 'sayfa_no')").select(*place[:4], "tur", "belirtec", F.col("belirtec").alias("deger"))
    return formed.unionByName(lines)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damage in scanned documents."""
    return repairs(*scanned_texts(spark, sf_dir)).where("deger <> ''").select("alan", "evrak_id", "tur", "deger").distinct()


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned text as continuous paragraphs, with the number of repairs."""
    scanned, clean = scanned_texts(spark, sf_dir)
    fixes = repairs(scanned, clean).where("tur = 'karakter'").groupBy("evrak_id", "alan").agg(F.collect_list(F.struct("satir", "sira", "belirtec", "deger")).alias("duzeltmeler"))

    def make():
        def run(rows):
            for r in rows:
                fixed = {(x["satir"], x["sira"]): (x["belirtec"], x["deger"]) for x in r["duzeltmeler"] or ()}
                yield r["evrak_id"], r["alan"], repaired(r["metin"], fixed), len(fixed)

        return run

    both = scanned.dropDuplicates(["evrak_id", "alan", "metin"]).join(fixes, ["evrak_id", "alan"], "left")
    return flat_map(both, make, "evrak_id bigint, alan string, metin string, duzeltme_sayisi int")


def repaired(text: str, fixed: dict[tuple[int, int], tuple[str, str]]) -> str:
    """A scanned text as paragraphs: without page lines, words joined and corrected, wrapped lines made one."""
    found = layout(text)
    lines, _, _ = read_lines(text)
    body = [text[a:b] for a, b in body_lines(text, found)]
    width = max((len(x.rstrip()) for x in body), default=0)
    ends, n = [], -1
    # A line goes on in the next unless a blank line follows or it is much shorter than the widest.
    for x in body:
        if not x.strip():
            if n >= 0:
                ends[n] = "\n\n"
        else:
            n += 1
            ends.append("\n" if len(x.rstrip()) < 0.7 * width else " ")
    out = []
    for n, line in enumerate(lines):
        words = []
        for k, (token, _) in enumerate(line):
            old, new = fixed.get((n, k), ("", ""))
            words.append(token.replace(old, new, 1) if old else re.sub(r"\|$", "!", token))
        out += [" ".join(words), ends[n] if n < len(ends) else " "]
    return "".join(out).strip()


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}

"""Problem 3: variant spellings of persons, institutions and units.

Method: suffix blocking. Spellings are folded to sets of words; spellings with the same words in any order, case
or accents form a class. The suffix of ``SUFFIX`` letters of each word (a shorter word whole) indexes the class; longer shared suffixes hold it.
A suffix alone is shared by too many, so every one is refined by another word of the name before anything is compared: of a
person by that word and the word less one letter (two words with one slip share such a form), by its initial against spellings that have
an initial only, and by its first two letters against short ones that may be pet forms; of an institution or unit by the initial of
another word. The refined keys keep every pair that the comparison would accept by that suffix, so no block is discarded, however
common; large ones are joined in slices of ``SLICE`` classes. Pairs that share a block are compared word by word by the
longest-common-subsequence ratio, with rules for abbreviations, acronyms, initials, inflection and pet forms.

Two words count as misspellings of each other only if the rarer is as rare beside the other as slips are: at most what a share of
``SLIP`` of the other's spellings, three standard deviations and one make. Names that both occur in many spellings, such as Kemal and Cemal, stay
apart, and listed given names are never slips of each other. Persons known by an initial or
a pet form join the one person of that surname who fits; where several persons fit, they stay alone.

Defined cases: null, blank and filler spellings name no entity; a single word is no person's name;
repeated rows count once; a spelling with no partner gives no row; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.operators.components import connected_components
from tomar.session import cut, table

from .folding import fold
from .names import GIVEN
from .rows import flat_map

SUFFIX, SLICE = 4, 500
#: Least ratio of the common subsequence to the longer word, and the letters of a word that may be out of place.
RATIO, SLIPS = 0.75, 1
SLIP = 0.05

#: Words that fill a field without naming an entity, and words that an institution's name may lack.
FILLERS = frozenset(
    "adi soyadi ad soyad isim isimsiz imza unvan unvani yetkili ilgili kisi kisiler sahis bilinmiyor bilinmeyen belirtilmemis belirsiz yok bos mevcut degil girilmemis "
    "kurum kurumu kurulus birim birimi na nan null none test deneme diger muhtelif cesitli kase muhur tarih sayi konu x xx xxx vatandas basvuran basvuru sahibi sayin makam".split()
)
OPTIONAL = frozenset("ve ile tc t c makami baskanligi il".split())
#: Forms of address that go with a given name, and pet forms that no rule gives.
ADDRESS = frozenset("abla abi agabey bey hanim hoca usta amca teyze dayi hala baba ana dede sayin av dr doc prof uzm op muh".split())
PET_FORMS = {"mistik": "mustafa", "hatce": "hatice", "ibo": "ibrahim", "apo": "abdullah", "esme": "esma", "fadik": "fatma", "nermin": "neriman", "meyro": "meryem", "ese": "ayse", "dudu": "durdu"}
LISTED = frozenset(fold(x) for x in GIVEN)
_PET_ENDINGS = ("o", "os", "is", "us", "ik", "uk", "ko", "i", "is", "e", "cik", "cuk", "s", "u")
_INFLECTION = re.compile(r"(?<=.{4})(?:(?<=[ui])n[ea]|(?<=[ui])n[ui]n|(?<=[ui])nd[ea]|n?d[ea]n|'?y[ea])$")
#: Endings, folded, in which two forms of one word may differ.
ENDINGS = frozenset(["", *"i u si su gi gu k g n in un nin nun ne na lik ligi luk lugu ler lar leri lari e a de da den dan ye ya".split()])
_PART = re.compile(r"[^\W_]+(?:\.(?=[^\W\d_]{2}))?")


def tokens(name: str) -> list[str]:
    """The folded words of a name in the order given name first; 'Md.lüğü' is one word."""
    if name.count(",") == 1:
        a, b = name.split(",")
        name = f"{b} {a}"
    folded = fold(name)
    out, glue = [], False
    for part in _PART.findall(folded):
        word = part.rstrip(".")
        if glue:
            out[-1] += word
        else:
            out.append(word)
        glue = part.endswith(".") and len(word) > 1 and bool(re.search(re.escape(part) + r"l", folded))
    return out


def entity_words(field: str, name: str | None) -> list[str]:
    """The words that name an entity, or none for blanks and fillers."""
    if not name:
        return []
    own = tokens(name)
    if field == "kisi":
        own = [w for w in own if not w.isdigit()]
        if len(own) < 2 or all(w in FILLERS for w in own) or not any(len(w) > 2 for w in own):
            return []
        return own
    own = [_INFLECTION.sub("", w) if len(w) > 6 else w for w in own]
    while own[:2] == ["t", "c"] or own[:1] == ["tc"]:
        own = own[2:] if own[0] == "t" else own[1:]
    if not own or all(w in FILLERS or w.isdigit() for w in own):
        return []
    return own


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence of two words."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def misspelt(a: str, b: str, na: int, nb: int) -> bool:
    """Whether two words are one with a slip of the hand, given the spellings each occurs in."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2 or max(len(a), len(b)) < 4:
        return False
    few, many = sorted((na, nb))
    if few > SLIP * many + 3 * (SLIP * many) ** 0.5 + 1 or (a in LISTED and b in LISTED):
        return False
    long = max(len(a), len(b))
    # One slip leaves all letters but one in order, so the ratio that is asked for grows with the word.
    return common_subsequence(a, b) >= max(RATIO, 1 - SLIPS / long) * long


def shortened(short: str, word: str) -> bool:
    """Whether a word may be an abbreviation of another: same first letter, its letters in order."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    return True


def inflected(a: str, b: str) -> bool:
    """Whether two words differ in their ending only."""
    common = 0
    for x, y in zip(a, b):
        if x != y:
            break
        common += 1
    return common >= 4 and a[common:] in ENDINGS and b[common:] in ENDINGS


def written_apart(words: list[str], compound: str) -> bool:
    """Whether two words, the first perhaps abbreviated, are the parts of a compound."""
    if len(words) != 2 or min(map(len, words)) < 2:
        return False
    cuts = (i for i in range(2, len(compound) - 1) if compound.startswith(words[1], i))
    return any(compound[:i] == words[0] or shortened(words[0], compound[:i]) for i in cuts)


def acronym(short: str, words: list[str]) -> bool:
    """Whether the letters of short are the initials of the words, with letters from inside compounds."""
    if not 2 <= len(short) <= 6 or len(words) < 2:
        return False

    def fits(i: int, k: int, pos: int) -> bool:
        if i == len(short):
            return k == len(words)
        if k < len(words) and words[k][0] == short[i] and fits(i + 1, k + 1, 1):
            return True
        if 0 < k <= len(words):
            j = words[k - 1].find(short[i], max(pos, 3))
            return j >= 0 and fits(i + 1, k, j + 1)
        return False

    return fits(0, 0, 0)


def same_body(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
    """Whether two institutions or units are one: every word of either has its partner in the other."""
    if len(a) > len(b) or (len(a) == len(b) and sum(len(w) for w, _ in a) > sum(len(w) for w, _ in b)):
        a, b = b, a
    left, right = [x for x in a], [x for x in b]
    sure = 0
    def pair_off(test) -> None:
        nonlocal sure
        for x in list(left):
            y = next((y for y in right if test(x, y)), None)
            if y:
                left.remove(x)
                right.remove(y)
                sure += 1

    pair_off(lambda x, y: x[0] == y[0])
    pair_off(lambda x, y: misspelt(x[0], y[0], x[1], y[1]))
    if written_apart([w for w, _ in left], "".join(w for w, _ in right)) or written_apart([w for w, _ in right], "".join(w for w, _ in left)):
        return True
    pair_off(lambda x, y: inflected(x[0], y[0]))
    pair_off(lambda x, y: shortened(x[0], y[0]) or shortened(y[0], x[0]))
    if len(left) == len(right) == 1 and sure and any(x in b and len(x[0]) > 3 for x in a):
        # A slip in the abbreviation of the last word left.
        short, word = sorted((left[0][0], right[0][0]), key=len)
        if 2 < len(short) < 5 and short[0] == word[0] and common_subsequence(short, word) >= len(short) - 1:
            return True
    for mine, other in ((left, right), (right, left)):
        for x in list(mine):
            rest = [w for w, _ in other if w not in ("ve", "ile")]
            if acronym(x[0], rest) or acronym(x[0], [w for w, _ in other]):
                mine.remove(x)
                other.clear()
                sure += len(rest)
    left = [w for w, _ in left if w not in OPTIONAL and not shortened(w, "baskanligi")]
    right = [w for w, _ in right if w not in OPTIONAL and not shortened(w, "baskanligi")]
    return sure > 0 and not left and not right


def pet_form(short: str, given: str) -> bool:
    """Whether a given name may be called by a short form."""
    if PET_FORMS.get(short) == given:
        return True
    return any(short.endswith(e) and 2 <= len(short) - len(e) <= 4 and len(short) <= 6 and len(given) >= 4 and given.startswith(short[: len(short) - len(e)]) and short != given for e in _PET_ENDINGS)


def same_person(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> str | None:
    """'ayni' for two spellings of one full name, 'kisa' where one has an initial only, 'evcil' where one has a pet form."""
    if len(a) > len(b):
        a, b = b, a
    a = [x for x in a if x[0] not in ADDRESS] if len(a) > 2 else a
    b = [x for x in b if x[0] not in ADDRESS] if len(b) > 2 else b
    if len(a) < 2 or len(b) < 2:
        return None
    if len(a) > len(b):
        a, b = b, a
    ends_b = [(0, len(b) - 1), (len(b) - 1, 0)] if len(b) == 2 or len(b[0][0]) == 1 or len(b[-1][0]) == 1 else [(0, len(b) - 1)]
    ends_a = [(0, len(a) - 1), (len(a) - 1, 0)] if len(a) == 2 or len(a[0][0]) == 1 or len(a[-1][0]) == 1 else [(0, len(a) - 1)]
    best = None
    for ga, sa in ends_a:
        for gb, sb in ends_b:
            (x, nx), (y, ny) = a[sa], b[sb]
            if len(x) < 3 or len(y) < 3 or not misspelt(x, y, nx, ny):
                continue
            (g, ng), (h, nh) = a[ga], b[gb]
            mid_a = [w for i, (w, _) in enumerate(a) if i not in (ga, sa)]
            mid_b = [w for i, (w, _) in enumerate(b) if i not in (gb, sb)]
            if mid_a and mid_b and not (mid_a == mid_b or (mid_a[0][0] == mid_b[0][0] and 1 in (len(mid_a[0]), len(mid_b[0]))) or common_subsequence(mid_a[0], mid_b[0]) >= 0.75 * max(len(mid_a[0]), len(mid_b[0]))):
                continue
            if x != y and g != h and len(g) > 1 and len(h) > 1 and common_subsequence(g, h) < len(g) - 2:
                continue
            if len(g) == 1 and len(h) == 1:
                if g == h:
                    best = best or "kisa"
            elif len(g) == 1 or len(h) == 1:
                if g[0] == h[0]:
                    best = best or "kisa"
            elif misspelt(g, h, ng, nh):
                return "ayni"
            elif pet_form(g, h) or pet_form(h, g):
                best = "evcil"
    return best


def _short(words: list[str], field: str) -> bool:
    return field == "kisi" and (len(words[0]) == 1 or len(words[-1]) == 1)


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alan, ad): the distinct spellings of the three fields."""
    state, register = table(spark, sf_dir, "agent_state"), table(spark, sf_dir, "islemler")
    units = register.select(F.lit("birim").alias("alan"), F.col("birim").alias("ad"))
    persons = state.select(F.lit("kisi").alias("alan"), F.explode("extracted_info.kisi_adlari").alias("ad"))
    bodies = state.select(F.lit("kurum").alias("alan"), F.explode("extracted_info.kurum_adlari").alias("ad"))
    return units.unionByName(persons).unionByName(bodies).where("trim(ad) <> ''").distinct()


def classes_of(names: DataFrame) -> DataFrame:
    """(alan, ad, sinif, kelime): the class of each spelling and its words."""

    def make():
        def run(rows):
            for r in rows:
                own = entity_words(r["alan"], r["ad"])
                if own:
                    yield r["alan"], r["ad"], " ".join(sorted(own)), own

        return run

    return flat_map(names, make, "alan string, ad string, sinif string, kelime array<string>")


def _forms(word: str) -> set[str]:
    """A word and the word less one letter: two words with one slip share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _person_keys(own: list[str]):
    """(key, asks): the blocks of a person. In blocks by initial or pet form a pair needs one class that asks."""
    for i, w in enumerate(own):
        if len(w) < 2:
            continue
        end = w[-SUFFIX:]
        for j, o in enumerate(own):
            if i == j:
                continue
            yield f"{end}|{o[0]}.", len(o) == 1
            if len(o) > 1:
                for form in _forms(o):
                    yield f"{end}|{form}", True
                for start in {o[:2], PET_FORMS.get(o, o)[:2]}:
                    yield f"{end}|{start}~", len(o) <= 6


def _body_keys(own: list[str]):
    """(key, True): the blocks of an institution or unit, and its letters as an acronym."""
    telling = [w for w in own if w not in OPTIONAL and not shortened(w, "baskanligi")] or own
    for i, w in enumerate(telling):
        if len(w) < 2:
            continue
        if len(telling) == 1:
            yield w[-SUFFIX:], True
        for j, o in enumerate(telling):
            if i != j:
                for letter in {o[0], o[1:2] if len(o) <= SUFFIX else o[0]} - {""}:
                    yield f"{w[-SUFFIX:]}|{letter}", True
    letters = "".join(w[0] for w in own if w not in ("ve", "ile"))
    if len(letters) >= 2:
        yield f"={letters}", True
    if len(own) == 1:
        yield f"={own[0]}", True


def _keys(field: str, own: list[str]) -> dict[str, bool]:
    """The blocks of a class, and whether it asks for partners there."""
    out: dict[str, bool] = {}
    for key, asks in _person_keys(own) if field == "kisi" else _body_keys(own):
        out[key] = out.get(key, False) or asks
    return out


def blocks(classes: DataFrame) -> DataFrame:
    """(alan, a, b): pairs of classes that share a block in which one of them asks for partners."""

    def make():
        def run(rows):
            for r in rows:
                for k, asks in _keys(r["alan"], r["kelime"]).items():
                    yield r["alan"], r["sinif"], k, asks

        return run

    keyed = cut(flat_map(classes.select("alan", "sinif", "kelime"), make, "alan string, sinif string, k string, soran boolean"))
    sizes = keyed.groupBy("alan", "k").agg(F.count("*").alias("n"), F.bool_or("soran").alias("var")).where("n > 1 and var").drop("var")
    own = keyed.join(sizes, ["alan", "k"]).withColumn("dilimler", F.ceil(F.col("n") / SLICE))
    left = own.where("soran").select("alan", "k", F.pmod(F.xxhash64("sinif"), "dilimler").alias("dilim"), F.col("sinif").alias("a"))
    right = own.select("alan", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("dilimler") - 1)).alias("dilim"), F.col("sinif").alias("b"))
    both = left.join(right, ["alan", "k", "dilim"]).where("a <> b")
    return both.select("alan", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(classes: DataFrame) -> DataFrame:
    """(alan, a, b, bag): compared pairs of classes that name one entity; bag is 'ayni', 'kisa' or 'evcil'."""
    words = classes.select("alan", "sinif", F.explode("kelime").alias("w")).distinct()
    support = words.groupBy("alan", "w").agg(F.count("*").alias("n"))
    weighed = (
        classes.select("alan", "sinif", F.posexplode("kelime").alias("p", "w")).join(support, ["alan", "w"]).groupBy("alan", "sinif").agg(F.sort_array(F.collect_list(F.struct("p", "w", "n"))).alias("x"))
    )
    pairs = blocks(classes)
    both = pairs.join(weighed.select("alan", F.col("sinif").alias("a"), F.col("x").alias("xa")), ["alan", "a"]).join(weighed.select("alan", F.col("sinif").alias("b"), F.col("x").alias("xb")), ["alan", "b"])

    def make():
        def run(rows):
            for r in rows:
                a, b = ([(x["w"], x["n"]) for x in r[c]] for c in ("xa", "xb"))
                if r["alan"] == "kisi":
                    kind = same_person(a, b)
                else:
                    kind = "ayni" if same_body(a, b) else None
                if kind:
                    yield r["alan"], r["a"], r["b"], kind

        return run

    return flat_map(both, make, "alan string, a string, b string, bag string")


def entities(names: DataFrame) -> DataFrame:
    """(alan, ad, varlik): the entity of each spelling, named after its first class."""
    members = cut(classes_of(names))
    # One class of words may come in several orders; the one of the first spelling is compared.
    classes = members.groupBy("alan", "sinif").agg(F.min_by("kelime", "ad").alias("kelime"))
    found = cut(links(classes))
    key = lambda c: F.concat("alan", F.lit("\x1f"), c)
    firm = connected_components(found.where("bag = 'ayni'").select(key("a").alias("src"), key("b").alias("dst")))
    nodes = classes.select("alan", "sinif", key("sinif").alias("node")).join(firm, "node", "left").select("alan", "sinif", F.coalesce("component", "node").alias("varlik"))
    # A pet form joins the one entity that it fits: the one with fewer classes goes to the other.
    size = nodes.groupBy("varlik").agg(F.count("*").alias("m"))
    ways = _ways(found.where("bag = 'evcil'"), nodes)
    pets = ways.join(size.select(F.col("varlik").alias("va"), F.col("m").alias("ma")), "va").join(size.select(F.col("varlik").alias("vb"), F.col("m").alias("mb")), "vb")
    nodes = cut(_joined(nodes, pets.where("ma < mb or (ma = mb and va > vb)").select("va", "vb")))
    # An initial joins the one entity of a full name that it fits.
    initials = classes.where("alan = 'kisi' and (length(kelime[0]) = 1 or length(element_at(kelime, -1)) = 1)").select("alan", "sinif")
    short = initials.join(nodes, ["alan", "sinif"]).select("varlik").distinct()
    full = _ways(found.where("bag = 'kisa'"), nodes).join(short.select(F.col("varlik").alias("vb")), "vb", "left_anti").join(short.select(F.col("varlik").alias("va")), "va", "left_semi")
    named = _joined(nodes, full.select("va", "vb"))
    return members.select("alan", "ad", "sinif").join(named, ["alan", "sinif"]).select("alan", "ad", "varlik")


def _ways(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(va, vb): the different entities that links join, both ways."""
    own = nodes.select("alan", F.col("sinif").alias("a"), F.col("varlik").alias("va"))
    other = nodes.select("alan", F.col("sinif").alias("b"), F.col("varlik").alias("vb"))
    one = found.join(own, ["alan", "a"]).join(other, ["alan", "b"]).where("va <> vb").select("va", "vb")
    return one.unionByName(one.select(F.col("vb").alias("va"), F.col("va").alias("vb"))).distinct()


def _joined(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The nodes, with each entity va that has one way only gone to that vb."""
    only = ways.groupBy("va").agg(F.count("*").alias("n"), F.min("vb").alias("vb")).where("n = 1")
    groups = connected_components(only, "va", "vb").select(F.col("node").alias("varlik"), "component")
    return nodes.join(groups, "varlik", "left").select("alan", "sinif", F.coalesce("component", "varlik").alias("varlik"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling with its entity and the number of spellings of that entity."""
    found = entities(spellings(spark, sf_dir))
    sizes = found.groupBy("alan", "varlik").agg(F.count("*").alias("yazim_sayisi"))
    return found.join(sizes, ["alan", "varlik"]).select("alan", "ad", "varlik", "yazim_sayisi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of different spellings of one entity."""
    found = entities(spellings(spark, sf_dir))
    a = found.select("alan", "varlik", F.col("ad").alias("ad_a"))
    b = found.select("alan", "varlik", F.col("ad").alias("ad_b"))
    return a.join(b, ["alan", "varlik"]).where("ad_a < ad_b").select("alan", "ad_a", "ad_b").distinct()


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL: dict[str, str] = {}

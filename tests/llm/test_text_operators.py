"""Pieces, look-alike characters, languages, leaks and mixtures on small fixtures, against brute force where there is one."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomar.llm import evalleak, langid, lookalike, mixture, pieces

# ---------------------------------------------------------------- pieces


@settings(max_examples=150, deadline=None)
@given(st.text("ab ç.\n̈MADE1-;", max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    spans = pieces.pieces(text, limit, overlap)
    assert "".join(text[core:end] for _, core, end in spans) == text
    for n, (start, core, end) in enumerate(spans):
        assert 0 < end - start <= limit and core - start == (min(overlap, core) if n else 0)


def test_pieces_end_at_paragraphs_articles_and_sentences():
    text = "MADDE 1 - Birinci kural. İkinci cümle.\n\nMADDE 2 - Üçüncü kural burada.\n\nMADDE 3 - Son."
    own = [text[core:end] for _, core, end in pieces.pieces(text, 45, 5)]
    assert own[0].startswith("MADDE 1") and all(x.startswith("MADDE") for x in own)
    assert pieces.pieces(None, 10, 2) == [] == pieces.pieces("", 10, 2) and pieces.pieces("kısa", 10, 2) == [(0, 0, 4)]
    with pytest.raises(ValueError):
        pieces.pieces("x", 5, 5)


def test_pieces_follow_the_tree():
    body = lambda n: " ".join(f"Kural {n} numaralı {i}. cümledir." for i in range(3))
    text = "\n".join(["# Genel", "## Amaç", body(1), "## Kapsam", body(2), "# Özel", "## Usul", "1. " + body(3), "1.1. " + body(4), "2. " + body(5), "  - " + body(6), "## Son", body(7)])
    own = [text[core:end] for _, core, end in pieces.pieces(text, 300, 20)]
    assert "".join(own) == text
    # Chapters don't share a piece, headings stand before their text and never end a piece.
    assert not any("Kapsam" in x and "Usul" in x for x in own) and all(not x.strip().split("\n")[-1].startswith("#") for x in own)
    assert [r for _, r in pieces.marks(text)] == [1, 2, 2, 1, 2, 14, 15, 14, 22, 2]
    assert next(x for x in own if "## Usul" in x).startswith("# Özel") and any(x.startswith("2. ") and "  - " in x for x in own)
    small = pieces.pieces("# A\n" + "## B\nx.\n" * 20, 30, 5)
    assert all(("## B\nx.\n" * 20)[: b - max(c, 4)] for _, c, b in small) and len(small) > 5


def test_every_item_is_a_piece(spark, tmp_path):
    match = "array<struct<doc_id:string,icerik_ozeti:string>>"
    spark.createDataFrame([(1, "kısa metin", None), (2, "uzun cümle. " * 600, [("d", "x" * 1300), ("e", None)]), (3, None, [])], f"evrak_id long, raw_text string, legislation_matches {match}").write.parquet(str(tmp_path / "agent_state.parquet"))
    got = {(r.alan, r.evrak_id, r.sira, r.parca_sayisi) for r in pieces.p5_pieces(spark, str(tmp_path)).collect()}
    assert got == {("raw_text", 1, 0, 1), ("raw_text", 2, 0, 2), ("legislation_matches", 2, 1, 2)}
    assert {tuple(r) for r in pieces.p5_found(spark, str(tmp_path)).collect()} == {("raw_text", 2, 0), ("legislation_matches", 2, 1)}


def test_split_items_with_extra_columns_repeats_and_nothing(spark):
    rows = [("raw_text", 1, 0, "a" * 9000, "fazla"), ("raw_text", 1, 0, "a" * 9000, "fazla"), ("legislation_matches", 2, 3, "kelime " * 400, "x"), ("raw_text", 3, 0, "", "x")]
    frame = spark.createDataFrame(rows, "alan string, evrak_id long, sira int, metin string, parca string")
    got = pieces.split_items(frame).collect()
    assert {(r.evrak_id, r.parca_sayisi) for r in got} == {(1, 3), (2, 3)} and sum(r.evrak_id == 1 for r in got) == 6
    assert all(len(r.metin) <= pieces.LIMITS[r.alan][0] for r in got)
    assert pieces.split_items(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- look-alikes


@pytest.mark.parametrize("text,wanted,kinds", [
    ("Вахrіkışlа Москва", "Baxrikışla Москва", {"benzer_harf"}), ("ｎｅｄｅｎｉｙｌｅ １２", "nedeniyle 12", {"tam_genislik"}), ("a​b­c", "abc", {"gorunmez"}), ("a b　c", "a b c", {"bosluk"}),
    ("şü", "şü", {"birlesen"}), ("geri̇", "geri", {"birlesen"}), ("5 μm, 12 Ω, Αθήνα", "5 μm, 12 Ω, Αθήνα", set()), ("", "", set()), (None, None, set()), ("düz metin\t\n\f", "düz metin\t\n\f", set()),
    ("s​̧", "ş", {"gorunmez", "birlesen"}),
])
def test_rewriting(text, wanted, kinds):
    assert lookalike.Rewriter({})(text) == (wanted, kinds)


def test_rewriting_is_stable_and_classes_are_transitive():
    rewrite = lookalike.Rewriter({})
    rng = random.Random(1)
    alphabet = [b for _, _, b in lookalike.pairs()] + list("abcçğşü ")
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(12))
        once = rewrite(text)[0]
        assert rewrite(once)[0] == once
    classes = lookalike.Classes([("x", "a", "b"), ("x", "b", "c"), ("x", "q", "r")])
    assert classes.find("a") == classes.find("c") != classes.find("q")
    assert lookalike.Classes([("x", "a", "b"), ("x", "d", "b")]).rewrites({"d": 5, "a": 1})["b"][0] == "d"


def test_compatibility_forms_are_plain_and_units_stay():
    assert lookalike.Rewriter({})("𝐀nkara ﬁnal Ⅳ, m² ½ ㎡ № ª") == ("Ankara final IV, m² ½ ㎡ № ª", {"uyumluluk"})


@pytest.mark.parametrize("counts,wanted", [({"'": 9, "’": 2, "…": 1, "...": 7}, "it's, Ali'nin... ve... o"), ({"'": 1, "’": 2, "…": 4, "...": 3}, "it’s, Ali’nin… ve… o")])
def test_frequency_chooses_among_alike_signs(counts, wanted):
    assert lookalike.Rewriter(counts)("it's, Ali’nin… ve... o") == (wanted, {"isaret"})


def test_rewriting_ends_only_when_nothing_changes():
    text = "s" + "​̧" * 1 + "a" + "​" * 50 + "𝐛" + "­" * 9 + "̆"
    once, _ = lookalike.Rewriter({})(text)
    assert lookalike.Rewriter({})(once)[0] == once and not set(once) & set("​­𝐛")


def test_canonical_of_tables(spark):
    rows = [(1, "Аltyapı", 0), (1, "Аltyapı", 0), (2, None, 1), (3, "", 1)]
    frame = spark.createDataFrame(rows, "evrak_id long, raw_text string, turler int")
    got = sorted((r.evrak_id, r.metin or "", tuple(r.turler)) for r in lookalike.canonical(frame, "evrak_id", "raw_text").collect())
    assert got == [(1, "Altyapı", ("benzer_harf",)), (1, "Altyapı", ("benzer_harf",)), (2, "", ()), (3, "", ())]
    assert lookalike.canonical(frame.limit(0), "evrak_id", "raw_text").count() == 0


# ---------------------------------------------------------------- languages

SENTENCES = {
    "tr": "Belediye meclisi yeni yolun bakımı için karar almıştır. Başvuru sahipleri belgelerini cuma gününe kadar teslim etmelidir. Kurul toplantıda bütçe kalemlerini ayrıntılı biçimde görüşmüştür.",
    "en": "The council decided to repair the old road before winter. Applicants should hand in their papers until Friday. The board discussed every part of the budget in the meeting.",
    "de": "Der Rat hat beschlossen, die alte Straße vor dem Winter zu reparieren. Die Antragsteller sollen ihre Unterlagen bis Freitag einreichen. Der Ausschuss hat den Haushalt ausführlich besprochen.",
    "fr": "Le conseil a décidé de réparer l'ancienne route avant l'hiver. Les demandeurs doivent remettre leurs dossiers avant vendredi. La commission a discuté du budget pendant la réunion.",
}


def _documents(spark):
    rows = []
    for n, (code, text) in enumerate(SENTENCES.items()):
        parts = text.split(". ")
        rows += [(100 * n + i, ". ".join(parts[i % 3 :] + parts[: i % 3]).rstrip(".") + ".", code, "x") for i in range(8)]
    rows += [(901, SENTENCES["tr"], None, "x"), (902, SENTENCES["de"], "tr-TR", "x"), (903, SENTENCES["tr"] + "\n\n" + SENTENCES["en"], "tr", "x"), (904, "12345 -- 77", None, "x"), (905, None, "en", "x"), (906, "", "-", "x"), (907, SENTENCES["de"], "Deutsch", "x"), (908, SENTENCES["tr"].upper(), "unknown", "x"), (901, SENTENCES["tr"], None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, dil string")


def test_languages_of_documents(spark, tmp_path):
    _documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.dil) for r in langid.p9_found(spark, str(tmp_path)).collect()}
    assert found == {(901, "tr"), (902, "de"), (903, "tr"), (903, "en"), (908, "tr")}
    stretches = [(r.sira, r.dil) for r in langid.p9_segments(spark, str(tmp_path)).where("doc_id = 903").orderBy("sira").collect()]
    assert stretches == [(1, "tr"), (2, "en")]


def test_documents_in_no_known_language_are_und(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in _documents(spark).where("doc_id < 900").collect()]
    odd = [(950, "Ĝxqq wvzk ĵĵpk qqzr xxwv. Zzkq pqvx wwzq kkxq vvpz."), (951, SENTENCES["de"])]
    frame = spark.createDataFrame([*rows, *((i, t, None) for i, t in odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.dil, r.guven) for r in langid.languages(langid.segments(frame)).collect()}
    assert got[950][0] == "und" and 0 <= got[950][1] <= 1 and got[951][0] == "de" and len(got) == len(rows) + 2


def test_languages_are_those_of_the_labels(spark):
    italian = "Il consiglio ha deciso di riparare la vecchia strada prima dell'inverno. I richiedenti devono consegnare i loro documenti entro venerdì. La commissione ha discusso ogni parte del bilancio."
    rows = [(r.doc_id, r.text, r.lang) for r in _documents(spark).where("doc_id < 900").collect()] + [(800 + i, italian, "it-IT") for i in range(8)] + [(899, italian, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.dil for r in langid.languages(langid.segments(frame)).where("doc_id = 899").collect()} == {"it"}


def test_languages_of_nothing(spark):
    none = _documents(spark).limit(0)
    assert langid.languages(langid.segments(none)).count() == 0


@pytest.mark.parametrize("notation,code", [("TR", "tr"), ("tr-TR", "tr"), ("Türkçe", "tr"), ("ger", "de"), ("français", "fr"), ("AZƏRBAYCANCA", "az"), ("xyz", "xyz"), ("it", "it"), ("und", None), ("sonstige", None), ("", None), (None, None)])
def test_labels(spark, notation, code):
    assert spark.createDataFrame([(notation,)], "l string").select(langid.label(F.col("l")).alias("c")).first().c == code


# ---------------------------------------------------------------- leaks


def _item(rng, n):
    return [rng.choice("kurul meclis yol bakım onarım bütçe karar belge dosya arşiv sayım ölçüm rapor talep kayıt".split()) + rng.choice("lar ler ın e de".split()) + str(rng.randint(1, 999)) for _ in range(n)]


def _holds(document, item):
    """Brute force: some run of at least 30 words with one wrong word in ten, begun and ended by a right one."""
    for o in range(-len(item), len(document)):
        match = [0 <= i + o < len(document) and document[i + o] == w for i, w in enumerate(item)]
        for a in range(len(item)):
            for b in range(a + 30, len(item) + 1):
                if match[a] and match[b - 1] and 10 * match[a:b].count(False) <= b - a:
                    return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(_item(rng, rng.choice([25, 40, 70])))) for i in range(12)]
    docs = []
    for d in range(60):
        own = _item(rng, rng.randint(0, 60))
        words = items[d % 12][1].split()
        n = rng.choice([12, 20, 26, 30, 34, 45])
        a = rng.randrange(max(1, len(words) - n))
        quote = words[a : a + n]
        for k in range(rng.choice([0, 1, 2, 5])):
            quote[rng.randrange(len(quote))] = f"değişik{k}"
        text = " ".join(own[:10] + quote + own[10:])
        docs.append((d, text.upper() if d % 7 == 0 else text.replace(" ", "\n", 5) if d % 5 == 0 else text, "fazla"))
    docs += [(98, None, ""), (99, "", ""), (100, docs[0][1], "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, test_id string")
    asked = spark.createDataFrame(items + [(50, None), (51, "")], "test_id int, metin string")
    got = {(r.doc_id, r.test_id) for r in evalleak.leaks(frame, asked).collect()}
    folded = {i: evalleak.squeezed(t) for i, t in items}
    wanted = {(d, i) for d, t, _ in docs if t for i, w in folded.items() if len(w) >= 30 and _holds(evalleak.squeezed(t), w)}
    assert got == wanted and len(wanted) > 10
    # Items that don't fit a block are joined by shuffle, with the same rows.
    assert {(r.doc_id, r.test_id) for r in evalleak.leaks(frame, asked, block=0).collect()} == wanted
    assert evalleak.leaks_by_shuffle(frame.select("doc_id", "text").limit(0), asked).count() == 0
    assert evalleak.leaks(frame.limit(0), asked).count() == 0 == evalleak.leaks(frame, asked.limit(0)).count()


def test_replaced_words_of_other_lengths_stay_within_a_band():
    rng = random.Random(2)
    item = _item(rng, 36)
    quote = list(item)
    for k in (7, 15, 24):
        quote[k] = "x" * (len(quote[k]) + 40)
    index = evalleak.Items([(1, evalleak.squeezed(" ".join(item)))])
    assert index.passages([evalleak.squeezed(" ".join(["önce"] * 9 + quote))]) == [(0, 0)]


def test_many_items_by_shuffle(spark):
    """Items that share phrases, more than a block holds."""
    rng = random.Random(8)
    phrase = " ".join(_item(rng, 20))
    items = spark.range(5_000).selectExpr("cast(id as int) as test_id", f"concat('{phrase} ', array_join(transform(sequence(1, 34), i -> concat('k', hex(xxhash64(id, i)))), ' ')) as metin")
    some = {r.test_id: r.metin for r in items.where("test_id % 1000 = 7").collect()}
    docs = spark.createDataFrame([(i, f"giriş {m} son") for i, m in some.items()] + [(10**6 + i, f"{phrase} yalnızca ortak söz {i}") for i in range(200)], "doc_id long, text string")
    assert {tuple(r) for r in evalleak.leaks(docs, items).collect()} == {(i, i) for i in some}


def test_passages_begin_and_end_with_right_words():
    assert evalleak._passage([True] * 27 + [False] * 2 + [True])
    assert not evalleak._passage([True] * 27 + [False] * 3)
    assert not evalleak._passage([True] * 29) and evalleak._passage([False] * 9 + [True] * 30)


# ---------------------------------------------------------------- mixtures


def test_replication_has_the_mean_and_the_cap():
    for rate, cap in ((0.2, 1), (0.9, 1), (2.5, 4), (3.999, 4), (4, 4)):
        below = mixture.replication(rate, cap)
        assert cap - sum(below) == pytest.approx(rate, abs=1e-6) and len(below) == cap


def test_rates_hold_the_shares():
    got = mixture.rates({"a": 1000, "b": 100, "c": 7}, {"a": (0.5, 1), "b": (0.3, 4), "yok": (0.2, 2)})
    assert set(got) == {"a", "b"} and got["b"][0] == pytest.approx(4)
    assert got["a"][0] * 1000 / (got["b"][0] * 100) == pytest.approx(5 / 3)
    assert mixture.rates({}, {"a": (1.0, 2)}) == {} == mixture.rates({"a": 5}, {"a": (None, 2)})


def test_mixture_of_tables(spark):
    rows = [(i, "a" if i % 3 else "b", f"belge metni {i} " * 6, 0) for i in range(3000)] + [(9001, None, "kaynaksız", 0), (9002, "z", "hedefsiz", 0), (9003, "a", None, 0), (9004, "a", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, kopya int")
    targets = spark.createDataFrame([("a", 0.4, 3), ("b", 0.5, 2), ("yok", 0.1, 1)], "source string, hedef_pay double, azami_tekrar int")
    counts = mixture.token_counts(docs)
    plan = mixture.plan(counts, targets)
    mixed = mixture.mixture(docs, plan)
    most = {r.source: (r.m, r.n) for r in mixed.groupBy("source").agg(F.max("kopya").alias("m"), F.countDistinct("doc_id", "kopya").alias("n")).collect()}
    assert set(most) == {"a", "b"} and most["a"][0] <= 3 and most["b"][0] <= 2
    shares = {r.source: r.gercek_pay for r in mixture.report(counts, targets, plan).collect()}
    assert shares["a"] == pytest.approx(4 / 9, abs=0.03) and shares["b"] == pytest.approx(5 / 9, abs=0.03) and shares["yok"] == 0 == shares["z"]
    assert [tuple(r) for r in mixed.limit(50).collect()] == [tuple(r) for r in mixture.mixture(docs.repartition(7), plan).limit(50).collect()]
    none = mixture.token_counts(docs.limit(0))
    assert mixture.mixture(docs, mixture.plan(none, targets)).count() == 0

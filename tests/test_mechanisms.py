"""Triage, rule tables, search mechanisms and reports on small fixtures, with nulls, ties and empty tables."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tomar.operators import extract as X
from tomar.operators import mask as K
from tomar.operators import metrics as M
from tomar.operators import register as G
from tomar.operators import retrieval as R
from tomar.operators import rules as U
from tomar.operators import triage as T


def _one(spark, column, **values):
    kinds = ", ".join(f"{k} {'date' if isinstance(v, date) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,wanted", [("ÇOK ACELE\nmetin", ["cok_acele"]), ("ÇOK İVEDİ\nACELE\nx", ["cok_acele"]), ("ACELE\nGÜNLÜ", ["acele", "gunlu"]), ("çok acele bir iş", []), ("", []), (None, [])])
def test_stamps(spark, text, wanted):
    assert _one(spark, T.stamps("t"), t=text) == wanted


def test_deadlines_and_priority(spark):
    text = "Belgelerin 5.3.2025 tarihine kadar, itirazın 10 gün içinde, ekin 2 hafta içinde, raporun 1 ay içinde, cevabın 3 iş günü içinde verilmesi; 31.02.2025 tarihine kadar."
    assert _one(spark, T.explicit_deadlines("t"), t=text) == [date(2025, 3, 5)]
    got = {(x.n, x.birim): x.son for x in _one(spark, T.relative_deadlines("t", "d"), t=text, d=date(2025, 1, 31))}
    assert got == {(10, "gün"): date(2025, 2, 10), (2, "hafta"): date(2025, 2, 14), (1, "ay"): date(2025, 2, 28), (3, "iş günü"): date(2025, 2, 5)}
    assert _one(spark, T.relative_deadlines("t", "d"), t=None, d=date(2025, 1, 1)) == []
    for signals, wanted in (((1.0, 0.2), (1.0, "yuksek")), ((None, 0.55), (0.55, "orta")), ((None, None), (0.0, "dusuk"))):
        assert tuple(_one(spark, T.priority(*[F.lit(s).cast("double") for s in signals]), t="")) == wanted
    assert _one(spark, F.array(*[T.deadline_score(F.lit(d)) for d in (-2, 3, 7, 15, 90)]), t="") == [0.9, 0.9, 0.7, 0.55, 0.2]


@pytest.mark.parametrize("text,wanted", [
    ("2025 yılı mart ayının on ikinci günü yapılan", date(2025, 3, 12)), ("ŞUBAT ayının 3 günü, 2024 yılında", date(2024, 2, 3)), ("ocak ayının dördüncü günü 2023", date(2023, 1, 4)), ("şubat ayının otuzuncu günü 2023", None), ("mart ayının beşinci günü", None), (None, None),
])
def test_worded_dates(spark, text, wanted):
    assert _one(spark, T.worded_date("t"), t=text) == wanted


def test_document_date_chain(spark):
    assert _one(spark, T.document_date(F.col("a"), F.col("b")), a="yok", b="2024-05-06") == date(2024, 5, 6)
    assert _one(spark, T.document_date(F.col("a"), F.col("b")), a=None, b="31.02.2024") is None


def test_ranked_alternatives_bonus_and_confidence(spark):
    m = F.create_map(*[F.lit(x) for p in (("a", 4.0), ("b", 2.0), ("c", 2.0), ("d", 0.0), ("e", 1.0)) for x in p])
    rows = spark.createDataFrame([(1,)], "id long").select("id", m.alias("skorlar"))
    assert [(r.sinif, r.sira) for r in U.ranked(rows, "id").orderBy("sira").collect()] == [("b", 2), ("c", 3), ("e", 4)]
    assert U.ranked(rows.limit(0), "id").count() == 0
    assert _one(spark, U.with_bonus(m, ["d"])["d"], t="") == pytest.approx(0.4)
    assert _one(spark, U.covered_confidence(m, F.lit(1.0)), t="") == pytest.approx(0.5)
    zero = F.create_map(F.lit("a"), F.lit(0.0))
    assert _one(spark, U.covered_confidence(zero, F.lit(1.0)), t="") == 0.3


def test_validation_notes_and_best_candidate(spark):
    rules = [("konu", "Konu", 3.0, None), ("tarih", "[0-9]{4}", 1.0, None), ("ilgi", "İlgi", 5.0, F.col("t").contains("cevap"))]
    got = _one(spark, U.validated("t", rules), t="Konu : yol")
    assert (got.skor, got.uygun, got.eksikler) == (0.75, False, ["tarih"])
    assert _one(spark, U.validated("t", rules), t="Konu : yol 2024").uygun and not _one(spark, U.validated("t", rules), t="Konu : [KURUM] 2024").uygun
    assert _one(spark, U.validated("t", rules), t="cevap Konu 2024").eksikler == ["ilgi"] and _one(spark, U.validated("t", rules), t=None).skor == 0.0
    assert _one(spark, U.note(F.array(*[F.lit(f"k{i}") for i in range(9)])), t="") == "k0; k1; k2; k3; k4; k5"
    pick = lambda *c: _one(spark, U.best_candidate(*[(n, F.lit(t), F.lit(s)) for n, t, s in c]), t="")
    assert pick(("x", "a", 0.5), ("y", "b", 0.7)) == "y" and pick(("x", "a", 0.5), ("y", "b", 0.5)) == "x" and pick(("x", None, 0.9), ("y", "b", 0.1)) == "y" and pick(("x", None, 0.9)) is None


def test_citations_phrases_and_order(spark):
    assert _one(spark, U.unsupported(U.law_numbers("t"), F.array(F.lit("4734"))), t="4734 sayılı ve 6698 sayılı, 6698 sayılı") == ["6698"]
    titles = F.array(F.lit("Su Kanunu"), F.lit("Yol Tüzüğü"))
    assert _one(spark, U.contained(F.lit("YOL TÜZÜĞÜ m. 3"), titles), t="") == "Yol Tüzüğü" and _one(spark, U.contained(F.lit("hava"), titles), t="") is None
    assert _one(spark, U.by_priority(F.array(*[F.lit(x) for x in ("z", "imza", "adres", "a")]), {"imza": 0, "adres": 1}), t="") == ["imza", "adres", "a", "z"]
    assert [_one(spark, U.first_person("t"), t=x) for x in ("Ben geldim", "talep ediyorum", "kurum bildirdi", None)] == [True, True, False, False]
    assert _one(spark, U.holds_any("t", ["şifre"]), t="ŞİFRE nedir") and not _one(spark, U.holds_any("t", ["şifre"]), t=None)


def test_unknown_tokens_and_traces(spark):
    texts = spark.createDataFrame([(1, "yol bakımı yol kazası"), (2, ""), (3, None)], "id long, t string")
    assert [tuple(r) for r in U.unknown_share(texts, "id", "t", spark.createDataFrame([("yol",), ("yol",)], "term string")).collect()] == [(1, 3, 2, 0.666667)]
    steps = [("oku", F.col("t").isNotNull(), F.lit(0.9)), ("sec", F.lit(None).cast("boolean"), F.lit(None))]
    got = _one(spark, U.traced(steps, [(F.lit(True), "neden"), (F.lit(True), "neden"), (F.lit(None).cast("boolean"), "yok")]), t="x")
    assert got.tamam == 1 and got.atlanan == ["sec"] and got.nedenler == ["neden"] and [a.guven for a in got.adimlar] == [0.9, None]


def test_search_mechanisms(spark):
    chunks = spark.createDataFrame([(1, "su yolu bakımı"), (2, "yol yapımı"), (3, "park bahçe")], "id long, text string")
    every = R.with_external(chunks, spark.createDataFrame([(9, "hava durumu")], "id long, text string"))
    assert {(r.id, r.dis) for r in every.collect()} == {(1, False), (2, False), (3, False), (9, True)}
    ix = R.index(every)
    terms = R.query_terms(spark.createDataFrame([(1, "yol bahçe bilinmeyen"), (2, None)], "qid long, text string"))
    assert {r.qid: r.terimler for r in R.rationale(terms, ix, 2).collect()} == {1: ["bahçe", "yol"]}
    first = spark.createDataFrame([(1, 5, 0.1), (2, 5, 0.9), (3, 5, 0.1)], "qid long, id long, similarity double")
    second = spark.createDataFrame([(1, 6, 0.3), (2, 6, 0.95), (3, 6, 0.05), (4, 6, 0.2)], "qid long, id long, similarity double")
    assert {(r.qid, r.id) for r in R.corrected(first, second).collect()} == {(1, 6), (2, 5), (3, 5), (4, 6)}


def test_dense_blocks_give_the_same_lists(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    lists = lambda b: sorted((r.qid, r.id, r["rank"]) for r in R.dense_top(queries, vectors, 3, b).collect())
    assert lists(100) == lists(4) and len(lists(4)) == 36 and R.dense_top(queries.limit(0), vectors, 3).count() == 0


def test_precedent_majority(spark):
    cases = spark.createDataFrame([("a", 1, "x", "u"), ("a", 2, "y", None), ("a", 3, "y", "v"), ("b", 4, None, None)], "qid string, id long, tur string, birim string")
    own = spark.createDataFrame([("a", "x", None), ("b", "x", None)], "qid string, tur string, birim string")
    got = {r.qid: (r.n, r.tur, r.birim, r.celiski) for r in R.precedent_majority(cases, own).collect()}
    assert got == {"a": (3, "y", "u", True), "b": (1, None, None, False)}


def test_reports(spark):
    rows = spark.createDataFrame([(0.9, True, "a"), (0.8, False, "a"), (0.4, False, "b")], "conf double, ok boolean, g string")
    r = M.calibration_report(rows).first()
    assert r.n == 3 and r.dogruluk == pytest.approx(1 / 3) and r.brier == pytest.approx((0.01 + 0.64 + 0.16) / 3)
    assert {x.g: (x.n, x.k, x.oran) for x in M.rate_summary(rows, "g").collect()} == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
    f = _one(spark, M.entity_f1(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("b"), F.lit("c"))), t="")
    assert tuple(f) == (0.5, 0.5, 0.5) and tuple(_one(spark, M.entity_f1(F.lit(None).cast("array<string>"), F.array(F.lit("a"))), t="")) == (0.0, 0.0, 0.0)


def test_subjects_places_and_masks(spark):
    assert _one(spark, X.subject("t"), t="Konu  : yolun bakımı\n        ve onarımı\n        hakkında\nTarih : 1.1.2024") == "yolun bakımı ve onarımı hakkında"
    assert _one(spark, X.subject("t"), t="Konu : tek\n\nmetin") == "tek"
    assert _one(spark, X.places_of("t"), t="Ankara ve Kestane köyü, Van ile ankara; Ankara ilinde") == ["Ankara", "Van", "Kestane"] and len(X.PROVINCES) == 81
    assert _one(spark, K.registry_numbers("t"), t="sicil no: 48213 ve ticaret sicil no: 77123") == "sicil no: *** ve ticaret sicil no: 77123"
    assert _one(spark, K.addresses("t"), t="Kestane Mah. Gül Sok. No: 5 Kat 3 içinde") == "[ADRES] içinde" and _one(spark, K.addresses("t"), t=None) is None


def test_counts_of_the_register_read_no_text(spark, tmp_path):
    rows = [(1, "2024-01-02T00:00:00", "dilekce", "uzun metin"), (1, "2024-01-02T00:00:00", "dilekce", "uzun metin"), (2, "2024-01-01T00:00:00", "rapor", None)]
    spark.createDataFrame(rows, "id long, zaman string, tur string, metin_ozu string").write.parquet(str(tmp_path / "r"))
    counted = G.distribution(G.delivered_once(spark.read.parquet(str(tmp_path / "r"))), "tur")
    assert {(r.deger, r.n) for r in counted.collect()} == {("dilekce", 1), ("rapor", 1)}
    assert "metin_ozu" not in counted._jdf.queryExecution().executedPlan().toString()
    later = G.numbered(spark.read.parquet(str(tmp_path / "r")).drop("id"), 10).orderBy("id").collect()
    assert [r.zaman for r in later] == sorted(r.zaman for r in later) and later[0]["id"] >= 10

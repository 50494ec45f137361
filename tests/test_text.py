import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomar.functions import sequential as Q
from tomar.functions import text as T
from tomar.functions.dates import business_day, number_word, parse_date


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize("text,wanted", [("İIÇÖÜŞĞ", "iıçöüşğ"), ("Istanbul", "ıstanbul"), ("", ""), (None, None)])
def test_turkish_lower(spark, text, wanted):
    assert one(spark, T.tr_lower("x"), text) == wanted


def test_tokens_split_foreign_letters_and_drop_stop_words(spark):
    assert one(spark, T.tokens("x"), "Bu dilekçe için Kamu-Kurumu café 12 a") == ["dilekçe", "kamu", "kurumu", "caf", "12"]
    assert one(spark, T.tokens("x"), "") == []


def test_facts_keep_null_and_zero_apart(spark):
    rows = spark.createDataFrame([("3 gün", "3 gün ve 5 TL"), ("yok", "yok"), (None, None)], "s string, t string")
    got = rows.select(T.faithfulness("s", "t"), T.source_coverage("s", "t"), T.compression("s", "t")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5, 0.4), (1.0, None, 1.0), (1.0, None, 0.0)]


def test_simplified_keeps_facts(spark):
    assert one(spark, T.simplified_safely("x"), "Ayrıca, karar (açıklama) verildi.") == "karar verildi."
    assert one(spark, T.simplified_safely("x"), "Karar (2024) verildi.") == "Karar (2024) verildi."


def test_sentences_know_ordinals_abbreviations_and_initials():
    text = "Toplantı 5. etapta yapıldı. Dr. Kaya geldi ve konuştu. T.C. kurumu yanıt verdi. Kısa."
    assert Q.split_sentences(text) == ["Toplantı 5. etapta yapıldı.", "Dr. Kaya geldi ve konuştu.", "T.C. kurumu yanıt verdi."]
    assert Q.split_sentences(None) == [] == Q.split_sentences("")


@pytest.mark.parametrize("a,b,d", [("ca", "abc", 3), ("ab", "ba", 1), ("", "abc", 3), ("aynı", "aynı", 0)])
def test_osa(a, b, d):
    assert Q.osa(a, b) == d == Q.osa(b, a)


@settings(max_examples=60, deadline=None)
@given(st.text("abç", max_size=7), st.text("abç", max_size=7))
def test_osa_is_bounded(a, b):
    d = Q.osa(a, b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_perturbations_are_seeded():
    text = "Ölçüm sonuçları, kurul tarafından; incelenmiştir. " * 5
    for kind in Q.PERTURBATIONS:
        assert Q.perturbed(text, kind, 7) == Q.perturbed(text, kind, 7)


@pytest.mark.parametrize("text,wanted", [("5.3.2024", "2024-03-05"), ("7 Mart 2023", "2023-03-07"), ("2024-02-30", None), ("yok", None), (None, None)])
def test_parse_date(spark, text, wanted):
    got = one(spark, parse_date("x"), text)
    assert (str(got) if got else None) == wanted


def test_numbers_and_working_days(spark):
    assert one(spark, number_word("x"), "otuz beş") == 35 and one(spark, number_word("x"), "çok") is None
    got = one(spark, business_day(F.col("x").cast("date"), 3), "2024-04-19")
    assert str(got) == "2024-04-25"  # a weekend and a holiday lie between


@pytest.mark.parametrize("text,wanted", [("2 + 3 * 4", 14.0), ("2 ** 999", None), ("__import__('os')", None), ("", None), (None, None), ("1/0", None)])
def test_arithmetic(text, wanted):
    assert Q.evaluate(text) == wanted


def test_empty_tables(spark):
    none = spark.createDataFrame([], "x string")
    assert none.select(T.tokens("x"), T.facts("x"), T.language_signals("x"), T.cleaned("x"), Q.sentences("x")).collect() == []


def test_osa_units_compares_all_spellings(spark, tmp_path):
    from tomar.plans.text import QUERIES

    common = [f"{chr(97 + i) * 9}" for i in range(20)]
    rare = ["Fen İşleri", "Fen İşlri", "Fne İşleri", "Fen İşlerii", "nFe İşleir", "Fn İşler", "A", "AB", "BC", "Park"]
    spark.createDataFrame([(u,) for u in common * 5 + rare], "birim string").write.parquet(f"{tmp_path}/islemler.parquet")
    spellings = spark.createDataFrame([(a, b) for a in common + rare for b in common + rare if a != b], "a string, b string")
    want = {(r.a, r.b, r.d) for r in spellings.select("a", "b", Q.osa_distance("a", "b").alias("d")).where("d <= 2").collect()}
    got = [(r.birim, r.yaygin, r.uzaklik) for r in QUERIES["osa_units"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) > 10

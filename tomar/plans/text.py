"""Queries of the text functions over the corpus and the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomar.functions import sequential as Q
from tomar.functions import text as T
from tomar.session import spread, table

from .sql import TELLING, count_words, facts, low, tok


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _reg(spark, sf):
    return table(spark, sf, "islemler").distinct().select("id", F.col("ozet_ilk_200").alias("s"), F.col("metin_ozu").alias("t"))


def turkish_case(spark, sf):
    return table(spark, sf, "islemler").distinct().select("id", T.tr_lower("birim").alias("kucuk"), T.tr_upper("birim").alias("buyuk"), T.ascii_fold(T.tr_lower("birim")).alias("sade"))


def token_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.tokens("text")).alias("n"), T.word_count("text").alias("kelime")).where("n >= 0")


def stop_words_removed(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").select("chunk_id", T.without_stop_words("body").alias("metin"))


def clean_text(spark, sf):
    return table(spark, sf, "agent_state").where("raw_text is not null").select("evrak_id", F.length(T.cleaned("raw_text")).alias("n"), F.md5(T.cleaned("raw_text")).alias("ozet"))


def language_signals(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", T.language_signals("text").alias("s"), T.is_turkish("text").alias("turkce")).select("doc_id", "s.*", "turkce")


def readability_gate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.readable("text").alias("okunur"))


def input_cap(spark, sf):
    return _docs(spark, sf).where("text is not null").select("doc_id", T.capped("text", 1000).alias("x")).select("doc_id", F.length("x.metin").alias("n"), "x.kesildi")


def char_features(spark, sf):
    own = table(spark, sf, "mevzuat_parcalari").select("chunk_id", F.explode(T.features("section")).alias("oznitelik"))
    return own.groupBy("chunk_id", "oznitelik").agg(F.count("*").alias("tf"))


def facts_set(spark, sf):
    return _reg(spark, sf).where("t is not null").select("id", F.explode(T.facts("t")).alias("olgu"))


def summary_quality(spark, sf):
    own = _reg(spark, sf).where("s is not null and t is not null")
    return own.select("id", T.faithfulness("s", "t").alias("sadakat"), T.source_coverage("s", "t").alias("kapsama"), T.compression("s", "t").alias("sikistirma"))


def snippets(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").select("chunk_id", T.snippet("body").alias("alinti"))


def article_labels(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").select("chunk_id", T.article_label("articles").alias("etiket"))


def literal_search(spark, sf):
    return table(spark, sf, "islemler").distinct().where(T.contains_literal("metin_ozu", "50%") | T.contains_literal("metin_ozu", "tl bedelli")).select("id")


def number_codes(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").select("doc_id", T.code_of("doc_id").cast("string").alias("kod")).distinct()


def html_fields(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").select("chunk_id", T.html_escape("section").alias("guvenli"))


def sentence_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(Q.sentences("text")).alias("cumle"))


def osa_units(spark, sf):
    """The pairs of unit spellings at distance 1 or 2, both ways: such a pair shares what is left after at most two deletions on either side."""
    units = table(spark, sf, "islemler").where("birim <> ''").select("birim").distinct()
    fewer = lambda df: df.where("k <> ''").select("birim", F.explode(F.transform(F.sequence(F.lit(1), F.length("k")), lambda i: F.concat(F.substring("k", F.lit(1), i - 1), F.substring("k", i + 1, F.length("k"))))).alias("k")).distinct()
    whole = units.select("birim", F.col("birim").alias("k"))
    one = fewer(whole)
    keyed = whole.unionByName(one).unionByName(fewer(one)).distinct()
    pairs = keyed.join(keyed.select(F.col("birim").alias("yaygin"), "k"), "k").where("birim <> yaygin").select("birim", "yaygin").distinct()
    return pairs.select("birim", "yaygin", Q.osa_distance("birim", "yaygin").alias("uzaklik")).where("uzaklik between 1 and 2")


def rouge_scores(spark, sf):
    return _reg(spark, sf).select("id", Q.rouge_l_f1("s", "t").alias("rouge_l"))


def perturbation_variants(spark, sf):
    own = table(spark, sf, "mevzuat_parcalari").select("chunk_id", F.explode(Q.variants()("body")).alias("v"))
    return own.select("chunk_id", "v.tur", F.length("v.metin").alias("n"))


QUERIES = {f.__name__: f for f in (turkish_case, token_counts, stop_words_removed, clean_text, language_signals, readability_gate, input_cap, char_features, facts_set, summary_quality, snippets, article_labels, literal_search, number_codes, html_fields, sentence_counts, osa_units, rouge_scores, perturbation_variants)}

_REG = "(select distinct id, ozet_ilk_200 as s, metin_ozu as t from (select distinct * from islemler))"
_UP = lambda c: f"upper(translate({c}, 'iıçöüşğ', 'İIÇÖÜŞĞ'))"
_COMMON = lambda a, b: f"len(list_intersect({a}, {b}))"
_CLEAN = r"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(raw_text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
SQL = {
    "turkish_case": f"select id, {low('birim')} as kucuk, {_UP('birim')} as buyuk, translate({low('birim')}, 'çğıöşüâîû', 'cgiosuaiu') as sade from (select distinct * from islemler)",
    "token_counts": f"select doc_id, len({tok('text')})::int as n, {count_words('text')}::int as kelime from documents where text is not null",
    "stop_words_removed": f"select chunk_id, array_to_string(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '' and not list_contains({tok.__globals__['STOP']}, {low('w')})), ' ') as metin from mevzuat_parcalari",
    "clean_text": f"select evrak_id, length({_CLEAN})::int as n, md5({_CLEAN}) as ozet from agent_state where raw_text is not null",
    "language_signals": rf"""with s as (select doc_id, length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::int as h, length(regexp_replace(text, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) as o, regexp_extract_all({low('text')}, '\p{{L}}+') as w from documents where text is not null),
        r as (select doc_id, h as harf_sayisi, len(w)::int as kelime_sayisi, case when h > 0 then round(o / h, 4) else 0.0 end as turkce_karakter_orani, case when len(w) > 0 then round(len(list_filter(w, lambda x: list_contains({TELLING}, x))) / len(w), 4) else 0.0 end as durak_kelime_orani from s)
        select *, harf_sayisi < 20 or turkce_karakter_orani >= 0.01 or durak_kelime_orani >= 0.05 as turkce from r""",
    "readability_gate": r"select doc_id, coalesce(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 30, false) as okunur from documents",
    "input_cap": "select doc_id, least(length(text), 1000)::int as n, length(text) > 1000 as kesildi from documents where text is not null",
    "char_features": f"""with t as (select chunk_id, unnest({tok('section')}) as t from mevzuat_parcalari), g as (select chunk_id, t as oznitelik from t union all
        select chunk_id, 'c3:' || substr('<' || t || '>', i::int, 3) from (select chunk_id, t, unnest(range(1, length(t) + 1)) as i from t)) select chunk_id, oznitelik, count(*) as tf from g group by all""",
    "facts_set": f"select id, unnest({facts('t')}) as olgu from {_REG} where t is not null",
    "summary_quality": f"""with f as (select id, {facts('s')} as a, {facts('t')} as b, {count_words('s')} as x, {count_words('t')} as y from {_REG} where s is not null and t is not null)
        select id, case when len(a) = 0 then 1.0 else round({_COMMON('a', 'b')} / len(a), 4) end as sadakat, case when len(b) > 0 then round({_COMMON('a', 'b')} / len(b), 4) end as kapsama, case when y > 0 then round(x / y, 4) else 0.0 end as sikistirma from f""",
    "snippets": r"select chunk_id, case when length(body) <= 300 then body else regexp_replace(substr(body, 1, 300), '\s\S*$', '') || '...' end as alinti from mevzuat_parcalari",
    "article_labels": "select chunk_id, array_to_string(list_transform(articles, lambda x: 'm. ' || x), ', ') as etiket from mevzuat_parcalari",
    "literal_search": "select id from (select distinct * from islemler) where contains(lower(metin_ozu), '50%') or contains(lower(metin_ozu), 'tl bedelli')",
    "number_codes": "select distinct doc_id, cast((('0x' || substr(sha256(doc_id), 1, 12))::bigint) % 90000000 + 10000000 as varchar) as kod from mevzuat_parcalari",
    "html_fields": "select chunk_id, replace(replace(replace(replace(replace(coalesce(section, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as guvenli from mevzuat_parcalari",
}

"""Queries of the mechanisms behind triage, rule tables, validation, citations, precedents and reports; the rules here are examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomar.operators import classify as C
from tomar.operators import extract as X
from tomar.operators import mask as K
from tomar.operators import metrics as M
from tomar.operators import register as G
from tomar.operators import retrieval as R
from tomar.operators import rules as U
from tomar.operators import triage as T
from tomar.session import spread, table

from .documents import RULES
from .metrics import _P, _REL, _pairs
from .sql import listed, low, tok

#: Example rules: (name, pattern, class, weight) of signals, (name, pattern, weight) of the parts of a letter.
SIGNALS = [
    ("sayi", r"(?m)^[ \t]*Say[ıi][ \t]*:", "yazisma", 2.0), ("ilgi", r"(?m)^[ \t]*İlgi[ \t]*:", "yazisma", 1.0), ("arz", r"arz ederim", "dilekce", 1.5), ("kimlik", r"[Kk]imlik", "dilekce", 1.0),
    ("tutanak", r"(?i)tutanak", "tutanak", 2.0), ("madde", r"MADDE [0-9]+", "mevzuat", 2.0),
]
PARTS = [("sayi", r"(?m)^[ \t]*Say[ıi][ \t]*:", 2.0), ("konu", r"(?m)^[ \t]*Konu[ \t]*:", 2.0), ("tarih", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", 1.5), ("kapanis", r"(?:arz|rica) eder", 1.5), ("ilgi", r"(?m)^[ \t]*İlgi[ \t]*:", 1.0)]
PLACEHOLDER = r"\[[A-ZÇĞİÖŞÜ _]+\]"
PHRASES = ["önceki talimat", "şifre", "sistem mesajı", "talimatları yok say"]
RANKS = {"imza": 0, "kimlik_no": 0, "adres": 1, "tarih": 1, "iletisim": 2}


def _texts(spark, sf):
    return spread(table(spark, sf, "agent_state").where("raw_text is not null").select("evrak_id", "alinma", F.col("raw_text").alias("text")))


def urgency_stamps(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.array_join(T.stamps("text"), ",").alias("damgalar"), T.stamp_score(T.stamps("text")).alias("puan"))


def deadline_candidates(spark, sf):
    """Deadlines by calendar days; those in working days are in triage_scores."""
    own = _texts(spark, sf)
    fixed = own.select("evrak_id", F.lit("acik").alias("tur"), F.explode(F.transform(T.explicit_deadlines("text"), lambda d: d.cast("string"))).alias("son"))
    relative = own.select("evrak_id", F.explode(T.relative_deadlines("text", "alinma")).alias("x")).where("x.birim <> 'iş günü'")
    return fixed.unionByName(relative.select("evrak_id", F.lit("gorece").alias("tur"), F.col("x.son").cast("string").alias("son"))).distinct()


def triage_scores(spark, sf):
    own = _texts(spark, sf).withColumn("b", F.to_date("alinma"))
    all_ = F.concat(T.explicit_deadlines("text"), F.transform(T.relative_deadlines("text", "alinma"), lambda x: x["son"]))
    timed = own.select("evrak_id", "b", T.stamps("text").alias("s"), F.array_min(all_).alias("son"))
    p = T.priority(T.stamp_score("s"), T.deadline_score(F.datediff("son", "b")))
    return timed.select("evrak_id", F.col("son").cast("string").alias("son"), p["skor"].alias("skor"), p["oncelik"].alias("oncelik"))


def document_dates(spark, sf):
    """The date of a document: the field that was read, else the labelled line, else the day it came in."""
    own = table(spark, sf, "agent_state").select("evrak_id", "extracted_info.evrak_tarihi", F.regexp_extract(F.coalesce("raw_text", F.lit("")), r"(?m)^[ \t]*Tarih[ \t]*:[ \t]*([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})", 1).alias("satir"), F.date_format("alinma", "yyyy-MM-dd").alias("geldi"))
    return own.select("evrak_id", T.document_date(F.col("evrak_tarihi"), F.col("satir"), F.col("geldi")).cast("string").alias("tarih"))


def structural_signals(spark, sf):
    m = U.signal_scores("text", SIGNALS)
    return _texts(spark, sf).select("evrak_id", *[m[k].alias(k) for k in dict.fromkeys(s[2] for s in SIGNALS)])


def ranked_alternatives(spark, sf):
    return U.ranked(_texts(spark, sf).select("evrak_id", C.keyword_scores("text", RULES).alias("skorlar")), "evrak_id")


def routing_confidence(spark, sf):
    """Scores with a bonus for one class, and the confidence of the best by its lead and the share of classes with a score."""
    m = U.with_bonus("m", ["rapor"])
    coverage = F.size(F.filter(F.map_values("m"), lambda v: v > 0)) / F.lit(len(RULES))
    return _texts(spark, sf).select("evrak_id", C.keyword_scores("text", RULES).alias("m")).select("evrak_id", F.round(m["rapor"], 6).alias("rapor"), F.round(U.covered_confidence(m, coverage), 6).alias("guven"))


def format_validation(spark, sf):
    rules = [(n, p, w, F.col("text").contains("ilgi") if n == "ilgi" else None) for n, p, w in PARTS]
    v = U.validated("text", rules, PLACEHOLDER)
    return _texts(spark, sf).select("evrak_id", v["skor"].alias("skor"), v["uygun"].alias("uygun"), U.note(v["eksikler"]).alias("not_"))


def best_texts(spark, sf):
    """Which of the two texts of a document is the better letter."""
    rules = [(n, p, w, None) for n, p, w in PARTS]
    own = table(spark, sf, "agent_state").select("evrak_id", F.col("raw_text").alias("a"), F.col("ocr_result.metin").alias("b"))
    return own.select("evrak_id", U.best_candidate(*[(n, F.col(c), U.validated(c, rules)["skor"]) for n, c in (("raw_text", "a"), ("ocr_result", "b"))]).alias("metin"))


def unsupported_laws(spark, sf):
    """Law numbers of a text that the titles and summaries of its suggestions don't cite."""
    own = table(spark, sf, "agent_state").where("raw_text is not null")
    allowed = F.flatten(F.transform(F.coalesce("legislation_matches", F.array()), lambda m: U.law_numbers(F.concat_ws(" ", m["baslik"], m["icerik_ozeti"]))))
    return own.select("evrak_id", F.explode(U.unsupported(U.law_numbers("raw_text"), allowed)).alias("kanun"))


def cited_titles(spark, sf):
    """The subject of a document beside the first suggested title that holds it or is held by it; by the title's first word."""
    own = table(spark, sf, "agent_state").where("raw_text is not null")
    titles = F.transform(F.coalesce("legislation_matches", F.array()), lambda m: m["baslik"])
    first = F.regexp_extract(F.coalesce("extracted_info.konu", F.lit("")), r"^(\S+)", 1)
    return own.select("evrak_id", first.alias("soz"), U.contained(first, titles).alias("baslik")).where("soz <> '' and baslik is not null")


def missing_by_priority(spark, sf):
    own = table(spark, sf, "etiketler").where("eksik_alanlar is not null").select("evrak_id", F.array_join(U.by_priority(F.array_compact("eksik_alanlar"), RANKS), ",").alias("sirali"))
    return own.distinct()


def first_person_texts(spark, sf):
    return _texts(spark, sf).select("evrak_id", U.first_person("text").alias("birinci_sahis"))


def phrase_alarms(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", U.holds_any("text", PHRASES).alias("alarm")))


def unknown_tokens(spark, sf):
    laws = table(spark, sf, "mevzuat_parcalari").select(F.explode(R.tokens(F.concat_ws(" ", "title", "section", "body"))).alias("term"))
    return U.unknown_share(_texts(spark, sf), "evrak_id", "text", laws)


def step_traces(spark, sf):
    own = table(spark, sf, "agent_state")
    steps = [("okuma", F.coalesce("raw_text", "ocr_result.metin").isNotNull(), F.lit(1.0)), ("siniflandirma", F.col("classification.tur").isNotNull(), F.col("classification.guven")), ("cikarim", F.col("extracted_info.konu").isNotNull(), F.lit(None)), ("mevzuat", F.size(F.coalesce("legislation_matches", F.array())) > 0, F.lit(None))]
    t = U.traced(steps, [(F.col("classification.guven") < 0.6, "dusuk guven"), (F.col("classification.tur").isNull(), "tur yok"), (F.col("extracted_info.konu").isNull(), "konu yok")])
    return own.select("evrak_id", t["tamam"].alias("tamam"), F.array_join(t["atlanan"], ",").alias("atlanan"), F.array_join(t["nedenler"], ",").alias("nedenler"))


def batch_summary(spark, sf):
    """One line a document: dashes for what is missing, a header of what is there, and how many fields were read."""
    own = table(spark, sf, "agent_state")
    dash = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("—"))
    x = "extracted_info."
    read = sum((F.coalesce((F.col(x + c) != "").cast("int"), F.lit(0)) for c in ("evrak_tarihi", "evrak_sayisi", "konu", "muhatap")), F.lit(0))
    lists = sum((F.size(F.coalesce(F.col(x + c), F.array().cast("array<string>"))) for c in ("kurum_adlari", "kisi_adlari", "ilgi_referanslari")), F.lit(0))
    head = F.concat_ws(" | ", "classification.tur_adi", x + "konu", x + "evrak_tarihi")
    return own.select("evrak_id", dash("input_file").alias("dosya"), dash("classification.tur_adi").alias("tur"), dash(x + "muhatap").alias("muhatap"), head.alias("kunye"), (read + lists).cast("int").alias("alan_sayisi"))


def precedent_votes(spark, sf):
    """The register rows of a document as its cases: their majority and whether the document's own class speaks against it."""
    cases = G.delivered_once(table(spark, sf, "islemler").select("id", "kaynak", "tur", "birim")).where("kaynak is not null and kaynak <> 'dogrudan_metin'").withColumnRenamed("kaynak", "qid")
    own = table(spark, sf, "agent_state").select(F.col("input_file").alias("qid"), F.col("classification.tur").alias("tur"), F.lit(None).cast("string").alias("birim"))
    return R.precedent_majority(cases, own).select("qid", "n", "tur", F.round("tur_payi", 6).alias("tur_payi"), "birim", F.round("birim_payi", 6).alias("birim_payi"), "celiski")


def rationale_terms(spark, sf):
    laws = table(spark, sf, "mevzuat_parcalari").select(F.col("chunk_id").alias("id"), F.concat_ws(" ", "title", "section", "body").alias("text"))
    terms = R.query_terms(_texts(spark, sf).select(F.col("evrak_id").alias("qid"), "text"))
    return R.rationale(terms, R.index(laws)).select("qid", F.array_join("terimler", ",").alias("terimler"))


def _chunks(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").select(F.col("chunk_id").cast("bigint").alias("id"), F.concat_ws(" ", "title", "section", "body").alias("text"))


def corrective_search(spark, sf):
    """Search by the subject; where that finds nothing near, by the words of the class too. Corpus and held-out items in one index."""
    external = table(spark, sf, "test_maddeleri").select((F.col("test_id") + 1_000_000).cast("bigint").alias("id"), F.col("metin").alias("text"))
    every = R.with_external(_chunks(spark, sf), external)
    ix = R.index(every)
    own = table(spark, sf, "agent_state").select(F.col("evrak_id").alias("qid"), F.col("extracted_info.konu").alias("text"), F.concat_ws(" ", "extracted_info.konu", "classification.tur_adi").alias("more"))
    found = lambda c: R.saturated(R.bm25(t := R.query_terms(own.select("qid", F.col(c).alias("text"))), ix), t, ix).select("qid", "id", "similarity")
    best = R.top(R.corrected(found("text"), found("more")), 3, "similarity").where("similarity > 0")
    return best.join(every, "id").select("qid", "id", "rank", F.round("similarity", 4).alias("similarity"), F.substring("text", 1, 240).alias("alinti"), "dis")


def places_in_texts(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.explode(X.places_of("text")).alias("yer"))


def address_masks(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.md5(K.addresses("text").cast("binary")).alias("ozet"), F.regexp_count("text", F.lit(K.ADDRESS)).alias("n"))


def calibration_summary(spark, sf):
    return M.calibration_report(_pairs(spark, sf)).select("n", *[F.round(c, 6).alias(c) for c in ("dogruluk", "guven", "ece", "mce", "brier")])


def rates_by_class(spark, sf):
    return M.rate_summary(_pairs(spark, sf), "truth").select("truth", "n", "k", *[F.round(c, 6).alias(c) for c in ("oran", "alt", "ust")])


def entity_quality(spark, sf):
    """Expected against suggested laws of each document, as sets."""
    labels = table(spark, sf, "etiketler").where("mevzuat_beklenen is not null").groupBy("evrak_id").agg(F.min("mevzuat_beklenen").alias("g"))
    state = table(spark, sf, "agent_state").select("evrak_id", F.transform(F.coalesce("legislation_matches", F.array()), lambda m: m["doc_id"]).alias("f"))
    e = M.entity_f1(F.col("g"), F.col("f"))
    return labels.join(state, "evrak_id").select("evrak_id", *[F.round(e[c], 6).alias(c) for c in ("precision", "recall", "f1")])


QUERIES = {
    f.__name__: f
    for f in (
        urgency_stamps, deadline_candidates, triage_scores, document_dates, structural_signals, ranked_alternatives, routing_confidence, format_validation, best_texts, unsupported_laws, cited_titles, missing_by_priority,
        first_person_texts, phrase_alarms, unknown_tokens, step_traces, batch_summary, precedent_votes, rationale_terms, corrective_search, places_in_texts, address_masks, calibration_summary, rates_by_class, entity_quality,
    )
}

_T = "(select evrak_id, alinma, raw_text as text from agent_state where raw_text is not null)"
_has = lambda p, c="text": f"coalesce(regexp_matches({c}, '{p}'), false)"
_STAMP = {n: _has(T.stamp_pattern(b)) for n, b, _, _ in T.STAMPS}
_VOID = {weak: n for n, _, _, weak in T.STAMPS if weak}
_ON = {n: f"({_STAMP[n]} and not {_STAMP[_VOID[n]]})" if n in _VOID else _STAMP[n] for n in _STAMP}
_WEIGHT = "greatest(" + ", ".join(f"case when {_ON[n]} then {w} end" for n, _, w, _ in T.STAMPS) + ")::double"
_DUE = rf"""fixed as (select evrak_id, 'acik' as tur, try_strptime(replace(d, '/', '.'), '%d.%m.%Y')::date as son from (select evrak_id, unnest(list_distinct(regexp_extract_all({low('text')}, '{T.EXPLICIT}', 1))) as d from {_T})),
    rel as (select evrak_id, 'gorece' as tur, case u when 'gün' then b + n when 'hafta' then b + 7 * n when 'ay' then (b + to_months(n))::date end as son
        from (select evrak_id, alinma::date as b, try_cast(regexp_extract(x, '^([0-9]+)', 1) as integer) as n, regexp_extract(x, '^[0-9]+ (iş günü|gün|hafta|ay) ', 1) as u
            from (select evrak_id, alinma, unnest(list_distinct(regexp_extract_all({low('text')}, '{T.RELATIVE}'))) as x from {_T})) where u <> 'iş günü')"""
_RULE = lambda words: " + ".join(f"case when contains({low('text')}, '{w}') then {x} else 0 end" for w, x in words.items())
_SCORES = "s as (select evrak_id, " + ", ".join(f"({_RULE(words)})::double as {name}" for name, words in RULES.items()) + f" from {_T})"
_NAMES = list(RULES)
_SUM = lambda rules, c: " + ".join(f"case when {_has(p, c)} then {w} else 0 end" for _, p, w in rules)
_ALLW = sum(w for _, _, w in PARTS)
_LAW = lambda c: f"list_distinct(regexp_extract_all(coalesce({c}, ''), '(?:^|[^0-9])([0-9]{{3,4}}) sayılı', 1))"
_DASH = lambda c: f"coalesce(nullif(trim({c}), ''), '—')"
_VOTES = lambda c: f"""select qid, {c}, payi from (select qid, {c}, n / sum(n) over (partition by qid) as payi, row_number() over (partition by qid order by n desc, first, {c}) as r
    from (select qid, {c}, count(*) as n, min(id) as first from c where {c} is not null group by 1, 2)) where r = 1"""  # noqa: E731
SQL = {
    "urgency_stamps": f"select evrak_id, array_to_string(list_filter([{', '.join(f"case when {_ON[n]} then '{n}' end" for n in _ON)}], lambda x: x is not null), ',') as damgalar, {_WEIGHT} as puan from {_T}",
    "deadline_candidates": f"with {_DUE} select distinct evrak_id, tur, son::varchar as son from (select * from fixed where son is not null union all select * from rel)",
    "document_dates": r"""select evrak_id, coalesce(
        try_strptime(regexp_extract(extracted_info.evrak_tarihi, '(?:^|[^0-9])([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?:[^0-9]|$)', 1).replace('/', '.'), '%d.%m.%Y')::date,
        try_strptime(regexp_extract(coalesce(raw_text, ''), '(?m)^[ \t]*Tarih[ \t]*:[ \t]*([0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})', 1).replace('/', '.'), '%d.%m.%Y')::date, alinma::date)::varchar as tarih from agent_state""",
    "structural_signals": "select evrak_id, " + ", ".join(f"({_SUM([(n, p, w) for n, p, k, w in SIGNALS if k == name], 'text')})::double as {name}" for name in dict.fromkeys(s[2] for s in SIGNALS)) + f" from {_T}",
    "ranked_alternatives": f"""with {_SCORES}, l as ({' union all '.join(f"select evrak_id, '{n}' as sinif, {n} as skor from s" for n in _NAMES)}),
        r as (select *, row_number() over (partition by evrak_id order by skor desc, sinif) as sira from l where skor > 0) select evrak_id, sinif, skor, sira::int as sira from r where sira between 2 and 4""",
    "routing_confidence": f"""with {_SCORES}, b as (select *, rapor + 0.1 * greatest({', '.join(_NAMES)}) as yeni from s),
        o as (select evrak_id, yeni, list_reverse_sort([{', '.join('yeni' if n == 'rapor' else n for n in _NAMES)}]) as v, ({' + '.join(f'({n} > 0)::int' for n in _NAMES)}) / {len(_NAMES)} as c from b)
        select evrak_id, round(yeni, 6) as rapor, round(least(0.97, greatest(0.3, (case when v[1] > 0 then (v[1] - v[2]) / v[1] else 0 end) * (0.6 + 0.4 * c))), 6) as guven from o""",
    "format_validation": f"""with v as (select evrak_id, text, contains(text, 'ilgi') as var, {', '.join(f'{_has(p)} as h_{n}' for n, p, _ in PARTS)} from {_T}),
        s as (select *, round(({' + '.join(f"case when h_{n}{' and var' if n == 'ilgi' else ''} then {w} else 0 end" for n, _, w in PARTS)})::double / ({_ALLW - 1.0} + case when var then 1.0 else 0 end)::double, 4) as skor from v)
        select evrak_id, skor, skor >= 0.8 and not regexp_matches(text, '{PLACEHOLDER}') as uygun, array_to_string(list_filter([{', '.join(f"case when {'var and ' if n == 'ilgi' else ''}not h_{n} then '{n}' end" for n, _, _ in PARTS)}], lambda x: x is not null)[:6], '; ') as not_ from s""",
    "best_texts": f"""with s as (select evrak_id, raw_text as a, ocr_result.metin as b, {_SUM(PARTS, 'a')} as x, {_SUM(PARTS, 'b')} as y from agent_state)
        select evrak_id, case when a is null and b is null then null when a is null then 'ocr_result' when b is null or x >= y then 'raw_text' else 'ocr_result' end as metin from s""",
    "unsupported_laws": f"""select evrak_id, unnest(list_filter(a, lambda x: not list_contains(b, x))) as kanun from (select evrak_id, {_LAW('raw_text')} as a,
        coalesce(flatten(list_transform(legislation_matches, lambda m: {_LAW("concat_ws(' ', m.baslik, m.icerik_ozeti)")})), []) as b from agent_state where raw_text is not null)""",
    "cited_titles": rf"""select evrak_id, soz, baslik from (select evrak_id, soz, list_filter(list_transform(legislation_matches, lambda m: m.baslik), lambda t: contains({low('t')}, {low('soz')}) or contains({low('soz')}, {low('t')}))[1] as baslik
        from (select evrak_id, legislation_matches, regexp_extract(coalesce(extracted_info.konu, ''), '^(\S+)', 1) as soz from agent_state where raw_text is not null)) where soz <> '' and baslik is not null""",
    "missing_by_priority": "select distinct evrak_id, array_to_string(list_transform(list_sort(list_transform(list_filter(eksik_alanlar, lambda x: x is not null), lambda v: {'r': case " + " ".join(f"when v = '{k}' then {r}" for k, r in RANKS.items()) + " else 9 end, 'v': v})), lambda x: x.v), ',') as sirali from etiketler where eksik_alanlar is not null",
    "first_person_texts": f"select evrak_id, len(list_filter(regexp_extract_all({low('text')}, '[a-zçğıöşüâîû]+'), lambda w: list_contains({listed(U.FIRST_PERSON)}, w) or regexp_matches(w, '{U.FIRST_ENDINGS}'))) > 0 as birinci_sahis from {_T}",
    "phrase_alarms": f"select doc_id, {' or '.join(f"contains(coalesce({low('text')}, ''), '{p}')" for p in PHRASES)} as alarm from documents",
    "unknown_tokens": f"""with v as (select distinct unnest({tok("concat_ws(' ', title, section, body)")}) as term from mevzuat_parcalari), o as (select evrak_id, unnest(list_distinct({tok('text')})) as term from {_T})
        select evrak_id, count(*) as n, count(*) filter (v.term is null) as bilinmeyen, round(count(*) filter (v.term is null) / count(*), 6) as oran from o left join v using (term) group by evrak_id""",
    "step_traces": """with s as (select evrak_id, coalesce(raw_text, ocr_result.metin) is not null as a, classification.tur is not null as b, extracted_info.konu is not null as c, coalesce(len(legislation_matches), 0) > 0 as d, coalesce(classification.guven < 0.6, false) as e from agent_state)
        select evrak_id, (a::int + b::int + c::int + d::int) as tamam, array_to_string(list_filter([case when not a then 'okuma' end, case when not b then 'siniflandirma' end, case when not c then 'cikarim' end, case when not d then 'mevzuat' end], lambda x: x is not null), ',') as atlanan,
        array_to_string(list_filter([case when e then 'dusuk guven' end, case when not b then 'tur yok' end, case when not c then 'konu yok' end], lambda x: x is not null), ',') as nedenler from s""",
    "batch_summary": f"""select evrak_id, {_DASH('input_file')} as dosya, {_DASH('classification.tur_adi')} as tur, {_DASH('extracted_info.muhatap')} as muhatap, concat_ws(' | ', classification.tur_adi, extracted_info.konu, extracted_info.evrak_tarihi) as kunye,
        ({' + '.join(f"coalesce((extracted_info.{c} <> '')::int, 0)" for c in ('evrak_tarihi', 'evrak_sayisi', 'konu', 'muhatap'))} + {' + '.join(f'coalesce(len(extracted_info.{c}), 0)' for c in ('kurum_adlari', 'kisi_adlari', 'ilgi_referanslari'))})::int as alan_sayisi from agent_state""",
    "precedent_votes": f"""with c as (select distinct id, kaynak as qid, tur, birim from islemler where kaynak is not null and kaynak <> 'dogrudan_metin'), t as ({_VOTES('tur')}), b as ({_VOTES('birim')}), k as (select qid, count(*) as n from c group by 1)
        select k.qid, k.n, t.tur, round(t.payi, 6) as tur_payi, b.birim, round(b.payi, 6) as birim_payi, coalesce(t.tur <> a.classification.tur, false) as celiski
        from k left join t on t.qid = k.qid left join b on b.qid = k.qid left join agent_state a on a.input_file = k.qid""",
    "rationale_terms": f"""with l as (select chunk_id, unnest(list_distinct({tok("concat_ws(' ', title, section, body)")})) as term from mevzuat_parcalari), m as (select count(*) as n from mevzuat_parcalari),
        i as (select term, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) as idf from l, m group by term, n), q as (select evrak_id as qid, unnest(list_distinct({tok('text')})) as term from {_T}),
        r as (select qid, term, row_number() over (partition by qid order by idf desc, term) as r from q join i using (term)) select qid, string_agg(term, ',' order by r) as terimler from r where r <= 3 group by qid""",
    "places_in_texts": f"""select evrak_id, unnest(list_distinct(list_concat(list_filter({listed(X.PROVINCES)}, lambda p: list_contains(w, p)), y))) as yer from
        (select evrak_id, regexp_extract_all(text, '[A-ZÇĞİÖŞÜ][a-zçğıöşü]+') as w, regexp_extract_all(text, '{X.PLACE}', 1) as y from {_T})""",
    "address_masks": f"select evrak_id, md5(regexp_replace(text, '{K.ADDRESS}', '[ADRES]', 'g')) as ozet, len(regexp_extract_all(text, '{K.ADDRESS}'))::int as n from {_T}",
    "calibration_summary": f"with {_P}, b as ({_REL}) select (select count(*) from p) as n, (select round(avg(ok::int), 6) from p) as dogruluk, (select round(avg(conf), 6) from p) as guven, round(sum(abs(confidence - correct) * n) / sum(n), 6) as ece, round(max(abs(confidence - correct)), 6) as mce, (select round(avg(pow(conf - ok::int, 2)), 6) from p) as brier from b",
    "rates_by_class": f"""with {_P}, c as (select truth, count(*) as n, count(*) filter (ok) as k from p group by 1), w as (select *, k / n as p, 1 + 3.8416 / n as d from c)
        select truth, n, k, round(p, 6) as oran, round(greatest(0, (p + 3.8416 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) as alt, round(least(1, (p + 3.8416 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) as ust from w""",
    "entity_quality": """with g as (select evrak_id, list_distinct(min(mevzuat_beklenen)) as g from etiketler where mevzuat_beklenen is not null group by 1), e as (select g.evrak_id, g, list_distinct(coalesce(list_transform(legislation_matches, lambda m: m.doc_id), [])) as f from g join agent_state a using (evrak_id)),
        s as (select evrak_id, case when len(f) > 0 then len(list_intersect(g, f)) / len(f) else 0 end as p, case when len(g) > 0 then len(list_intersect(g, f)) / len(g) else 0 end as r from e)
        select evrak_id, round(p, 6)::double as "precision", round(r, 6)::double as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6)::double as f1 from s""",
}

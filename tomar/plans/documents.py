"""Queries over the texts as documents: fields, masks, summaries, classifiers, relations, sources and streams."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from tomar.operators import classify as C
from tomar.operators import extract as X
from tomar.operators import mask as K
from tomar.operators import metrics as M
from tomar.operators import naive_bayes as N
from tomar.operators import relations as R
from tomar.operators import summary as S
from tomar.operators.components import connected_components
from tomar.session import spread, table
from tomar.sources import readers, writers
from tomar.streaming import streams

from .sql import low, tok

#: An example rule table in the project's terms: words that speak for a type of document.
RULES = {
    "dilekce": {"dilekçe": 2.0, "arz ederim": 1.5, "başvuru": 1.0},
    "rapor": {"rapor": 2.0, "incelen": 1.0, "tespit": 1.0},
    "tutanak": {"tutanak": 2.0, "imza": 1.0},
    "genelge": {"genelge": 2.0, "rica ederim": 1.0},
}


def _texts(spark, sf):
    return spread(table(spark, sf, "agent_state").where("raw_text is not null").select("evrak_id", F.col("raw_text").alias("text")))


# ---------------------------------------------------------------- fields


def field_emails(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.explode(X.emails("text")).alias("eposta"))


def field_numbers(spark, sf):
    return _texts(spark, sf).select("evrak_id", X.own_number("text").alias("sayi"), F.size(X.document_numbers("text")).alias("n"))


def field_ibans(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.explode(X.ibans("text")).alias("iban"))


def field_amounts(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.explode(X.amounts("text")).alias("tutar"))


def field_dates(spark, sf):
    return _texts(spark, sf).select("evrak_id", F.explode(X.dates("text")).alias("tarih"))


def field_subjects(spark, sf):
    return _texts(spark, sf).select("evrak_id", X.subject("text").alias("konu"))


def field_struct(spark, sf):
    own = _texts(spark, sf).select("evrak_id", X.fields("text").alias("f"))
    return own.select("evrak_id", "f.evrak_tarihi", "f.muhatap", F.size("f.ilgi").alias("ilgi"), F.size("f.telefonlar").alias("telefon"), X.missing_fields("f", ["evrak_sayisi", "konu", "muhatap", "ilgi"]).alias("eksik"))


def field_lines(spark, sf):
    return _texts(spark, sf).select("evrak_id", X.line_fields("text").alias("x")).select("evrak_id", "x.*")


def national_number_check(spark, sf):
    own = _texts(spark, sf).select("evrak_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{11}"), F.lit(0)))).alias("sayi"))
    return own.select("evrak_id", "sayi", X.national_number_valid("sayi").alias("gecerli"))


# ---------------------------------------------------------------- masks


def email_mask(spark, sf):
    return _texts(spark, sf).where(F.contains("text", F.lit("@"))).select("evrak_id", F.md5(K.emails("text")).alias("ozet"))


def pii_counts(spark, sf):
    return _texts(spark, sf).select("evrak_id", K.counts("text").alias("s")).select("evrak_id", "s.eposta", "s.iban")


def leak_audit(spark, sf):
    names = table(spark, sf, "agent_state").select("evrak_id", F.col("extracted_info.kisi_adlari").alias("adlar"))
    own = _texts(spark, sf).join(names, "evrak_id").select("evrak_id", K.audit(K.masked("text", F.col("adlar"))).alias("a"))
    return own.select("evrak_id", "a.*")


def audit_raw(spark, sf):
    return _texts(spark, sf).select("evrak_id", K.audit("text").alias("a")).select("evrak_id", "a.eposta", "a.iban")


# ---------------------------------------------------------------- summaries


def summaries(spark, sf):
    own = spread(table(spark, sf, "agent_state").where("raw_text is not null").select(F.col("evrak_id").alias("id"), F.col("raw_text").alias("text"), F.col("extracted_info.konu").alias("subject")))
    return S.summaries(own).select(F.col("id").alias("evrak_id"), "summary")


# ---------------------------------------------------------------- classifiers


def rule_scores(spark, sf):
    own = _texts(spark, sf).select("evrak_id", C.keyword_scores("text", RULES).alias("m"))
    return own.select("evrak_id", *[F.col("m")[c].alias(c) for c in RULES])


def rule_decisions(spark, sf):
    own = _texts(spark, sf).select("evrak_id", C.keyword_scores("text", RULES).alias("m")).select("evrak_id", C.decided("m", "diger").alias("d"))
    return own.select("evrak_id", "d.class", "d.confidence")


def damped_scores(spark, sf):
    own = _texts(spark, sf).select("evrak_id", C.damped_scores("text", {"bakim": {"bakım": 1.0, "onarım": 1.0}}).alias("m"))
    return own.select("evrak_id", F.round(F.col("m")["bakim"], 6).alias("puan"))


def first_match_rule(spark, sf):
    orders = table(spark, sf, "orders")
    rules = [(F.col("o_totalprice") > 300000, F.lit("buyuk")), (F.col("o_orderpriority").startswith("1"), F.lit("acil")), (F.col("o_orderstatus") == "O", F.lit("acik"))]
    return orders.select("o_orderkey", F.coalesce(C.first_match(rules), F.lit("-")).alias("kural"))


def _labelled(spark, sf):
    types = table(spark, sf, "documents").where("evrak_turu is not null and text <> ''")
    return types.select(F.col("doc_id").alias("id"), "text", F.col("evrak_turu").alias("label"))


def nb_prior(spark, sf):
    return N.train(_labelled(spark, sf)).prior.select("class", F.round("log_prior", 6).alias("log_prior"), F.round("unseen", 6).alias("unseen"))


def nb_predict(spark, sf):
    model = N.train(_labelled(spark, sf))
    found = N.predict(model, _labelled(spark, sf)).select("id", "class", F.round("probability", 5).alias("probability"))
    return found


def _all_labelled(spark, sf):
    types = spread(table(spark, sf, "documents").where("evrak_turu is not null and text <> ''"))
    return types.select(F.col("doc_id").alias("id"), "text", F.col("evrak_turu").alias("label"))


def nb_prior_all(spark, sf):
    """As nb_prior, of all labelled documents."""
    return N.train(_all_labelled(spark, sf)).prior.select("class", F.round("log_prior", 6).alias("log_prior"), F.round("unseen", 6).alias("unseen"))


def nb_predict_all(spark, sf):
    """As nb_predict, trained on all labelled documents and for every document."""
    every = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return N.predict(N.train(_all_labelled(spark, sf)), every).select("id", "class", F.round("probability", 5).alias("probability"))


def nearest_units(spark, sf):
    """The most similar other spelling of each unit spelling."""
    units = table(spark, sf, "islemler").where("birim <> ''").select("birim").distinct()
    near = C.nearest(units.select(F.col("birim").alias("q")), units.select(F.col("birim").alias("c")), 0.75, others=True)
    return near.select("q", "candidate", F.round("similarity", 6).alias("similarity"))


def metamorphic_invariance(spark, sf):
    from tomar.functions.sequential import variants

    own = table(spark, sf, "mevzuat_parcalari").select("body", F.explode(variants()("body")).alias("v"))
    decide = lambda c: C.decided(C.keyword_scores(c, RULES), "diger")["class"]
    return M.invariance(own.select(F.col("v.tur").alias("kind"), decide(F.col("body")).alias("original"), decide(F.col("v.metin")).alias("changed"))).select("kind", "n", F.round("same", 6).alias("same"))


# ---------------------------------------------------------------- relations


def _related(spark, sf):
    x = table(spark, sf, "agent_state").where("extracted_info is not null")
    return x.select(F.col("evrak_id").alias("id"), F.col("extracted_info.evrak_sayisi").alias("number"), F.coalesce("extracted_info.ilgi_referanslari", F.array().cast("array<string>")).alias("refs"), F.col("extracted_info.konu").alias("subject"), F.concat(F.array("extracted_info.muhatap"), F.coalesce("extracted_info.kurum_adlari", F.array().cast("array<string>"))).alias("parties"))


def reference_edges(spark, sf):
    return R.references(_related(spark, sf)).select("src", "dst")


def subject_edges(spark, sf):
    return R.similar_counts(_related(spark, sf))


def relation_chains(spark, sf):
    return R.chains(_related(spark, sf))


def unlinked_documents(spark, sf):
    own = _related(spark, sf)
    return R.unlinked(own, R.chains(own))


def order_components_all(spark, sf):
    """The components of the graph of orders and parts that all line items make, and their sizes."""
    edges = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sources and sinks


def label_file_rows(spark, sf):
    """The labels written as a label file and read again."""
    labels = table(spark, sf, "etiketler").where("tur is not null").dropDuplicates(["file"])
    one = labels.select(F.to_json(F.create_map("file", F.struct("tur", "birim_kodu", "eksik_alanlar", "aciklama", "mevzuat_beklenen"))).alias("value"))
    read = one.select(F.from_json("value", f"map<string,{readers.LABEL}>").alias("m")).select(F.explode("m").alias("file", "x")).select("file", "x.tur", F.size("x.eksik_alanlar").alias("eksik"))
    return read


def corpus_overview(spark, sf):
    return table(spark, sf, "mevzuat_parcalari").groupBy("doc_id").agg(F.min("title").alias("baslik"), F.count("*").alias("bolum"), F.sum(F.length("body")).alias("karakter"))


def scan_quality(spark, sf):
    own = table(spark, sf, "agent_state").select(F.col("ocr_result.engine_used").alias("motor"), (F.col("classification.guven") * 100).alias("confidence")).where("motor is not null")
    return readers.scan_quality(own, "motor").select("motor", "n", F.round("mean", 4).alias("mean"), F.round("poor", 6).alias("poor"), "grade")


def run_seal(spark, sf):
    files = table(spark, sf, "agent_state").select(F.col("input_file").alias("file"), F.col("raw_text").alias("text"))
    return writers.seal(files).select("files", "seal")


def metadata_records(spark, sf):
    own = _texts(spark, sf)
    record = writers.metadata({"sayi": X.own_number("text"), "konu": X.subject("text"), "tarih": X.document_date("text").cast("string")})
    agrees = writers.metadata_agrees({"sayi": (F.col("r.sayi"), X.own_number("text")), "konu": (F.col("r.konu"), X.subject("text"))})
    return own.withColumn("r", record).select("evrak_id", writers.metadata_xml("r").alias("xml"), agrees["uyumlu"].alias("uyumlu"))


def html_reports(spark, sf):
    own = table(spark, sf, "islemler").distinct()
    page = writers.html_report(F.col("kaynak"), {"Tür": F.col("tur"), "Birim": F.col("birim"), "Özet": F.col("ozet_ilk_200")})
    return own.select("id", writers.file_name("kaynak", "html").alias("dosya"), F.length(page).alias("n"))


# ---------------------------------------------------------------- streams


def _streamed(spark, sf, name, query):
    """A table as a stream of its files; the result of what is there."""
    path = f"{sf}/{name}.parquet"
    schema = table(spark, sf, name).schema
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(path) else f"{name}.parquet").parquet(folder)
    memory = f"akis_{abs(hash((name, tempfile.mktemp())))}"
    streams.run_once(query(stream), memory)
    return spark.table(memory)


def stream_feedback(spark, sf):
    return _streamed(spark, sf, "geri_bildirim", streams.feedback_counts).select("predicted", "true", "n", "evidence")


def stream_windows(spark, sf):
    return _streamed(spark, sf, "events", lambda s: streams.windowed(s.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")).select(F.to_date("start").alias("gun"), "event_type", "n")


def user_sessions(spark, sf):
    own = streams.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return own.groupBy("user_id").agg(F.count("*").alias("oturum"), F.sum("n").alias("olay"))


QUERIES = {
    f.__name__: f
    for f in (
        field_emails, field_numbers, field_ibans, field_amounts, field_dates, field_subjects, field_struct, field_lines, national_number_check, email_mask, pii_counts, leak_audit, audit_raw, summaries, rule_scores, rule_decisions,
        damped_scores, first_match_rule, nb_prior, nb_predict, nb_prior_all, nb_predict_all, nearest_units, metamorphic_invariance, reference_edges, subject_edges, relation_chains, unlinked_documents, order_components_all, label_file_rows, corpus_overview,
        scan_quality, run_seal, metadata_records, html_reports, stream_feedback, stream_windows, user_sessions,
    )
}

_T = "(select evrak_id, raw_text as text from agent_state where raw_text is not null)"
_ALL = lambda p: f"list_distinct(regexp_extract_all(text, '{p}'))"
_EMAIL, _IBAN, _AMOUNT = X.EMAIL, X.IBAN, X.AMOUNT
_SCORE = lambda r: " + ".join(f"case when contains(l, '{w}') then {x} else 0.0 end" for w, x in r.items())
_RULED = f"r as (select evrak_id, {', '.join(f'{_SCORE(r)} as {c}' for c, r in RULES.items())} from (select evrak_id, {low('text')} as l from {_T}))"
_BEST = "list_sort([" + ", ".join(f"{{'s': -{c}, 'k': '{c}'}}" for c in RULES) + "])[1]"
_DAMP = lambda w: f"case when n_{w} > 0 then 1 + 0.25 * least(n_{w} - 1, 3) else 0 end"
_FEAT = f"""lab as (select doc_id as id, text, evrak_turu as c from documents where evrak_turu is not null and text <> ''),
    tk as (select id, c, unnest({tok('text')}) as t from lab), fe as (select id, c, t as f from tk union all select id, c, 'c3:' || substr('<' || t || '>', i::int, 3) from (select *, unnest(range(1, length(t) + 1)) as i from tk)),
    tf as (select id, c, f, count(*) as tf from fe group by all), nn as (select count(*) as n from lab), idf as (select f, ln((n + 1) / (df + 1)) + 1 as idf from (select f, count(*) as df from tf group by f), nn),
    w as (select c, f, sum((1 + ln(tf)) * idf) as w from tf join idf using (f) group by all), tot as (select c, sum(w) + (select count(*) from idf) as b from w group by c),
    ll as (select c, f, ln((w + 1) / b) as ll from w join tot using (c)), pr as (select c, ln(count(*) / n) as lp, ln(1 / b) as un from lab join tot using (c), nn group by c, n, b)"""
_REL = "rel as (select evrak_id as id, extracted_info.evrak_sayisi as number, coalesce(extracted_info.ilgi_referanslari, []) as refs from agent_state where extracted_info is not null)"
_REFS = f"""{_REL}, cited as (select distinct id as dst, unnest(regexp_extract_all({low('line')}, '[0-9a-zçğıöşü][0-9a-zçğıöşü./-]*[0-9a-zçğıöşü]')) as num from (select id, unnest(refs) as line from rel)),
    named as (select id as src, trim({low('number')}) as num from rel where length(trim(number)) >= 5 and regexp_matches(number, '[0-9]') and not regexp_matches(trim(number), '^(19|20)[0-9]{{2}}$')),
    e as (select distinct src, dst from named join cited using (num) where src <> dst)"""
SQL = {
    "field_emails": f"select evrak_id, unnest({_ALL(_EMAIL)}) as eposta from {_T}",
    "field_numbers": f"select evrak_id, nullif(trim(regexp_extract(text, '(?m)^[ \\t]*Say[ıi][ \\t]*:[ \\t]*(\\S+)', 1)), '') as sayi, len({_ALL(X.DOCUMENT_NUMBER)})::int as n from {_T}",
    "field_ibans": f"select distinct evrak_id, regexp_replace(x, '\\s', '', 'g') as iban from (select evrak_id, unnest({_ALL(_IBAN)}) as x from {_T})",
    "field_amounts": f"select evrak_id, unnest({_ALL(_AMOUNT)}) as tutar from {_T}",
    "field_subjects": f"select evrak_id, nullif(trim(regexp_replace(regexp_extract(text, '(?m)^[ \\t]*Konu[ \\t]*:[ \\t]*([^\\n]+(?:\\n[ \\t]{{2,}}[^\\n:]+$){{0,3}})', 1), '[ \\t\\n]+', ' ', 'g'), ' '), '') as konu from {_T}",
    "national_number_check": f"""with s as (select evrak_id, unnest({_ALL('[0-9]{11}')}) as sayi from {_T}), d as (select *, list_transform(range(1, 12), lambda i: substr(sayi, i::int, 1)::int) as d from s)
        select evrak_id, sayi, d[1] > 0 and (((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10 + 10) % 10 = d[10] and list_sum(d[1:10]) % 10 = d[11] and len(list_distinct(d)) > 1 as gecerli from d""",
    "email_mask": f"select evrak_id, md5(regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]{{0,63}}@((?:[A-Za-z0-9-]{{1,63}}\\.){{1,6}}[A-Za-z]{{2,15}})', '\\1***@\\2', 'g')) as ozet from {_T} where contains(text, '@')",
    "pii_counts": f"select evrak_id, len({_ALL(_EMAIL)})::int as eposta, len(list_distinct(list_transform(regexp_extract_all(text, '{_IBAN}'), lambda x: regexp_replace(x, '\\s', '', 'g'))))::int as iban from {_T}",
    "audit_raw": f"select evrak_id, len(regexp_extract_all(text, '{K.AUDIT['eposta']}'))::int as eposta, len(regexp_extract_all(text, '{K.AUDIT['iban']}'))::int as iban from {_T}",
    "rule_scores": f"with {_RULED} select evrak_id, {', '.join(f'{c}::double as {c}' for c in RULES)} from r",
    "rule_decisions": f"""with {_RULED}, b as (select *, {_BEST} as best from r) select evrak_id, case when best.s < 0 then best.k else 'diger' end as class,
        case when best.s < 0 then round(exp(-best.s / 2.0) / ({' + '.join(f'exp({c} / 2.0)' for c in RULES)}), 3) else 0.1 end as confidence from b""",
    "damped_scores": f"""with l as (select evrak_id, {low('text')} as l from {_T}), n as (select evrak_id, len(regexp_extract_all(l, '(?:^|[^a-zçğıöşüâîû0-9])bakım')) as n_a, len(regexp_extract_all(l, '(?:^|[^a-zçğıöşüâîû0-9])onarım')) as n_b from l)
        select evrak_id, round({_DAMP('a')} + {_DAMP('b')}, 6)::double as puan from n""",
    "first_match_rule": "select o_orderkey, case when o_totalprice > 300000 then 'buyuk' when starts_with(o_orderpriority, '1') then 'acil' when o_orderstatus = 'O' then 'acik' else '-' end as kural from orders",
    "nb_prior": f"with {_FEAT} select c as class, round(lp, 6) as log_prior, round(un, 6) as unseen from pr",
    "nb_predict": f"""with {_FEAT}, x as (select id, f, (1 + ln(tf)) * idf as w from tf join idf using (f)), m as (select id, sum(w) as mass from x group by id), s as (select id, c, sum(w * (ll - un)) as more from x join ll using (f) join pr using (c) group by all),
        e as (select l.id, pr.c, lp + case when mass > 0 then 6 * (un + coalesce(more, 0) / mass) else 0 end as s from (select distinct id from lab) l cross join pr left join m using (id) left join s on s.id = l.id and s.c = pr.c)
        select id, c as class, round(exp(s - max(s) over (partition by id)) / sum(exp(s)) over (partition by id) * exp(max(s) over (partition by id)), 5) as probability from e""",
    "reference_edges": f"with {_REFS} select src, dst from e",
    "label_file_rows": "select file, min(tur) as tur, min(len(eksik_alanlar))::int as eksik from etiketler where tur is not null group by file",
    "corpus_overview": "select doc_id, min(title) as baslik, count(*) as bolum, sum(length(body))::bigint as karakter from mevzuat_parcalari group by 1",
    "scan_quality": """select ocr_result.engine_used as motor, count(*) as n, round(avg(g), 4) as mean, round(avg((g < 60)::int), 6) as poor, case when avg(g) >= 80 then 'iyi' when avg(g) >= 60 then 'orta' else 'zayif' end as grade
        from (select *, classification.guven * 100 as g from agent_state) where ocr_result.engine_used is not null and g >= 0 group by 1""",
    "stream_feedback": """select tahmin_tur as predicted, dogru_tur as "true", count(*) as n, case when count(*) >= 3 then 'guclu' when count(*) >= 2 then 'orta' else 'zayif' end as evidence from geri_bildirim where tahmin_tur <> dogru_tur group by all""",
    "stream_windows": "select ts::date as gun, event_type, count(*) as n from events group by all",
    "user_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events)
        select user_id, sum(new)::bigint as oturum, count(*) as olay from g group by 1""",
}

"""Queries of the audit register: filters, counts, latest rows, cockpit, feedback, plus the same shapes on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomar.functions.dates import business_day, escalation, parse_date
from tomar.operators import metrics as M
from tomar.operators import register as G
from tomar.session import table

_REG = "(select distinct * from islemler)"


def _register(spark, sf):
    return G.delivered_once(table(spark, sf, "islemler"))


def register_totals(spark, sf):
    return G.totals(_register(spark, sf)).select("toplam", *[F.round(c, 4).alias(c) for c in ("ortalama_guven", "ortalama_sure")], "insan_onayi", "eksik")


def register_groups(spark, sf):
    return G.distribution(_register(spark, sf), "tur", "birim", "oncelik")


def register_filter(spark, sf):
    return G.query(_register(spark, sf), tur="dilekce", approval=True, text="Başvuru", limit=500).select("id", "tur", "birim", "insan_onayi")


def register_latest(spark, sf):
    return G.query(_register(spark, sf), limit=6).select("id", "kaynak", "tur")


def register_columns(spark, sf):
    return G.migrated(_register(spark, sf).drop("yazi_turu")).select("id", "zaman", "tur", "yazi_turu")


def register_cited(spark, sf):
    return G.cited(_register(spark, sf))


def pending_antijoin(spark, sf):
    handled = table(spark, sf, "geri_bildirim").select(F.col("dosya").alias("kaynak")).distinct()
    done = _register(spark, sf).join(handled, "kaynak", "left_semi").select("id")
    return G.pending(_register(spark, sf), done).select("id", "kaynak")


def cockpit_summary(spark, sf):
    rounded = ("eksik_orani", "ortalama_guven", "tasarruf_orani")
    return G.cockpit(_register(spark, sf)).select("toplam", "eksikli", "kaynak_sayisi", *[F.round(c, 6).alias(c) for c in rounded])


def latest_per_source(spark, sf):
    return G.top_per(_register(spark, sf), "kaynak", "id", 2).select("kaynak", "id", "sira")


def review_gate(spark, sf):
    own = _register(spark, sf).withColumn("acil", F.coalesce(F.col("tur_guven") < 0.6, F.lit(True)))
    return own.groupBy("tur").agg(F.count("*").alias("n"), F.count_if("acil").alias("inceleme"))


def feedback_patterns(spark, sf):
    return M.feedback_patterns(table(spark, sf, "geri_bildirim").distinct(), "tahmin_tur", "dogru_tur")


def feedback_majority(spark, sf):
    rows = table(spark, sf, "geri_bildirim").distinct().select("dosya", F.col("dogru_birim").alias("vote"), F.col("zaman").alias("seen"))
    return M.majority(rows, "dosya").select("dosya", "winner", F.round("share", 6).alias("share"))


def deadline_days(spark, sf):
    own = _register(spark, sf).select("id", parse_date("son_tarih").alias("son"), F.try_to_date(F.substring("zaman", 1, 10), "yyyy-MM-dd").alias("gun"))
    left = F.datediff("son", "gun")
    return own.where("son is not null and gun is not null").select("id", left.alias("kalan"), escalation(left).alias("durum"))


def business_days(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return orders.select("o_orderkey", business_day("d", 10).alias("son_gun"))


def latency_percentiles(spark, sf):
    own = M.latency(table(spark, sf, "events"), "value", "event_type")
    return own.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99", "least", "greatest")])


def duration_percentiles(spark, sf):
    own = M.latency(_register(spark, sf), "sure_saniye")
    return own.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95", "p99", "least", "greatest")])


def step_shares(spark, sf):
    steps = table(spark, sf, "events").select(F.col("event_type").alias("step"), F.col("value").alias("seconds"), (F.col("value") > 0).alias("ok"))
    return M.step_shares(steps).select("step", "n", *[F.round(c, 4).alias(c) for c in ("total", "mean", "share")])


def linearity_ratio(spark, sf):
    scales = table(spark, sf, "events").groupBy((F.dayofmonth("ts") % 3 + 1).alias("scale")).agg(F.round(F.sum("value"), 4).alias("seconds"))
    return M.linearity(scales).select("scale", "seconds", F.round("ratio", 6).alias("ratio"))


def throughput_by_day(spark, sf):
    own = table(spark, sf, "events").groupBy(F.to_date("ts").alias("gun")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return own.select("gun", "n", F.round(M.throughput(F.col("n"), F.col("s")), 6).alias("hiz"))


QUERIES = {f.__name__: f for f in (register_totals, register_groups, register_filter, register_latest, register_columns, register_cited, pending_antijoin, cockpit_summary, latest_per_source, review_gate, feedback_patterns, feedback_majority, deadline_days, business_days, latency_percentiles, duration_percentiles, step_shares, linearity_ratio, throughput_by_day)}

_HOLIDAYS = "['01-01','04-23','05-01','05-19','07-15','08-30','10-29']"
_LAT = "round(avg({v}), 6) as mean, round(median({v}), 6) as median, round(quantile_cont({v}::double, 0.95), 6) as p95, round(quantile_cont({v}::double, 0.99), 6) as p99, round(min({v}), 6) as least, round(max({v}), 6) as greatest"
_TEXT = lambda c: f"contains(lower({c}), lower('Başvuru'))"
SQL = {
    "register_totals": f"select count(*) as toplam, round(avg(tur_guven), 4) as ortalama_guven, round(avg(sure_saniye), 4) as ortalama_sure, coalesce(sum(insan_onayi), 0)::bigint as insan_onayi, coalesce(sum(eksik_sayisi), 0)::bigint as eksik from {_REG}",
    "register_groups": f"with r as (select * from {_REG}) " + " union all ".join(f"select '{c}' as alan, {c} as deger, count(*) as n from r where {c} <> '' group by {c}" for c in ("tur", "birim", "oncelik")),
    "register_filter": f"select id, tur, birim, insan_onayi from {_REG} where tur = 'dilekce' and insan_onayi = 1 and (coalesce({_TEXT('ozet_ilk_200')}, false) or coalesce({_TEXT('metin_ozu')}, false)) order by id desc limit 500",
    "register_latest": f"select id, kaynak, tur from {_REG} order by id desc limit 6",
    "register_columns": f"select id, zaman, tur, cast(null as varchar) as yazi_turu from {_REG}",
    "register_cited": f"select id, {', '.join(f"coalesce({c}, '') as {c}" for c in ('kaynak', 'tur', 'birim', 'ozet_ilk_200', 'metin_ozu', 'zaman', 'yazi_turu'))} from {_REG}",
    "pending_antijoin": f"select id, kaynak from {_REG} where insan_onayi = 1 and (kaynak is null or kaynak not in (select dosya from geri_bildirim where dosya is not null))",
    "cockpit_summary": f"""select count(*) as toplam, count(*) filter (eksik_sayisi > 0) as eksikli, count(distinct kaynak) as kaynak_sayisi, round(avg((eksik_sayisi > 0)::int), 6) as eksik_orani,
        round(avg(tur_guven), 6) as ortalama_guven, round(greatest(0.0, least(1.0, 1 - coalesce(sum(sure_saniye), 0) / (count(*) * 720.0))), 6) as tasarruf_orani from {_REG}""",
    "latest_per_source": f"select kaynak, id, row_number() over (partition by kaynak order by id desc) as sira from {_REG} qualify sira <= 2",
    "review_gate": f"select tur, count(*) as n, count(*) filter (coalesce(tur_guven < 0.6, true)) as inceleme from {_REG} group by tur",
    "feedback_patterns": """select tahmin_tur as predicted, dogru_tur as "true", count(*) as n, case when count(*) >= 3 then 'guclu' when count(*) >= 2 then 'orta' else 'zayif' end as evidence
        from (select distinct * from geri_bildirim) where tahmin_tur <> dogru_tur group by all""",
    "feedback_majority": """with c as (select dosya, dogru_birim as v, count(*) as n, min(zaman) as f from (select distinct * from geri_bildirim) where dogru_birim is not null group by all)
        select dosya, v as winner, round(n / sum(n) over (partition by dosya), 6) as share from c qualify row_number() over (partition by dosya order by n desc, f, v) = 1""",
    "deadline_days": rf"""with o as (select id, coalesce(try_cast(case when regexp_matches(son_tarih, '^\d{{4}}-\d{{2}}-\d{{2}}') then left(son_tarih, 10) end as date), try_strptime(regexp_extract(son_tarih, '\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}'), '%d.%m.%Y')::date) as son,
        try_cast(case when regexp_matches(left(zaman, 10), '^\d{{4}}-\d{{2}}-\d{{2}}$') then left(zaman, 10) end as date) as gun from {_REG})
        select id, datediff('day', gun, son)::int as kalan, case when son - gun < 0 then 'gecmis' when son - gun <= 3 then 'cok_yakin' when son - gun <= 7 then 'yakin' else 'uzak' end as durum from o where son is not null and gun is not null""",
    "business_days": f"""with o as (select o_orderkey, o_orderdate::date as d from orders), days as (select o_orderkey, (d + i::int) as x from o, range(1, 61) t(i) where isodow(d + i::int) < 6 and not list_contains({_HOLIDAYS}, strftime(d + i::int, '%m-%d')))
        select o_orderkey, x::date as son_gun from days qualify row_number() over (partition by o_orderkey order by x) = 10""",
    "latency_percentiles": f"select event_type, count(value) as n, {_LAT.format(v='value')} from events group by event_type",
    "duration_percentiles": f"select count(sure_saniye) as n, {_LAT.format(v='sure_saniye')} from {_REG}",
    "step_shares": "with s as (select event_type as step, count(*) as n, sum(value) as total, avg(value) as mean from events where value > 0 group by 1) select step, n, round(total, 4) as total, round(mean, 4) as mean, round(total / sum(total) over (), 4) as share from s",
    "linearity_ratio": "with s as (select day(ts) % 3 + 1 as scale, round(sum(value), 4) as seconds from events group by 1) select scale::int as scale, seconds, round((seconds / scale) / first_value(seconds / scale) over (order by scale), 6) as ratio from s",
    "throughput_by_day": "select ts::date as gun, count(*) as n, round(case when sum(value) > 0 then count(*) / sum(value) else 0 end, 6) as hiz from events group by 1",
}

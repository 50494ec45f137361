"""Queries of the evaluation operators: labels against the classes and confidences of the processed documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomar.operators import metrics as M
from tomar.session import table


def _pairs(spark, sf):
    """(id, truth, predicted, conf, ok): the label of each document beside its class."""
    labels = table(spark, sf, "etiketler").where("tur is not null").groupBy("evrak_id").agg(F.min("tur").alias("truth"))
    state = table(spark, sf, "agent_state").select("evrak_id", F.col("classification.tur").alias("predicted"), F.col("classification.guven").alias("conf")).where("predicted is not null and conf is not null")
    return labels.join(state, "evrak_id").select(F.col("evrak_id").alias("id"), "truth", "predicted", "conf", (F.col("truth") == F.col("predicted")).alias("ok"))


def _probs(spark, sf):
    """The confidence as a two-class distribution: the class that was named, and the rest."""
    p = F.least(F.greatest(F.col("conf"), F.lit(0.0)), F.lit(1.0))
    return _pairs(spark, sf).select("id", "ok", "conf", F.create_map(F.lit("evet"), p, F.lit("hayir"), 1 - p).alias("probs"), F.when(F.col("ok"), "evet").otherwise("hayir").alias("truth"))


def _ranked(spark, sf):
    expected = table(spark, sf, "etiketler").where("mevzuat_beklenen is not null").groupBy("evrak_id").agg(F.min("mevzuat_beklenen").alias("expected"))
    state = table(spark, sf, "agent_state").select("evrak_id", F.transform(F.coalesce("legislation_matches", F.array()), lambda m: m["doc_id"]).alias("ranked"))
    return expected.join(state, "evrak_id")


def accuracy(spark, sf):
    return M.accuracy(_pairs(spark, sf)).select("n", F.round("accuracy", 6).alias("accuracy"))


def prf_by_class(spark, sf):
    return M.by_class(_pairs(spark, sf)).select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def prf_macro(spark, sf):
    return M.macro(_pairs(spark, sf)).select("classes", *[F.round(f"macro_{c}", 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def confusion(spark, sf):
    return M.confusion(_pairs(spark, sf))


def error_list(spark, sf):
    return M.errors(_pairs(spark, sf)).select("id", "truth", "predicted")


def micro_set_f1(spark, sf):
    return M.micro_sets(_ranked(spark, sf).select(F.col("expected").alias("truth"), F.slice("ranked", 1, 3).alias("predicted"))).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def ranking_at_3(spark, sf):
    own = M.ranking(_ranked(spark, sf), 3)
    return own.select("n", *[F.round(c, 6).alias(c) for c in ("hit_at_k", "mrr", "ndcg", "context_precision", "context_recall")])


def ranking_misses(spark, sf):
    return M.misses(_ranked(spark, sf), 3).select("evrak_id")


def reliability_bins(spark, sf):
    return M.reliability(_pairs(spark, sf)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("correct", 6).alias("correct"))


def ece_mce(spark, sf):
    return M.ece_mce(_pairs(spark, sf)).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


def brier(spark, sf):
    return M.brier(_pairs(spark, sf)).select(F.round("brier", 6).alias("brier"))


def risk_coverage(spark, sf):
    return M.risk_coverage(_pairs(spark, sf)).select("rank", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


def aurc(spark, sf):
    return M.aurc(_pairs(spark, sf)).select(F.round("aurc", 6).alias("aurc"))


def selective_risk(spark, sf):
    return M.coverage_risk(_pairs(spark, sf)).select(F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


def uncertainty(spark, sf):
    return _probs(spark, sf).select("id", F.round(M.uncertainty("probs", F.lit(0.0)), 6).alias("belirsizlik"))


def nll_recalibrated(spark, sf):
    own = _probs(spark, sf)
    p = lambda t: F.element_at(M.recalibrated("probs", t), F.col("truth"))
    one, two = M.nll(own.withColumn("p", p(1.0)), "p"), M.nll(own.withColumn("p", p(2.0)), "p")
    return one.select(F.lit(1).alias("t"), F.round("nll", 6).alias("nll")).unionByName(two.select(F.lit(2).alias("t"), F.round("nll", 6).alias("nll")))


def temperature_fit(spark, sf):
    return spark.createDataFrame([(round(M.temperature(_probs(spark, sf), rounds=12), 2),)], "t double")


def conformal_sets(spark, sf):
    own = _probs(spark, sf).withColumn("score", F.round(M.nonconformity("probs", "truth"), 9))
    limit = M.conformal_threshold(own)
    sets = own.join(F.broadcast(limit)).select("id", "truth", F.round("threshold", 6).alias("threshold"), M.prediction_set("probs", F.col("threshold") + 1e-9).alias("s"))
    return sets.agg(F.first("threshold").alias("threshold"), F.round(F.avg(F.array_contains("s", F.col("truth")).cast("int")), 6).alias("coverage"), F.round(F.avg(F.size("s")), 6).alias("mean_size"))


def wilson_by_class(spark, sf):
    own = _pairs(spark, sf).groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    return own.select("class", "n", "k", M.wilson(F.col("k"), F.col("n")).alias("w")).select("class", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def mcnemar_counts(spark, sf):
    """The processed class against the majority class as a baseline."""
    own = _pairs(spark, sf)
    best = own.groupBy("truth").count().orderBy(F.desc("count"), "truth").limit(1).select(F.col("truth").alias("most"))
    pairs = own.join(F.broadcast(best)).select(F.col("ok").alias("a"), (F.col("truth") == F.col("most")).alias("b"))
    return pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(F.col("b") & ~F.col("a")).alias("c"))


def mcnemar_test(spark, sf):
    own = _pairs(spark, sf).select(F.col("ok").alias("a"), (F.col("conf") >= 0.5).alias("b"))
    r = M.mcnemar(own)
    return spark.createDataFrame([(r["b"], r["c"], round(r["chi2"], 6), round(r["p"], 6))], "b bigint, c bigint, chi2 double, p double")


def bootstrap_interval(spark, sf):
    n = _pairs(spark, sf).agg(F.count("*").alias("n"), F.count_if("ok").alias("k")).first()
    low, high = M.bootstrap(n.k, n.n) or (None, None)
    return spark.createDataFrame([(n.n, low, high)], "n bigint, low double, high double")


def split_quality(spark, sf):
    """The mean results of each split, as a report has them."""
    splits = table(spark, sf, "agent_state").select(F.col("evrak_id").alias("id"), "kume").distinct()
    own = _pairs(spark, sf).join(splits, "id").groupBy("kume")
    return own.agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("dogruluk"), F.round(F.avg("conf"), 6).alias("guven"), F.round(F.avg(F.pow(F.col("conf") - F.col("ok").cast("int"), 2)), 6).alias("brier"))


QUERIES = {f.__name__: f for f in (accuracy, prf_by_class, prf_macro, confusion, error_list, micro_set_f1, ranking_at_3, ranking_misses, reliability_bins, ece_mce, brier, risk_coverage, aurc, selective_risk, uncertainty, nll_recalibrated, temperature_fit, conformal_sets, wilson_by_class, mcnemar_counts, mcnemar_test, bootstrap_interval, split_quality)}

_P = """p as (select e.evrak_id as id, truth, predicted, conf, truth = predicted as ok from (select evrak_id, min(tur) as truth from etiketler where tur is not null group by 1) e
    join (select evrak_id, classification.tur as predicted, classification.guven as conf from agent_state) s using (evrak_id) where predicted is not null and conf is not null)"""
_C = f"""{_P}, c as (select class, sum(support)::bigint as support, sum(tp) as tp, sum(claimed) as claimed from (select truth as class, 1 as support, ok::int as tp, 0 as claimed from p union all select predicted, 0, 0, 1 from p) group by 1),
    m as (select class, support, case when claimed > 0 then tp / claimed else 0.0 end as precision, case when support > 0 then tp / support else 0.0 end as recall from c), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from m)"""
_R = """r as (select e.evrak_id, expected, list_transform(coalesce(legislation_matches, []), lambda m: m.doc_id) as ranked from (select evrak_id, min(mevzuat_beklenen) as expected from etiketler where mevzuat_beklenen is not null group by 1) e join agent_state using (evrak_id)),
    q as (select evrak_id, list_distinct(expected) as e, ranked[1:3] as r from r where len(expected) > 0)"""
_BIN = "least(floor(conf * 10) + 1, 10)::int"
_REL = f"select {_BIN} as bin, count(*) as n, avg(conf) as confidence, avg(ok::int) as correct from p group by 1"
_RC = "select rank, rank / n as coverage, sum(1 - ok::int) over (order by rank) / rank as risk from (select ok, row_number() over (order by conf desc, id) as rank, count(*) over () as n from p)"
SQL = {
    "accuracy": f"with {_P} select count(*) as n, round(avg(ok::int), 6) as accuracy from p",
    "prf_by_class": f"with {_C} select class, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f",
    "prf_macro": f"with {_C} select count(*) as classes, round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1 from f",
    "confusion": f"with {_P}, k as (select truth as c from p union select predicted from p) select a.c as truth, b.c as predicted, (select count(*) from p where truth = a.c and predicted = b.c) as n from k a, k b",
    "error_list": f"with {_P} select id, truth, predicted from p where not ok",
    "micro_set_f1": f"""with {_R}, s as (select list_distinct(expected) as t, list_distinct(ranked[1:3]) as p from r), k as (select sum(len(list_intersect(t, p)))::bigint as tp, sum(len(p) - len(list_intersect(t, p)))::bigint as fp, sum(len(t) - len(list_intersect(t, p)))::bigint as fn from s)
        select tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from k""",
    "ranking_at_3": f"""with {_R}, x as (select e, r, list_transform(r, lambda d: list_contains(e, d)) as h from q),
        y as (select (len(list_filter(h, lambda b: b)) > 0)::int as hit, coalesce(1.0 / nullif(list_position(h, true), 0), 0.0) as rr, (coalesce(h[1], false)::int + coalesce(h[2], false)::int / log2(3) + coalesce(h[3], false)::int / log2(4)) / (1 + (len(e) >= 2)::int / log2(3) + (len(e) >= 3)::int / log2(4)) as ndcg,
        case when len(r) > 0 then len(list_intersect(e, r)) / len(r) else 0.0 end as cp, len(list_intersect(e, r)) / len(e) as cr from x)
        select count(*) as n, round(avg(hit), 6) as hit_at_k, round(avg(rr), 6) as mrr, round(avg(ndcg), 6) as ndcg, round(avg(cp), 6) as context_precision, round(avg(cr), 6) as context_recall from y""",
    "ranking_misses": f"with {_R} select evrak_id from q where not list_has_any(e, r)",
    "reliability_bins": f"with {_P}, b as ({_REL}) select i::int as bin, coalesce(n, 0) as n, round(confidence, 6) as confidence, round(correct, 6) as correct from range(1, 11) t(i) left join b on bin = i",
    "ece_mce": f"with {_P}, b as ({_REL}) select round(sum(abs(confidence - correct) * n) / sum(n), 6) as ece, round(max(abs(confidence - correct)), 6) as mce from b",
    "brier": f"with {_P} select round(avg(pow(conf - ok::int, 2)), 6) as brier from p",
    "risk_coverage": f"with {_P} select rank, round(coverage, 6) as coverage, round(risk, 6) as risk from ({_RC})",
    "aurc": f"with {_P} select round(avg(risk), 6) as aurc from ({_RC})",
    "selective_risk": f"with {_P} select round(avg((conf >= 0.6)::int), 6) as coverage, round(avg(1 - ok::int) filter (conf >= 0.6), 6) as risk from p",
    "uncertainty": f"with {_P} select id, round(0.5 * (1 - greatest(c, 1 - c)) + 0.3 * (1 - abs(2 * c - 1)), 6) as belirsizlik from (select id, least(greatest(conf, 0), 1) as c from p)",
    "nll_recalibrated": f"""with {_P}, c as (select ok, greatest(least(greatest(conf, 0), 1), 1e-12) as a, greatest(1 - least(greatest(conf, 0), 1), 1e-12) as b from p), t as (select unnest([1, 2]) as t)
        select t, round(avg(-ln(greatest(case when ok then pow(a, 1.0 / t) else pow(b, 1.0 / t) end / (pow(a, 1.0 / t) + pow(b, 1.0 / t)), 1e-12))), 6) as nll from c, t group by t""",
    "conformal_sets": f"""with {_P}, c as (select id, ok, least(greatest(conf, 0), 1) as a from p), s as (select *, round(1 - case when ok then a else 1 - a end, 9) as score from c),
        h as (select coalesce((select score from (select score, row_number() over (order by score) as r from s) where r = (select ceil((count(*) + 1) * 0.9) from s)), 1.0) as h),
        z as (select ok, h, case when 1 - a <= h + 1e-9 or a <= h + 1e-9 then (1 - a <= h + 1e-9)::int + (a <= h + 1e-9)::int else 1 end as n, case when 1 - a <= h + 1e-9 or a <= h + 1e-9 then case when ok then 1 - a <= h + 1e-9 else a <= h + 1e-9 end else ok = (a >= 1 - a) end as inside from s, h)
        select round(any_value(h), 6) as threshold, round(avg(inside::int), 6) as coverage, round(avg(n), 6) as mean_size from z""",
    "wilson_by_class": f"""with {_P}, c as (select truth as class, count(*) as n, count(*) filter (ok) as k from p group by 1), w as (select *, k / n as p, 1 + 3.8416 / n as d from c)
        select class, n, k, round(greatest(0, (p + 3.8416 / (2 * n)) / d - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) as low, round(least(1, (p + 3.8416 / (2 * n)) / d + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / d), 6) as high from w""",
    "mcnemar_counts": f"with {_P}, b as (select truth as most from p group by 1 order by count(*) desc, 1 limit 1) select count(*) filter (ok and truth <> most) as b, count(*) filter (not ok and truth = most) as c from p, b",
    "split_quality": f"with {_P} select kume, count(*) as n, round(avg(ok::int), 6) as dogruluk, round(avg(conf), 6) as guven, round(avg(pow(conf - ok::int, 2)), 6) as brier from p join (select distinct evrak_id as id, kume from agent_state) using (id) group by 1",
}

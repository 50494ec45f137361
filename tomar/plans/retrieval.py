"""Queries of the retrieval operators: legislation search, precedents, dense search and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.operators import retrieval as R
from tomar.session import spread, table

from .sql import tok


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mevzuat_parcalari").select(F.col("chunk_id").alias("id"), "doc_id", F.concat_ws(" ", "title", "section", "body").alias("text"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "text").where("text is not null"))


def _scored(spark: SparkSession, sf: str):
    ix = R.index(_chunks(spark, sf))
    terms = R.query_terms(_queries(spark, sf))
    return ix, terms, R.bm25(terms, ix).withColumn("score", F.round("score", 6))


def tok_term_freq(spark, sf):
    return R.index(table(spark, sf, "documents"), "doc_id").postings.select(F.col("id").alias("doc_id"), "term", "tf")


def doc_freq_idf(spark, sf):
    return R.index(table(spark, sf, "documents"), "doc_id").idf.select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark, sf):
    return R.index(table(spark, sf, "documents"), "doc_id").size.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_top3(spark, sf):
    return R.top(_scored(spark, sf)[2], 3).select("qid", F.col("id").alias("chunk_id"), "score", "rank")


def bm25_saturated(spark, sf):
    ix, terms, scores = _scored(spark, sf)
    own = R.saturated(scores, terms, ix).select("qid", "id", F.round("similarity", 6).alias("similarity"))
    best = own.groupBy("qid").agg(F.max("similarity").alias("best"))
    return R.top(own, 1, "similarity").join(best, "qid").select("qid", F.col("id").alias("chunk_id"), "similarity", (F.col("best") < 0.5).alias("zayif"))


def bm25_best_per_law(spark, sf):
    scores = _scored(spark, sf)[2].join(_chunks(spark, sf).select("id", "doc_id"), "id")
    return R.best_per(scores, "doc_id", 5).select("qid", "doc_id", F.col("id").alias("chunk_id"), "score", "rank")


def precedent_search(spark, sf):
    register = table(spark, sf, "islemler").select("id", F.col("kaynak").alias("source"), F.coalesce(F.nullif(F.trim("metin_ozu"), F.lit("")), F.trim("ozet_ilk_200")).alias("text")).distinct()
    queries = register.where("id % 50 = 0").select(F.col("id").alias("qid"), "source", "text")
    return R.precedents(queries, register).select("qid", "id", "source", F.round("similarity", 3).alias("similarity"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(spark, sf):
    return _vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def dense_topk(spark, sf):
    return R.dense_top(_asked(spark, sf), _vectors(spark, sf), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _lists(spark, sf):
    """Two rankings of the legislation for each document: by the whole text and by the section's title only."""
    terms = R.query_terms(_queries(spark, sf))
    titles = table(spark, sf, "mevzuat_parcalari").select(F.col("chunk_id").alias("id"), F.concat_ws(" ", "title", F.array_join("keywords", " ")).alias("text"))
    a = R.bm25(terms, R.index(_chunks(spark, sf))).withColumn("score", F.round("score", 6))
    b = R.bm25(terms, R.index(titles)).withColumn("score", F.round("score", 6))
    return a, b


def rrf_fusion(spark, sf):
    a, b = _lists(spark, sf)
    lists = R.top(a, 10).withColumn("list", F.lit("a")).unionByName(R.top(b, 10).withColumn("list", F.lit("b")))
    return R.top(R.rrf(lists).withColumn("score", F.round("score", 9)), 3).select("qid", F.col("id").alias("chunk_id"), "score", "rank")


def convex_fusion(spark, sf):
    a, b = _lists(spark, sf)
    return R.top(R.convex(a, b).withColumn("score", F.round("score", 6)), 3).select("qid", F.col("id").alias("chunk_id"), "score", "rank")


QUERIES = {f.__name__: f for f in (bm25_top3, tok_term_freq, doc_freq_idf, corpus_stats, bm25_saturated, bm25_best_per_law, precedent_search, dense_topk, rrf_fusion, convex_fusion)}

_POST = f"postings as (select id, term, count(*) as tf from (select id, unnest({tok('text')}) as term from corpus) group by all)"


def _index(corpus: str, idf: str = "ln((n - df + 0.5) / (df + 0.5) + 1)") -> str:
    return f"""corpus as ({corpus}), toks as (select id, {tok('text')} as t from corpus),
        postings as (select id, term, count(*) as tf from (select id, unnest(t) as term from toks) group by all),
        lens as (select id, len(t) as dl from toks), size as (select count(*) as n, avg(dl) as avgdl from lens),
        idf as (select term, df, {idf} as idf from (select term, count(*) as df from postings group by all), size)"""


_LAWS = "select chunk_id as id, concat_ws(' ', title, section, body) as text from mevzuat_parcalari"
_TITLES = "select chunk_id as id, concat_ws(' ', title, array_to_string(keywords, ' ')) as text from mevzuat_parcalari"
_DOCS = "select doc_id as id, coalesce(text, '') as text from documents"
_TERMS = f"terms as (select qid, term, count(*) as qtf from (select doc_id as qid, unnest({tok('text')}) as term from documents) group by all)"
_SCORES = "scores as (select qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from terms join postings using (term) join idf using (term) join lens using (id), size group by all)"
_BASE = f"with {_index(_LAWS)}, {_TERMS}, {_SCORES}"


def _ranked(scores: str, n: int) -> str:
    return f"select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from {scores} qualify rank <= {n}"


_TWO = f"""with {_TERMS}, a as (with {_index(_LAWS)}, {_SCORES} select * from scores), b as (with {_index(_TITLES)}, {_SCORES} select * from scores)"""

SQL = {
    "tok_term_freq": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({tok('text')}) as term from documents) group by all",
    "doc_freq_idf": f"with {_index(_DOCS)} select term, df, round(idf, 6) as idf from idf",
    "corpus_stats": f"with {_index(_DOCS)} select n, round(avgdl, 6) as avgdl from size",
    "bm25_top3": f"{_BASE} select qid, id as chunk_id, score, rank from ({_ranked('scores', 3)})",
    "bm25_saturated": f"""{_BASE}, mass as (select qid, sum(coalesce(idf, 0)) as mass from terms left join idf using (term) group by all),
        own as (select qid, id, round(least(1.0, score / (1.5 * mass)), 6) as similarity from scores join mass using (qid) where mass > 0)
        select qid, id as chunk_id, similarity, similarity < 0.5 as zayif from own qualify row_number() over (partition by qid order by similarity desc, id) = 1""",
    "bm25_best_per_law": f"""{_BASE}, best as (select qid, doc_id, id, score from scores join mevzuat_parcalari on chunk_id = id qualify row_number() over (partition by qid, doc_id order by score desc, id) = 1)
        select qid, doc_id, id as chunk_id, score, row_number() over (partition by qid order by score desc, id) as rank from best qualify rank <= 5""",
    "precedent_search": f"""with reg as (select distinct id, kaynak as source, coalesce(nullif(trim(metin_ozu), ''), trim(ozet_ilk_200)) as text from (select distinct * from islemler)),
        {_index("select id, coalesce(text, '') as text from reg", "ln(1 + (n + 1) / (df + 0.5))")},
        terms as (select qid, term, count(*) as qtf from (select id as qid, unnest({tok('text')}) as term from reg where id % 50 = 0) group by all),
        scores as (select qid, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from terms join postings using (term) join idf using (term) join lens using (id), size group by all),
        mass as (select qid, sum(coalesce(idf, ln(1 + (n + 1) / 0.5))) as mass from terms left join idf using (term), size group by all),
        sims as (select s.qid, s.id, r.source, round(least(1.0, score / (1.5 * mass)), 9) as similarity from scores s join mass using (qid) join reg r on r.id = s.id join reg q on q.id = s.qid
            where not (coalesce(r.source, '') <> '' and r.source is not distinct from q.source) and trim(r.text) <> trim(q.text)),
        best as (select *, case when coalesce(source, '') = '' then '#' || id else source end as g from sims where similarity >= 0.05 qualify row_number() over (partition by qid, g order by similarity desc, id) = 1)
        select qid, id, source, round(similarity, 3) as similarity from best qualify row_number() over (partition by qid order by similarity desc, id) <= 3""",
    "dense_topk": """with s as (select q.vec_id as qid, v.vec_id as id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score from embeddings q, embeddings v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)
        select qid, id, round(score, 6) as score, row_number() over (partition by qid order by score desc, id) as rank from s where score > 0 qualify rank <= 10""",
    "rrf_fusion": f"""{_TWO}, lists as (({_ranked('a', 10)}) union all ({_ranked('b', 10)})), f as (select qid, id, round(sum(1.0 / (60 + rank)), 9) as score from lists group by all)
        select qid, id as chunk_id, score, rank from ({_ranked('f', 3)})""",
    "convex_fusion": f"""{_TWO}, x as (select qid, id, case when max(score) over (partition by qid) > 0 then score / max(score) over (partition by qid) else 0 end as a from a),
        y as (select qid, id, case when max(score) over (partition by qid) > 0 then score / max(score) over (partition by qid) else 0 end as b from b),
        f as (select qid, id, round(case when qid not in (select qid from y) then coalesce(a, 0) when qid not in (select qid from x) then coalesce(b, 0) else 0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0) end, 6) as score from x full join y using (qid, id))
        select qid, id as chunk_id, score, rank from ({_ranked('f', 3)})""",
}

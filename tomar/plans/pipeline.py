"""The document pipeline: every stage is a function from table to table, one row a document.

read and cap -> gates -> classify -> fields -> legislation -> summary -> mask -> register row. Stages see only the columns
of earlier ones, so a mode is a list of stages. A document that a gate stops keeps nulls in the columns of the later stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.functions import text as T
from tomar.operators import classify as C
from tomar.operators import extract as X
from tomar.operators import mask as K
from tomar.operators import retrieval as R
from tomar.operators import summary as S
from tomar.session import spread, table

Stage = Callable[[DataFrame], DataFrame]
MOST_CHARACTERS = 200_000


def capped(df: DataFrame) -> DataFrame:
    """Cuts texts to the input limit and notes it."""
    c = T.capped("text", MOST_CHARACTERS)
    return df.select("id", "source", c["metin"].alias("text"), c["kesildi"].alias("cut"))


def gated(df: DataFrame) -> DataFrame:
    """Notes whether a text is readable and Turkish."""
    return df.withColumn("readable", T.readable("text")).withColumn("turkish", F.col("readable") & F.coalesce(T.is_turkish("text"), F.lit(False)))


def classified(rules: dict[str, dict[str, float]]) -> Stage:
    """Classifies readable texts by a rule table."""

    def run(df: DataFrame) -> DataFrame:
        decided = T.bound(C.keyword_scores("text", rules), lambda m: C.decided(m, "diger"))
        return df.withColumn("class", F.when(F.col("readable"), decided)).withColumn("review", C.gate(F.col("class.confidence")))

    return run


def extracted(df: DataFrame) -> DataFrame:
    """Fields of readable texts; a field that no later stage reads isn't looked for."""
    own = df.withColumns({f"_{name}": F.when(F.col("readable"), of("text")) for name, of in X.FIELDS.items()})
    return own.withColumn("fields", F.struct(*[F.col(f"_{name}").alias(name) for name in X.FIELDS])).drop(*[f"_{name}" for name in X.FIELDS])


def cited(laws: DataFrame, n: int = 3, characters: int | None = None, most: int = R.SMALL) -> Stage:
    """The legislation that fits each text best; laws(id, doc_id, text). Texts are searched by whole, or by so many characters if asked.

    A small index goes to the texts; a larger one is joined with their terms by shuffle.
    """
    own_text = F.col("text") if characters is None else F.substring("text", 1, characters)
    query = F.concat_ws(" ", "fields.konu", own_text)

    def run(df: DataFrame) -> DataFrame:
        ix = R.index(laws)
        found = R.best_of_small(F.when(F.col("readable"), query), ix, laws.select("id", F.col("doc_id").alias("group")), n, most)
        if found is not None:
            return df.withColumn("matches", F.transform(found, lambda m: F.struct(m["rank"].alias("rank"), m["group"].alias("doc_id"), F.round(m["similarity"], 4).alias("similarity"))))
        terms = R.query_terms(df.where("readable").select("id", query.alias("q")), "id", "q")
        own = R.saturated(R.bm25(terms, ix), terms, ix).join(laws.select("id", "doc_id"), "id")
        best = R.best_per(own, "doc_id", n, "similarity").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.round("similarity", 4).alias("similarity")))).alias("matches"))
        return df.join(best.withColumnRenamed("qid", "id"), "id", "left")

    return run


def summarised(df: DataFrame) -> DataFrame:
    """Extractive summaries of readable texts."""
    return df.withColumn("summary", S.summary(F.when(F.col("readable"), F.col("text")), F.col("fields.konu")))


def anonymised(df: DataFrame) -> DataFrame:
    """Masked texts and what the audit still finds."""
    return df.withColumn("masked", F.when(F.col("readable"), K.masked("text"))).withColumn("leaks", K.audit("masked"))


def registered(df: DataFrame) -> DataFrame:
    """The columns that the register takes."""
    return df.select(
        "id", F.col("source").alias("kaynak"), F.col("class.class").alias("tur"), F.round("class.confidence", 3).alias("tur_guven"), F.col("review").cast("int").alias("insan_onayi"), "fields.konu", "fields.muhatap",
        F.transform("matches", lambda m: m["doc_id"]).alias("mevzuat"), F.substring("summary", 1, 200).alias("ozet_ilk_200"), F.substring("masked", 1, 2000).alias("metin_ozu"), "readable", "turkish",
    )


def pipeline(stages: list[Stage]) -> Stage:
    """One stage of several."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = stage(df)
        return df

    return run


def document_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    from .documents import RULES

    laws = table(spark, sf_dir, "mevzuat_parcalari").select(F.col("chunk_id").alias("id"), "doc_id", F.concat_ws(" ", "title", "section", "body").alias("text"))
    documents = spread(table(spark, sf_dir, "agent_state").select(F.col("evrak_id").alias("id"), F.col("input_file").alias("source"), F.coalesce("raw_text", "ocr_result.metin").alias("text")))
    return pipeline([capped, gated, classified(RULES), extracted, cited(laws), summarised, anonymised, registered])(documents)


QUERIES = {"document_pipeline": document_pipeline}
SQL: dict[str, str] = {}

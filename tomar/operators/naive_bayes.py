"""Multinomial Naive Bayes over weighted features: the model is three tables, training and prediction are plans.

Training rows without class or features are left out. Features that training never saw are ignored in prediction; a text
without any known feature gets the prior. Ties between classes go to the smaller name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tomar.session import cut

from . import featured
from .retrieval import idf_smooth

EVIDENCE = 6.0
#: Features whose weights go to every task in prediction.
HOT = 100_000


@dataclass
class Model:
    prior: DataFrame
    idf: DataFrame
    likelihood: DataFrame


def whole(documents: DataFrame, *by: str) -> DataFrame:
    """documents(*by, text) with the texts of repeated keys put together; only then are texts shuffled."""
    if documents.groupBy(*by).count().where("count > 1").isEmpty():
        return documents
    return documents.groupBy(*by).agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))


def train(documents: DataFrame, key: str = "id", text: str = "text", label: str = "label", alpha: float = 1.0) -> Model:
    """A model from labelled documents. Features are counted where the documents are and shuffled as sums by class."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    known = documents.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).alias("class"))
    schema = T.StructType([known.select("class").schema["class"], T.StructField("feature", T.StringType()), T.StructField("df", T.LongType()), T.StructField("s", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    parts = whole(known, "id", "class").select("class", "text").mapInArrow(lambda batches: featured.learned(batches, arrow), schema)
    rows = cut(parts.groupBy("class", "feature").agg(F.sum("df").alias("df"), F.sum("s").alias("s")))
    n = known.agg(F.count("*").alias("n"))
    idf = rows.groupBy("feature").agg(F.sum("df").alias("df")).join(F.broadcast(n)).select("feature", idf_smooth(F.col("n"), F.col("df")).alias("idf"))
    weights = rows.join(idf, "feature").select("class", "feature", (F.col("s") * F.col("idf")).alias("w"))
    size = idf.agg(F.count("*").alias("v"))
    totals = weights.groupBy("class").agg(F.sum("w").alias("total")).join(F.broadcast(size)).select("class", (F.col("total") + alpha * F.col("v")).alias("below"))
    likelihood = weights.join(F.broadcast(totals), "class").select("class", "feature", F.ln((F.col("w") + alpha) / F.col("below")).alias("ll"))
    prior = known.groupBy("class").agg(F.count("*").alias("m")).join(F.broadcast(n)).join(totals, "class").select(
        "class", F.ln(F.col("m") / F.col("n")).alias("log_prior"), F.ln(alpha / F.col("below")).alias("unseen")
    )
    return Model(prior, idf, likelihood)


def predict(model: Model, documents: DataFrame, key: str = "id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(id, class, probability) of every document and class; the classes are few and their size is that of the prior.

    The ``hot`` features that most documents have go to the documents; the rest, a few a document, are joined by shuffle.
    """
    own = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    prior = sorted(model.prior.collect(), key=lambda r: r["class"])
    kind = {f.name: f.dataType for f in [*own.schema, *model.prior.schema]}
    if not prior:
        return own.where("false").select("id", F.lit(None).cast(kind["class"]).alias("class"), F.lit(0.0).alias("probability"))
    # A feature that a class never had gets the class's unseen value: the sum over the seen ones corrects it.
    seen = [F.sum(F.when(F.col("class") == r["class"], F.col("ll") - r["unseen"]).otherwise(0.0)) for r in prior]
    wide = cut(model.likelihood.groupBy("feature").agg(F.array(*seen).alias("d")).join(model.idf, "feature"))
    least, count = None, 0
    for r in wide.groupBy("idf").count().orderBy("idf").toLocalIterator():
        count += r["count"]
        if count > hot:
            break
        least = r["idf"]
    top = wide.where(F.col("idf") <= least).select("feature", "idf", "d").collect() if least is not None else []
    names, idf = [r["feature"] for r in top], np.array([r["idf"] for r in top])
    more = np.array([r["d"] for r in top], dtype=float).reshape(len(top), len(prior))
    schema = T.StructType([T.StructField("id", kind["id"]), T.StructField("mass", T.DoubleType()), T.StructField("more", T.ArrayType(T.DoubleType())), T.StructField("rest", T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("tf", T.LongType())])))])
    arrow = to_arrow_schema(schema)
    known = F.when(F.col("id").isNotNull(), F.coalesce("text", F.lit(""))).otherwise(F.lit(""))
    counted = cut(whole(own, "id").select("id", known.alias("text")).mapInArrow(lambda batches: featured.weighed(batches, names, idf, more, arrow), schema))
    rest = counted.select("id", F.inline("rest")).join(wide, "feature").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    cold = rest.select("id", F.col("w").alias("mass"), F.transform("d", lambda x: x * F.col("w")).alias("more"))
    sums = counted.select("id", "mass", "more").unionByName(cold).groupBy("id").agg(F.sum("mass").alias("mass"), *[F.sum(F.col("more")[i]).alias(f"m{i}") for i in range(len(prior))])
    score = [r["log_prior"] + F.when(F.col("mass") > 0, EVIDENCE * (r["unseen"] + F.col(f"m{i}") / F.col("mass"))).otherwise(F.lit(0.0)) for i, r in enumerate(prior)]
    shifted = sums.select("id", F.array(*score).alias("s")).select("id", F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e"))
    every = shifted.select("id", F.posexplode("e").alias("i", "p"), F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("all"))
    names_of = F.array(*[F.lit(r["class"]) for r in prior])
    return every.select("id", F.get(names_of, F.col("i")).cast(kind["class"]).alias("class"), (F.col("p") / F.col("all")).alias("probability"))


def decided(probabilities: DataFrame) -> DataFrame:
    """(id, class, probability): the likeliest class of each document."""
    order = Window.partitionBy("id").orderBy(F.desc("probability"), "class")
    return probabilities.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def ensemble(rules: DataFrame, learned: DataFrame, share: float = 0.6) -> DataFrame:
    """(id, class, probability): rules weighted against a learned model; without the model the rules alone."""
    a = rules.select("id", "class", F.col("probability").alias("a"))
    b = learned.select("id", "class", F.col("probability").alias("b"))
    known = learned.select("id").distinct().withColumn("known", F.lit(True))
    both = a.join(b, ["id", "class"], "full_outer").join(known, "id", "left")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select("id", "class", F.when(F.col("known"), share * x + (1 - share) * y).otherwise(x).alias("probability"))

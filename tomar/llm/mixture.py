"""Problem 8: a mixture of sources by target weights.

Method: Poisson replication. The size of the mixture is the largest at which every source can hold its
target share without repeating a document more often than allowed: the least over the sources of
cap x tokens / share. A source then repeats its documents at the mean rate share x size / tokens. The
count of a document is a Poisson variable, cut off at the cap and with its mean raised so that the rate still holds,
inverted at a uniform number hashed from the seed and the document; documents are exploded by their
counts and ordered globally by another hash.

Defined cases: sources without a target, and documents without source or tokens, are left out; a target
whose source has no tokens is reported with share 0 and the other targets hold their shares among
themselves; repeated rows are replicated alike; a target that is null or not positive counts as none, a cap below 1 as 1;
empty tables give an empty mixture; extra columns are ignored.

Sizes are tokens of a public byte-level vocabulary, whose file is a parameter. The figures that reach the
driver are one row for each source that has a target; the rates go back as a table, broadcast behind a check of its size.
"""

from __future__ import annotations

import base64
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import checked_broadcast, cut, table

from .rows import flat_map

TOKENIZER = os.environ.get("TOMAR_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern of words of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 20250101


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, token): the tokens of every whole text."""

    def make():
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def run(rows):
            for r in rows:
                yield r["doc_id"], r["source"], len(encoding.encode_ordinary(r["text"])) if r["text"] else 0

        return run

    return flat_map(documents.select("doc_id", "source", "text"), make, "doc_id bigint, source string, token bigint")


def _poisson(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k below the cap."""
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(cap):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def replication(rate: float, cap: int) -> list[float]:
    """The distribution of a Poisson count cut off at the cap whose mean is the rate."""
    if rate >= cap - 1e-9:
        return [0.0] * cap
    low, high = 0.0, 700.0
    for _ in range(200):
        middle = (low + high) / 2
        if cap - sum(_poisson(middle, cap)) < rate:
            low = middle
        else:
            high = middle
    return _poisson(low, cap)


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """source -> (mean repetitions, cap) of the largest mixture in which every source holds its share."""
    able = {s: (share, max(1, cap)) for s, (share, cap) in targets.items() if tokens.get(s, 0) > 0 and share and share > 0}
    if not able:
        return {}
    total = sum(share for share, _ in able.values())
    size = min(cap * tokens[s] / (share / total) for s, (share, cap) in able.items())
    return {s: (share / total * size / tokens[s], cap) for s, (share, cap) in able.items()}


def plan(counts: DataFrame, targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The rates from token counts and kaynak_hedefleri(source, hedef_pay, azami_tekrar)."""
    wanted = {r.source: (r.hedef_pay or 0.0, r.azami_tekrar or 1) for r in targets.where("source is not null").collect()}
    totals = counts.join(checked_broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("token").alias("token"))
    return rates({r.source: r.token for r in totals.collect()}, wanted)


def repeated(documents: DataFrame, plan_: dict[str, tuple[float, int]], seed: int = SEED) -> DataFrame:
    """documents with n: how often a document (doc_id, source) is repeated, 0 for sources without a rate."""
    spark = documents.sparkSession
    rows = [(s, replication(rate, cap)) for s, (rate, cap) in sorted(plan_.items())]
    cuts = spark.createDataFrame(rows, "source string, _esik array<double>")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    n = F.coalesce(F.size(F.filter("_esik", lambda c: c <= uniform)), F.lit(0))
    return documents.join(checked_broadcast(cuts), "source", "left").withColumn("n", F.when(F.col("_esik").isNull(), 0).otherwise(n)).drop("_esik")


def mixture(documents: DataFrame, plan_: dict[str, tuple[float, int]], seed: int = SEED) -> DataFrame:
    """(doc_id, source, kopya, text): the documents repeated by their counts, in one global random order."""
    own = repeated(documents.select("doc_id", "source", "text").where("source is not null and text <> ''"), plan_, seed).where("n > 0")
    each = own.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("kopya"), "text")
    return each.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "kopya"), "doc_id", "kopya")


def report(counts: DataFrame, targets: DataFrame, plan_: dict[str, tuple[float, int]], seed: int = SEED) -> DataFrame:
    """The shares really reached, one row for each target and each source without target."""
    by = repeated(counts.select("doc_id", "source", "token"), plan_, seed).groupBy("source").agg(
        F.count("*").alias("belge"), F.sum("token").alias("token"), F.sum("n").alias("kopya"), F.max("n").alias("en_cok_tekrar"), F.sum(F.col("n") * F.col("token")).alias("karisim_token")
    )
    every = by.join(checked_broadcast(targets.select("source", "hedef_pay", "azami_tekrar")), "source", "full_outer")
    total = by.agg(F.sum("karisim_token").alias("toplam"))
    return every.join(F.broadcast(total)).select(
        "source", "hedef_pay", "azami_tekrar", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("belge", "token", "kopya", "en_cok_tekrar", "karisim_token")],
        F.round(F.coalesce(F.col("karisim_token") / F.col("toplam"), F.lit(0.0)), 6).alias("gercek_pay"),
    )


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents by kaynak_hedefleri."""
    documents = table(spark, sf_dir, "documents")
    return mixture(documents, plan(token_counts(documents), table(spark, sf_dir, "kaynak_hedefleri")))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the mixture per source."""
    targets = table(spark, sf_dir, "kaynak_hedefleri")
    counts = cut(token_counts(table(spark, sf_dir, "documents")))
    return report(counts, targets, plan(counts, targets))


QUERIES = {"p8_mixture": p8_mixture, "p8_report": p8_report}
SQL: dict[str, str] = {}

"""Evaluation as aggregates: classification, ranking, latency, calibration, selection, conformal sets, intervals.

Without rows an average is null, never 0. Inputs are tables whose rows pair truth and prediction by key.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-12


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- classification


def accuracy(pairs: DataFrame) -> DataFrame:
    """One row (n, accuracy) of pairs(truth, predicted)."""
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("accuracy"))


def by_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as truth or prediction."""
    sides = pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    right = (F.col("truth") == F.col("predicted")).cast("int") * F.col("n")
    truth = sides.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(right).alias("tp"), F.lit(0).cast("bigint").alias("claimed"))
    claimed = sides.groupBy(F.col("predicted").alias("class")).agg(F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("tp"), F.sum("n").alias("claimed"))
    both = truth.unionByName(claimed).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "claimed")])
    p, r = _share(F.col("tp"), F.col("claimed")), _share(F.col("tp"), F.col("support"))
    return both.select("class", "support", p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1"))


def macro(pairs: DataFrame) -> DataFrame:
    """One row of means over the classes."""
    return by_class(pairs).agg(F.count("*").alias("classes"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def micro_sets(pairs: DataFrame) -> DataFrame:
    """One row of counts and micro precision, recall and F1 of pairs(truth array, predicted array)."""
    t, p = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("truth", "predicted"))
    counts = pairs.agg(F.sum(F.size(F.array_intersect(t, p))).alias("tp"), F.sum(F.size(F.array_except(p, t))).alias("fp"), F.sum(F.size(F.array_except(t, p))).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(tp, fp, fn, _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, predicted, n) of every pair of classes that occur, with 0 for pairs that don't. The classes are few."""
    counts = pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    classes = counts.select(F.explode(F.array("truth", "predicted")).alias("class")).distinct()
    square = classes.select(F.col("class").alias("truth")).join(F.broadcast(classes.select(F.col("class").alias("predicted"))))
    return square.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def errors(pairs: DataFrame) -> DataFrame:
    """The rows whose prediction is wrong."""
    return pairs.where("truth <> predicted")


# ---------------------------------------------------------------- ranking


def ranking(pairs: DataFrame, k: int) -> DataFrame:
    """One row of hit@k, MRR@k, nDCG@k and context precision and recall of pairs(expected, ranked); rows without expectation don't count."""
    own = pairs.where(F.size("expected") > 0).select(F.array_distinct("expected").alias("e"), F.slice("ranked", 1, k).alias("r"))
    hit = F.transform("r", lambda x: F.array_contains(F.col("e"), x).cast("double"))
    first = F.array_position(F.transform("r", lambda x: F.array_contains(F.col("e"), x)), True)
    gain = F.aggregate(F.transform(hit, lambda x, i: x / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    best = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.size("e"), F.lit(k))), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    common = F.size(F.array_intersect("e", "r"))
    rows = own.select(
        (common > 0).cast("int").alias("hit"), F.when(first > 0, 1.0 / first).otherwise(0.0).alias("rr"), F.when(best > 0, gain / best).otherwise(0.0).alias("ndcg"),
        _share(common, F.size("r")).alias("cp"), (common / F.size("e")).alias("cr"),
    )
    return rows.agg(F.count("*").alias("n"), F.avg("hit").alias("hit_at_k"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.avg("cp").alias("context_precision"), F.avg("cr").alias("context_recall"))


def misses(pairs: DataFrame, k: int) -> DataFrame:
    """The rows with an expectation that their first k don't meet."""
    return pairs.where((F.size("expected") > 0) & ~F.arrays_overlap("expected", F.slice("ranked", 1, k)))


# ---------------------------------------------------------------- latency


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, p95, p99, least and greatest of a value."""
    v = F.col(value).cast("double")
    own = rows.groupBy(*by) if by else rows
    return own.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, 0.95).alias("p95"), F.percentile(v, 0.99).alias("p99"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def percentile(value: str, p: float) -> Column:
    """Percentile by linear interpolation, p from 0 to 100."""
    return F.percentile(F.col(value).cast("double"), min(100.0, max(0.0, p)) / 100)


def throughput(n: Column, seconds: Column) -> Column:
    """n a second, 0 where no time passed."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))


def step_shares(steps: DataFrame) -> DataFrame:
    """(step, n, total, mean, share) of steps(step, seconds, ok); failed steps don't count."""
    own = steps.where("ok").groupBy("step").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))
    return own.join(F.broadcast(own.agg(F.sum("total").alias("_t")))).select("step", "n", "total", "mean", _share(F.col("total"), F.col("_t")).alias("share"))


def linearity(scales: DataFrame) -> DataFrame:
    """(scale, seconds, ratio) of scales: seconds a unit against those of the smallest scale. The rows are a handful of runs."""
    order = Window.orderBy("scale")
    unit = F.col("seconds") / F.col("scale")
    return scales.select("scale", "seconds", (unit / F.first(unit).over(order)).alias("ratio"))


# ---------------------------------------------------------------- votes and feedback


def majority(votes: DataFrame, *by: str) -> DataFrame:
    """(by, winner, share): the most frequent vote of each group, the first seen where tied; votes(by, vote, seen)."""
    counts = votes.where("vote is not null").groupBy(*by, "vote").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    own = Window.partitionBy(*by)
    ranked = counts.withColumn("_r", F.row_number().over(own.orderBy(F.desc("n"), "first", "vote"))).withColumn("share", F.col("n") / F.sum("n").over(own))
    return ranked.where("_r = 1").select(*by, F.col("vote").alias("winner"), "share")


def feedback_patterns(rows: DataFrame, predicted: str, true: str) -> DataFrame:
    """(predicted, true, n, evidence) of corrections: strong from 3, some from 2, else weak."""
    counts = rows.where(F.col(predicted).isNotNull() & F.col(true).isNotNull() & (F.col(predicted) != F.col(true))).groupBy(F.col(predicted).alias("predicted"), F.col(true).alias("true")).agg(F.count("*").alias("n"))
    return counts.withColumn("evidence", F.when(F.col("n") >= 3, "guclu").when(F.col("n") >= 2, "orta").otherwise("zayif"))


def invariance(rows: DataFrame) -> DataFrame:
    """(kind, n, same): share of variants whose decision stays, by kind; rows(kind, original, changed)."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.avg((F.col("original").eqNullSafe(F.col("changed"))).cast("int")).alias("same"))


# ---------------------------------------------------------------- calibration and selection


def softmax(scores: Column | str, temperature: float = 1.0) -> Column:
    """Softmax over the values of a map, shifted by the greatest."""
    m = F.col(scores) if isinstance(scores, str) else scores
    most = F.array_max(F.map_values(m))
    e = F.transform_values(m, lambda k, v: F.exp((v - most) / temperature))
    total = F.aggregate(F.map_values(e), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(e, lambda k, v: v / total)


def recalibrated(probabilities: Column | str, temperature: float) -> Column:
    """Published probabilities at another temperature."""
    m = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return softmax(F.transform_values(m, lambda k, v: F.ln(F.greatest(v, F.lit(FLOOR)))), temperature)


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, correct) for every bin of rows(conf, ok), empty ones too; the last bin is closed."""
    spark = rows.sparkSession
    b = F.least(F.floor(F.col("conf") * bins) + 1, F.lit(bins)).cast("int")
    own = rows.where("conf is not null").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg(F.col("ok").cast("int")).alias("correct"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(own), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "correct")


def ece_mce(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row (ece, mce) of rows(conf, ok)."""
    own = reliability(rows, bins).where("n > 0").withColumn("gap", F.abs(F.col("confidence") - F.col("correct")))
    return own.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def brier(rows: DataFrame) -> DataFrame:
    """One row: mean squared distance of confidence and correctness."""
    return rows.agg(F.avg(F.pow(F.col("conf") - F.col("ok").cast("int"), 2)).alias("brier"))


def nll(rows: DataFrame, probability: str) -> DataFrame:
    """One row: mean negative log-likelihood of the true class."""
    return rows.agg(F.avg(-F.ln(F.greatest(F.col(probability), F.lit(FLOOR)))).alias("nll"))


def temperature(rows: DataFrame, low: float = 0.25, high: float = 5.0, rounds: int = 40) -> float:
    """The temperature of the least NLL of rows(probs map, truth), by golden section; each step is one aggregate over all rows."""

    def at(t: float) -> float:
        own = rows.select(F.coalesce(F.try_element_at(recalibrated("probs", t), F.col("truth")), F.lit(0.0)).alias("p"))
        return nll(own, "p").first()[0]

    if rows.isEmpty():
        return 1.0
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = at(x), at(y)
    for _ in range(rounds):
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - ratio * (b - a)
            fx = at(x)
        else:
            a, x, fx = x, y, fy
            y = a + ratio * (b - a)
            fy = at(y)
        if b - a < 1e-4:
            break
    return (a + b) / 2


def risk_coverage(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """(rank, coverage, risk) of rows(id, conf, ok) by falling confidence.

    The running count goes over ranges of the confidence: each range is ranked by itself and starts from the sums of
    the ranges before it, so no task sorts all rows.
    """
    own = rows.select("id", "conf", (1 - F.col("ok").cast("int")).alias("err")).withColumn("g", F.least(F.greatest(F.floor((1 - F.col("conf")) * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int"))
    sums = own.groupBy("g").agg(F.count("*").alias("n"), F.sum("err").alias("e"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"))
    inside = Window.partitionBy("g").orderBy(F.desc("conf"), "id")
    rank = F.col("n0") + F.row_number().over(inside)
    wrong = F.col("e0") + F.sum("err").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    total = sums.agg(F.sum("n").alias("total"))
    ranked = own.join(F.broadcast(start), "g").select(rank.alias("rank"), wrong.alias("wrong"))
    return ranked.join(F.broadcast(total)).select("rank", (F.col("rank") / F.col("total")).alias("coverage"), (F.col("wrong") / F.col("rank")).alias("risk"))


def aurc(rows: DataFrame) -> DataFrame:
    """One row: the mean risk over all coverages."""
    return risk_coverage(rows).agg(F.avg("risk").alias("aurc"))


def coverage_risk(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row: share of rows at or above a threshold, and their share of errors (null where none is)."""
    kept = F.col("conf") >= threshold
    return rows.agg(F.avg(kept.cast("int")).alias("coverage"), F.avg(F.when(kept, 1 - F.col("ok").cast("int"))).alias("risk"))


def uncertainty(probs: Column | str, unknown: Column) -> Column:
    """0.5 (1 - greatest) + 0.3 (1 - margin) + 0.2 unknown share."""
    m = F.col(probs) if isinstance(probs, str) else probs
    own = F.sort_array(F.map_values(m), asc=False)
    first, second = F.coalesce(F.try_element_at(own, F.lit(1)), F.lit(0.0)), F.coalesce(F.try_element_at(own, F.lit(2)), F.lit(0.0))
    return 0.5 * (1 - first) + 0.3 * (1 - (first - second)) + 0.2 * unknown


# ---------------------------------------------------------------- conformal sets


def nonconformity(probs: Column | str, truth: Column | str) -> Column:
    """1 - probability of the true class; 1 for an unknown class."""
    m, t = (F.col(c) if isinstance(c, str) else c for c in (probs, truth))
    return 1 - F.coalesce(F.try_element_at(m, t), F.lit(0.0))


def conformal_threshold(scores: DataFrame, alpha: float = 0.1) -> DataFrame:
    """One row (threshold) of scores(score): the ceil((n + 1)(1 - alpha))-th smallest, 1 where there is none.

    Equal scores are counted together, so what is ordered is the distinct scores only.
    """
    counts = scores.groupBy("score").agg(F.count("*").alias("m"))
    n = scores.agg(F.count("*").alias("n")).select(F.ceil((F.col("n") + 1) * F.lit(round(1 - alpha, 12))).alias("k"))
    upto = counts.withColumn("c", F.sum("m").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)))
    return upto.join(F.broadcast(n)).where("c >= k").agg(F.coalesce(F.min("score"), F.lit(1.0)).alias("threshold"))


def prediction_set(probs: Column | str, threshold: Column) -> Column:
    """The classes whose score is within the threshold, sorted; the likeliest where none is."""
    m = F.col(probs) if isinstance(probs, str) else probs
    inside = F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: 1 - v <= threshold)))
    best = F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct((-x["value"]).alias("p"), x["key"].alias("k"))))
    return F.when(F.size(inside) > 0, inside).otherwise(F.transform(F.slice(best, 1, 1), lambda x: x["k"]))


# ---------------------------------------------------------------- intervals and tests


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of a share by Wilson's interval; nulls where n is 0."""
    p = k / n
    below = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / below
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / below
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def calibration_report(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row (n, dogruluk, guven, ece, mce, brier) of rows(conf, ok)."""
    whole = rows.agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("dogruluk"), F.avg("conf").alias("guven"))
    return whole.join(F.broadcast(ece_mce(rows, bins))).join(F.broadcast(brier(rows)))


def rate_summary(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, k, oran, alt, ust) of rows(by, ok): the rate of each group with its interval."""
    own = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    bounds = wilson(F.col("k"), F.col("n"))
    return own.select(*by, "n", "k", (F.col("k") / F.col("n")).alias("oran"), bounds["low"].alias("alt"), bounds["high"].alias("ust"))


def entity_f1(gold: Column, found: Column) -> Column:
    """(precision, recall, f1) of a set of entities against the right ones; 0 where there is nothing to divide by."""
    a, b = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(a, b))
    p, r = _share(both, F.size(b)), _share(both, F.size(a))
    return F.struct(p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1"))


def mcnemar(pairs: DataFrame) -> dict:
    """Discordant counts, chi-square with continuity correction and p of pairs(a, b), two systems' correctness."""
    r = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("b"), F.count_if(~F.col("a") & F.col("b")).alias("c")).first()
    n = r.b + r.c
    chi = (abs(r.b - r.c) - 1) ** 2 / n if n else 0.0
    return {"b": r.b, "c": r.c, "chi2": chi, "p": math.erfc(math.sqrt(chi / 2)) if n else 1.0}


def bootstrap(hits: int, n: int, draws: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float] | None:
    """Interval of a share by seeded resampling; a 0/1 sample is its two counts, so nothing else leaves the cluster."""
    if not n:
        return None
    rng = random.Random(seed)
    means = sorted(rng.binomialvariate(n, hits / n) / n for _ in range(draws))
    cut = (1 - level) / 2
    return means[int(cut * draws)], means[min(draws - 1, int((1 - cut) * draws))]

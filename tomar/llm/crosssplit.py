"""Problem 1: records of the evaluation splits that recur in the training split.

Method: minwise hashing with banded buckets. Texts are read without scan layout, letter case, accents,
character forms and punctuation. Texts with the same words form a class and only one representative of a
class is hashed further. The hashed set is that of its words (shingles of one word: where a quarter of the words is replaced
at scattered places, single words keep a Jaccard similarity of 0.6, pairs of words one of 1/3 only); ``HASHES`` minwise hashes
are read as ``BANDS`` bands of ``ROWS`` hashes each, drawn at random. Only pairs that share a band's bucket and stand in
different splits are candidates. A pair at 0.6 shares a bucket with a probability of 0.98, one at 0.3 with 0.06. Candidates are
first held against each other by counts of their words in ``CELLS`` cells: texts that share enough words differ little there, so nothing is
lost. What remains is verified by the exact Jaccard similarity of the words and then by
the words in the same order (longest common subsequence against the longer text). Confirmed pairs of classes are
expanded to the members of both classes where pairs are asked for; the report counts members and expands nothing.

Words are compared by their skeleton, in which characters that scans exchange are alike. Buckets with many
members are salted: the training side of a hot bucket is spread over as many slices as it has times ``SALT``
members, and the other side is repeated for each slice, so no pair is lost and no task gets a whole hot bucket. Which
buckets are hot is estimated from one class in ``PROBE``; the estimate decides on the slices only, never on the pairs.

Defined cases: null texts and texts without letters or digits pair with nothing; repeated rows count once; rows of
other splits or without split are left out; a record pairs at most once with another, whatever their order; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import checked_broadcast, cut, spread, table

from .folding import fold, words
from .ocrnoise import skeleton
from .rows import flat_map
from .scan import continuous

TRAINING, EVALUATION = "dev", ("h", "v2", "v3", "v4")
HASHES, BANDS, ROWS, SALT, PROBE = 240, 80, 6, 512, 16
CELLS = 256
#: A quarter of the words in other places, where words recur, leaves at least this much of the set; the order decides.
LEAST_JACCARD, LEAST_ORDER = 0.3, 0.75


def plain_words(text: str | None) -> list[int]:
    """The words of a text as they are compared, hashed."""
    return [hash_of(w) for w in words(fold(continuous(text)))] if text else []


def in_order(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence of two word lists, by bits."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def cells(own: list[int]) -> bytes:
    """How many words fall into each cell, 255 at most."""
    counts = np.bincount(np.array(own, dtype=np.uint64) >> np.uint64(56), minlength=CELLS) if own else np.zeros(CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def nearly_same(a: list[int], b: list[int]) -> tuple[float, float] | None:
    """(Jaccard similarity of the words, share of the longer text in order) of a confirmed pair."""
    x, y = set(a), set(b)
    common = len(x & y)
    jaccard = common / (len(x) + len(y) - common)
    if jaccard < LEAST_JACCARD or min(len(a), len(b)) < LEAST_ORDER * max(len(a), len(b)):
        return None
    order = in_order(a, b) / max(len(a), len(b))
    return (jaccard, order) if order >= LEAST_ORDER else None


class Signer:
    """Bucket numbers of the bands of minwise hashes."""

    def __init__(self, hashes: int = HASHES, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.factor = random.integers(1, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        self.shift = random.integers(0, 1 << 32, hashes, dtype=np.uint32)
        # Every hash is used about equally often: bands are cut from permutations of all.
        rounds = -(-bands * rows // (hashes - hashes % rows))
        self.of = np.concatenate([random.permutation(hashes)[: hashes - hashes % rows] for _ in range(rounds)])[: bands * rows].reshape(bands, rows)
        self.mix = random.integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, own: list[int]) -> list[int]:
        h = np.unique(np.array(own, dtype=np.uint64))
        h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
        least = None
        for a in range(0, len(h), 256):
            part = h[a : a + 256, None] ^ self.shift
            part *= self.factor
            part = part.min(axis=0)
            least = part if least is None else np.minimum(least, part)
        mixed = (least[self.of].astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64)
        return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


_cache: dict[str, int] = {}


def hash_of(word: str) -> int:
    """A 64-bit hash of a word's skeleton that is the same on every machine."""
    value = _cache.get(word)
    if value is None:
        if len(_cache) > 200_000:
            _cache.clear()
        value = _cache[word] = int.from_bytes(hashlib.blake2b(skeleton(word).encode(), digest_size=8).digest(), "little")
    return value


def digest(own: list[int]) -> int:
    """A name for all texts with these words."""
    return int.from_bytes(hashlib.blake2b(np.array(own, dtype=np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alan, evrak_id, kume, kaynak, metin) of both fields."""
    state = spread(table(spark, sf_dir, "agent_state").select("evrak_id", "kume", "raw_text"))
    labels = spread(table(spark, sf_dir, "etiketler").select("evrak_id", "kume", "aciklama"))
    texts = state.select(F.lit("raw_text").alias("alan"), "evrak_id", "kume", F.col("raw_text").alias("metin"))
    notes = labels.select(F.lit("aciklama").alias("alan"), "evrak_id", "kume", F.col("aciklama").alias("metin"))
    return texts.unionByName(notes).where(F.col("kume").isin(TRAINING, *EVALUATION) & F.col("metin").isNotNull())


def signed(rows: DataFrame) -> DataFrame:
    """(alan, evrak_id, egitim, sinif, boy, hucreler, kovalar): the class of each record, the counts of its words by cell and the buckets of its bands."""

    def make():
        sign = Signer()
        seen: set[tuple] = set()

        def run(batch):
            for r in batch:
                own = plain_words(r["metin"])
                if not own:
                    continue
                record = (r["alan"], r["evrak_id"], r["kume"] == TRAINING, digest(own))
                # Rows delivered again are left out here where they meet; the rest of them does no harm.
                if record not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(record)
                    yield *record, len(own), cells(own), sign(own)

        return run

    return flat_map(rows.select("alan", "evrak_id", "kume", "metin"), make, "alan string, evrak_id bigint, egitim boolean, sinif bigint, boy int, hucreler binary, kovalar array<int>")


def candidates(classes: DataFrame, salt: int = SALT, probe: int = PROBE) -> DataFrame:
    """(alan, a, b): pairs of different classes, a with a training record, that share a bucket.

    Pairs whose lengths alone rule out enough words in order are left out at once.
    """
    # Field, band and bucket in one number.
    key = (F.lit(1) * F.when(F.col("alan") == "raw_text", 0).otherwise(1)).cast("bigint") * F.lit(1 << 40) + F.col("bant").cast("bigint") * F.lit(1 << 32) + F.col("kova").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    banded = classes.select("alan", "sinif", "egitim", "sinama", "boy", F.posexplode("kovalar").alias("bant", "kova")).select("sinif", "egitim", "sinama", "boy", key.alias("k"))
    seen = banded.where(F.col("egitim") & (F.pmod(F.col("sinif"), F.lit(probe)) == 0)).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") * probe > salt)
    hot = cut(seen.select("k", F.ceil(F.col("n") * probe / salt).cast("int").alias("tuz")))
    left = banded.where("egitim").select("k", F.col("sinif").alias("a"), F.col("boy").alias("na"))
    right = banded.where("sinama").select("k", F.col("sinif").alias("b"), F.col("boy").alias("nb"))
    on = ["k"]
    if not hot.isEmpty():
        few = checked_broadcast(hot)
        left = left.join(few, "k", "left").select("k", "a", "na", F.pmod(F.hash("a"), F.coalesce("tuz", F.lit(1))).alias("dilim"))
        right = right.join(few, "k", "left").select("k", "b", "nb", F.explode(F.sequence(F.lit(0), F.coalesce("tuz", F.lit(1)) - 1)).alias("dilim"))
        on = ["k", "dilim"]
    long_enough = F.least("na", "nb") >= F.lit(LEAST_ORDER) * F.greatest("na", "nb")
    return left.join(right, on).where("a <> b").where(long_enough).select(F.when(F.col("k") < 1 << 40, "raw_text").otherwise("aciklama").alias("alan"), "a", "b").distinct()


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs(alan, a, b) that may have enough words in common, by classes(alan, sinif, boy, hucreler).

    Texts of na and nb words with at least that share of the longer in common have na + nb less twice that many others, and no
    fewer differences between their cells, so none is lost.
    """
    side = lambda x: classes.select("alan", F.col("sinif").alias(x), F.col("boy").alias(f"n{x}"), F.col("hucreler").alias(f"h{x}"))
    both = pairs.join(side("a"), ["alan", "a"]).join(side("b"), ["alan", "b"])

    def make():
        def run(batch):
            a, b = (np.frombuffer(b"".join(r[x] for r in batch), np.uint8).reshape(-1, CELLS).astype(np.int16) for x in ("ha", "hb"))
            differences = np.abs(a - b).sum(axis=1)
            for r, d in zip(batch, differences.tolist()):
                if d <= r["na"] + r["nb"] - 2 * LEAST_ORDER * max(r["na"], r["nb"]):
                    yield r["alan"], r["a"], r["b"]

        return run

    return flat_map(both.select("alan", "a", "b", "na", "nb", "ha", "hb"), make, "alan string, a bigint, b bigint")


def verified(pairs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The candidates that are nearly the same: (alan, a, b, benzerlik, sirali); groups(alan, sinif, evrak_id, ozet) names a record of each class and its digest."""
    needed = cut(pairs.select("alan", F.explode(F.array("a", "b")).alias("sinif")).distinct().join(groups, ["alan", "sinif"]))
    texts = rows.join(checked_broadcast(needed), ["alan", "evrak_id"]).select("alan", "sinif", "ozet", "metin")

    def fold_():
        def run(batch):
            for r in batch:
                own = plain_words(r["metin"])
                if digest(own) == r["ozet"]:  # a record may have other texts too
                    yield r["alan"], r["sinif"], [w - (1 << 64) if w >> 63 else w for w in own]

        return run

    plain = cut(flat_map(texts, fold_, "alan string, sinif bigint, kelimeler array<bigint>").dropDuplicates(["alan", "sinif"]))
    both = pairs.join(plain.select("alan", F.col("sinif").alias("a"), F.col("kelimeler").alias("ka")), ["alan", "a"]).join(plain.select("alan", F.col("sinif").alias("b"), F.col("kelimeler").alias("kb")), ["alan", "b"])

    def make():
        def run(batch):
            for r in batch:
                found = nearly_same(r["ka"], r["kb"])
                if found:
                    yield r["alan"], r["a"], r["b"], round(found[0], 6), round(found[1], 6)

        return run

    return flat_map(both, make, "alan string, a bigint, b bigint, benzerlik double, sirali double")


def class_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows(alan, evrak_id, kume, metin).

    members(alan, evrak_id, egitim, sinif) has the class of each record, links(alan, a, b, benzerlik, sirali) the classes a with a
    training record and b with an evaluation record that are the same or nearly so. Classes are numbered, which keeps the bucket rows short.
    """
    rows = rows.select("alan", "evrak_id", "kume", "metin")
    members = cut(signed(rows))
    groups = members.groupBy("alan", "sinif").agg(F.bool_or("egitim").alias("egitim"), F.bool_or(~F.col("egitim")).alias("sinama"), F.min("evrak_id").alias("evrak_id"), F.first("boy").alias("boy"))
    groups = cut(groups.withColumn("no", F.monotonically_increasing_id()))
    # The cells and buckets of a class are those of its first record, so only the numbers are joined and no array is grouped.
    numbered = members.drop("egitim", "boy").join(checked_broadcast(groups), ["alan", "sinif", "evrak_id"]).drop("sinif", "evrak_id").withColumnRenamed("no", "sinif")
    pairs = cut(alike(candidates(numbered), numbered))
    near = verified(pairs, rows, groups.select("alan", F.col("no").alias("sinif"), "evrak_id", F.col("sinif").alias("ozet")))
    same = groups.where("egitim and sinama").select("alan", F.col("no").alias("a"), F.col("no").alias("b"), F.lit(1.0).alias("benzerlik"), F.lit(1.0).alias("sirali"))
    of = members.select("alan", "evrak_id", "egitim", "sinif").join(checked_broadcast(groups.select("alan", "sinif", "no")), ["alan", "sinif"]).drop("sinif").withColumnRenamed("no", "sinif")
    return of.distinct(), cut(near.unionByName(same).dropDuplicates(["alan", "a", "b"]))


def overlaps(rows: DataFrame) -> DataFrame:
    """(alan, egitim_id, sinama_id, benzerlik, sirali): every confirmed pair of rows(alan, evrak_id, kume, metin)."""
    of, links = class_links(rows)
    left = of.where("egitim").select("alan", F.col("sinif").alias("a"), F.col("evrak_id").alias("egitim_id"))
    right = of.where("not egitim").select("alan", F.col("sinif").alias("b"), F.col("evrak_id").alias("sinama_id"))
    return checked_broadcast(links).join(left, ["alan", "a"]).join(right, ["alan", "b"]).where("egitim_id <> sinama_id").select("alan", "egitim_id", "sinama_id", "benzerlik", "sirali")


def report(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """(alan, kume, kaynak, cift, sizan_evrak) from the members of linked classes; channels(evrak_id, kume, kaynak) may lack records.

    A class pair counts as many pairs as it has training records times evaluation records of the split and channel, so nothing is expanded.
    """
    of, links = class_links(rows)
    training = of.where("egitim").groupBy("alan", F.col("sinif").alias("a")).agg(F.count("*").alias("n"))
    partners = links.join(training, ["alan", "a"]).groupBy("alan", F.col("b").alias("sinif")).agg(F.sum("n").alias("n"))
    leaked = of.where("not egitim").join(partners, ["alan", "sinif"]).join(channels, "evrak_id", "left")
    return leaked.groupBy("alan", "kume", "kaynak").agg(F.sum("n").alias("cift"), F.countDistinct("evrak_id").alias("sizan_evrak"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a training and an evaluation record with the same or nearly the same text."""
    pairs = overlaps(records(spark, sf_dir))
    return pairs.select("alan", F.least("egitim_id", "sinama_id").alias("evrak_id_a"), F.greatest("egitim_id", "sinama_id").alias("evrak_id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and leaked records per field, evaluation split and channel."""
    return report(records(spark, sf_dir), table(spark, sf_dir, "agent_state").select("evrak_id", "kume", "kaynak").distinct())


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL: dict[str, str] = {}

"""Relations between documents: references, similar subjects with a common party, and chains.

Pairs come from equality joins on numbers, tokens and parties, never from comparing all with all. A document without an
edge is on its own. Repeated ids are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tomar.functions.text import tokens, tr_lower

from tomar.session import cut

from . import meetings
from .components import connected_components

LEAST_JACCARD, LEAST_COVER, LEAST_NUMBER = 0.5, 0.6, 5
#: Classes on either side that are compared at once.
BLOCK = 4000
_NUMBER = r"[0-9a-zçğıöşü][0-9a-zçğıöşü./-]*[0-9a-zçğıöşü]"


def own_numbers(number: Column | str, references: Column | None = None) -> Column:
    """The numbers a document may be cited by: long enough, with a digit, not a bare year."""
    number = F.col(number) if isinstance(number, str) else number
    every = F.array(number) if references is None else F.concat(F.array(number), F.coalesce(references, F.array().cast("array<string>")))
    low = F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.trim(tr_lower(x)))
    return F.array_distinct(F.filter(low, lambda x: (F.length(x) >= LEAST_NUMBER) & x.rlike("[0-9]") & ~x.rlike("^(19|20)[0-9]{2}$")))


def references(documents: DataFrame) -> DataFrame:
    """(src, dst, note): dst's reference lines cite the number of src; documents(id, number, refs array).

    The cited numbers are cut out of the reference lines and joined by equality.
    """
    cited = documents.select(F.col("id").alias("dst"), F.explode("refs").alias("line")).select("dst", F.explode(F.array_distinct(F.regexp_extract_all(tr_lower("line"), F.lit(_NUMBER), F.lit(0)))).alias("number"))
    named = documents.select(F.col("id").alias("src"), F.explode(own_numbers("number")).alias("number"))
    return named.join(cited, "number").where("src <> dst").select("src", "dst", F.col("number").alias("note")).distinct()


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, s, p, k) of the smallest document of each class of equal subject and party tokens, and (head, id) of the other members."""
    shaped = documents.select("id", F.array_sort(F.array_distinct(tokens(F.coalesce("subject", F.lit(""))))).alias("s"), F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("parties", F.array().cast("array<string>")), lambda p: F.array_join(F.array_sort(F.array_distinct(tokens(p))), " ")), lambda p: p != ""))).alias("p")).where("size(s) > 0 and size(p) > 0")
    classed = cut(shaped.withColumn("c", F.xxhash64("s", "p")))
    classes = cut(classed.groupBy("c").agg(F.min("id").alias("id"), F.first("s").alias("s"), F.first("p").alias("p")).withColumn("k", F.xxhash64("s")))
    members = classed.select("c", "id").join(classes.select("c", F.col("id").alias("head")), "c").where("id <> head").select("head", "id").distinct()
    return classes.drop("c"), members


def _near_subjects(classes: DataFrame, least: float) -> DataFrame:
    """(k, other, j): every subject with each that is similar to it, itself among them."""
    subjects = classes.groupBy("k").agg(F.first("s").alias("s"))
    prefix = subjects.select("k", "s", F.explode("s").alias("t"))
    # A pair with Jaccard j shares a token among the rarest of either side: the prefix of the tokens by rising frequency.
    df = prefix.groupBy("t").agg(F.count("*").alias("n"))
    ordered = prefix.join(df, "t").groupBy("k").agg(F.first("s").alias("s"), F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("o"))
    short = ordered.select("k", "s", F.explode(F.slice("o", F.lit(1), F.size("s") - F.ceil(F.size("s") * F.lit(least)).cast("int") + 1)).alias("t"))
    a, b = short.select("k", F.col("s").alias("sa"), "t"), short.select(F.col("k").alias("other"), F.col("s").alias("sb"), "t")
    jaccard = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return a.join(b, "t").where(jaccard >= least).select("k", "other", F.round(jaccard, 6).alias("j")).distinct()


def _met(classes: DataFrame, kind: str, least: float, cover: float, block: int) -> DataFrame:
    """What meetings.met finds between the classes of similar subjects, in cells of at most about ``block`` by ``block`` of them."""
    near = cut(_near_subjects(classes, least))
    sizes = classes.groupBy("k").agg(F.count("*").alias("n"))
    other = near.join(sizes.select(F.col("k").alias("other"), F.col("n").alias("m")), "other").groupBy("k").agg(F.sum("m").alias("m"))
    grid = sizes.join(other, "k").where("m > 1").select("k", F.ceil(F.col("n") / block).cast("int").alias("na"), F.ceil(F.col("m") / block).cast("int").alias("nb"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = classes.join(grid, "k").select("k", part("na").alias("ca"), every("nb").alias("cb"), F.lit(True).alias("own"), "id", F.lit(1.0).alias("j"), "p")
    right = near.join(grid, "k").join(classes.select(F.col("k").alias("other"), "id", "p"), "other").select("k", every("na").alias("ca"), part("nb").alias("cb"), F.lit(False).alias("own"), "id", "j", "p")
    cells = left.unionByName(right).repartition("k", "ca", "cb").sortWithinPartitions("k", "ca", "cb")
    node = classes.schema["id"].dataType
    more = {"pairs": [T.StructField("dst", node), T.StructField("jaccard", T.DoubleType())], "counts": [T.StructField("n", T.LongType())], "links": [T.StructField("dst", node)]}[kind]
    schema = T.StructType([T.StructField("src", node), *more])
    arrow = to_arrow_schema(schema)
    return cells.mapInArrow(lambda batches: meetings.met(batches, kind, cover, arrow), schema)


def similar_subjects(documents: DataFrame, least: float = LEAST_JACCARD, cover: float = LEAST_COVER, block: int = BLOCK) -> DataFrame:
    """(src, dst, jaccard): src < dst with similar subjects and a common party; documents(id, subject, parties array).

    Documents with the same subject tokens and party tokens form a class, and pairs are built between classes; the
    members of a class come linked to the smallest of them, which keeps every component whole.
    """
    classes, members = _classes(documents)
    pairs = _met(classes, "pairs", least, cover, block).distinct()
    return pairs.unionByName(members.select(F.col("head").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("jaccard")))


def similar_counts(documents: DataFrame, least: float = LEAST_JACCARD, cover: float = LEAST_COVER, block: int = BLOCK) -> DataFrame:
    """(src, n): how many rows of similar_subjects each src has, counted without building them unless ids repeat."""
    classes, members = _classes(documents)
    if not classes.groupBy("id").count().where("count > 1").isEmpty():
        return similar_subjects(documents, least, cover, block).groupBy("src").agg(F.count("*").alias("n"))
    counts = _met(classes, "counts", least, cover, block).unionByName(members.groupBy(F.col("head").alias("src")).agg(F.count("*").alias("n")))
    return counts.groupBy("src").agg(F.sum("n").alias("n"))


def similar_links(documents: DataFrame, least: float = LEAST_JACCARD, cover: float = LEAST_COVER, block: int = BLOCK) -> DataFrame:
    """(src, dst) with the components of similar_subjects, but of its pairs only as many as hold them together."""
    classes, members = _classes(documents)
    return _met(classes, "links", least, cover, block).distinct().unionByName(members.select(F.col("head").alias("src"), F.col("id").alias("dst")))


def edges(documents: DataFrame) -> DataFrame:
    """(src, dst, kind) of documents(id, number, refs, subject, parties), each pair once with its strongest kind."""
    strong = references(documents).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(0).alias("k"))
    weak = similar_subjects(documents).select("src", "dst", F.lit(1).alias("k"))
    best = strong.unionByName(weak).groupBy("src", "dst").agg(F.min("k").alias("k"))
    return best.select("src", "dst", F.when(F.col("k") == 0, "ilgi_referansi").otherwise("konu_benzerligi").alias("kind"))


def chains(documents: DataFrame) -> DataFrame:
    """(id, chain, kind): the chain of each linked document, named after its smallest id, with its strongest kind."""
    strong = references(documents).select("src", "dst", F.lit("ilgi_referansi").alias("kind"))
    found = cut(strong.unionByName(similar_links(documents).withColumn("kind", F.lit("konu_benzerligi"))))
    member = connected_components(found)
    kinds = found.join(member, found["src"] == member["node"]).groupBy("component").agg(F.min("kind").alias("kind"))
    return member.join(kinds, "component").select(F.col("node").alias("id"), F.col("component").alias("chain"), "kind")


def unlinked(documents: DataFrame, members: DataFrame) -> DataFrame:
    """The ids that are in no chain."""
    return documents.select("id").distinct().join(members.select("id"), "id", "left_anti")


def base_name(path: Column | str, fallback: Column | None = None) -> Column:
    """The last part of a path, or a fallback where it is blank."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"[^/]+$", 0)
    return F.when(name != "", name).otherwise(fallback if fallback is not None else F.lit("evrak"))

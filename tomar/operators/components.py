"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomar.session import cut


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component for each node of an edge.

    Alternating large-star and small-star rounds on the edge table: each round is two aggregations by
    node and needs about the logarithm of the longest path. Lineage is cut each round in the shared checkpoint folder. The root of a
    large component is a hot key of the joins, which adaptive execution splits; the aggregations combine before they shuffle.
    Null ends and loops are dropped; an empty edge table gives an empty result.
    """
    plain = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).where("u is not null and v is not null and u <> v")
    current = cut(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = print_of(current)
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours greater than a node go to its least neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: a node and its smaller neighbours go to the least of them.
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        current, before, last = following, last, print_of(following)
        if last == before or not last[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()

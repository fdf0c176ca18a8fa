"""Connected components of an edge table by alternating star contractions.

Each round lets every node point its larger neighbours, then its smaller ones, at
the least node it knows of; the number of rounds is logarithmic in practice.  Every
round is a written table, which replaces the one before it; nothing is collected but
a count and a checksum.  The centre of a large star is split by the skew handling of
sort-merge joins.  Rounds end when nothing changes any more; should they ever pass
``rounds``, the call fails rather than return components that are not whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.staging import discard, staged


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, one: str = "a", other: str = "b", rounds: int = 200) -> DataFrame:
    """node and root (its component's least node) of all nodes that an edge names."""
    pairs = edges.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).where("u <> v").distinct()
    pairs = staged(pairs, "links")
    before = None
    for _ in range(rounds):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        older, pairs = pairs, staged(small.where("u <> v").distinct(), "links")
        discard(older)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

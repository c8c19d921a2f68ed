"""Connected components of an edge table by alternating star contractions.

Large and small stars after Kiveris et al., "Connected Components in MapReduce
and Beyond" (SoCC 2014). Every round is two grouped minima and two equi joins;
nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, materialise


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a long, b long) -> node long, component long (the least node reachable), for every node with an edge to another.

    Loops, repeated edges and either direction are allowed; rows with a null end are no edges.
    """
    a, b = F.col("a"), F.col("b")
    stars = materialise(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    seen = _state(stars)
    while seen[0]:
        before, stars = stars, materialise(_small_star(_large_star(stars)), name)
        now = _state(stars)
        drop_scratch(before)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

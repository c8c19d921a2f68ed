"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector x, padded and turned at random, keeps the signs of its ``bits`` coordinates (its code, the corner c of a
cube) and the correction factor <c, x>. For any other unit vector y, <c, y> / <c, x> estimates <x, y> without bias,
and its error stays below ``confidence * sqrt((1 - f^2) / f^2 / (bits - 1))`` with high probability; pairs whose
upper bound misses the threshold are dropped, all others are recomputed exactly in double precision.

Candidates meet in bands of sign bits, drawn anew for every band; how many bands there are follows from the band's width and the
accepted ``miss`` rate of a pair at the threshold itself (closer pairs are missed far more rarely).

Dense groups never turn into pairs. Vectors in a crowded band bucket that lie within half the
threshold angle of the bucket's least vector form a ball: by the triangle inequality all of them link to each other, so a ball counts
as its size. Two balls whose centres are near enough (or far enough) for their radii link fully (or not at
all); only what remains undecided is compared, block of members against block of members, and only counts leave a task.

Defined cases: see ``usable_vectors``; every row of the table gets a result, unusable vectors with no links and themselves as
component; repeated ids give one row; a null id gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shuffle_partitions
from tidemark.llm.components import connected_components
from tidemark.llm.vectors import rotation, stacked, usable_vectors

_SLACK = 1e-9


class Codes:
    """The rotation and the arithmetic of the codes; the same in every task."""

    def __init__(self, dimensions: int, bits: int, seed: int):
        self.bits, self.dimensions = max(bits, -(-dimensions // 64) * 64), dimensions
        self.turn = rotation(self.bits, dimensions, seed)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed sign bits and correction factors of unit vectors."""
        turned = unit @ self.turn.T
        return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(self.bits)

    def corners(self, packed: np.ndarray) -> np.ndarray:
        """The corners of codes, turned back to the vectors' own coordinates."""
        signs = np.unpackbits(packed, axis=1).astype(np.float64) * 2 - 1
        return signs @ self.turn / math.sqrt(self.bits)

    def upper_bounds(self, packed: np.ndarray, factors: np.ndarray, others: np.ndarray, confidence: float) -> np.ndarray:
        """Upper confidence bounds of the inner products of coded vectors (rows) with ``others`` (columns)."""
        estimate = self.corners(packed) @ others.T / factors[:, None]
        return estimate + (confidence * np.sqrt(np.maximum(0, 1 - factors**2) / factors**2 / (self.bits - 1)))[:, None]


def band_plan(n: int, dimensions: int, cosine: float, miss: float, seed: int) -> list[np.ndarray]:
    """Random hyperplanes (rows) of every band: about 16 random neighbours a bucket, and as many bands as the miss rate asks for.

    No band shares a hyperplane with another, so for any pair the bands are independent and the miss rate holds at every size.
    """
    width = int(np.clip(math.ceil(math.log2(max(n, 2))) - 4, 8, 40))
    hit = (1 - math.acos(cosine) / math.pi) ** width
    bands = math.ceil(math.log(miss) / math.log(1 - hit))
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(width, dimensions)) for _ in range(bands)]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed bytes and their scale; the error of a product with a unit vector stays below half a step times sqrt(dimensions)."""
    scale = np.maximum(np.abs(unit).max(1), 1e-12) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale


def near_duplicates(table: DataFrame, cosine: float = 0.95, bits: int = 256, miss: float = 1e-6, confidence: float = 4.0, crowd: int = 16, most_in_bucket: int = 4096, block: int = 1024, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (vectors linked directly), component_id (least vec_id reachable), kept."""
    spark = table.sparkSession
    vectors = materialise(usable_vectors(table, id_col, vector_col), "vectors")
    n, head = vectors.count(), vectors.first()
    everyone = table.select(F.col(id_col).cast("long").alias("vec_id")).filter(F.col("vec_id").isNotNull()).distinct()
    if not n:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    codes = Codes(len(head["v"]), bits, seed)
    bands = band_plan(n, codes.dimensions, cosine, miss, seed)
    shared = spark.sparkContext.broadcast((codes, bands))
    theta, parts = math.acos(cosine), shuffle_partitions(spark)
    near = math.cos(theta / 2)

    def unit_of(v: pd.Series) -> np.ndarray:
        x = stacked(v, codes.dimensions)
        x = x / np.abs(x).max(1)[:, None]
        return x / np.linalg.norm(x, axis=1)[:, None]

    def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, bands = shared.value
        for batch in batches:
            unit = unit_of(batch["v"])
            for number, planes in enumerate(bands):
                keys = (unit @ planes.T >= 0).astype(np.int64) @ (np.int64(1) << np.arange(len(planes), dtype=np.int64))
                yield pd.DataFrame({"band": np.int32(number), "key": keys, "vec_id": batch["vec_id"]})

    keys = materialise(vectors.mapInPandas(key_rows, "band int, key long, vec_id long"), "bands")

    # balls: crowded buckets offer their least vector as a centre
    centres = keys.groupBy("band", "key").agg(F.min("vec_id").alias("centre"), F.count("*").alias("n")).filter(F.col("n") >= crowd).drop("n")
    offers = keys.join(centres, ["band", "key"]).select("vec_id", "centre").distinct()
    offers = offers.join(vectors, "vec_id").join(vectors.select(F.col("vec_id").alias("centre"), F.col("v").alias("w")), "centre")

    def lean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cos = np.einsum("ij,ij->i", unit_of(batch["v"]), unit_of(batch["w"])) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "centre": batch["centre"], "cos": cos})[cos >= near + _SLACK]

    joined = offers.mapInPandas(lean, "vec_id long, centre long, cos double").groupBy("vec_id").agg(F.min(F.struct("centre", "cos")).alias("at"))
    members = materialise(joined.select("vec_id", F.col("at.centre").alias("ball"), F.acos(F.least(F.lit(1.0), "at.cos")).alias("angle")), "members")
    placed = vectors.select("vec_id").join(members, "vec_id", "left").select("vec_id", F.coalesce("ball", "vec_id").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle"))
    placed = materialise(placed, "placed")
    balls = placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"))
    balls = materialise(balls.join(vectors.withColumnRenamed("vec_id", "ball"), "ball"), "balls")

    def code_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, _ = shared.value
        for batch in batches:
            unit = unit_of(batch["v"])
            packed, factors = codes.encode(unit)
            small, scale = quantised(unit)
            yield pd.DataFrame({"ball": batch["ball"], "radius": batch["radius"], "code": [r.tobytes() for r in packed], "factor": factors, "small": [r.tobytes() for r in small], "scale": scale})

    coded = balls.mapInPandas(code_rows, "ball long, radius double, code binary, factor double, small binary, scale double")
    spots = keys.join(placed.select("vec_id", "ball"), "vec_id").select("band", "key", "ball").distinct()
    crowded = spots.groupBy("band", "key").count().filter(F.col("count") > 1)
    spots = spots.join(crowded, ["band", "key"]).join(coded, "ball")
    cut = F.ceil(F.col("count") / most_in_bucket).cast("int")
    own = F.pmod(F.xxhash64("ball"), cut).cast("int")
    # a bucket of several blocks: each unordered pair of blocks is one task group, to which both send their rows
    tiles = F.when(cut == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), cut - 1), lambda j: F.least(own, j) * cut + F.greatest(own, j)))
    dealt = spots.withColumn("side", own).withColumn("tile", F.explode(tiles)).drop("count")
    dealt = dealt.repartition(parts, "band", "key", "tile").sortWithinPartitions("band", "key", "tile")

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, _ = shared.value
        group: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            spot = list(zip(batch["band"], batch["key"], batch["tile"]))
            starts = [k for k in range(len(spot)) if not k or spot[k] != spot[k - 1]]
            for a, b in zip(starts, [*starts[1:], len(spot)]):
                if spot[a] != last and group:
                    yield from pairs(codes, pd.concat(group))
                    group = []
                last = spot[a]
                group.append(batch.iloc[a:b])
        if group:
            yield from pairs(codes, pd.concat(group))

    def pairs(codes: Codes, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ball, radius, side = rows["ball"].to_numpy(), rows["radius"].to_numpy(), rows["side"].to_numpy()
        packed = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
        factors, scale = rows["factor"].to_numpy(), rows["scale"].to_numpy()
        small = np.frombuffer(b"".join(rows["small"]), dtype=np.int8).reshape(len(rows), -1) * scale[:, None]
        rough = 0.5 * scale.max() * math.sqrt(codes.dimensions)
        several = side.min() != side.max()
        for at in range(0, len(rows), 512):
            upper = codes.upper_bounds(packed[at : at + 512], factors[at : at + 512], small, confidence) + rough / factors[at : at + 512, None]
            angle = np.minimum(math.pi, theta + radius[at : at + 512, None] + radius[None, :])
            i, j = np.nonzero((upper >= np.cos(angle)) & (ball[at : at + 512, None] < ball[None, :]))
            if several:  # pairs of one side meet in that side's own tile
                apart = side[at + i] != side[j]
                i, j = i[apart], j[apart]
            if len(i):
                yield pd.DataFrame({"a": ball[at + i], "b": ball[j]})

    candidates = dealt.mapInPandas(estimate, "a long, b long").distinct()
    one = lambda c: balls.select(F.col("ball").alias(c), F.col("v").alias(f"v{c}"), F.col("radius").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    measured = candidates.join(one("a"), "a").join(one("b"), "b")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cos = np.einsum("ij,ij->i", unit_of(batch["va"]), unit_of(batch["vb"])) if len(batch) else np.zeros(0)
            angle, reach = np.arccos(np.clip(cos, -1, 1)), (batch["ra"] + batch["rb"]).to_numpy()
            single = (batch["na"].to_numpy() == 1) & (batch["nb"].to_numpy() == 1) & (reach == 0)
            full = np.where(single, cos >= cosine, angle + reach <= theta - 1e-7)
            none = np.where(single, ~full, angle - reach > theta + 1e-7)
            verdict = np.where(full, 1, np.where(none, 0, 2)).astype(np.int32)
            yield batch[["a", "b", "na", "nb"]].assign(verdict=verdict)[verdict > 0]

    decided = materialise(measured.mapInPandas(decide, "a long, b long, na long, nb long, verdict int"), "decided")
    full = decided.filter("verdict = 1")
    by_ball = full.select(F.col("a").alias("ball"), F.col("nb").alias("n")).unionByName(full.select(F.col("b").alias("ball"), F.col("na").alias("n"))).groupBy("ball").agg(F.sum("n").alias("more"))

    # undecided pairs of balls: blocks of members against blocks of members
    open_pairs = decided.filter("verdict = 2").select("a", "b")
    touched = open_pairs.select(F.col("a").alias("ball")).unionByName(open_pairs.select(F.col("b").alias("ball"))).distinct()
    slots = placed.join(touched, "ball", "left_semi").join(balls.select("ball", F.ceil(F.col("n") / block).alias("blocks")), "ball").select("ball", "vec_id", F.pmod(F.xxhash64("vec_id"), "blocks").alias("slot")).join(vectors, "vec_id")
    blocks = slots.groupBy("ball", "slot").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    tiles_of = open_pairs.join(blocks.select(F.col("ball").alias("a"), F.col("rows").alias("ra")), "a").join(blocks.select(F.col("ball").alias("b"), F.col("rows").alias("rb")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, left, right in zip(batch["a"], batch["b"], batch["ra"], batch["rb"]):
                x, y = (unit_of(pd.Series([r["v"] for r in side])) for side in (left, right))
                hit = x @ y.T >= cosine
                for ids, n in (([r["vec_id"] for r in left], hit.sum(1)), ([r["vec_id"] for r in right], hit.sum(0))):
                    if hit.any():
                        yield pd.DataFrame({"a": a, "b": b, "vec_id": ids, "n": n})[n > 0]

    counted = materialise(tiles_of.mapInPandas(compare, "a long, b long, vec_id long, n long"), "counted")
    by_vector = counted.groupBy("vec_id").agg(F.sum("n").alias("few"))
    edges = full.select("a", "b").unionByName(counted.select("a", "b").distinct())
    groups = connected_components(edges, "embeddings")
    rooted = balls.select("ball", "n", "least").join(groups, F.col("ball") == F.col("node"), "left").select("ball", "n", "least", F.coalesce("component", "ball").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(by_ball, "ball", "left")
    result = placed.join(named.select("ball", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("base"), "component_id"), "ball").join(by_vector, "vec_id", "left")
    result = result.select("vec_id", (F.col("base") + F.coalesce("few", F.lit(0))).cast("long").alias("n_links"), "component_id")
    out = everyone.join(result, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

"""Sampling: design of stratified samples on parameter grids, and drawing them by hash.

Draws never use ``rand``: an item's place is a hash of its key, so samples repeat in any partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import clamp, hash_uniform, ratio, z_value

STRATEGIES = ("proportional", "neyman", "risk_stratified")


def srs_size(p: Column, e: Column, confidence: float = 0.95) -> Column:
    """Simple random sample size for half-width ``e``."""
    z = z_value(confidence)
    return F.ceil(F.lit(z * z) * p * (1 - p) / (e * e)).cast("long")


def difficulty(categories: DataFrame, target: float = 0.01, least_positives: int = 100, budget: int = 10_000, cost: float = 0.001) -> DataFrame:
    """How hard each (harm_vertical, true_prevalence) is to measure by simple random sampling."""
    p = F.col("true_prevalence")
    sized = categories.withColumn("n_for_ci_abs", srs_size(p, F.lit(target))).withColumn("n_for_min_positives", F.ceil(F.lit(float(least_positives)) / p).cast("long"))
    n = F.greatest("n_for_ci_abs", "n_for_min_positives")
    return sized.select("*", n.alias("n_operational_required"), (F.col("n_for_ci_abs") * p).alias("expected_positives_at_ci_n"), (n * p).alias("expected_positives_at_operational_n"), (n <= budget).alias("within_budget"), (F.col("n_for_ci_abs") * p >= least_positives).alias("enough_positives_at_ci_n"), (n * cost).alias("labeling_cost_usd"))


def strata_table(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    """stratum, stratum_rank (0 is the highest risk), weight."""
    rows = [(name, rank, float(w)) for rank, (name, w) in enumerate((weights or {"high_risk": 0.1, "low_risk": 0.9}).items())]
    return spark.createDataFrame(rows, "stratum string, stratum_rank int, weight double")


def stratum_prevalences(designs: DataFrame, strata: DataFrame) -> DataFrame:
    """Each design (design_id, corpus_size, prevalence, target) with its strata: stratum_size and the prevalence that puts 80 % of harm in rank 0."""
    each = designs.crossJoin(F.broadcast(strata)).withColumn("stratum_size", (F.col("corpus_size") * F.col("weight")).cast("long"))
    w = Window.partitionBy("design_id")
    harm = F.col("corpus_size") * F.col("prevalence")
    rest = F.sum(F.when(F.col("stratum_rank") > 0, F.col("stratum_size")).otherwise(0)).over(w)
    first = F.least(F.lit(0.999), ratio(0.8 * harm, F.col("stratum_size")))
    others = clamp(F.coalesce(ratio(harm - 0.8 * harm, rest), F.lit(0.0)), 1e-6, 0.999)
    p = F.when(F.count("*").over(w) == 1, F.col("prevalence")).when(F.col("stratum_rank") == 0, first).otherwise(others)
    return each.withColumn("p_h", p)


def allocate(designs: DataFrame, strata: DataFrame, strategy: str, confidence: float = 0.95) -> DataFrame:
    """Sample sizes n_h of every stratum of every design under ``strategy``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    z, w = z_value(confidence), Window.partitionBy("design_id")
    each = stratum_prevalences(designs, strata)
    n_all, p, size = F.sum("stratum_size").over(w), F.col("p_h"), F.col("stratum_size")
    if strategy == "proportional":
        pooled = F.sum(size * p).over(w) / n_all
        total = F.greatest(srs_size(pooled, F.col("target"), confidence), F.lit(100))
        return each.withColumn("n_h", F.greatest(F.lit(1), F.bround(total * size / n_all).cast("long")))
    sigma = F.sqrt(p * (1 - p))
    spread, squares = F.sum(size * sigma).over(w), F.sum(size * sigma * sigma).over(w)
    total = F.greatest(F.ceil(spread * spread / (F.pow(n_all * F.col("target") / z, F.lit(2.0)) + squares)), F.lit(100))
    neyman = each.withColumn("n_h", F.greatest(F.lit(1), F.bround(total * size * sigma / spread).cast("long")))
    if strategy == "neyman":
        return neyman
    budget = F.sum("n_h").over(w)
    high = F.greatest(F.lit(1), F.bround(0.6 * budget).cast("long"))
    rest = F.sum(F.when(F.col("stratum_rank") > 0, size).otherwise(0)).over(w)
    share = F.coalesce(ratio(size, rest), 1 / (F.count("*").over(w) - 1))
    return neyman.withColumn("n_h", F.when(F.col("stratum_rank") == 0, high).otherwise(F.greatest(F.lit(1), F.bround((budget - high) * share).cast("long"))))


def design_summary(allocated: DataFrame, confidence: float = 0.95, cost: float = 0.001) -> DataFrame:
    """One row a design: total size, expected half-width (with finite population correction), design effect, cost, expected positives, warnings."""
    z = z_value(confidence)
    p, n, size = F.col("p_h"), F.col("n_h"), F.col("stratum_size")
    share = size / F.col("corpus_size")
    part = share * share * p * (1 - p) / n * (1 - n / size)
    keys = ["design_id", "corpus_size", "prevalence", "target"]
    out = allocated.groupBy(*keys).agg(F.sum("n_h").alias("n_total"), F.sum(part).alias("variance"), F.sum(n * cost).alias("total_cost"))
    srs = F.col("prevalence") * (1 - F.col("prevalence")) / F.col("n_total")
    positives = F.col("n_total") * F.col("prevalence")
    # quantities that can be negative where a stratum is oversampled have no half-width
    out = out.withColumn("half_width", F.when(F.col("variance") >= 0, F.lit(z) * F.sqrt(F.col("variance")))).withColumn("deff", F.when(srs == 0, F.lit(1.0)).otherwise(F.col("variance") / srs))
    return out.select(*keys, "n_total", "half_width", "deff", "total_cost", positives.alias("expected_positives"), (positives < 5).alias("few_positives"), (F.col("prevalence") < 0.001).alias("very_rare"))


def srs(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the first by hash."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def per_group_sample(df: DataFrame, group: str, key: str, sizes: dict, seed: str = "") -> DataFrame:
    """The first ``sizes[group]`` rows of each group by hash."""
    want = F.lit(0)
    for value, n in sizes.items():
        want = F.when(F.col(group) == value, n).otherwise(want)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key))
    # the literal bound lets the planner stop each group early
    return df.withColumn("_rank", rank).filter((F.col("_rank") <= max(sizes.values(), default=0)) & (F.col("_rank") <= want)).drop("_rank")


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: str = "") -> DataFrame:
    """Without replacement, chances in proportion to weight: the n least of -ln(u) / w (Efraimidis and Spirakis); no weight, no chance."""
    u = hash_uniform(F.col(key), seed)
    score = -F.log(F.greatest(u, F.lit(1e-12))) / weight
    return df.withColumn("_order", F.round(score, 12)).filter(weight > 0).orderBy("_order", key).limit(n).drop("_order")


def hash_split(df: DataFrame, key: str, share: float = 0.7, salt: str = "split") -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by a hash of the key."""
    u = hash_uniform(F.col(key), salt)
    return df.filter(u < share), df.filter(u >= share)


@dataclass(frozen=True)
class SampleDesign:
    """The scalar view of one design."""

    strategy: str
    n_total: int
    half_width: float | None
    deff: float
    total_cost: float
    allocation: dict[str, int]
    notes: list[str]
    strata: list[dict]

    def summary_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s["stratum"], s["stratum_size"], s["p_h"], s["n_h"], s["n_h"] / s["stratum_size"], s["cost_h"]) for s in self.strata], "stratum string, stratum_size long, est_prevalence double, n_h_allocated long, sampling_fraction double, cost_h double")


class StratifiedHarmSampler:
    """Designs from plain numbers; the arithmetic runs through the same plans."""

    def __init__(self, spark: SparkSession, confidence_level: float = 0.95):
        self.spark, self.confidence, self.z = spark, confidence_level, z_value(confidence_level)

    def minimum_sample_size_srs(self, prevalence: float, half_width: float) -> int:
        return math.ceil(self.z**2 * prevalence * (1 - prevalence) / half_width**2)

    def expected_positives(self, n_sample: int, prevalence: float) -> float:
        return n_sample * prevalence

    def design_sample(self, corpus_size: int, estimated_prevalence: float, target_ci_width: float, strata_weights: dict[str, float] | None = None, labeling_cost_per_item: float = 0.001, strategy: str = "neyman") -> SampleDesign:
        designs = self.spark.createDataFrame([(0, corpus_size, estimated_prevalence, target_ci_width)], "design_id int, corpus_size long, prevalence double, target double")
        allocated = allocate(designs, strata_table(self.spark, strata_weights), strategy, self.confidence)
        rows = [r.asDict() for r in allocated.orderBy("stratum_rank").collect()]  # one row a stratum
        made = design_summary(allocated, self.confidence, labeling_cost_per_item).first()
        notes = [f"{corpus_size:,} items at an estimated prevalence of {estimated_prevalence:.4%}", f"{strategy}: {made.n_total:,} items to label, {made.expected_positives:.1f} expected to be harmful"]
        if made.half_width:
            notes.append(f"a simple random sample of {self.minimum_sample_size_srs(estimated_prevalence, made.half_width):,} would be as precise")
        if made.few_positives:
            notes.append("WARNING: fewer than 5 positives expected; the interval will be unreliable")
        if made.very_rare:
            notes.append("below 0.1 %: proportional sampling is very inefficient")
        strata = [{k: r[k] for k in ("stratum", "stratum_size", "p_h", "n_h")} | {"cost_h": r["n_h"] * labeling_cost_per_item} for r in rows]
        return SampleDesign(strategy, made.n_total, made.half_width, made.deff, made.total_cost, {r["stratum"]: r["n_h"] for r in rows}, notes, strata)

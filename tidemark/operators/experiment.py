"""Experiment design for prevalence metrics: sample sizes, detectable effects, alpha spending, proxy metrics."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import norm_cdf, ratio


def _z(alpha: float, power: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)


def power_prevalence_test(grid: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """``grid`` (baseline, treatment, review_budget) -> n_naive, inflation, n_per_arm; null where the effect is (about) zero.

    The reviewed samples of both arms add noise to the estimates: sizes are inflated by 1 + their variance over that of a corpus of n_naive.
    """
    z, b, t = _z(alpha, power), F.col("baseline"), F.col("treatment")
    delta = F.when(F.abs(t - b) >= 1e-9, t - b)
    naive = F.lit(z * z) * (b * (1 - b) + t * (1 - t)) / (delta * delta)
    spread = b * (1 - b) + t * (1 - t)
    inflation = 1 + ratio(spread / F.col("review_budget"), spread / 2 / naive)
    return grid.select("*", F.ceil(naive).cast("long").alias("n_naive"), inflation.alias("inflation"), F.ceil(naive * inflation).cast("long").alias("n_per_arm"), F.abs(delta).alias("effect"))


def mde(prevalence: Column, n_corpus: Column, n_review: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Least detectable absolute effect with corpus and review sampling noise."""
    return F.lit(_z(alpha, power)) * F.sqrt(2 * prevalence * (1 - prevalence) * (1 / n_corpus + 1 / n_review))


def worked(grid: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """``grid`` (baseline, treatment, weekly_corpus, review_budget): sizes, the detectable effect, whether the planned one is powered, and the weeks it takes where it is not."""
    m = mde(F.col("baseline"), F.col("weekly_corpus"), F.col("review_budget"), alpha, power)
    sized = power_prevalence_test(grid, alpha, power).withColumn("mde", m).withColumn("powered", F.coalesce(F.col("effect") >= m, F.lit(False)))
    return sized.withColumn("weeks", F.when(~F.col("powered"), F.ceil(ratio(F.col("n_per_arm"), F.col("weekly_corpus"))).cast("long")))


def obf_alpha(information: Column, alpha: float = 0.05) -> Column:
    """O'Brien-Fleming alpha spent by an information fraction in (0, 1]."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return 2 * (1 - norm_cdf(F.lit(z) / F.sqrt(information)))


def proxy_metrics(df: DataFrame, arm: str, score: str, flags: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Per arm: mean score, 95th percentile (interpolated), share at or above each flag."""
    shares = [F.avg((F.col(score) >= t).cast("double")).alias(f"flag_{round(100 * t)}") for t in flags]
    return df.groupBy(arm).agg(F.avg(score).alias("mean_score"), F.percentile(score, F.lit(0.95)).alias("p95_score"), *shares)


def percent_change(metrics: DataFrame, arm: str, control, treatment, columns: list[str]) -> DataFrame:
    """Relative change of each metric from one arm to the other, one row a metric."""
    at = lambda c, a: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = metrics.agg(F.array(*[F.struct(F.lit(c).alias("metric"), at(c, control).alias("control"), at(c, treatment).alias("treatment")) for c in columns]).alias("m"))
    return wide.select(F.inline("m")).withColumn("change", ratio(F.col("treatment") - F.col("control"), F.col("control")))

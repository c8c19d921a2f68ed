"""Actor risk: component scores, composite, tier, and sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, ratio

# fixed values
DEFAULT_WEIGHTS = {"velocity": 0.25, "newness": 0.20, "repetition": 0.25, "automation": 0.15, "enforcement": 0.10, "coordination": 0.05}
TIER_CUTS = (("high", 0.60), ("medium", 0.35))


def velocity(p7: Column, p30: Column, baseline: float = 3.0) -> Column:
    """Recent rate against the baseline, and against the actor's own month."""
    d7, d30 = p7 / 7.0, p30 / 30.0
    burst = d7 / F.greatest(d30, F.lit(0.1))
    return clamp(0.55 * clamp(d7 / (baseline * 10)) + 0.45 * clamp((burst - 1) / 9))


def newness(age_days: Column, threshold_days: float = 30.0) -> Column:
    return clamp(F.exp(-age_days / threshold_days))


def repetition(unique_ratio: Column) -> Column:
    return 1 - clamp(unique_ratio)


def automation(api_fraction: Column) -> Column:
    return clamp(api_fraction)


def enforcement(n: Column) -> Column:
    return clamp(F.log1p(n.cast("double")) / F.log1p(F.lit(10.0)))


def tier(composite: Column) -> Column:
    out = F.lit("low")
    for name, cut in reversed(TIER_CUTS):
        out = F.when(composite >= cut, name).otherwise(out)
    return out


def composite(weights: dict[str, float], columns) -> Column:
    """Weighted sum of component scores; a missing coordination score counts as 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        score = F.coalesce(F.col(f"{name}_score"), F.lit(0.0)) if name == "coordination" and "coordination_score" in columns else F.lit(0.0) if name == "coordination" else F.col(f"{name}_score")
        total = total + F.lit(weight) * score
    return clamp(total)


class ActorFeatureExtractor:
    def __init__(self, score_weights: dict[str, float] | None = None, velocity_baseline_posts_per_day: float = 3.0, new_account_threshold_days: float = 30.0):
        self.weights = dict(score_weights or DEFAULT_WEIGHTS)
        if abs(sum(self.weights.values()) - 1) > 1e-6:
            raise ValueError("score weights must sum to 1")
        self.baseline, self.threshold = velocity_baseline_posts_per_day, new_account_threshold_days

    def compute_risk_scores(self, actors: DataFrame) -> DataFrame:
        """All component scores, composite_score and risk_tier."""
        needed = {"account_age_days", "post_count_7d", "post_count_30d", "unique_content_ratio", "api_usage_fraction", "prior_enforcement_count"}
        if missing := needed - set(actors.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        scored = actors.select(
            *[c for c in actors.columns if not c.endswith("_score") or c == "coordination_score"],
            velocity(F.col("post_count_7d"), F.col("post_count_30d"), self.baseline).alias("velocity_score"),
            newness(F.col("account_age_days"), self.threshold).alias("newness_score"),
            repetition(F.col("unique_content_ratio")).alias("repetition_score"),
            automation(F.col("api_usage_fraction")).alias("automation_score"),
            enforcement(F.col("prior_enforcement_count")).alias("enforcement_score"),
        )
        scored = scored.withColumn("composite_score", composite(self.weights, scored.columns))
        return scored.withColumn("risk_tier", tier(F.col("composite_score")))

    def stratum_sampling_weights(self, scored: DataFrame) -> DataFrame:
        """``sampling_weight`` in proportion to composite + .05, summing to 1 over all rows."""
        total = F.broadcast(scored.agg(F.sum(F.col("composite_score") + 0.05).alias("_total")))
        return scored.crossJoin(total).withColumn("sampling_weight", ratio(F.col("composite_score") + 0.05, F.col("_total"))).drop("_total")


def rate_by(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per group: rows, positives, rate."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("positives"), F.avg(F.col(label).cast("double")).alias("rate"))


def lift(df: DataFrame, inside: Column, label: str) -> DataFrame:
    """Rates inside and outside a segment and their ratio; null where the outside rate is 0."""
    y = F.col(label).cast("double")
    rates = df.agg(F.avg(F.when(inside, y)).alias("rate_in"), F.avg(F.when(~inside, y)).alias("rate_out"))
    return rates.withColumn("lift", ratio(F.col("rate_in"), F.col("rate_out")))

"""Evidence updates of a prior by signals with known hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio

# fixed values
POSTERIOR_TIERS = ((0.05, "escalate"), (0.02, "review"), (0.005, "sample"))


def update(prior: Column, tpr: Column, fpr: Column, present: Column) -> Column:
    """Posterior after one signal; the prior where the evidence has probability 0."""
    t, f = F.when(present, tpr).otherwise(1 - tpr), F.when(present, fpr).otherwise(1 - fpr)
    evidence = prior * t + (1 - prior) * f
    return F.when(evidence > 0, prior * t / evidence).otherwise(prior)


def sequential(prior: Column, signals: Column) -> Column:
    """Posterior after an ordered array of (tpr, fpr, present); no or null signals leave the prior."""
    return F.aggregate(F.coalesce(signals, F.array().cast("array<struct<tpr:double,fpr:double,present:boolean>>")), prior.cast("double"), lambda p, s: update(p, s["tpr"], s["fpr"], s["present"]))


def trace(df: DataFrame, prior: str = "prior", signals: str = "signals") -> DataFrame:
    """One row a step: the prior at step 0, then the posterior after each signal."""
    steps = F.transform(F.sequence(F.lit(0), F.size(signals)), lambda k: F.struct(k.alias("step"), sequential(F.col(prior), F.slice(F.col(signals), F.lit(1), k)).alias("posterior")))
    return df.select("*", F.inline(steps))


def lift(prior: Column, posterior: Column) -> Column:
    return ratio(posterior, prior)


def break_even(posterior: Column) -> Column:
    """Cost of a false positive over that of a miss at which acting starts to pay."""
    return ratio(posterior, 1 - posterior)


def action_tier(posterior: Column) -> Column:
    out = F.lit("monitor")
    for cut, name in reversed(POSTERIOR_TIERS):
        out = F.when(posterior > cut, name).otherwise(out)
    return out


def review_allocation(df: DataFrame, segment: str, label: str, posterior: Column, budget: int = 3000) -> DataFrame:
    """A review budget split over two segments (boolean): in proportion to size, and to posterior times size, with expected positives."""
    inside = F.col(segment)
    counts = df.withColumn("_p", posterior).agg(
        F.count_if(inside).alias("n_in"), F.count("*").alias("n"),
        F.avg(F.when(inside, F.col(label).cast("double"))).alias("rate_in"), F.avg(F.when(~inside, F.col(label).cast("double"))).alias("rate_out"),
        F.sum(F.when(inside, F.col("_p")).otherwise(0.0)).alias("w_in"), F.sum("_p").alias("w"),
    )
    split = lambda name, share: F.struct(F.lit(name).alias("strategy"), (F.lit(float(budget)) * share).cast("long").alias("n_signal"))
    both = F.array(split("flat", ratio(F.col("n_in"), F.col("n"))), split("posterior", ratio(F.col("w_in"), F.col("w"))))
    out = counts.select("rate_in", "rate_out", F.inline(both)).withColumn("n_rest", F.lit(budget) - F.col("n_signal"))
    return out.select("strategy", "n_signal", "n_rest", (F.col("n_signal") * F.coalesce("rate_in", F.lit(0.0)) + F.col("n_rest") * F.coalesce("rate_out", F.lit(0.0))).alias("expected_positives"))

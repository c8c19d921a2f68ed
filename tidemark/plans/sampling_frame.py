"""The weekly review sample: strata, budget, inclusion probability, hash selection, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import ratio, round_to_long

# fixed values
BUDGET_SHARES = {"high_risk": 0.60, "medium_risk": 0.30, "low_risk": 0.10}


def stratum_of(tier: Column) -> Column:
    return F.when(tier == "high", "high_risk").when(tier == "medium", "medium_risk").otherwise("low_risk")


def budget_of(stratum: Column, total: int) -> Column:
    """Null for a stratum without a share."""
    out = F.lit(None).cast("long")
    for name, share in BUDGET_SHARES.items():
        out = F.when(stratum == name, round_to_long(F.lit(total) * F.lit(share))).otherwise(out)
    return out


def unreviewed(items: DataFrame, week: str) -> DataFrame:
    """This week's items without a review, with their stratum."""
    return items.filter((F.col("week") == F.to_date(F.lit(week))) & F.col("reviewed_at").isNull()).withColumn("stratum", stratum_of(F.col("risk_tier")))


def stratum_table(items: DataFrame, week: str, total: int = 3000) -> DataFrame:
    """stratum, stratum_size, n_h, inclusion_prob: at most as many rows as there are strata."""
    counts = unreviewed(items, week).groupBy("stratum").agg(F.count("*").alias("stratum_size")).withColumn("n_h", budget_of(F.col("stratum"), total))
    share = ratio(F.col("n_h"), F.col("stratum_size"))
    return counts.withColumn("inclusion_prob", F.when(share.isNotNull(), F.least(share, F.lit(1.0))))


def sampling_frame(items: DataFrame, week: str, total: int = 3000) -> DataFrame:
    """The sampled items with Horvitz-Thompson weights.

    The three-row stratum table is broadcast. The literal bound beside ``rn <= n_h`` lets each task keep a stratum's first rows only before the shuffle.
    """
    strata = stratum_table(items, week, total)
    most = max(int(total * share + 0.5) for share in BUDGET_SHARES.values())
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.col("item_id"), F.lit(week)).cast("binary")), "item_id"))
    ranked = unreviewed(items, week).join(F.broadcast(strata), "stratum").withColumn("rn", place).filter((F.col("rn") <= most) & (F.col("rn") <= F.col("n_h")))
    return ranked.select(
        F.md5(F.concat("item_id", F.lit(f"{week}sample")).cast("binary")).alias("sample_id"),
        "item_id", "actor_id", "stratum", "classifier_score", "classifier_label", "inclusion_prob",
        F.round(F.try_divide(F.lit(1.0), F.col("inclusion_prob")), 4).alias("sample_weight"),
        F.to_date(F.lit(week)).alias("review_week"),
        F.lit(None).cast("string").alias("assigned_to"), F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("boolean").alias("true_harmful"), F.lit(None).cast("string").alias("harm_vertical"),
    )


def assignment_order(frame: DataFrame, seed: int = 0) -> DataFrame:
    """Random but repeatable order within each stratum."""
    return frame.orderBy("stratum", F.md5(F.concat("item_id", F.lit(f":{seed}")).cast("binary")), "item_id")


def frame_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("review_week", "stratum").agg(F.count("*").alias("n"))


def weight_range(frame: DataFrame) -> DataFrame:
    return frame.agg(F.min("sample_weight").alias("min_weight"), F.max("sample_weight").alias("max_weight"))

"""Weekly prevalence by vertical: weighted gold estimate, classifier-adjusted estimate, naive rate, four-week trend.

The gold table is aggregated once for rates and weighted sums together; the later joins meet aggregates only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import at_least, at_most, clamp, ratio

Z = 1.96  # fixed value of this report
KEYS = ["week", "harm_vertical"]


def gold_aggregates(gold: DataFrame) -> DataFrame:
    """Rates and weighted prevalence of reviewed items in one pass."""
    t, p, w = F.col("true_harmful"), F.col("predicted_harmful"), F.col("sample_weight")
    return gold.filter(F.col("reviewed_at").isNotNull()).groupBy(*KEYS).agg(
        ratio(F.count_if(p & t), F.count_if(t)).alias("tpr"),
        ratio(F.count_if(p & ~t), F.count_if(~t)).alias("fpr"),
        F.count_if(t).alias("n_positive_gold"),
        F.count("*").alias("n_reviewed"),
        F.sum(F.when(t, w).otherwise(0.0)).alias("ht_num"),
        F.sum(w).alias("ht_denom"),
        ratio(F.sum(F.when(t, w).otherwise(0.0)), F.sum(w)).alias("ht_prevalence"),
    )


def observed_rates(items: DataFrame) -> DataFrame:
    """Share of labelled items that score .5 or more."""
    labelled = items.filter(F.col("classifier_label").isNotNull())
    return labelled.groupBy("week", F.col("classifier_label").alias("harm_vertical")).agg(ratio(F.count_if(F.col("classifier_score") >= 0.5), F.count("*")).alias("observed_positive_rate"), F.count("*").alias("n_corpus"))


def ht_columns():
    p, n = F.col("ht_prevalence"), F.col("n_reviewed")
    half = Z * F.sqrt(ratio(p * (1 - p), n))
    return p - half, p + half


def adjusted(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Adjusted prevalence and the standard error from the observed rate alone."""
    q, d = F.col("observed_positive_rate"), F.col("tpr") - F.col("fpr")
    se = ratio(F.sqrt(ratio(q * (1 - q), F.col("n_corpus"))), F.abs(d))
    joined = observed.join(gold.select(*KEYS, "tpr", "fpr"), KEYS)
    return joined.select(*KEYS, q.alias("q_hat"), "tpr", "fpr", "n_corpus", ratio(q - F.col("fpr"), d).alias("adjusted_raw"), se.alias("adjusted_se"))


def prevalence_rollup(items: DataFrame, gold: DataFrame) -> DataFrame:
    """The whole report."""
    g = gold_aggregates(gold)
    a = adjusted(observed_rates(items), g)
    low, high = ht_columns()
    raw, se = F.col("adjusted_raw"), F.col("adjusted_se")
    combined = g.drop("tpr", "fpr").join(a, KEYS, "left").select(
        *KEYS,
        F.round("ht_prevalence", 6).alias("ht_prevalence"), F.round(low, 6).alias("ht_ci_lower"), F.round(high, 6).alias("ht_ci_upper"),
        F.round(clamp(raw), 6).alias("adjusted_prevalence"), F.round(at_least(raw - Z * se, 0.0), 6).alias("adj_ci_lower"), F.round(at_most(raw + Z * se, 1.0), 6).alias("adj_ci_upper"),
        F.round("q_hat", 6).alias("naive_observed_rate"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), "n_corpus", "n_reviewed",
    )
    return with_trend(combined)


def with_trend(combined: DataFrame) -> DataFrame:
    """Four-row means of the rounded estimates, per vertical in week order."""
    w = Window.partitionBy("harm_vertical").orderBy("week").rowsBetween(-3, 0)
    return combined.withColumn("ht_prevalence_4w_avg", F.round(F.avg("ht_prevalence").over(w), 6)).withColumn("adjusted_prevalence_4w_avg", F.round(F.avg("adjusted_prevalence").over(w), 6))

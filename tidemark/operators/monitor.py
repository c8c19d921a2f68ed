"""Trend monitors over weekly series: rolling and baseline z-scores, CUSUM, last four weeks against the four before.

Every function takes the order column and optional partition keys; nothing relies on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import ratio


def _over(by: list[str] | None, order: str):
    return Window.partitionBy(*(by or [])).orderBy(order)


def rolling_mean(x: Column, order: str, size: int = 4, least: int = 1, by: list[str] | None = None) -> Column:
    """Mean of the last ``size`` rows (gaps in time are not filled); null with fewer than ``least`` values."""
    w = _over(by, order).rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def rolling_zscore(df: DataFrame, x: str, order: str, size: int = 8, least: int = 3, alert: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """Score against the window that ends at, and includes, the row itself; no alert while the window is short."""
    w = _over(by, order).rowsBetween(-(size - 1), 0)
    enough = F.count(x).over(w) >= least
    mean, std = F.when(enough, F.avg(x).over(w)), F.when(enough, F.stddev_samp(x).over(w))
    z = (F.col(x) - mean) / F.when(std.isNotNull(), F.greatest(std, F.lit(1e-6)))
    return df.withColumn("rolling_mean", mean).withColumn("rolling_std", std).withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > alert, F.lit(False)))


def _baseline(df: DataFrame, x: str, order: str, n: int, by: list[str] | None) -> DataFrame:
    """Each row with its 1-based rank and the mean and population deviation of the first ``n`` rows."""
    ranked = df.withColumn("_r", F.row_number().over(_over(by, order)))
    whole, early = Window.partitionBy(*(by or [])), F.when(F.col("_r") <= n, F.col(x))
    return ranked.withColumn("baseline_mean", F.avg(early).over(whole)).withColumn("baseline_std", F.stddev_pop(early).over(whole))


def baseline_zscore(df: DataFrame, x: str, order: str, n: int = 8, by: list[str] | None = None) -> DataFrame:
    """Score against the first ``n`` rows; null where these do not vary."""
    return _baseline(df, x, order, n, by).withColumn("z", ratio(F.col(x) - F.col("baseline_mean"), F.col("baseline_std"))).drop("_r")


def cusum(df: DataFrame, x: str, order: str, k: float | None = None, h: float | None = None, n: int = 8, by: list[str] | None = None, lower: bool = False) -> DataFrame:
    """One-sided CUSUM from the second row on; ``k`` and ``h`` default to half and five baseline deviations.

    The recursion max(0, C + d) is the running sum of d less its running minimum (0 included), so two windows do it.
    """
    based = _baseline(df, x, order, n, by)
    kk = F.lit(k) if k is not None else 0.5 * F.col("baseline_std")
    hh = F.lit(h) if h is not None else 5 * F.col("baseline_std")
    gap = F.col(x) - F.col("baseline_mean")
    step = F.when(F.col("_r") == 1, F.lit(0.0)).otherwise((-gap if lower else gap) - kk)
    w = _over(by, order).rowsBetween(Window.unboundedPreceding, 0)
    summed = based.withColumn("_s", F.sum(step).over(w))
    return summed.withColumn("cusum", F.col("_s") - F.min("_s").over(w)).withColumn("alarm", F.round("cusum", 9) > F.round(hh, 9)).drop("_s", "_r", "baseline_mean", "baseline_std")


def last_against_prior(df: DataFrame, columns: list[str], order: str, size: int = 4, by: list[str] | None = None) -> DataFrame:
    """Means of the last ``size`` rows, of those before, and their difference, per column."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc(order)))).filter(F.col("_r") <= 2 * size)
    recent = lambda c: F.avg(F.when(F.col("_r") <= size, F.col(c)))
    prior = lambda c: F.avg(F.when(F.col("_r") > size, F.col(c)))
    return ranked.groupBy(*(by or [])).agg(*[e for c in columns for e in (recent(c).alias(f"{c}_recent"), prior(c).alias(f"{c}_prior"), (recent(c) - prior(c)).alias(f"{c}_delta"))])


def spike_alert(df: DataFrame, x: str, low: str, high: str, order: str, by: list[str] | None = None, alert: float = 2.5) -> DataFrame:
    """Change against the week before in units of that week's half-width; only rows beyond ``alert``."""
    w = _over(by, order)
    z = ratio(F.col(x) - F.lag(x).over(w), F.lag(F.col(high) - F.col(low)).over(w) / 2)
    return df.withColumn("z_score", z).filter(F.abs("z_score") > alert)


def flagged_weeks(df: DataFrame, flag: str, order: str) -> DataFrame:
    """First and last flagged position, and all of them in order."""
    return df.filter(F.col(flag)).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_sort(F.collect_list(order)).alias("all"))


def weekly_volumes(df: DataFrame, sampled: int = 2000, corpus: int = 100_000, enforced: float = 0.78) -> DataFrame:
    """Detections scaled from the sample (``n1``) to the corpus, and enforcement of them, truncated to whole items."""
    detections = (F.col("n1") / sampled * corpus).cast("long")
    out = df.withColumn("detections_week", detections).withColumn("enforcement_week", (F.col("detections_week") * F.lit(enforced)).cast("long"))
    return out.withColumn("enforcement_rate", F.col("enforcement_week") / F.greatest(F.col("detections_week"), F.lit(1)))


def executive_summary(df: DataFrame, x: str, order: str, size: int = 4) -> DataFrame:
    """Mean of the last ``size`` rows, change against those before, anomalies among the last and over all rows."""
    scored = rolling_zscore(df, x, order)
    ranked = scored.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order))))
    recent, prior = F.col("_r") <= size, (F.col("_r") > size) & (F.col("_r") <= 2 * size)
    mean = lambda where: F.avg(F.when(where, F.col(x)))
    return ranked.agg(mean(recent).alias("avg_recent"), (mean(recent) - mean(prior)).alias("delta"), F.count_if(recent & F.col("anomaly")).alias("anomalies_recent"), F.count_if("anomaly").alias("anomalies"), F.count("*").alias("n"))

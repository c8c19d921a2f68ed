"""Calibration: error of scores, reliability bins, Platt and isotonic fits, and what miscalibration does to prevalence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, ratio, z_value


def edges(n_bins: int) -> list[float]:
    """Bin edges as an evenly spaced double grid has them: k times the step, so some are a bit above the decimal value."""
    return [k * (1.0 / n_bins) for k in range(n_bins)] + [1.0]


def left_closed_bin(p: Column, n_bins: int = 10) -> Column:
    """0-based bin with [edge, next edge); null at 1.0 and outside."""
    return F.when((p >= 0) & (p < 1), F.size(F.filter(F.array(*map(F.lit, edges(n_bins)[1:])), lambda e: e <= p)))


def right_closed_bin(p: Column, n_bins: int = 10) -> Column:
    """0-based bin with (edge, next edge], 0 in the first."""
    return F.when((p >= 0) & (p <= 1), F.size(F.filter(F.array(*map(F.lit, edges(n_bins)[1:-1])), lambda e: e < p)))


def binned(df: DataFrame, n_bins: int = 10, by: list[str] | None = None, right_closed: bool = False, score: str = "score", label: str = "label") -> DataFrame:
    """Per used bin: count, mean score, share of positives. Bins and counts stay aligned when a bin is empty."""
    bucket = (right_closed_bin if right_closed else left_closed_bin)(F.col(score), n_bins)
    usable = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("bin", bucket)
    return usable.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, n_bins: int = 10, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """ECE; rows scored exactly 1.0 fall in no bin but count in the total."""
    bins = binned(df, n_bins, by, False, score, label)
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")).otherwise(0.0)
    return bins.groupBy(*(by or [])).agg(ratio(F.sum(gap), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def reliability(df: DataFrame, n_bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """The reliability diagram's points, with the count of each."""
    return binned(df, n_bins, None, True, score, label).filter(F.col("bin").isNotNull())


def maximum_calibration_error(df: DataFrame, n_bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    return reliability(df, n_bins, score, label).agg(F.max(F.abs(F.col("accuracy") - F.col("confidence"))).alias("mce"))


def propagated(ece: Column, prevalence: Column, tpr: Column, fpr: Column, n: Column, confidence: float = 0.95) -> Column:
    """Interval of the adjusted prevalence when both rates carry half the calibration error, and its width over that without."""
    z = z_value(confidence)
    d = F.when(F.abs(tpr - fpr) >= 1e-8, tpr - fpr)
    q, sigma = prevalence * d + fpr, ece / 2
    naive = q * (1 - q) / n / (d * d)
    both = F.pow((q - fpr) / (d * d) * sigma, F.lit(2.0)) + F.pow((tpr - q) / (d * d) * sigma, F.lit(2.0))
    half, plain = F.lit(z) * F.sqrt(naive + both), F.lit(z) * F.sqrt(naive)
    low, high = clamp(prevalence - half), clamp(prevalence + half)
    amplification = F.when(plain > 0, half / plain).when(plain == 0, F.lit(float("inf")))
    return F.struct(low.alias("ci_lower"), high.alias("ci_upper"), (2 * half).alias("full_width"), amplification.alias("amplification"))


class ClassifierCalibrator:
    """Platt and isotonic calibration fitted by Spark ML; transforms are column expressions or the fitted model."""

    def __init__(self, n_bins: int = 10):
        self.n_bins, self._platt, self._isotonic = n_bins, None, None

    @staticmethod
    def _logit(p: Column) -> Column:
        c = clamp(p, 1e-7, 1 - 1e-7)
        return F.log(c / (1 - c))

    def platt_scale(self, df: DataFrame, score: str = "score", label: str = "label", max_iter: int = 100) -> DataFrame:
        """Fit slope and intercept of the logit, and transform ``df``."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        points = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(self._logit(F.col(score)).alias("x"), F.col(label).cast("double").alias("y"))
        fitted = LogisticRegression(regParam=0.0, maxIter=max_iter, tol=1e-9, labelCol="y", featuresCol="f", standardization=False).fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(points))
        self._platt = (float(fitted.coefficients[0]), float(fitted.intercept))
        return self.platt_transform(df, score)

    def platt_transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        if self._platt is None:
            raise RuntimeError("platt_scale has not been called")
        slope, intercept = self._platt
        return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * self._logit(F.col(score)) + F.lit(intercept)))))

    def isotonic_regression(self, df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
        from pyspark.ml.regression import IsotonicRegression

        points = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
        fitted = IsotonicRegression(featuresCol="x", labelCol="y").fit(points)
        self._isotonic = fitted
        return self.isotonic_transform(df, score)

    def isotonic_transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        """Linear between the fitted boundaries, constant beyond them."""
        if self._isotonic is None:
            raise RuntimeError("isotonic_regression has not been called")
        model = self._isotonic.copy({self._isotonic.featuresCol: "_x", self._isotonic.predictionCol: "_fitted"})
        fitted = model.transform(df.withColumn("_x", F.coalesce(F.col(score).cast("double"), F.lit(0.0))))
        return fitted.withColumn("calibrated", F.when(F.col(score).isNotNull(), F.col("_fitted"))).drop("_x", "_fitted")

    def expected_calibration_error(self, df: DataFrame, score: str = "score", label: str = "label") -> float:
        return expected_calibration_error(df, self.n_bins, None, score, label).first()["ece"]

    def reliability_diagram(self, df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
        return reliability(df, self.n_bins, score, label)

    def propagate_calibration_error_to_prevalence(self, calibration_error: float, prevalence_estimate: float, tpr: float, fpr: float, n_sample: int, confidence_level: float = 0.95) -> dict[str, float]:
        d = tpr - fpr
        if abs(d) < 1e-8:
            raise ValueError("an uninformative classifier (tpr = fpr)")
        z, q, sigma = z_value(confidence_level), prevalence_estimate * d + fpr, calibration_error / 2
        naive = q * (1 - q) / n_sample / d**2
        both = ((q - fpr) / d**2 * sigma) ** 2 + ((tpr - q) / d**2 * sigma) ** 2
        half, plain = z * math.sqrt(naive + both), z * math.sqrt(naive)
        return {"ci_lower": max(0.0, prevalence_estimate - half), "ci_upper": min(1.0, prevalence_estimate + half), "full_width": 2 * half, "amplification": half / plain if plain else math.inf}


def sensitivity(grid: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``grid`` (ece, prevalence, tpr, fpr, n) with the propagated interval."""
    return grid.withColumn("_p", propagated(*(F.col(c) for c in ("ece", "prevalence", "tpr", "fpr", "n")), confidence)).select("*", "_p.*").drop("_p")


DEFAULT_ECES = (0.0, 0.02, 0.05, 0.10, 0.15, 0.20)

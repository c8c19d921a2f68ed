"""The estimators as SQL functions: plain expressions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "rogan_gladen": ("q DOUBLE, t DOUBLE, f DOUBLE", "try_divide(q - f, t - f)"),
    "chapman_n": ("n1 DOUBLE, n2 DOUBLE, m DOUBLE", "(n1 + 1) * (n2 + 1) / (m + 1) - 1"),
    "wilson_lower": ("k DOUBLE, n DOUBLE, z DOUBLE", "greatest(0D, (k + z * z / 2 - z * sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z))"),
    "wilson_upper": ("k DOUBLE, n DOUBLE, z DOUBLE", "least(1D, (k + z * z / 2 + z * sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z))"),
    "posterior": ("p DOUBLE, t DOUBLE, f DOUBLE", "coalesce(try_divide(p * t, p * t + (1 - p) * f), p)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create every function as a temporary SQL function of the session."""
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    return sorted(SQL_FUNCTIONS)

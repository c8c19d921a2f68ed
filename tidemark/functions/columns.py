"""Column helpers that pin down null, rounding and time semantics.

Everything here is a built-in expression; nothing needs a Python worker except
``norm_cdf``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def z_value(confidence: float = 0.95) -> float:
    """Two-sided standard normal quantile."""
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` within [low, high]; null stays null (bare greatest/least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), x))


def at_most(x: Column, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_to_long(x: Column) -> Column:
    """Cast to an integer by rounding half away from zero, not by truncation."""
    return F.round(x).cast("long")


def whole_units(unit: str, earlier: Column, later: Column) -> Column:
    """Whole elapsed units between two timestamps, truncated toward zero."""
    seconds = {"day": 86_400, "hour": 3_600}[unit]
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return (micros / F.lit(seconds * 1_000_000.0)).cast("long")


def monday(ts: Column) -> Column:
    """The Monday of a timestamp's week."""
    return F.to_date(F.date_trunc("week", ts.cast("timestamp")))


def hash_uniform(key: Column, salt: str = "") -> Column:
    """A uniform in [0, 1) that depends on the key and salt alone: the same in any partitioning and engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def safe_round(x: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def percent(x: Column, digits: int = 3) -> Column:
    """A share as text, in per cent."""
    return F.format_string(f"%.{digits}f%%", F.round(x * 100, digits))


def title(name: Column) -> Column:
    """``some_name`` as ``Some Name``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


@F.pandas_udf(DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function; neither engine has erf."""
    return x.map(lambda v: None if v is None or v != v else 0.5 * (1 + math.erf(v / math.sqrt(2))))

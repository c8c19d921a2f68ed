"""Weekly measurements over streams of the warehouse tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio


def monday_window(ts: str):
    """A seven-day tumbling window that starts on Mondays (day 0 of the epoch was a Thursday)."""
    return F.window(ts, "7 days", "7 days", "4 days")


def weekly_observed(items: DataFrame, late: str = "2 days") -> DataFrame:
    """Observed positive rate per Monday week and label, dropping events later than the watermark."""
    hit = F.col("classifier_score") >= 0.5
    counted = items.filter(F.col("classifier_label").isNotNull()).withWatermark("created_at", late).groupBy(monday_window("created_at").alias("w"), F.col("classifier_label").alias("harm_vertical")).agg(F.count("*").alias("n_corpus"), F.count_if(hit).alias("n_positive"))
    return counted.select(F.to_date("w.start").alias("week"), "harm_vertical", "n_corpus", "n_positive", ratio(F.col("n_positive"), F.col("n_corpus")).alias("observed_positive_rate"))


def weekly_ht(gold: DataFrame, late: str = "2 days") -> DataFrame:
    """Weighted prevalence of reviewed samples per Monday week and vertical."""
    weight = F.col("sample_weight")
    sums = gold.filter(F.col("reviewed_at").isNotNull()).withWatermark("reviewed_at", late).groupBy(monday_window("reviewed_at").alias("w"), "harm_vertical").agg(F.sum(F.when(F.col("true_harmful"), weight).otherwise(0.0)).alias("ht_num"), F.sum(weight).alias("ht_denom"), F.count("*").alias("n_reviewed"))
    return sums.select(F.to_date("w.start").alias("week"), "harm_vertical", "n_reviewed", ratio(F.col("ht_num"), F.col("ht_denom")).alias("ht_prevalence"))


def with_actor_tiers(items: DataFrame, actors: DataFrame) -> DataFrame:
    """Stream-static join: unknown actors keep a null tier."""
    return items.join(actors.select("actor_id", F.col("risk_tier").alias("actor_risk_tier")), "actor_id", "left")


def responses(items: DataFrame, actions: DataFrame, window_days: int = 7, late: str = "1 day") -> DataFrame:
    """Stream-stream interval join: actions within ``window_days`` of their item."""
    left = items.withWatermark("created_at", late).alias("i")
    right = actions.select(F.col("item_id").alias("a_item_id"), "action_id", "action_type", "actioned_at").withWatermark("actioned_at", late).alias("a")
    near = F.expr(f"a_item_id = item_id AND actioned_at >= created_at AND actioned_at < created_at + INTERVAL {window_days + 1} DAYS")
    return left.join(right, near, "leftOuter")


def cusum_stream(series: DataFrame, key: str, order: str, x: str, mean: float, k: float, h: float) -> DataFrame:
    """Upper CUSUM kept as state per key; rows of one micro-batch are taken in ``order``."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(order)
        levels = []
        for value in rows[x]:
            level = max(0.0, level + (value - mean) - k)
            levels.append(level)
        state.update((level,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "cusum": levels, "alarm": [v > h for v in levels]})

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    return series.select(key, order, x).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, cusum double, alarm boolean", "level double", "append", "NoTimeout")

"""Detections without enforcement: match within a response window, collapse to items, weekly gap metrics and trend flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import ratio, whole_units

SEGMENT = ["harm_vertical", "content_risk_tier", "actor_risk_tier"]
ITEM = ["item_id", "harm_vertical", "week", "content_risk_tier", "actor_risk_tier", "classifier_score", "composite_risk_score"]


def detections(items: DataFrame, actors: DataFrame, start: str, end: str, threshold: float = 0.5) -> DataFrame:
    """Labelled items above the threshold in the window, with their actor's tier (null where unknown)."""
    found = items.filter(F.col("week").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & (F.col("classifier_score") >= threshold) & F.col("classifier_label").isNotNull())
    who = actors.select("actor_id", F.col("risk_tier").alias("actor_risk_tier"), "composite_risk_score")
    return found.join(who, "actor_id", "left").select("item_id", "actor_id", "week", "created_at", F.col("risk_tier").alias("content_risk_tier"), F.col("classifier_label").alias("harm_vertical"), "classifier_score", "actor_risk_tier", "composite_risk_score")


def matched(found: DataFrame, actions: DataFrame, window_days: int = 7) -> DataFrame:
    """Every detection with each of its actions. The response window is judged after the join, so late actions keep their hours."""
    took = actions.select("item_id", "harm_vertical", "action_id", "action_type", "actioned_by", "actioned_at")
    acted = F.col("action_id").isNotNull()
    days, hours = (whole_units(u, F.col("created_at"), F.col("actioned_at")) for u in ("day", "hour"))
    joined = found.join(took, ["item_id", "harm_vertical"], "left")
    return joined.withColumn("was_enforced", F.coalesce(acted & (days <= window_days), F.lit(False))).withColumn("hours_to_action", F.when(acted, hours))


def deduplicated(rows: DataFrame) -> DataFrame:
    """One row an item: enforced at all, least hours, distinct action types and channels in order (null where none)."""
    listed = lambda c: F.array_join(F.when(F.count(c) > 0, F.array_sort(F.collect_set(c))), ",")
    return rows.groupBy(*ITEM).agg(F.max("was_enforced").alias("was_enforced"), F.min("hours_to_action").alias("min_hours_to_action"), listed("action_type").alias("action_types_taken"), listed("actioned_by").alias("enforced_by_channels"))


def gap_metrics(items: DataFrame) -> DataFrame:
    """Counts, rates and response-time quantiles per week and segment."""
    done, strong = F.col("was_enforced"), F.col("classifier_score") >= 0.80
    hours = F.when(done, F.col("min_hours_to_action"))
    quantiles = F.percentile_approx(hours, [0.5, 0.95], 10_000)
    out = items.groupBy("week", *SEGMENT).agg(
        F.count("*").alias("detection_count"), F.count_if(done).alias("enforced_count"), F.count_if(~done).alias("gap_count"),
        F.round(ratio(F.count_if(done), F.count("*")), 4).alias("enforcement_rate"), F.round(ratio(F.count_if(~done), F.count("*")), 4).alias("gap_rate"),
        quantiles.alias("_q"), F.count_if(~done & strong).alias("high_confidence_gap_count"),
        F.round(ratio(F.count_if(~done & strong), F.count_if(strong)), 4).alias("high_confidence_gap_rate"),
    )
    return out.withColumn("median_hours_to_action", F.col("_q")[0]).withColumn("p95_hours_to_action", F.col("_q")[1]).drop("_q")


def with_trend(metrics: DataFrame) -> DataFrame:
    """Four-row means per segment (null tiers are a segment) and a flag on ten points of change."""
    w = Window.partitionBy(*SEGMENT).orderBy("week").rowsBetween(-3, 0)
    out = metrics.withColumn("enforcement_rate_4w_avg", F.round(F.avg("enforcement_rate").over(w), 6)).withColumn("gap_rate_4w_avg", F.round(F.avg("gap_rate").over(w), 6))
    change = F.col("gap_rate") - F.col("gap_rate_4w_avg")
    return out.withColumn("trend_flag", F.when(F.round(change, 6) > 0.10, "REGRESSION").when(F.round(change, 6) < -0.10, "IMPROVEMENT").otherwise("STABLE"))


def enforcement_gap(items: DataFrame, actors: DataFrame, actions: DataFrame, start: str, end: str, threshold: float = 0.5, window_days: int = 7) -> DataFrame:
    """The whole report."""
    return with_trend(gap_metrics(deduplicated(matched(detections(items, actors, start, end, threshold), actions, window_days))))


def gap_summary(report: DataFrame, since: str) -> DataFrame:
    """Totals per vertical over the weeks from ``since`` on."""
    return report.filter(F.col("week") >= F.to_date(F.lit(since))).groupBy("harm_vertical").agg(F.sum("detection_count").alias("total_detected"), F.sum("gap_count").alias("total_gaps"), F.round(ratio(F.sum("gap_count"), F.sum("detection_count")), 4).alias("overall_gap_rate"), F.sum("high_confidence_gap_count").alias("high_conf_gaps"))

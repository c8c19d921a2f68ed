"""Warehouse schemas and enumerations."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType(), "array<string>": ArrayType(StringType())}


def schema(columns: str) -> StructType:
    """A schema from ``name type`` pairs; needs no session, unlike DDL parsing."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


CONTENT_ITEMS = schema(
    "item_id string, actor_id string, created_at timestamp, content_type string, risk_tier string, classifier_score double, classifier_label string, sample_weight double, reviewed_at timestamp, true_label string, week date"
)
ENFORCEMENT_ACTIONS = schema("action_id string, item_id string, actor_id string, action_type string, harm_vertical string, actioned_at timestamp, actioned_by string, week date")
ACTORS = schema(
    "actor_id string, account_age_days long, post_count_7d long, post_count_30d long, unique_content_ratio double, api_usage_fraction double, prior_enforcement_count long, risk_tier string, composite_risk_score double, post_count_total long, avg_content_length double, is_verified boolean"
)
GOLD_REVIEW_SAMPLES = schema(
    "sample_id string, item_id string, week date, stratum string, sample_weight double, true_harmful boolean, predicted_harmful boolean, harm_vertical string, reviewed_at timestamp, inclusion_prob double, actor_id string, classifier_score double, classifier_label string, queued_at timestamp, assigned_to string"
)
CLASSIFICATIONS = schema(
    "text string, harm_category string, label boolean, confidence double, key_signals array<string>, reasoning string, mode string, provider string, model string, input_tokens long, output_tokens long, cost_usd double, timestamp string, error string"
)
TABLES = {"content_items": CONTENT_ITEMS, "enforcement_actions": ENFORCEMENT_ACTIONS, "actors": ACTORS, "gold_review_samples": GOLD_REVIEW_SAMPLES}

# fixed values
RISK_TIERS = ("high", "medium", "low")
CONTENT_TYPES = ("post", "comment", "message", "media")
ACTION_TYPES = ("remove", "suspend", "restrict", "warn")
ACTIONED_BY = ("classifier", "human", "policy_rule")
HARM_VERTICALS = ("sexual_content_minors", "violent_extremism", "self_harm_suicide", "influence_operations", "platform_abuse")
TREND_FLAGS = ("REGRESSION", "IMPROVEMENT", "STABLE")

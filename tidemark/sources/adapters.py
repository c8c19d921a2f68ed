"""The synthetic star schema seen as a moderation warehouse.

The driver tables hold no harm data, so the warehouse columns are derived from
their columns and from hashes of their keys: deterministic, and the same in SQL
(``CTES`` says it in DuckDB's dialect for the oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import hash_uniform, monday


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item an order: score is the cubed price share, vertical the priority, a fifth is reviewed."""
    return items_of(read(spark, sf_dir, "orders"))


def streamed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the files of the order table."""
    schema = read(spark, sf_dir, "orders").schema
    return items_of(spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir))


def items_of(o: DataFrame) -> DataFrame:
    x = F.col("o_totalprice") / 500000
    score = x * x * x
    tier = F.when(score >= 0.5, "high").when(score >= 0.125, "medium").otherwise("low")
    reviewed = hash_uniform(F.col("o_orderkey"), "r") < 0.2
    return o.select(
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.col("o_custkey").cast("string").alias("actor_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        tier.alias("risk_tier"),
        score.alias("classifier_score"),
        F.col("o_orderpriority").alias("classifier_label"),
        F.when(reviewed, F.col("o_orderdate").cast("timestamp")).alias("reviewed_at"),
        monday(F.col("o_orderdate")).alias("week"),
    )


def gold_review_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash sample of the items, heavier in the high tiers, with weights 1 / inclusion probability and simulated truth."""
    c = content_items(spark, sf_dir)
    prob = F.when(F.col("risk_tier") == "high", 0.8).when(F.col("risk_tier") == "medium", 0.4).otherwise(0.2)
    score = F.col("classifier_score")
    return c.filter(hash_uniform(F.col("item_id"), "g") < prob).select(
        "item_id",
        "week",
        F.concat("risk_tier", F.lit("_risk")).alias("stratum"),
        (F.lit(1.0) / prob).alias("sample_weight"),
        (hash_uniform(F.col("item_id"), "t") < 0.6 * score * score).alias("true_harmful"),
        (score >= 0.5).alias("predicted_harmful"),
        F.col("classifier_label").alias("harm_vertical"),
        F.when(hash_uniform(F.col("item_id"), "v") < 0.95, F.col("created_at")).alias("reviewed_at"),
    )


def enforcement_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action a line item, up to several an item, under the item's vertical (one in eight under none)."""
    items = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    action = F.when(F.col("l_returnflag") == "A", "remove").when(F.col("l_returnflag") == "N", "restrict").otherwise("warn")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("action_id"),
        F.col("l_orderkey").cast("string").alias("item_id"),
        action.alias("action_type"),
        F.when(F.col("l_partkey") % 8 != 0, F.col("o_orderpriority")).alias("harm_vertical"),
        F.col("l_shipdate").cast("timestamp").alias("actioned_at"),
        F.when(F.col("l_linestatus") == "F", "human").otherwise("classifier").alias("actioned_by"),
        monday(F.col("l_shipdate")).alias("week"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One actor a user of ``events``: recent activity counts, variety, automation share and enforcement count."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("ts").alias("last"))
    recent = lambda days: F.col("ts") > F.col("last") - F.expr(f"INTERVAL {days} DAYS")
    kinds = F.concat_ws("|", "event_type", F.floor(F.col("value") / 10).cast("string"))
    return (
        e.crossJoin(F.broadcast(last))
        .groupBy("user_id")
        .agg(
            F.floor((F.unix_micros(F.max("last")) - F.unix_micros(F.min("ts"))) / 86_400_000_000.0).cast("long").alias("account_age_days"),
            F.count_if(recent(7)).alias("post_count_7d"),
            F.count_if(recent(30)).alias("post_count_30d"),
            F.count("*").alias("post_count_total"),
            (F.count_distinct(kinds).cast("double") / F.count("*")).alias("unique_content_ratio"),
            F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("api_usage_fraction"),
            F.count_if(F.col("event_type") == "error").alias("prior_enforcement_count"),
        )
        .withColumn("actor_id", F.col("user_id").cast("string"))
        .drop("user_id")
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense labelled series: five Monday weeks and five verticals, a score and a noisy truth for every event."""
    e = read(spark, sf_dir, "events")
    score = F.round(hash_uniform(F.col("event_id"), "s") * hash_uniform(F.col("event_id"), "s2"), 3)
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("actor_id"),
        F.col("event_type").alias("harm_vertical"),
        monday(F.col("ts")).alias("week"),
        score.alias("score"),
        (hash_uniform(F.col("event_id"), "y") < score * score).alias("label"),
        (score >= 0.5).alias("detected_a"),
        (hash_uniform(F.col("event_id"), "b") < F.when(hash_uniform(F.col("event_id"), "y") < score * score, 0.74).otherwise(0.04)).alias("detected_b"),
    )


def _u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(cast({key} AS VARCHAR) || '{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_MONDAY = "date_trunc('week', {})::DATE"

#: The same tables in DuckDB's SQL.
CTES = {
    "content_items": f"""content_items AS (
    SELECT o_orderkey::VARCHAR AS item_id, o_custkey::VARCHAR AS actor_id, o_orderdate AS created_at,
        CASE WHEN s >= 0.5 THEN 'high' WHEN s >= 0.125 THEN 'medium' ELSE 'low' END AS risk_tier,
        s AS classifier_score, o_orderpriority AS classifier_label,
        CASE WHEN {_u('o_orderkey', 'r')} < 0.2 THEN o_orderdate END AS reviewed_at, {_MONDAY.format('o_orderdate')} AS week
    FROM (SELECT *, (o_totalprice / 500000) * (o_totalprice / 500000) * (o_totalprice / 500000) AS s FROM orders))""",
    "gold": f"""gold AS (
    SELECT item_id, week, risk_tier || '_risk' AS stratum, 1.0::DOUBLE / p AS sample_weight,
        {_u('item_id', 't')} < 0.6::DOUBLE * classifier_score * classifier_score AS true_harmful, classifier_score >= 0.5 AS predicted_harmful,
        classifier_label AS harm_vertical, CASE WHEN {_u('item_id', 'v')} < 0.95 THEN created_at END AS reviewed_at
    FROM (SELECT *, CASE WHEN risk_tier = 'high' THEN 0.8::DOUBLE WHEN risk_tier = 'medium' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS p FROM content_items)
    WHERE {_u('item_id', 'g')} < p)""",
    "actions": f"""actions AS (
    SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS action_id, l_orderkey::VARCHAR AS item_id,
        CASE WHEN l_returnflag = 'A' THEN 'remove' WHEN l_returnflag = 'N' THEN 'restrict' ELSE 'warn' END AS action_type,
        CASE WHEN l_partkey % 8 <> 0 THEN o_orderpriority END AS harm_vertical, l_shipdate AS actioned_at,
        CASE WHEN l_linestatus = 'F' THEN 'human' ELSE 'classifier' END AS actioned_by, {_MONDAY.format('l_shipdate')} AS week
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "actors": """actors AS (
    SELECT user_id::VARCHAR AS actor_id, floor((epoch_us(max(last)) - epoch_us(min(ts))) / 86400000000.0)::BIGINT AS account_age_days,
        count(*) FILTER (WHERE ts > last - INTERVAL 7 DAYS) AS post_count_7d, count(*) FILTER (WHERE ts > last - INTERVAL 30 DAYS) AS post_count_30d,
        count(*) AS post_count_total, count(DISTINCT event_type || '|' || floor(value / 10)::BIGINT::VARCHAR)::DOUBLE / count(*) AS unique_content_ratio,
        avg(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS api_usage_fraction, count(*) FILTER (WHERE event_type = 'error') AS prior_enforcement_count
    FROM events CROSS JOIN (SELECT max(ts) AS last FROM events) GROUP BY user_id)""",
    "scored": f"""scored AS (
    SELECT *, y < score * score AS label, score >= 0.5 AS detected_a, b < CASE WHEN y < score * score THEN 0.74::DOUBLE ELSE 0.04::DOUBLE END AS detected_b
    FROM (SELECT event_id, user_id::VARCHAR AS actor_id, event_type AS harm_vertical, {_MONDAY.format('ts')} AS week,
        round({_u('event_id', 's')} * {_u('event_id', 's2')}, 3) AS score, {_u('event_id', 'y')} AS y, {_u('event_id', 'b')} AS b FROM events))""",
}


def with_ctes(sql: str, *names: str) -> str:
    """``sql`` below the named CTEs."""
    head, body = "WITH " + ",\n".join(CTES[n] for n in names), sql.lstrip()
    return f"{head}\n{body}"

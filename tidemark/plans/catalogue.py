"""Every operator as a query over the synthetic tables, each with the same question in SQL.

A query is registered with ``@query(name, sql)``; doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import hash_uniform, percent, ratio, safe_round, title, z_value
from tidemark.operators import actors as A
from tidemark.operators import bayes, calibration, classify, estimators, experiment, funnel, monitor, networks, sampling, simulate, thresholds
from tidemark.plans import enforcement_gap, rollup, sampling_frame
from tidemark.sources import adapters
from tidemark.sources.adapters import read, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WEEK = "1995-01-02"
START, END = "1995-01-02", "1995-12-25"
Z = repr(z_value())


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, without negative zeros."""
    return df.select(*[safe_round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


# ---- weekly prevalence report ------------------------------------------------------------------------------

GOLD_AGG = """g AS (
    SELECT week, harm_vertical,
        count(*) FILTER (WHERE predicted_harmful AND true_harmful)::DOUBLE / nullif(count(*) FILTER (WHERE true_harmful), 0) AS tpr,
        count(*) FILTER (WHERE predicted_harmful AND NOT true_harmful)::DOUBLE / nullif(count(*) FILTER (WHERE NOT true_harmful), 0) AS fpr,
        count(*) FILTER (WHERE true_harmful) AS n_positive_gold, count(*) AS n_reviewed,
        sum(CASE WHEN true_harmful THEN sample_weight ELSE 0.0 END) AS ht_num, sum(sample_weight) AS ht_denom,
        sum(CASE WHEN true_harmful THEN sample_weight ELSE 0.0 END) / nullif(sum(sample_weight), 0) AS p
    FROM gold WHERE reviewed_at IS NOT NULL GROUP BY ALL)"""
OBSERVED = """o AS (
    SELECT week, classifier_label AS harm_vertical, count(*) FILTER (WHERE classifier_score >= 0.5)::DOUBLE / nullif(count(*), 0) AS q, count(*) AS n_corpus
    FROM content_items WHERE classifier_label IS NOT NULL GROUP BY ALL)"""
ADJUSTED = """a AS (
    SELECT o.week, o.harm_vertical, q, tpr, fpr, n_corpus, (q - fpr) / nullif(tpr - fpr, 0) AS raw, sqrt(q * (1 - q) / n_corpus) / nullif(abs(tpr - fpr), 0) AS se
    FROM o JOIN g ON o.week = g.week AND o.harm_vertical = g.harm_vertical)"""
COMBINED = """c AS (
    SELECT g.week, g.harm_vertical, round(p, 6) AS ht_prevalence, round(p - 1.96 * sqrt(p * (1 - p) / n_reviewed), 6) AS ht_ci_lower, round(p + 1.96 * sqrt(p * (1 - p) / n_reviewed), 6) AS ht_ci_upper,
        CASE WHEN raw IS NOT NULL THEN round(greatest(0, least(1, raw)), 6) END AS adjusted_prevalence, CASE WHEN raw - 1.96 * se IS NOT NULL THEN round(greatest(0, raw - 1.96 * se), 6) END AS adj_ci_lower,
        CASE WHEN raw + 1.96 * se IS NOT NULL THEN round(least(1, raw + 1.96 * se), 6) END AS adj_ci_upper, round(q, 6) AS naive_observed_rate, round(a.tpr, 6) AS tpr, round(a.fpr, 6) AS fpr, n_corpus, n_reviewed
    FROM g LEFT JOIN a ON g.week = a.week AND g.harm_vertical = a.harm_vertical)"""


def _gold(spark, sf):
    return adapters.gold_review_samples(spark, sf)


def _items(spark, sf):
    return adapters.content_items(spark, sf)


@query("weekly_ht_prevalence", with_ctes(f", {GOLD_AGG} SELECT week, harm_vertical, n_reviewed, {_r('ht_num', 'ht_num')}, {_r('ht_denom', 'ht_denom')}, {_r('p', 'ht_prevalence')}, {_r('p - 1.96 * sqrt(p * (1 - p) / n_reviewed)', 'ht_ci_lower')}, {_r('p + 1.96 * sqrt(p * (1 - p) / n_reviewed)', 'ht_ci_upper')} FROM g", "content_items", "gold"))
def weekly_ht_prevalence(spark, sf):
    low, high = rollup.ht_columns()
    return rounded(rollup.gold_aggregates(_gold(spark, sf)).select("week", "harm_vertical", "n_reviewed", "ht_num", "ht_denom", "ht_prevalence", low.alias("ht_ci_lower"), high.alias("ht_ci_upper")))


@query("weekly_tpr_fpr", with_ctes(f", {GOLD_AGG} SELECT week, harm_vertical, {_r('tpr', 'tpr')}, {_r('fpr', 'fpr')}, n_positive_gold, n_reviewed FROM g", "content_items", "gold"))
def weekly_tpr_fpr(spark, sf):
    return rounded(rollup.gold_aggregates(_gold(spark, sf)).select("week", "harm_vertical", "tpr", "fpr", "n_positive_gold", "n_reviewed"))


@query("weekly_observed_rate", with_ctes(f", {OBSERVED} SELECT week, harm_vertical, {_r('q', 'observed_positive_rate')}, n_corpus FROM o", "content_items"))
def weekly_observed_rate(spark, sf):
    return rounded(rollup.observed_rates(_items(spark, sf)))


@query("weekly_adjusted", with_ctes(f", {GOLD_AGG}, {OBSERVED}, {ADJUSTED} SELECT week, harm_vertical, {_r('q', 'q_hat')}, {_r('tpr', 'tpr')}, {_r('fpr', 'fpr')}, n_corpus, {_r('raw', 'adjusted_raw')}, {_r('se', 'adjusted_se')} FROM a", "content_items", "gold"))
def weekly_adjusted(spark, sf):
    return rounded(rollup.adjusted(rollup.observed_rates(_items(spark, sf)), rollup.gold_aggregates(_gold(spark, sf))))


@query("prevalence_rollup", with_ctes(f", {GOLD_AGG}, {OBSERVED}, {ADJUSTED}, {COMBINED} SELECT *, round(avg(ht_prevalence) OVER w, 6) AS ht_prevalence_4w_avg, round(avg(adjusted_prevalence) OVER w, 6) AS adjusted_prevalence_4w_avg FROM c WINDOW w AS (PARTITION BY harm_vertical ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "content_items", "gold"))
def prevalence_rollup(spark, sf):
    return rounded(rollup.prevalence_rollup(_items(spark, sf), _gold(spark, sf)))


@query("rollup_4w_avg", with_ctes(f", {GOLD_AGG} SELECT week, harm_vertical, {_r('avg(round(p, 6)) OVER (PARTITION BY harm_vertical ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 'ht_prevalence_4w_avg')} FROM g", "content_items", "gold"))
def rollup_4w_avg(spark, sf):
    g = rollup.gold_aggregates(_gold(spark, sf)).withColumn("x", F.round("ht_prevalence", 6))
    return rounded(g.select("week", "harm_vertical", monitor.rolling_mean(F.col("x"), "week", 4, 1, ["harm_vertical"]).alias("ht_prevalence_4w_avg")))


@query("wow_spike_alert", with_ctes(f", {GOLD_AGG}, z AS (SELECT week, harm_vertical, p, (p - lag(p) OVER w) / nullif(lag(2 * 1.96 * sqrt(p * (1 - p) / n_reviewed)) OVER w / 2, 0) AS z FROM g WINDOW w AS (PARTITION BY harm_vertical ORDER BY week)) SELECT week, harm_vertical, {_r('p', 'ht_prevalence')}, {_r('z', 'z_score')} FROM z WHERE abs(z) > 2.5", "content_items", "gold"))
def wow_spike_alert(spark, sf):
    low, high = rollup.ht_columns()
    g = rollup.gold_aggregates(_gold(spark, sf)).withColumn("low", low).withColumn("high", high)
    return rounded(monitor.spike_alert(g, "ht_prevalence", "low", "high", "week", ["harm_vertical"]).select("week", "harm_vertical", "ht_prevalence", "z_score"))


# ---- sampling frame ----------------------------------------------------------------------------------------

STRATA = f"""u AS (SELECT *, CASE WHEN risk_tier = 'high' THEN 'high_risk' WHEN risk_tier = 'medium' THEN 'medium_risk' ELSE 'low_risk' END AS stratum FROM content_items WHERE week = DATE '{WEEK}' AND reviewed_at IS NULL),
st AS (SELECT *, least(n_h::DOUBLE / nullif(N_h_, 0), 1.0) AS inclusion_prob FROM (SELECT stratum, count(*) AS N_h_, CASE stratum WHEN 'high_risk' THEN 6 WHEN 'medium_risk' THEN 3 WHEN 'low_risk' THEN 1 END::BIGINT AS n_h FROM u GROUP BY stratum)),
fr AS (SELECT * FROM (SELECT u.*, N_h_, n_h, inclusion_prob, row_number() OVER (PARTITION BY stratum ORDER BY md5(item_id || '{WEEK}'), item_id) AS rn FROM u JOIN st USING (stratum)) WHERE rn <= n_h)"""
FRAME_COLUMNS = f"md5(item_id || '{WEEK}sample') AS sample_id, item_id, actor_id, stratum, classifier_score, classifier_label, inclusion_prob, round(1.0 / nullif(inclusion_prob, 0), 4) AS sample_weight, DATE '{WEEK}' AS review_week"


def _frame(spark, sf):
    return sampling_frame.sampling_frame(_items(spark, sf), WEEK, 10)


@query("sampling_frame", with_ctes(f", {STRATA} SELECT {FRAME_COLUMNS}, NULL::VARCHAR AS assigned_to, NULL::TIMESTAMP AS reviewed_at, NULL::BOOLEAN AS true_harmful, NULL::VARCHAR AS harm_vertical FROM fr", "content_items"))
def sampling_frame_query(spark, sf):
    return _frame(spark, sf).withColumn("reviewed_at", F.lit(None).cast("timestamp_ntz"))


@query("sampling_frame_counts", with_ctes(f", {STRATA} SELECT DATE '{WEEK}' AS review_week, stratum, count(*) AS n FROM fr GROUP BY stratum", "content_items"))
def sampling_frame_counts(spark, sf):
    return sampling_frame.frame_counts(_frame(spark, sf))


@query("sampling_weight_range", with_ctes(f", {STRATA} SELECT min(round(1.0 / inclusion_prob, 4)) AS min_weight, max(round(1.0 / inclusion_prob, 4)) AS max_weight FROM fr", "content_items"))
def sampling_weight_range(spark, sf):
    return sampling_frame.weight_range(_frame(spark, sf))


@query("stratum_budget", with_ctes(f", {STRATA} SELECT stratum, N_h_ AS n_population, n_h AS n_budget, {_r('inclusion_prob', 'inclusion_prob')} FROM st", "content_items"))
def stratum_budget(spark, sf):
    s = sampling_frame.stratum_table(_items(spark, sf), WEEK, 10)
    return rounded(s.select("stratum", F.col("stratum_size").alias("n_population"), F.col("n_h").alias("n_budget"), "inclusion_prob"))


# ---- enforcement gap ---------------------------------------------------------------------------------------

SCORED_ACTORS = """ar AS (
    SELECT *, CASE WHEN composite >= 0.60 THEN 'high' WHEN composite >= 0.35 THEN 'medium' ELSE 'low' END AS risk_tier FROM (
        SELECT *, greatest(0, least(1, 0.25 * velocity + 0.20 * newness + 0.25 * repetition + 0.15 * automation + 0.10 * enforcement)) AS composite FROM (
            SELECT *, greatest(0, least(1, 0.55 * greatest(0, least(1, post_count_7d / 7.0 / 30.0)) + 0.45 * greatest(0, least(1, (post_count_7d / 7.0 / greatest(post_count_30d / 30.0, 0.1) - 1) / 9)))) AS velocity,
                greatest(0, least(1, exp(-account_age_days / 30.0))) AS newness, 1 - greatest(0, least(1, unique_content_ratio)) AS repetition,
                greatest(0, least(1, api_usage_fraction)) AS automation, greatest(0, least(1, ln(1 + prior_enforcement_count) / ln(11))) AS enforcement FROM actors)))"""
DETECTED = f"""d AS (
    SELECT c.item_id, c.actor_id, c.week, c.created_at, c.risk_tier AS content_risk_tier, c.classifier_label AS harm_vertical, c.classifier_score, ar.risk_tier AS actor_risk_tier, round(ar.composite, 6) AS composite_risk_score
    FROM content_items c LEFT JOIN ar ON c.actor_id = ar.actor_id
    WHERE c.week BETWEEN DATE '{START}' AND DATE '{END}' AND c.classifier_score >= 0.5 AND c.classifier_label IS NOT NULL)"""
MATCHED = """m AS (
    SELECT d.*, action_id, action_type, actioned_by, coalesce(action_id IS NOT NULL AND ((epoch_us(actioned_at) - epoch_us(created_at)) / 86400000000.0)::DOUBLE < 8, FALSE) AS was_enforced,
        CASE WHEN action_id IS NOT NULL THEN trunc((epoch_us(actioned_at) - epoch_us(created_at)) / 3600000000.0)::BIGINT END AS hours_to_action
    FROM d LEFT JOIN actions e ON d.item_id = e.item_id AND e.harm_vertical = d.harm_vertical)"""
DEDUPED = """dd AS (
    SELECT item_id, harm_vertical, week, content_risk_tier, actor_risk_tier, classifier_score, composite_risk_score, bool_or(was_enforced) AS was_enforced, min(hours_to_action) AS min_hours_to_action,
        string_agg(DISTINCT action_type, ',' ORDER BY action_type) AS action_types_taken, string_agg(DISTINCT actioned_by, ',' ORDER BY actioned_by) AS enforced_by_channels FROM m GROUP BY ALL)"""
GAPS = """gm AS (
    SELECT week, harm_vertical, content_risk_tier, actor_risk_tier, count(*) AS detection_count, count(*) FILTER (WHERE was_enforced) AS enforced_count, count(*) FILTER (WHERE NOT was_enforced) AS gap_count,
        round(count(*) FILTER (WHERE was_enforced)::DOUBLE / count(*), 4) AS enforcement_rate, round(count(*) FILTER (WHERE NOT was_enforced)::DOUBLE / count(*), 4) AS gap_rate,
        quantile_disc(CASE WHEN was_enforced THEN min_hours_to_action END, 0.5) AS median_hours_to_action, quantile_disc(CASE WHEN was_enforced THEN min_hours_to_action END, 0.95) AS p95_hours_to_action,
        count(*) FILTER (WHERE NOT was_enforced AND classifier_score >= 0.8) AS high_confidence_gap_count,
        round(count(*) FILTER (WHERE NOT was_enforced AND classifier_score >= 0.8)::DOUBLE / nullif(count(*) FILTER (WHERE classifier_score >= 0.8), 0), 4) AS high_confidence_gap_rate FROM dd GROUP BY ALL)"""
TREND = """gt AS (
    SELECT *, CASE WHEN round(gap_rate - gap_rate_4w_avg, 6) > 0.10 THEN 'REGRESSION' WHEN round(gap_rate - gap_rate_4w_avg, 6) < -0.10 THEN 'IMPROVEMENT' ELSE 'STABLE' END AS trend_flag FROM (
        SELECT *, round(avg(enforcement_rate) OVER w, 6) AS enforcement_rate_4w_avg, round(avg(gap_rate) OVER w, 6) AS gap_rate_4w_avg FROM gm
        WINDOW w AS (PARTITION BY harm_vertical, content_risk_tier, actor_risk_tier ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)))"""
GAP_CTES = ("content_items", "actions", "actors")


def _actors(spark, sf):
    scored = A.ActorFeatureExtractor().compute_risk_scores(adapters.actors(spark, sf))
    return scored.withColumn("composite_risk_score", safe_round(F.col("composite_score")))


def _found(spark, sf):
    return enforcement_gap.detections(_items(spark, sf), _actors(spark, sf), START, END)


def _matched(spark, sf):
    return enforcement_gap.matched(_found(spark, sf), adapters.enforcement_actions(spark, sf))


def _report(spark, sf):
    return enforcement_gap.with_trend(enforcement_gap.gap_metrics(enforcement_gap.deduplicated(_matched(spark, sf))))


@query("detections", with_ctes(f", {SCORED_ACTORS}, {DETECTED} SELECT item_id, week, content_risk_tier, harm_vertical, {_r('classifier_score', 'classifier_score')}, actor_risk_tier, composite_risk_score FROM d", *GAP_CTES))
def detections(spark, sf):
    return rounded(_found(spark, sf).select("item_id", "week", "content_risk_tier", "harm_vertical", "classifier_score", "actor_risk_tier", "composite_risk_score"))


@query("enforcement_matched", with_ctes(f", {SCORED_ACTORS}, {DETECTED}, {MATCHED} SELECT item_id, harm_vertical, action_id, action_type, actioned_by, was_enforced, hours_to_action FROM m", *GAP_CTES))
def enforcement_matched(spark, sf):
    return _matched(spark, sf).select("item_id", "harm_vertical", "action_id", "action_type", "actioned_by", "was_enforced", "hours_to_action")


@query("enforcement_dedup", with_ctes(f", {SCORED_ACTORS}, {DETECTED}, {MATCHED}, {DEDUPED} SELECT item_id, harm_vertical, week, was_enforced, min_hours_to_action, action_types_taken, enforced_by_channels FROM dd", *GAP_CTES))
def enforcement_dedup(spark, sf):
    return enforcement_gap.deduplicated(_matched(spark, sf)).select("item_id", "harm_vertical", "week", "was_enforced", "min_hours_to_action", "action_types_taken", "enforced_by_channels")


@query("enforcement_gap", with_ctes(f", {SCORED_ACTORS}, {DETECTED}, {MATCHED}, {DEDUPED}, {GAPS}, {TREND} SELECT * FROM gt", *GAP_CTES))
def enforcement_gap_query(spark, sf):
    return _report(spark, sf)


@query("response_quantiles", with_ctes(f", {SCORED_ACTORS}, {DETECTED}, {MATCHED}, {DEDUPED} SELECT harm_vertical, quantile_disc(min_hours_to_action, 0.5) AS p50_hours, quantile_disc(min_hours_to_action, 0.95) AS p95_hours FROM dd WHERE was_enforced GROUP BY ALL", *GAP_CTES))
def response_quantiles(spark, sf):
    q = F.percentile_approx("min_hours_to_action", [0.5, 0.95], 10_000)
    return enforcement_gap.deduplicated(_matched(spark, sf)).filter("was_enforced").groupBy("harm_vertical").agg(q.alias("q")).select("harm_vertical", F.col("q")[0].alias("p50_hours"), F.col("q")[1].alias("p95_hours"))


@query("gap_rolling_trend", with_ctes(f", {SCORED_ACTORS}, {DETECTED}, {MATCHED}, {DEDUPED}, {GAPS}, {TREND} SELECT week, harm_vertical, content_risk_tier, actor_risk_tier, gap_rate, gap_rate_4w_avg, trend_flag FROM gt", *GAP_CTES))
def gap_rolling_trend(spark, sf):
    return _report(spark, sf).select("week", "harm_vertical", "content_risk_tier", "actor_risk_tier", "gap_rate", "gap_rate_4w_avg", "trend_flag")


@query("gap_summary", with_ctes(f", {SCORED_ACTORS}, {DETECTED}, {MATCHED}, {DEDUPED}, {GAPS} SELECT harm_vertical, sum(detection_count)::BIGINT AS total_detected, sum(gap_count)::BIGINT AS total_gaps, round(sum(gap_count)::DOUBLE / sum(detection_count), 4) AS overall_gap_rate, sum(high_confidence_gap_count)::BIGINT AS high_conf_gaps FROM gm WHERE week >= DATE '1995-11-27' GROUP BY ALL", *GAP_CTES))
def gap_summary(spark, sf):
    return enforcement_gap.gap_summary(_report(spark, sf), "1995-11-27")


# ---- estimators --------------------------------------------------------------------------------------------


def _scored(spark, sf):
    return adapters.scored_events(spark, sf)


COUNTS = "k AS (SELECT harm_vertical, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE label))::DOUBLE AS k, (count(*) FILTER (WHERE detected_a))::DOUBLE AS n1, (count(*) FILTER (WHERE detected_b))::DOUBLE AS n2, (count(*) FILTER (WHERE detected_a AND detected_b))::DOUBLE AS m FROM scored GROUP BY ALL)"
WILSON = f"SELECT harm_vertical, 'direct_proportion' AS method, k / n AS e, (k + {Z} * {Z} / 2 - {Z} * sqrt(k * (1 - k / n) + {Z} * {Z} / 4)) / (n + {Z} * {Z}) AS lo, (k + {Z} * {Z} / 2 + {Z} * sqrt(k * (1 - k / n) + {Z} * {Z} / 4)) / (n + {Z} * {Z}) AS hi FROM k"
GLADEN = f"SELECT harm_vertical, 'classifier_adjusted' AS method, (q - f) / (t - f) AS e, (q - f) / (t - f) - {Z} * sqrt(v) AS lo, (q - f) / (t - f) + {Z} * sqrt(v) AS hi FROM (SELECT *, q * (1 - q) / n / ((t - f) * (t - f)) + pow((q - f) / ((t - f) * (t - f)), 2) * 0.0004 + pow((t - q) / ((t - f) * (t - f)), 2) * 0.0001 AS v FROM (SELECT *, n1 / n AS q, 0.6::DOUBLE AS t, 0.1::DOUBLE AS f FROM k))"
CHAPMAN = f"SELECT harm_vertical, 'chapman_capture_recapture' AS method, t / n AS e, t * exp(-{Z} * s) / n AS lo, t * exp({Z} * s) / n AS hi FROM (SELECT *, (n1 + 1) * (n2 + 1) / (m + 1) - 1 AS t, sqrt(greatest((n1 - m) * (n2 - m), 0) / ((n1 + 1) * (n2 + 1) * (m + 1))) AS s FROM k)"
CLIPPED = f"{_r('e', 'estimate')}, {_r('greatest(0, lo)', 'ci_lower')}, {_r('least(1, hi)', 'ci_upper')}"


def _grouped(spark, sf):
    return _scored(spark, sf).groupBy("harm_vertical").agg(F.count("*").alias("n"), F.count_if("label").alias("k"), F.count_if("detected_a").alias("n1"), F.count_if("detected_b").alias("n2"), F.count_if(F.col("detected_a") & F.col("detected_b")).alias("m"))


def _estimate(df, column, *keys):
    return rounded(df.select(*keys, column.alias("e")).select(*keys, "e.method", "e.estimate", "e.ci_lower", "e.ci_upper"))


@query("wilson_by_group", with_ctes(f", {COUNTS} SELECT harm_vertical, method, {CLIPPED} FROM ({WILSON})", "scored"))
def wilson_by_group(spark, sf):
    return _estimate(_grouped(spark, sf), estimators.wilson(F.col("k"), F.col("n")), "harm_vertical")


@query("rogan_gladen_by_group", with_ctes(f", {COUNTS} SELECT harm_vertical, method, {CLIPPED} FROM ({GLADEN})", "scored"))
def rogan_gladen_by_group(spark, sf):
    return _estimate(_grouped(spark, sf), estimators.rogan_gladen(F.col("n1") / F.col("n"), F.lit(0.6), F.lit(0.1), F.col("n"), F.lit(0.02), F.lit(0.01)), "harm_vertical")


@query("chapman_by_week", with_ctes(f", {COUNTS.replace('harm_vertical', 'week')} SELECT week, method, {CLIPPED} FROM ({CHAPMAN.replace('harm_vertical', 'week')})", "scored"))
def chapman_by_week(spark, sf):
    df = _scored(spark, sf).groupBy("week").agg(F.count("*").alias("n"), F.count_if("detected_a").alias("n1"), F.count_if("detected_b").alias("n2"), F.count_if(F.col("detected_a") & F.col("detected_b")).alias("m"))
    return _estimate(df, estimators.chapman(F.col("n1"), F.col("n2"), F.col("m"), F.col("n")), "week")


@query("compare_all_long", with_ctes(f", {COUNTS} SELECT harm_vertical, method, {CLIPPED} FROM ({WILSON} UNION ALL {GLADEN} UNION ALL {CHAPMAN})", "scored"))
def compare_all_long(spark, sf):
    return estimators.compare_all(_scored(spark, sf), ["harm_vertical"], F.col("label"), F.col("detected_a"), F.col("detected_b"), 0.6, 0.1, 0.02, 0.01)


@query("naive_bias", with_ctes(f", {COUNTS} SELECT harm_vertical, {_r('n1 / n', 'naive_rate')}, {_r('n1 / n - k / n', 'error')}, {_r('(n1 / n - k / n) / nullif(k / n, 0)', 'relative_error')} FROM k", "scored"))
def naive_bias(spark, sf):
    g = _grouped(spark, sf)
    return rounded(g.select("harm_vertical", estimators.naive_rate(ratio(F.col("n1"), F.col("n")), ratio(F.col("k"), F.col("n"))).alias("e")).select("harm_vertical", "e.*"))


def _grid(spark, name, values):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def _values(name, values):
    return f"(SELECT unnest([{', '.join(f'{float(v)!r}::DOUBLE' for v in values)}]) AS {name})"


PIS = (0.001, 0.004, 0.01, 0.05, 0.1)
TS, FS = (0.6, 0.7, 0.8, 0.9), (0.01, 0.05, 0.1, 0.58)


@query("ppv_curve", f"SELECT prevalence, tpr, fpr, {_r('tpr * prevalence / nullif(tpr * prevalence + fpr * (1 - prevalence), 0)', 'ppv')}, {_r('(tpr * prevalence + fpr * (1 - prevalence)) / prevalence', 'naive_bias')} FROM {_values('prevalence', PIS)}, {_values('tpr', TS)}, {_values('fpr', FS)}")
def ppv_curve(spark, sf):
    grid = _grid(spark, "prevalence", PIS).crossJoin(_grid(spark, "tpr", TS)).crossJoin(_grid(spark, "fpr", FS))
    p, t, f = F.col("prevalence"), F.col("tpr"), F.col("fpr")
    return rounded(grid.select("*", estimators.ppv(p, t, f).alias("ppv"), estimators.naive_bias(p, t, f).alias("naive_bias")))


@query("tpr_fpr_surface", f"SELECT tpr, fpr, CASE WHEN abs(tpr - fpr) >= 0.05 THEN round(greatest(0, least(0.2, (0.07 - fpr) / (tpr - fpr))), 6) + 0.0 END AS adjusted FROM {_values('tpr', TS)}, {_values('fpr', FS)}")
def tpr_fpr_surface(spark, sf):
    return rounded(estimators.sensitivity_surface(0.07, _grid(spark, "tpr", TS), _grid(spark, "fpr", FS)))


NS = (500, 2000, 10_000)


@query("ci_width_curve", f"SELECT prevalence, n, {_r(f'(CASE WHEN 1 < hi THEN 1 ELSE hi END) - (CASE WHEN 0 > lo THEN 0 ELSE lo END)', 'direct_width')}, {_r('least(1, e + h) - greatest(0, e - h)', 'adjusted_width')} FROM (SELECT *, (p * n + {Z} * {Z} / 2 - {Z} * sqrt(n * p * (1 - p) + {Z} * {Z} / 4)) / (n + {Z} * {Z}) AS lo, (p * n + {Z} * {Z} / 2 + {Z} * sqrt(n * p * (1 - p) + {Z} * {Z} / 4)) / (n + {Z} * {Z}) AS hi, p AS e, {Z} * sqrt((p * 0.75 + 0.05) * (1 - (p * 0.75 + 0.05)) / n) / 0.75 AS h FROM (SELECT prevalence, n, prevalence AS p FROM {_values('prevalence', PIS)}, {_values('n', NS)}))")
def ci_width_curve(spark, sf):
    grid = _grid(spark, "prevalence", PIS).crossJoin(_grid(spark, "n", NS))
    p, n = F.col("prevalence"), F.col("n")
    return rounded(grid.select("prevalence", "n", estimators.wilson(p * n, n)["ci_width"].alias("direct_width"), estimators.rogan_gladen(p * 0.75 + 0.05, F.lit(0.8), F.lit(0.05), n)["ci_width"].alias("adjusted_width")))


@query("sql_functions", with_ctes(f", {COUNTS} SELECT harm_vertical, {_r('(n1 / n - 0.1) / 0.5', 'rogan_gladen')}, {_r('(n1 + 1) * (n2 + 1) / (m + 1) - 1', 'chapman_n')} FROM k", "scored"))
def sql_functions(spark, sf):
    from tidemark.functions.registry import register

    register(spark)
    g = _grouped(spark, sf)
    return rounded(g.select("harm_vertical", F.expr("rogan_gladen(n1 / n, 0.6D, 0.1D)").alias("rogan_gladen"), F.expr("chapman_n(n1, n2, m)").alias("chapman_n")))


# ---- thresholds and calibration ----------------------------------------------------------------------------

RATES = ", ".join(
    _r(f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)", name)
    for name, a, b in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("fpr", "fp", "fp + tn"), ("fnr", "fn", "fn + tp"), ("specificity", "tn", "tn + fp"), ("f1", "2 * tp", "2 * tp + fp + fn"))
)
MARKS = [k / 20 for k in range(21)]
SWEPT = f"sw AS (SELECT threshold, (count(*) FILTER (WHERE score >= threshold AND label)) AS tp, (count(*) FILTER (WHERE score >= threshold AND NOT label)) AS fp, (count(*) FILTER (WHERE score < threshold AND NOT label)) AS tn, (count(*) FILTER (WHERE score < threshold AND label)) AS fn FROM scored, {_values('threshold', MARKS)} GROUP BY threshold)"


def _sweep(spark, sf):
    return thresholds.sweep(_scored(spark, sf), _grid(spark, "threshold", MARKS))


@query("confusion_at_threshold", with_ctes(f"SELECT harm_vertical, tp, fp, tn, fn, {RATES} FROM (SELECT harm_vertical, count(*) FILTER (WHERE score >= 0.5 AND label) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT label) AS fp, count(*) FILTER (WHERE score < 0.5 AND NOT label) AS tn, count(*) FILTER (WHERE score < 0.5 AND label) AS fn FROM scored GROUP BY ALL)", "scored"))
def confusion_at_threshold(spark, sf):
    return rounded(thresholds.metrics_at(_scored(spark, sf), 0.5, ["harm_vertical"]))


@query("threshold_sweep", with_ctes(f", {SWEPT} SELECT threshold, tp, fp, tn, fn, {RATES} FROM sw", "scored"))
def threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf))


@query("best_f1_threshold", with_ctes(f", {SWEPT} SELECT threshold, tp, fp, tn, fn, {RATES} FROM sw ORDER BY coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) DESC, threshold LIMIT 1", "scored"))
def best_f1_threshold(spark, sf):
    return rounded(thresholds.best_by_f1(_sweep(spark, sf)))


@query("cost_optimal_threshold", with_ctes(f", {SWEPT} SELECT threshold, {_r('fn * 1.0::DOUBLE + fp * 0.1::DOUBLE', 'cost')} FROM sw ORDER BY fn * 1.0::DOUBLE + fp * 0.1::DOUBLE, threshold LIMIT 1", "scored"))
def cost_optimal_threshold(spark, sf):
    return rounded(thresholds.cost_optimal(_sweep(spark, sf)))


@query("nearest_threshold", with_ctes(f", {SWEPT} SELECT threshold, tp, fp FROM sw ORDER BY abs(threshold - 0.33), threshold LIMIT 1", "scored"))
def nearest_threshold(spark, sf):
    return thresholds.nearest_threshold(_sweep(spark, sf), 0.33).select("threshold", "tp", "fp")


CURVE = "cu AS (SELECT s AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (SELECT score AS s, count(*) FILTER (WHERE label) AS pos, count(*) FILTER (WHERE NOT label) AS neg FROM scored GROUP BY ALL) WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


@query("roc_points", with_ctes(f", {CURVE} SELECT threshold, {_r('tp::DOUBLE / np', 'tpr')}, {_r('fp::DOUBLE / nn', 'fpr')}, {_r('tp::DOUBLE / (tp + fp)', 'precision')} FROM cu", "scored"))
def roc_points(spark, sf):
    return rounded(thresholds.curve(_scored(spark, sf)).select("threshold", "tpr", "fpr", "precision"))


@query("roc_auc", with_ctes(f", {CURVE} SELECT {_r('sum(neg * (tp - pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)', 'roc_auc')} FROM cu", "scored"))
def roc_auc(spark, sf):
    return rounded(thresholds.roc_auc(_scored(spark, sf)))


@query("average_precision", with_ctes(f", {CURVE} SELECT {_r('sum(pos * tp::DOUBLE / (tp + fp)) / nullif(sum(pos), 0)', 'average_precision')} FROM cu", "scored"))
def average_precision(spark, sf):
    return rounded(thresholds.average_precision(_scored(spark, sf)))


EDGES = ", ".join(f"{e!r}::DOUBLE" for e in calibration.edges(10))
LEFT_BIN = f"(CASE WHEN score >= 0 AND score < 1 THEN len(list_filter([{EDGES}], lambda e: e <= score)) - 1 END)"
RIGHT_BIN = f"len(list_filter([{', '.join(f'{e!r}::DOUBLE' for e in calibration.edges(10)[1:-1])}], lambda e: e < score))"


@query("ece", with_ctes(f"SELECT harm_vertical, {_r('sum(CASE WHEN bin IS NULL THEN 0 ELSE abs(acc - conf) * n END) / sum(n)', 'ece')}, sum(n)::BIGINT AS n FROM (SELECT harm_vertical, {LEFT_BIN} AS bin, count(*) AS n, avg(score) AS conf, avg(label::INT) AS acc FROM scored GROUP BY ALL) GROUP BY ALL", "scored"))
def ece(spark, sf):
    return rounded(calibration.expected_calibration_error(_scored(spark, sf), 10, ["harm_vertical"]))


@query("reliability_bins", with_ctes(f"SELECT {RIGHT_BIN}::INT AS bin, count(*) AS n, {_r('avg(score)', 'confidence')}, {_r('avg(label::INT)', 'accuracy')} FROM scored GROUP BY ALL", "scored"))
def reliability_bins(spark, sf):
    return rounded(calibration.reliability(_scored(spark, sf)))


@query("max_calibration_error", with_ctes(f"SELECT {_r('max(abs(a - c))', 'mce')} FROM (SELECT avg(score) AS c, avg(label::INT) AS a FROM scored GROUP BY {RIGHT_BIN})", "scored"))
def max_calibration_error(spark, sf):
    return rounded(calibration.maximum_calibration_error(_scored(spark, sf)))


PROPAGATED = f"SELECT ece, prevalence, 2 * h AS full_width, h / h0 AS amplification, greatest(0, least(1, prevalence - h)) AS ci_lower, greatest(0, least(1, prevalence + h)) AS ci_upper FROM (SELECT *, {Z} * sqrt(v0) AS h0, {Z} * sqrt(v0 + pow((q - 0.06) / (0.76 * 0.76) * ece / 2, 2) + pow((0.82 - q) / (0.76 * 0.76) * ece / 2, 2)) AS h FROM (SELECT *, q * (1 - q) / 5000 / (0.76 * 0.76) AS v0 FROM (SELECT *, prevalence * 0.76 + 0.06 AS q FROM {_values('ece', calibration.DEFAULT_ECES)}, {_values('prevalence', PIS)})))"


def _sensitivity(spark):
    grid = _grid(spark, "ece", calibration.DEFAULT_ECES).crossJoin(_grid(spark, "prevalence", PIS))
    return calibration.sensitivity(grid.select("*", F.lit(0.82).alias("tpr"), F.lit(0.06).alias("fpr"), F.lit(5000.0).alias("n")))


@query("calibration_sensitivity", f"SELECT ece, prevalence, {_r('full_width', 'full_width')}, {_r('amplification', 'amplification')}, {_r('ci_lower', 'ci_lower')}, {_r('ci_upper', 'ci_upper')} FROM ({PROPAGATED})")
def calibration_sensitivity(spark, sf):
    return rounded(_sensitivity(spark).select("ece", "prevalence", "full_width", "amplification", "ci_lower", "ci_upper"))


@query("amplification_pivot", f"SELECT ece, {', '.join(_r(f'avg(amplification) FILTER (WHERE prevalence = {p!r}::DOUBLE)', f'p_{str(p)[2:]}') for p in PIS)} FROM ({PROPAGATED}) GROUP BY ece")
def amplification_pivot(spark, sf):
    wide = _sensitivity(spark).groupBy("ece").pivot("prevalence", list(PIS)).agg(F.avg("amplification"))
    return rounded(wide.select("ece", *[F.col(f"`{p}`").alias(f"p_{str(p)[2:]}") for p in PIS]))


@query("platt_scores")
def platt_scores(spark, sf):
    scored = calibration.ClassifierCalibrator().platt_scale(_scored(spark, sf).select("event_id", "score", "label"))
    return rounded(scored.select("event_id", "calibrated"), 4)


@query("isotonic_scores")
def isotonic_scores(spark, sf):
    scored = calibration.ClassifierCalibrator().isotonic_regression(_scored(spark, sf).select("event_id", "score", "label"))
    return rounded(scored.select("event_id", "calibrated"), 4)


@query("score_histogram", with_ctes(f", b AS (SELECT label, least(floor(score / 0.05)::INT, 19) AS bin, count(*) AS n FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY ALL) SELECT label, bin, n, {_r('n / (sum(n) OVER (PARTITION BY label)) / 0.05', 'density')} FROM b", "scored"))
def score_histogram(spark, sf):
    return rounded(funnel.histogram(_scored(spark, sf), "score", 0.0, 1.0, 20, ["label"]))


# ---- sampling design ---------------------------------------------------------------------------------------

VERTICALS = (("a", 0.004), ("b", 0.011), ("c", 0.021), ("d", 0.065))
VERTICAL_SQL = "(SELECT unnest(['a', 'b', 'c', 'd']) AS harm_vertical, unnest([0.004::DOUBLE, 0.011::DOUBLE, 0.021::DOUBLE, 0.065::DOUBLE]) AS true_prevalence)"
ES = (0.003, 0.005, 0.01)


def _verticals(spark):
    return spark.createDataFrame(VERTICALS, "harm_vertical string, true_prevalence double")


@query("srs_size_grid", f"SELECT harm_vertical, e, ceil({Z} * {Z} * true_prevalence * (1 - true_prevalence) / (e * e))::BIGINT AS n FROM {VERTICAL_SQL}, {_values('e', ES)}")
def srs_size_grid(spark, sf):
    return _verticals(spark).crossJoin(_grid(spark, "e", ES)).select("harm_vertical", "e", sampling.srs_size(F.col("true_prevalence"), F.col("e")).alias("n"))


@query("sampling_difficulty", f"SELECT harm_vertical, true_prevalence, n1 AS n_for_ci_abs, n2 AS n_for_min_positives, greatest(n1, n2) AS n_operational_required, {_r('n1 * true_prevalence', 'expected_positives_at_ci_n')}, {_r('greatest(n1, n2) * true_prevalence', 'expected_positives_at_operational_n')}, greatest(n1, n2) <= 10000 AS within_budget, n1 * true_prevalence >= 100 AS enough_positives_at_ci_n, {_r('greatest(n1, n2) * 0.001::DOUBLE', 'labeling_cost_usd')} FROM (SELECT *, ceil({Z} * {Z} * true_prevalence * (1 - true_prevalence) / (0.01::DOUBLE * 0.01::DOUBLE))::BIGINT AS n1, ceil(100.0::DOUBLE / true_prevalence)::BIGINT AS n2 FROM {VERTICAL_SQL})")
def sampling_difficulty(spark, sf):
    return rounded(sampling.difficulty(_verticals(spark)))


DESIGNS = ((1, 1_000_000, 0.01, 0.005), (2, 1_000_000, 0.05, 0.01), (3, 500_000, 0.02, 0.005), (4, 10_000_000, 0.0001, 0.0001))
DESIGN_ROWS = ", ".join(f"({i}, {n}::BIGINT, {p!r}::DOUBLE, {e!r}::DOUBLE)" for i, n, p, e in DESIGNS)
STRATUM_ROWS = f"""s AS (
    SELECT *, sum(N) OVER (PARTITION BY design_id)::DOUBLE AS Nt, sum(CASE WHEN rk > 0 THEN N ELSE 0 END) OVER (PARTITION BY design_id)::DOUBLE AS Nr FROM (
        SELECT *, trunc(corpus_size * weight)::BIGINT AS N FROM (VALUES {DESIGN_ROWS}) d(design_id, corpus_size, prevalence, target), (VALUES ('high_risk', 0, 0.1::DOUBLE), ('low_risk', 1, 0.9::DOUBLE)) t(stratum, rk, weight))),
ph AS (SELECT *, CASE WHEN rk = 0 THEN least(0.999, 0.8::DOUBLE * (corpus_size * prevalence) / N) ELSE greatest(1e-6, least(0.999, (corpus_size * prevalence - 0.8::DOUBLE * (corpus_size * prevalence)) / Nr)) END AS p FROM s),
al AS (SELECT *, sum(N * p) OVER w / Nt AS pool, sqrt(p * (1 - p)) AS sg, sum(N * sqrt(p * (1 - p))) OVER w AS spread, sum(N * p * (1 - p)) OVER w AS sq FROM ph WINDOW w AS (PARTITION BY design_id)),
pr AS (SELECT *, greatest(1, round_even(greatest(ceil({Z} * {Z} * pool * (1 - pool) / (target * target)), 100) * N / Nt, 0)::BIGINT) AS n_prop, greatest(1, round_even(greatest(ceil(spread * spread / (pow(Nt * target / {Z}, 2) + sq)), 100) * N * sg / spread, 0)::BIGINT) AS n_ney FROM al),
rs AS (SELECT *, CASE WHEN rk = 0 THEN greatest(1, round_even(0.6::DOUBLE * B, 0)::BIGINT) ELSE greatest(1, round_even((B - greatest(1, round_even(0.6::DOUBLE * B, 0)::BIGINT)) * (N / Nr), 0)::BIGINT) END AS n_risk FROM (SELECT *, (sum(n_ney) OVER (PARTITION BY design_id))::BIGINT AS B FROM pr))"""


def _designs(spark):
    return spark.createDataFrame(DESIGNS, "design_id int, corpus_size long, prevalence double, target double")


def _allocation(strategy):
    def run(spark, sf):
        out = sampling.allocate(_designs(spark), sampling.strata_table(spark), strategy)
        return rounded(out.select("design_id", "stratum", F.col("stratum_size").alias("n_population"), "p_h", F.col("n_h").alias("n_sample")))

    return run


for _name, _strategy, _column in (("allocation_proportional", "proportional", "n_prop"), ("allocation_neyman", "neyman", "n_ney"), ("allocation_risk", "risk_stratified", "n_risk")):
    query(_name, f"WITH {STRATUM_ROWS} SELECT design_id, stratum, N AS n_population, {_r('p', 'p_h')}, {_column} AS n_sample FROM rs")(_allocation(_strategy))


def _summary_sql(strategy: str, n: str) -> str:
    v = f"sum((N / corpus_size) * (N / corpus_size) * p * (1 - p) / {n} * (1 - {n} / N::DOUBLE))"
    return f"SELECT '{strategy}' AS strategy, design_id, sum({n})::BIGINT AS n_total, CASE WHEN {v} >= 0 THEN round({Z} * sqrt(greatest({v}, 0)), 6) + 0.0 END AS half_width, {_r(f'{v} / (prevalence * (1 - prevalence) / sum({n}))', 'deff')}, {_r(f'sum({n} * 0.001::DOUBLE)', 'total_cost')}, {_r(f'sum({n}) * prevalence', 'expected_positives')}, sum({n}) * prevalence < 5 AS few_positives, prevalence < 0.001 AS very_rare FROM rs GROUP BY design_id, prevalence"


@query("strategy_comparison", f"WITH {STRATUM_ROWS} {' UNION ALL '.join(_summary_sql(s, n) for s, n in (('proportional', 'n_prop'), ('neyman', 'n_ney'), ('risk_stratified', 'n_risk')))}")
def strategy_comparison(spark, sf):
    out = None
    for strategy in sampling.STRATEGIES:
        one = sampling.design_summary(sampling.allocate(_designs(spark), sampling.strata_table(spark), strategy)).select(F.lit(strategy).alias("strategy"), "design_id", "n_total", "half_width", "deff", "total_cost", "expected_positives", "few_positives", "very_rare")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("srs_sample", "SELECT event_id FROM events ORDER BY md5(event_id::VARCHAR || 'srs'), event_id LIMIT 500")
def srs_sample(spark, sf):
    return sampling.srs(read(spark, sf, "events").select("event_id"), "event_id", 500, "srs")


@query("stratified_draw", "SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || 'draw'), event_id) AS rn FROM events) WHERE rn <= CASE event_type WHEN 'click' THEN 40 WHEN 'error' THEN 10 ELSE 0 END")
def stratified_draw(spark, sf):
    return sampling.per_group_sample(read(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", {"click": 40, "error": 10}, "draw")


@query("weighted_sample", f"SELECT event_id FROM events WHERE value > 0 ORDER BY round(-ln(greatest({adapters._u('event_id', 'ws')}, 1e-12)) / value, 12), event_id LIMIT 300")
def weighted_sample(spark, sf):
    return sampling.weighted_sample(read(spark, sf, "events").select("event_id", "value"), "event_id", F.col("value"), 300, "ws").select("event_id")


@query("hash_split", f"SELECT {adapters._u('event_id', 'split')} < 0.7 AS train, count(*) AS n FROM events GROUP BY ALL")
def hash_split(spark, sf):
    train, test = sampling.hash_split(read(spark, sf, "events").select("event_id"), "event_id")
    return train.select(F.lit(True).alias("train")).unionByName(test.select(F.lit(False).alias("train"))).groupBy("train").agg(F.count("*").alias("n"))


# ---- actors and networks -----------------------------------------------------------------------------------

ACTOR_CTES = ("actors",)
ACTOR_COLUMNS = [f"{c}_score" for c in ("velocity", "newness", "repetition", "automation", "enforcement")]


@query("actor_features", with_ctes(f"SELECT actor_id, account_age_days, post_count_7d, post_count_30d, post_count_total, {_r('unique_content_ratio', 'unique_content_ratio')}, {_r('api_usage_fraction', 'api_usage_fraction')}, prior_enforcement_count FROM actors", *ACTOR_CTES))
def actor_features(spark, sf):
    return rounded(adapters.actors(spark, sf))


@query("actor_risk_scores", with_ctes(f", {SCORED_ACTORS} SELECT actor_id, {', '.join(_r(c[:-6], c) for c in ACTOR_COLUMNS)}, {_r('composite', 'composite_score')}, risk_tier FROM ar", *ACTOR_CTES))
def actor_risk_scores(spark, sf):
    return rounded(_actors(spark, sf).select("actor_id", *ACTOR_COLUMNS, "composite_score", "risk_tier"))


@query("tier_bad_rate", with_ctes(f", {SCORED_ACTORS} SELECT risk_tier, count(*) AS n, count(*) FILTER (WHERE prior_enforcement_count > 10) AS positives, {_r('avg((prior_enforcement_count > 10)::INT)', 'rate')} FROM ar GROUP BY ALL", *ACTOR_CTES))
def tier_bad_rate(spark, sf):
    return rounded(A.rate_by(_actors(spark, sf).withColumn("bad", F.col("prior_enforcement_count") > 10), "risk_tier", "bad"))


@query("label_means", with_ctes(f", {SCORED_ACTORS} SELECT prior_enforcement_count > 10 AS bad, {', '.join(f'round(avg({c[:-6]}), 3) + 0.0 AS {c}' for c in ACTOR_COLUMNS)} FROM ar GROUP BY ALL", *ACTOR_CTES))
def label_means(spark, sf):
    df = _actors(spark, sf).withColumn("bad", F.col("prior_enforcement_count") > 10)
    return df.groupBy("bad").agg(*[safe_round(F.avg(c), 3).alias(c) for c in ACTOR_COLUMNS])


@query("actor_sampling_weights", with_ctes(f", {SCORED_ACTORS} SELECT actor_id, {_r('(composite + 0.05) / sum(composite + 0.05) OVER ()', 'sampling_weight')} FROM ar", *ACTOR_CTES))
def actor_sampling_weights(spark, sf):
    return rounded(A.ActorFeatureExtractor().stratum_sampling_weights(_actors(spark, sf)).select("actor_id", "sampling_weight"))


@query("ht_totals", with_ctes(f", {SCORED_ACTORS} SELECT {_r('sum(CASE WHEN prior_enforcement_count > 10 THEN 1 / pi ELSE 0 END)', 'ht_positives')}, {_r('sum(1 / pi)', 'ht_total')} FROM (SELECT *, composite + 0.05 AS pi FROM ar)", *ACTOR_CTES))
def ht_totals(spark, sf):
    pi = F.col("composite_score") + 0.05
    return rounded(_actors(spark, sf).agg(F.sum(F.when(F.col("prior_enforcement_count") > 10, 1 / pi).otherwise(0.0)).alias("ht_positives"), F.sum(1 / pi).alias("ht_total")))


UNIT = "un AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"
EDGE = f"{UNIT}, ed AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.u, b.u) AS sim FROM un a JOIN un b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.u, b.u), 12) >= 0.4)"


def _vectors(spark, sf):
    return networks.unit_vectors(read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


@query("coordination_edges", f"WITH {EDGE} SELECT src, dst, {_r('sim', 'sim')} FROM ed")
def coordination_edges(spark, sf):
    return rounded(networks.similarity_edges(_vectors(spark, sf), 0.4))


# the greedy scan, one step a node: a node with enough neighbours that no earlier seed touches becomes a seed
LEADERS = """
no AS (
    SELECT id, u, row_number() OVER (ORDER BY id) AS n FROM un
), nb AS (
    SELECT a.n, any_value(a.id) AS id, list(b.n) AS near FROM no a JOIN no b ON a.n = b.n OR round(list_dot_product(a.u, b.u), 12) >= {threshold} GROUP BY a.n
), st(n, seeds) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT nb.n, CASE WHEN len(near) >= 3 AND len(list_intersect(seeds, near)) = 0 THEN list_append(seeds, nb.n) ELSE seeds END FROM st JOIN nb ON nb.n = st.n + 1
), cl AS (
    SELECT id, seed FROM (SELECT nb.id, list_min(list_intersect(nb.near, f.seeds)) AS k FROM nb, (SELECT seeds FROM st ORDER BY n DESC LIMIT 1) f) x
    JOIN (SELECT n, id AS seed FROM no) s ON s.n = x.k
)"""
UNIT_ACTORS = """
f5 AS (
    SELECT actor_id, unique_content_ratio AS a, api_usage_fraction AS b, velocity AS c, newness AS d, repetition AS e FROM ar
), mm AS (
    SELECT min(a) AS a0, max(a) - min(a) AS a1, min(b) AS b0, max(b) - min(b) AS b1, min(c) AS c0, max(c) - min(c) AS c1, min(d) AS d0, max(d) - min(d) AS d1, min(e) AS e0, max(e) - min(e) AS e1 FROM f5
), vs AS (
    SELECT actor_id, list_transform([(a - a0) / nullif(a1, 0), (b - b0) / nullif(b1, 0), (c - c0) / nullif(c1, 0), (d - d0) / nullif(d1, 0), (e - e0) / nullif(e1, 0)], lambda x: coalesce(x, 0)::DOUBLE) AS v FROM f5, mm
), un AS (
    SELECT actor_id AS id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM vs WHERE list_sum(list_transform(v, lambda y: y * y)) > 0
)"""
CLUSTERED = """
sz AS (
    SELECT seed, count(*) AS size, row_number() OVER (ORDER BY seed) - 1 AS cluster_id FROM cl GROUP BY seed
), ca AS (
    SELECT ar.*, coalesce(cluster_id, -1) AS network_cluster_id, coalesce(ln(1 + size) / (SELECT ln(1 + max(size)) FROM sz), 0) AS coordination
    FROM ar LEFT JOIN cl ON ar.actor_id = cl.id LEFT JOIN sz ON cl.seed = sz.seed
)"""


def _clusters_sql(select: str) -> str:
    text = with_ctes(f", {SCORED_ACTORS}, {UNIT_ACTORS}, {LEADERS.format(threshold=0.9)}, {CLUSTERED} {select}", *ACTOR_CTES)
    assert text.lstrip().startswith("WITH ")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


RESCORED = " + ".join(f"{w!r}::DOUBLE * {name}" for name, w in A.DEFAULT_WEIGHTS.items())
RETIERED = "CASE " + " ".join(f"WHEN s >= {cut} THEN '{name}'" for name, cut in A.TIER_CUTS) + " ELSE 'low' END"


@query("coordination_clusters", _clusters_sql(f"SELECT actor_id, network_cluster_id, {_r('coordination', 'coordination_score')}, {_r('s', 'composite_score')}, {RETIERED} AS risk_tier FROM (SELECT *, least(1, greatest(0, {RESCORED})) AS s FROM ca)"))
def coordination_clusters(spark, sf):
    scored, _ = networks.detect_coordination_networks(_actors(spark, sf), 0.9, 3)
    return rounded(scored.select("actor_id", "network_cluster_id", "coordination_score", "composite_score", "risk_tier"))


@query("coordination_report", _clusters_sql(f"SELECT sz.cluster_id, sz.size, (SELECT string_agg(id, ',' ORDER BY id) FROM cl WHERE cl.seed = sz.seed) AS actor_ids, {_r('(SELECT avg(list_dot_product(a.u, b.u)) FROM cl x JOIN un a ON x.id = a.id JOIN cl y ON y.seed = x.seed AND y.id <> x.id JOIN un b ON y.id = b.id WHERE x.seed = sz.seed)', 'avg_similarity')} FROM sz WHERE size >= 3"))
def coordination_report(spark, sf):
    report = networks.detect_coordination_networks(_actors(spark, sf), 0.9, 3)[1]
    return rounded(report.withColumn("actor_ids", F.array_join("actor_ids", ",")))


@query("embedding_leaders", f"WITH RECURSIVE {UNIT.replace('SELECT vec_id, list_transform(v', 'SELECT vec_id AS id, list_transform(v')}, {LEADERS.format(threshold=0.4)} SELECT id, seed FROM cl")
def embedding_leaders(spark, sf):
    return networks.vector_leaders(_vectors(spark, sf), 0.4, 3)


@query("cluster_lift", _clusters_sql(f"SELECT {_r('a', 'rate_in')}, {_r('b', 'rate_out')}, {_r('a / nullif(b, 0)', 'lift')} FROM (SELECT avg((prior_enforcement_count > 10)::INT) FILTER (WHERE network_cluster_id >= 0) AS a, avg((prior_enforcement_count > 10)::INT) FILTER (WHERE network_cluster_id < 0) AS b FROM ca)"))
def cluster_lift(spark, sf):
    placed, _ = networks.detect_coordination_networks(_actors(spark, sf), 0.9, 3)
    return rounded(A.lift(placed.withColumn("bad", F.col("prior_enforcement_count") > 10), F.col("network_cluster_id") >= 0, "bad"))


# ---- monitors ----------------------------------------------------------------------------------------------

SERIES = "ws AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, avg((o_totalprice / 500000) * (o_totalprice / 500000) * (o_totalprice / 500000)) AS x FROM orders GROUP BY ALL)"


def _series(spark, sf):
    return _items(spark, sf).groupBy("week").agg(F.avg("classifier_score").alias("x"))


@query("rolling_zscore", f"WITH {SERIES}, r AS (SELECT *, CASE WHEN count(x) OVER w >= 3 THEN avg(x) OVER w END AS m, CASE WHEN count(x) OVER w >= 3 THEN stddev_samp(x) OVER w END AS s FROM ws WINDOW w AS (ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT week, {_r('x', 'x')}, {_r('m', 'rolling_mean')}, {_r('s', 'rolling_std')}, {_r('(x - m) / CASE WHEN s IS NOT NULL THEN greatest(s, 1e-6) END', 'z')}, coalesce(abs((x - m) / CASE WHEN s IS NOT NULL THEN greatest(s, 1e-6) END) > 2, FALSE) AS anomaly FROM r")
def rolling_zscore(spark, sf):
    return rounded(monitor.rolling_zscore(_series(spark, sf), "x", "week"))


BASE = f"{SERIES}, b AS (SELECT *, row_number() OVER (ORDER BY week) AS r FROM ws), c AS (SELECT *, avg(CASE WHEN r <= 8 THEN x END) OVER () AS mu, stddev_pop(CASE WHEN r <= 8 THEN x END) OVER () AS sd FROM b)"


@query("baseline_zscore", f"WITH {BASE} SELECT week, {_r('(x - mu) / nullif(sd, 0)', 'z')} FROM c")
def baseline_zscore(spark, sf):
    return rounded(monitor.baseline_zscore(_series(spark, sf), "x", "week").select("week", "z"))


def _cusum_sql(step: str, h: str) -> str:
    # the recursion itself
    return f"WITH RECURSIVE {BASE}, q(r, week, cu, h) AS (SELECT r, week, 0.0::DOUBLE, {h} FROM c WHERE r = 1 UNION ALL SELECT c.r, c.week, greatest(0.0, q.cu + {step}), {h} FROM q JOIN c ON c.r = q.r + 1) SELECT week, {_r('cu', 'cusum')}, round(cu, 9) > round(h, 9) AS alarm FROM q"


@query("cusum_upper", _cusum_sql("(c.x - c.mu) - 0.002", "0.01::DOUBLE"))
def cusum_upper(spark, sf):
    return rounded(monitor.cusum(_series(spark, sf), "x", "week", 0.002, 0.010).select("week", "cusum", "alarm"))


@query("cusum_lower", _cusum_sql("-(c.x - c.mu) - 0.002", "0.01::DOUBLE"))
def cusum_lower(spark, sf):
    return rounded(monitor.cusum(_series(spark, sf), "x", "week", 0.002, 0.010, lower=True).select("week", "cusum", "alarm"))


@query("cusum_sigma", _cusum_sql("(c.x - c.mu) - 0.5 * c.sd", "5 * c.sd"))
def cusum_sigma(spark, sf):
    return rounded(monitor.cusum(_series(spark, sf), "x", "week").select("week", "cusum", "alarm"))


@query("last4_vs_prior4", f"WITH {SERIES} SELECT {_r('avg(x) FILTER (WHERE r <= 4)', 'x_recent')}, {_r('avg(x) FILTER (WHERE r > 4)', 'x_prior')}, {_r('avg(x) FILTER (WHERE r <= 4) - avg(x) FILTER (WHERE r > 4)', 'x_delta')} FROM (SELECT x, row_number() OVER (ORDER BY week DESC) AS r FROM ws) WHERE r <= 8")
def last4_vs_prior4(spark, sf):
    return rounded(monitor.last_against_prior(_series(spark, sf), ["x"], "week"))


@query("executive_summary", f"WITH {SERIES}, r AS (SELECT *, avg(x) OVER w AS m, CASE WHEN count(x) OVER w >= 3 THEN greatest(stddev_samp(x) OVER w, 1e-6) END AS s, row_number() OVER (ORDER BY week DESC) AS k FROM ws WINDOW w AS (ORDER BY week ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), z AS (SELECT *, coalesce(abs((x - m) / s) > 2, FALSE) AS a FROM r) SELECT {_r('avg(x) FILTER (WHERE k <= 4)', 'avg_recent')}, {_r('avg(x) FILTER (WHERE k <= 4) - avg(x) FILTER (WHERE k BETWEEN 5 AND 8)', 'delta')}, count(*) FILTER (WHERE k <= 4 AND a) AS anomalies_recent, count(*) FILTER (WHERE a) AS anomalies, count(*) AS n FROM z")
def executive_summary(spark, sf):
    return rounded(monitor.executive_summary(_series(spark, sf), "x", "week"))


@query("flagged_weeks", f"WITH {SERIES} SELECT min(week) AS first, max(week) AS last, count(*) AS n FROM ws WHERE x > 0.16")
def flagged_weeks(spark, sf):
    found = monitor.flagged_weeks(_series(spark, sf).withColumn("flag", F.col("x") > 0.16), "flag", "week")
    return found.select("first", "last", F.size("all").cast("long").alias("n"))


@query("weekly_volumes", with_ctes("SELECT week, n1, d AS detections_week, trunc(d * 0.78::DOUBLE)::BIGINT AS enforcement_week, round(trunc(d * 0.78::DOUBLE) / greatest(d, 1), 6) + 0.0 AS enforcement_rate FROM (SELECT *, trunc(n1 / 2000.0::DOUBLE * 100000)::BIGINT AS d FROM (SELECT week, count(*) FILTER (WHERE detected_a) AS n1 FROM scored GROUP BY ALL))", "scored"))
def weekly_volumes(spark, sf):
    return rounded(monitor.weekly_volumes(_scored(spark, sf).groupBy("week").agg(F.count_if("detected_a").alias("n1"))))


# ---- flags, experiments, evidence --------------------------------------------------------------------------

FLAGS = {"is_high": "o_totalprice > 250000", "is_urgent": "o_orderpriority = '1-URGENT'", "is_open": "o_orderstatus = 'O'", "is_early": "o_orderdate < TIMESTAMP '1995-01-01'"}
FLAG_SQL = f"fl AS (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in FLAGS.items())} FROM orders)"


def _flags(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") > 250000).alias("is_high"), (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"), (F.col("o_orderstatus") == "O").alias("is_open"), (F.col("o_orderdate").cast("timestamp") < F.lit("1995-01-01").cast("timestamp")).alias("is_early"))


@query("flag_prevalence_ranked", f"WITH {FLAG_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS flag, {_r(f'avg({k}::INT)', 'prevalence')} FROM fl" for k in FLAGS))
def flag_prevalence_ranked(spark, sf):
    from tidemark.sources.tables import flag_columns

    df = _flags(spark, sf)
    return rounded(funnel.prevalence_by_flag(df, flag_columns(df)))


PAIRS = [(a, b) for k, a in enumerate(FLAGS) for b in list(FLAGS)[k + 1 :]]


@query("label_correlation", f"WITH {FLAG_SQL} SELECT a, b, {_r('r', 'r')}, coalesce(abs(r) > 0.15, FALSE) AS strong FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}::INT) > 0 AND stddev_pop({b}::INT) > 0 THEN corr({a}::INT, {b}::INT) END AS r FROM fl" for a, b in PAIRS) + ")")
def label_correlation(spark, sf):
    return rounded(funnel.correlations(_flags(spark, sf), list(FLAGS)))


ZP = repr(experiment._z(0.05, 0.8))
TREATED = (0.004, 0.0055, 0.008, 0.012)


# z * z * spread / effect^2, and 1 + (spread / budget) / (spread / 2 / n)
POWER = f"""
SELECT baseline, treatment, review_budget, ceil(nn)::BIGINT AS n_naive, {_r('1 + 2 * nn / review_budget', 'inflation')},
    ceil(nn * (1 + 2 * nn / review_budget))::BIGINT AS n_per_arm, {_r('d', 'effect')}
FROM (
    SELECT *, {ZP} * {ZP} * (baseline * (1 - baseline) + treatment * (1 - treatment)) / (d * d) AS nn
    FROM (
        SELECT *, CASE WHEN abs(treatment - baseline) >= 1e-9 THEN abs(treatment - baseline) END AS d
        FROM {_values('baseline', (0.004, 0.01))}, {_values('treatment', TREATED)}, {_values('review_budget', (2000.0, 5000.0))}
    )
)"""


@query("power_grid", POWER)
def power_grid(spark, sf):
    grid = _grid(spark, "baseline", (0.004, 0.01)).crossJoin(_grid(spark, "treatment", TREATED)).crossJoin(_grid(spark, "review_budget", (2000.0, 5000.0)))
    return rounded(experiment.power_prevalence_test(grid).select("baseline", "treatment", "review_budget", "n_naive", "inflation", "n_per_arm", "effect"))


@query("mde_grid", f"SELECT prevalence, n, {_r(f'{ZP} * sqrt(2 * prevalence * (1 - prevalence) * (1 / 1000000.0::DOUBLE + 1 / n))', 'mde')}, {_r(f'{ZP} * sqrt(2 * prevalence * (1 - prevalence) * (1 / 1000000.0::DOUBLE + 1 / n)) / prevalence', 'relative_mde')} FROM {_values('prevalence', PIS)}, {_values('n', NS)}")
def mde_grid(spark, sf):
    m = experiment.mde(F.col("prevalence"), F.lit(1_000_000.0), F.col("n"))
    return rounded(_grid(spark, "prevalence", PIS).crossJoin(_grid(spark, "n", NS)).select("prevalence", "n", m.alias("mde"), ratio(m, F.col("prevalence")).alias("relative_mde")))


WORKED = f"""
SELECT treatment, {_r('m', 'mde')}, d >= m AS powered, CASE WHEN d < m THEN ceil(ceil(nn * (1 + 2 * nn / 3000)) / 2000000)::BIGINT END AS weeks
FROM (
    SELECT *, {ZP} * sqrt(2 * 0.005 * 0.995 * (1 / 2000000.0::DOUBLE + 1 / 3000.0::DOUBLE)) AS m, {ZP} * {ZP} * (0.005 * 0.995 + treatment * (1 - treatment)) / (d * d) AS nn
    FROM (SELECT treatment, abs(treatment - 0.005) AS d FROM {_values('treatment', (0.00425, 0.001, 0.02))})
)"""


@query("worked_experiment", WORKED)
def worked_experiment(spark, sf):
    grid = _grid(spark, "treatment", (0.00425, 0.001, 0.02)).select("*", F.lit(0.005).alias("baseline"), F.lit(2_000_000.0).alias("weekly_corpus"), F.lit(3000.0).alias("review_budget"))
    return rounded(experiment.worked(grid).select("treatment", "mde", "powered", "weeks"))


# what each of eight looks may spend, by the standard library's normal distribution
SPENT = ", ".join(f"({k}, {2 * (1 - NormalDist().cdf(z_value() / (k / 8) ** 0.5))!r}::DOUBLE)" for k in range(1, 9))


@query("obf_alpha", f"SELECT look::BIGINT AS look, {_r('a', 'alpha_spent')} FROM (VALUES {SPENT}) v(look, a)")
def obf_alpha(spark, sf):
    return rounded(spark.range(1, 9).select(F.col("id").alias("look"), experiment.obf_alpha(F.col("id") / 8.0).alias("alpha_spent")))


@query("proxy_metrics", with_ctes(f"SELECT label AS arm, {_r('avg(score)', 'mean_score')}, {_r('quantile_cont(score, 0.95)', 'p95_score')}, {_r('avg((score >= 0.5)::INT)', 'flag_50')}, {_r('avg((score >= 0.8)::INT)', 'flag_80')} FROM scored GROUP BY ALL", "scored"))
def proxy_metrics(spark, sf):
    return rounded(experiment.proxy_metrics(_scored(spark, sf).withColumnRenamed("label", "arm"), "arm", "score"))


@query("proxy_change", with_ctes(f", p AS (SELECT label AS arm, avg(score) AS m, avg((score >= 0.5)::INT) AS f FROM scored GROUP BY ALL), w AS (SELECT max(m) FILTER (WHERE NOT arm) AS m0, max(m) FILTER (WHERE arm) AS m1, max(f) FILTER (WHERE NOT arm) AS f0, max(f) FILTER (WHERE arm) AS f1 FROM p) SELECT 'mean_score' AS metric, {_r('m0', 'control')}, {_r('m1', 'treatment')}, {_r('(m1 - m0) / nullif(m0, 0)', 'change')} FROM w UNION ALL SELECT 'flag_50', {_r('f0', 'control')}, {_r('f1', 'treatment')}, {_r('(f1 - f0) / nullif(f0, 0)', 'change')} FROM w", "scored"))
def proxy_change(spark, sf):
    arms = experiment.proxy_metrics(_scored(spark, sf).withColumnRenamed("label", "arm"), "arm", "score")
    return rounded(experiment.percent_change(arms, "arm", False, True, ["mean_score", "flag_50"]))


@query("bayes_update", f"SELECT prior, present, {_r('coalesce(prior * t / nullif(prior * t + (1 - prior) * f, 0), prior)', 'posterior')}, {_r('coalesce(prior * t / nullif(prior * t + (1 - prior) * f, 0), prior) / prior', 'lift')} FROM (SELECT prior, present, CASE WHEN present THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END AS t, CASE WHEN present THEN 0.04::DOUBLE ELSE 0.96::DOUBLE END AS f FROM {_values('prior', PIS)}, (SELECT unnest([TRUE, FALSE]) AS present))")
def bayes_update(spark, sf):
    grid = _grid(spark, "prior", PIS).crossJoin(spark.createDataFrame([(True,), (False,)], "present boolean"))
    post = bayes.update(F.col("prior"), F.lit(0.65), F.lit(0.04), F.col("present"))
    return rounded(grid.select("prior", "present", post.alias("posterior"), bayes.lift(F.col("prior"), post).alias("lift")))


SIGNAL_LR = "0.65 / 0.04, 0.3 / 0.9, 0.5 / 0.02"


@query("bayes_sequential", f"SELECT prior, step::INT AS step, {_r('prior * lr / (prior * lr + 1 - prior)', 'posterior')} FROM {_values('prior', PIS)}, (SELECT 0 AS step, 1.0::DOUBLE AS lr UNION ALL SELECT 1, 0.65 / 0.04 UNION ALL SELECT 2, 0.65 / 0.04 * (0.3 / 0.9) UNION ALL SELECT 3, 0.65 / 0.04 * (0.3 / 0.9) * (0.5 / 0.02))")
def bayes_sequential(spark, sf):
    rows = [(float(p), [(0.65, 0.04, True), (0.7, 0.1, False), (0.5, 0.02, True)]) for p in PIS]
    df = spark.createDataFrame(rows, "prior double, signals array<struct<tpr:double,fpr:double,present:boolean>>")
    return rounded(bayes.trace(df).select("prior", "step", "posterior"))


@query("break_even_cost", f"SELECT prior, {_r('prior / (1 - prior)', 'break_even')} FROM {_values('prior', PIS)}")
def break_even_cost(spark, sf):
    return rounded(_grid(spark, "prior", PIS).select("prior", bayes.break_even(F.col("prior")).alias("break_even")))


@query("posterior_action_tier", with_ctes("SELECT event_id, CASE WHEN score > 0.05 THEN 'escalate' WHEN score > 0.02 THEN 'review' WHEN score > 0.005 THEN 'sample' ELSE 'monitor' END AS tier FROM scored", "scored"))
def posterior_action_tier(spark, sf):
    return _scored(spark, sf).select("event_id", bayes.action_tier(F.col("score")).alias("tier"))


@query("review_allocation", with_ctes(f", a AS (SELECT count(*) FILTER (WHERE detected_b) AS ni, count(*) AS n, avg(label::INT) FILTER (WHERE detected_b) AS ri, avg(label::INT) FILTER (WHERE NOT detected_b) AS ro, sum(CASE WHEN detected_b THEN 0.14::DOUBLE ELSE 0 END) AS wi, sum(CASE WHEN detected_b THEN 0.14::DOUBLE ELSE 0.005::DOUBLE END) AS w FROM scored), s AS (SELECT 'flat' AS strategy, trunc(3000.0::DOUBLE * (ni::DOUBLE / n))::BIGINT AS k, ri, ro FROM a UNION ALL SELECT 'posterior', trunc(3000.0::DOUBLE * (wi / w))::BIGINT, ri, ro FROM a) SELECT strategy, k AS n_signal, 3000 - k AS n_rest, {_r('k * ri + (3000 - k) * ro', 'expected_positives')} FROM s", "scored"))
def review_allocation(spark, sf):
    post = F.when(F.col("detected_b"), 0.14).otherwise(0.005)
    return rounded(bayes.review_allocation(_scored(spark, sf), "detected_b", "label", post))


# ---- funnel, scorecard, simulation -------------------------------------------------------------------------

FUNNEL = (10_000_000, 0.005, 0.92, 0.18, 0.88, 0.04, 3000, 0.82, 0.08)


@query("funnel", f"WITH p AS (SELECT 10000000::BIGINT AS n, trunc(10000000 * 0.005::DOUBLE)::BIGINT AS h), q AS (SELECT *, trunc(h * 0.92::DOUBLE)::BIGINT AS qt, trunc((n - h) * 0.18::DOUBLE)::BIGINT AS qf FROM p), f AS (SELECT *, trunc(qt * 0.88::DOUBLE)::BIGINT AS ft, trunc(qf * 0.04::DOUBLE)::BIGINT AS ff FROM q), c AS (SELECT *, trunc(3000 * (ft::DOUBLE / (ft + ff)))::BIGINT AS k FROM f), a AS (SELECT *, trunc(k * 0.82::DOUBLE)::BIGINT AS e FROM c), z AS (SELECT *, trunc(e * (1 - 0.08::DOUBLE))::BIGINT AS x FROM a), s AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS stage_number, unnest([{', '.join(repr(s) for s in funnel.STAGES)}]) AS stage, unnest([n, qt + qf, ft + ff, 3000, k, e, x]) AS m FROM z) SELECT stage_number, stage, m::BIGINT AS n, {_r('100.0 * m / 10000000', 'pct_of_corpus')} FROM s")
def funnel_query(spark, sf):
    params = spark.createDataFrame([FUNNEL], "corpus_size long, prevalence double, prefilter_recall double, prefilter_fpr double, tpr double, fpr double, review_budget long, enforcement_rate double, reversal_rate double")
    return rounded(funnel.funnel(params))


@query("prefilter_metrics", with_ctes(f"SELECT {_r('(count(*) FILTER (WHERE score >= 0.2 AND label))::DOUBLE / nullif(count(*) FILTER (WHERE label), 0)', 'recall')}, {_r('(count(*) FILTER (WHERE score >= 0.2 AND label))::DOUBLE / nullif(count(*) FILTER (WHERE score >= 0.2), 0)', 'precision')}, {_r('1 - (count(*) FILTER (WHERE score >= 0.2))::DOUBLE / count(*)', 'queue_reduction')} FROM scored", "scored"))
def prefilter_metrics(spark, sf):
    return rounded(funnel.prefilter_metrics(_scored(spark, sf), F.col("score") >= 0.2, F.col("label")))


KPI = "ek AS (SELECT harm_vertical, avg(label::INT) AS true_prevalence, avg(detected_a::INT) AS flag_rate, 0.5 + avg(score) AS enforcement_rate, avg(detected_b::INT) AS reversal_rate FROM scored GROUP BY ALL)"


@query("enforcement_kpis", with_ctes(f", {KPI} SELECT harm_vertical, {_r('true_prevalence', 'true_prevalence')}, {_r('flag_rate', 'flag_rate')}, {_r('enforcement_rate', 'enforcement_rate')}, {_r('reversal_rate', 'reversal_rate')}, {_r('1 - enforcement_rate', 'gap_rate')}, {_r('enforcement_rate * (1 - reversal_rate)', 'final_enforcement_rate')}, {_r('enforcement_rate * reversal_rate', 'reversed_share')}, {_r('flag_rate / nullif(true_prevalence, 0)', 'naive_bias')} FROM ek", "scored"))
def enforcement_kpis(spark, sf):
    mean = lambda c: F.avg(F.col(c).cast("double"))
    kpi = _scored(spark, sf).groupBy("harm_vertical").agg(mean("label").alias("true_prevalence"), mean("detected_a").alias("flag_rate"), (F.lit(0.5) + F.avg("score")).alias("enforcement_rate"), mean("detected_b").alias("reversal_rate"))
    return rounded(funnel.enforcement_kpis(kpi))


@query("scorecard_lights", with_ctes(f", s AS (SELECT week, 100 * (0.5 + avg(score)) AS e, 100 * avg(detected_b::INT) AS r, 10 * avg(score) AS h, 1.0::DOUBLE AS t FROM scored GROUP BY ALL) SELECT week, 'enforcement_rate_pct' AS metric, {_r('e', 'value')}, CASE WHEN e < 70 THEN 'red' WHEN e < 80 THEN 'amber' ELSE 'green' END AS light FROM s UNION ALL SELECT week, 'reversal_rate_pct', {_r('r', 'value')}, CASE WHEN r > 12 THEN 'red' WHEN r > 8 THEN 'amber' ELSE 'green' END FROM s UNION ALL SELECT week, 'p50_hours', {_r('h', 'value')}, CASE WHEN h > 12 THEN 'red' WHEN h > 6 THEN 'amber' ELSE 'green' END FROM s UNION ALL SELECT week, 'true_prevalence_pct', {_r('t', 'value')}, 'white' FROM s", "scored"))
def scorecard_lights(spark, sf):
    weekly = _scored(spark, sf).groupBy("week").agg((100 * (F.lit(0.5) + F.avg("score"))).alias("enforcement_rate_pct"), (100 * F.avg(F.col("detected_b").cast("double"))).alias("reversal_rate_pct"), (10 * F.avg("score")).alias("p50_hours"), F.lit(1.0).alias("true_prevalence_pct"))
    return rounded(funnel.scorecard(weekly, "week", ["enforcement_rate_pct", "reversal_rate_pct", "p50_hours", "true_prevalence_pct"]))


CONFIG = simulate.SimulationConfig(n_corpus=50_000, true_prevalence=0.02)


def _draw_sql(key: str, purpose: str) -> str:
    return f"(('0x' || substr(md5({key} || '::{purpose}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)".replace("::" + purpose, ":" + purpose)


def _sim_sql(trials: int, n: int) -> str:
    key = "(trial + 42)::VARCHAR || ':' || item_id::VARCHAR"
    sampled = "(trial + 43)::VARCHAR || ':' || item_id::VARCHAR"
    return f"""WITH i AS (SELECT i // 50000 AS trial, i % 50000 AS item_id FROM range({trials * 50000}) r(i)),
t AS (SELECT trial, item_id FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY h, item_id) AS place FROM (SELECT *, {_draw_sql(sampled, 's')} AS h FROM i) WHERE h < 0.1) WHERE place <= {n}),
y AS (SELECT *, {_draw_sql(key, 'y')} < 0.02 AS y FROM t),
c AS (SELECT trial, {n}::DOUBLE AS n, (count(*) FILTER (WHERE y))::DOUBLE AS k, (count(*) FILTER (WHERE a))::DOUBLE AS n1, (count(*) FILTER (WHERE b))::DOUBLE AS n2, (count(*) FILTER (WHERE a AND b))::DOUBLE AS m
    FROM (SELECT trial, y, {_draw_sql(key, 'a')} < CASE WHEN y THEN 0.8 ELSE 0.05 END AS a, {_draw_sql(key, 'b')} < CASE WHEN y THEN 0.75 ELSE 0.03 END AS b FROM y) GROUP BY trial),
e AS (SELECT 'direct' AS method, k / n AS e, (k + {Z} * {Z} / 2 - {Z} * sqrt(k * (1 - k / n) + {Z} * {Z} / 4)) / (n + {Z} * {Z}) AS lo, (k + {Z} * {Z} / 2 + {Z} * sqrt(k * (1 - k / n) + {Z} * {Z} / 4)) / (n + {Z} * {Z}) AS hi FROM c
    UNION ALL SELECT 'adjusted', x, x - {Z} * sqrt(v), x + {Z} * sqrt(v) FROM (SELECT (q - 0.05) / 0.75 AS x, q * (1 - q) / n / 0.5625 + pow((q - 0.05) / 0.5625, 2) * 0.0004 + pow((0.8 - q) / 0.5625, 2) * 0.0001 AS v FROM (SELECT *, n1 / n AS q FROM c))
    UNION ALL SELECT 'chapman', t / n, t * exp(-{Z} * s) / n, t * exp({Z} * s) / n FROM (SELECT *, (n1 + 1) * (n2 + 1) / (m + 1) - 1 AS t, sqrt(greatest((n1 - m) * (n2 - m), 0) / ((n1 + 1) * (n2 + 1) * (m + 1))) AS s FROM c))
SELECT method, {_r('avg((0.02 BETWEEN greatest(0, lo) AND least(1, hi))::INT)', 'coverage')}, {_r('sqrt(avg(pow(e - 0.02, 2)))', 'rmse')}, {_r('avg(e - 0.02)', 'bias')} FROM e GROUP BY method"""


@query("coverage_simulation", _sim_sql(500, 2000))
def coverage_simulation(spark, sf):
    trials = simulate.run_coverage_simulation(spark, CONFIG, n_trials=500, sample_size=2000)
    return rounded(simulate.coverage_summary(trials, CONFIG.true_prevalence))


@query("simulated_corpus")
def simulated_corpus(spark, sf):
    return rounded(simulate.generate_corpus(spark, simulate.SimulationConfig(n_corpus=5000)))


@query("simulated_detections", f"WITH t AS (SELECT item_id, {_draw_sql(chr(39) + '42:' + chr(39) + ' || item_id::VARCHAR', 'y')} < 0.01 AS true_label FROM range(20000) r(item_id)) SELECT item_id, true_label, {_draw_sql(chr(39) + '42:' + chr(39) + ' || item_id::VARCHAR', 'a')} < CASE WHEN true_label THEN 0.8 ELSE 0.05 END AS detected_a, {_draw_sql(chr(39) + '42:' + chr(39) + ' || item_id::VARCHAR', 'b')} < CASE WHEN true_label THEN 0.75 ELSE 0.03 END AS detected_b FROM t ORDER BY md5(item_id::VARCHAR || ':43'), item_id LIMIT 2000")
def simulated_detections(spark, sf):
    config = simulate.SimulationConfig(n_corpus=20_000)
    ids = spark.range(config.n_corpus).withColumnRenamed("id", "item_id")
    return simulate.simulate_detection_systems(simulate.detections(ids, config), config, 2000)[0]


@query("simulated_actors")
def simulated_actors(spark, sf):
    return rounded(simulate.simulate_actor_corpus(spark, 2000))


@query("synthetic_flags", f"SELECT item_id, {', '.join(_draw_sql(chr(39) + '42:' + chr(39) + ' || item_id::VARCHAR', c) + f' < {p} AS {c}' for c, p in (('violence', 0.02), ('fraud', 0.1)))} FROM range(5000) r(item_id)")
def synthetic_flags(spark, sf):
    return simulate.synthetic_flags(spark, 5000, {"violence": 0.02, "fraud": 0.1})


@query("miscalibrated_scores")
def miscalibrated_scores(spark, sf):
    return rounded(simulate.miscalibrated_scores(spark, 5000, 0.3))


@query("weekly_platform")
def weekly_platform(spark, sf):
    return rounded(simulate.weekly_platform(spark))


@query("sampling_efficiency")
def sampling_efficiency(spark, sf):
    scored = A.ActorFeatureExtractor().compute_risk_scores(simulate.simulate_actor_corpus(spark, 10_000, 0.1))
    weighted = A.ActorFeatureExtractor().stratum_sampling_weights(scored)
    return rounded(simulate.sampling_efficiency(weighted, [100, 200, 500, 1000, 2000, 5000], 500))


@query("seven_day_grid", "SELECT week_number::INT AS week_number, (DATE '2025-01-06' + INTERVAL 7 DAYS * week_number)::DATE AS week FROM range(12) r(week_number)")
def seven_day_grid(spark, sf):
    from tidemark.sources.tables import weeks

    return weeks(spark, "2025-01-06", 12)


@query("union_populations", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) GROUP BY ALL")
def union_populations(spark, sf):
    both = read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")).unionByName(read(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("label_metrics", with_ctes(f"SELECT harm_vertical, tp, fp, tn, fn, {RATES} FROM (SELECT harm_vertical, count(*) FILTER (WHERE detected_b AND label) AS tp, count(*) FILTER (WHERE detected_b AND NOT label) AS fp, count(*) FILTER (WHERE NOT detected_b AND NOT label) AS tn, count(*) FILTER (WHERE NOT detected_b AND label) AS fn FROM scored GROUP BY ALL)", "scored"))
def label_metrics(spark, sf):
    return rounded(thresholds.label_metrics(_scored(spark, sf), "detected_b", "label", ["harm_vertical"]))


VARIANTS = (("plain", 0.0, 0.0), ("strict", -0.1, 0.05), ("lenient", 0.1, 0.05))
VARIANT_ROWS = ", ".join(f"('{n}', {b!r}::DOUBLE, {w!r}::DOUBLE)" for n, b, w in VARIANTS)
MOVED = f"greatest(0, least(1, score + bias + (('0x' || substr(md5(event_id::VARCHAR || '|' || variant || 'noise'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) * noise))"


@query("prompt_sensitivity", with_ctes(f", mv AS (SELECT variant, label, {MOVED} AS m FROM scored, (VALUES {VARIANT_ROWS}) v(variant, bias, noise)) SELECT variant, tp, fp, tn, fn, {RATES} FROM (SELECT variant, count(*) FILTER (WHERE m >= 0.5 AND label) AS tp, count(*) FILTER (WHERE m >= 0.5 AND NOT label) AS fp, count(*) FILTER (WHERE m < 0.5 AND NOT label) AS tn, count(*) FILTER (WHERE m < 0.5 AND label) AS fn FROM mv GROUP BY ALL)", "scored"))
def prompt_sensitivity(spark, sf):
    variants = spark.createDataFrame(VARIANTS, "variant string, bias double, noise double")
    return rounded(thresholds.prompt_sensitivity(_scored(spark, sf), variants, "event_id"))


@query("formatted_report", with_ctes("SELECT upper(substr(harm_vertical, 1, 1)) || lower(substr(harm_vertical, 2)) AS vertical, printf('%.3f%%', round(avg(detected_a::INT) * 100, 3)) AS flag_rate FROM scored GROUP BY harm_vertical", "scored"))
def formatted_report(spark, sf):
    rates = _scored(spark, sf).groupBy("harm_vertical").agg(F.avg(F.col("detected_a").cast("double")).alias("r"))
    return rates.select(title(F.col("harm_vertical")).alias("vertical"), percent(F.col("r")).alias("flag_rate"))


@query("simulated_arms")
def simulated_arms(spark, sf):
    return rounded(experiment.proxy_metrics(simulate.simulate_arms(spark, 50_000, {"control": 0.010, "treatment": 0.008}), "arm", "score"))


@query("signal_hits", f"WITH t AS (SELECT item_id, {_draw_sql(chr(39) + '42:' + chr(39) + ' || item_id::VARCHAR', 'y')} < 0.01 AS true_label FROM range(20000) r(item_id)), h AS (SELECT *, {_draw_sql(chr(39) + '42:' + chr(39) + ' || item_id::VARCHAR', 'h')} < CASE WHEN true_label THEN 0.65 ELSE 0.04 END AS hit FROM t) SELECT hit, count(*) AS n, {_r('avg(true_label::INT)', 'rate')} FROM h GROUP BY hit")
def signal_hits(spark, sf):
    hits = simulate.signal_hits(spark.range(20_000).withColumnRenamed("id", "item_id"), 0.01, 0.65, 0.04)
    return rounded(hits.groupBy("hit").agg(F.count("*").alias("n"), F.avg(F.col("true_label").cast("double")).alias("rate")))


@query("flattened_flags", "SELECT count(*) FILTER (WHERE o_totalprice > 250000) AS is_high, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS is_urgent FROM orders")
def flattened_flags(spark, sf):
    from tidemark.sources.tables import flag_columns, flatten_flags

    nested = _flags(spark, sf).select("o_orderkey", F.struct("is_high", "is_urgent").alias("category"))
    flat = flatten_flags(nested)
    return flat.agg(*[F.count_if(c).alias(c) for c in flag_columns(flat)])


@query("stream_weekly_observed", with_ctes(f", {OBSERVED} SELECT week, harm_vertical, n_corpus, round(q * n_corpus)::BIGINT AS n_positive, {_r('q', 'observed_positive_rate')} FROM o", "content_items"))
def stream_weekly_observed(spark, sf):
    """The weekly rate as a stream run to its end; the sink holds one row a week and vertical."""
    import uuid

    from tidemark.streaming.weekly import weekly_observed

    name = f"weekly_{uuid.uuid4().hex}"
    run = weekly_observed(adapters.streamed_items(spark, sf)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.table(name))


# ---- classification ----------------------------------------------------------------------------------------

PRICE_ROWS = ", ".join(f"('{p}', '{classify.DEFAULT_MODELS[p]}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for p, (a, b) in classify.PRICES.items())
SCALES = (1_000, 10_000, 100_000, 1_000_000, 10_000_000)


@query("provider_cost", f"SELECT provider, model, n_items, {_r('n_items * c', 'cost_zero_shot')}, {_r('n_items * c * 1.4', 'cost_few_shot')}, {_r('n_items / 3000.0', 'hours')} FROM (SELECT *, 450 * i / 1000000 + 80 * o / 1000000 AS c FROM (VALUES {PRICE_ROWS}) p(provider, model, i, o)), (SELECT unnest([{', '.join(map(str, SCALES))}])::BIGINT AS n_items)")
def provider_cost(spark, sf):
    return rounded(classify.provider_cost(spark, list(SCALES)))


RESPONSES = (
    (1, '{"violates_policy": true, "confidence": 0.9, "key_signals": ["a b"], "reasoning": "r"}'),
    (2, '```json\n{"violates_policy": false, "confidence": 0.2}\n```'),
    (3, "no json"),
    (4, "[1, 2]"),
    (5, '{"violates_policy": true, "confidence": "high"}'),
    (6, "{}"),
    (7, None),
)


ANSWERS = ", ".join(f"({k}, {'NULL' if r is None else chr(39) + r + chr(39)})" for k, r in RESPONSES)
PARSE_SQL = rf"""
WITH r AS (
    SELECT id, regexp_replace(coalesce(raw, ''), '^\s+|\s+$', '', 'g') AS t FROM (VALUES {ANSWERS}) v(id, raw)
), c AS (
    SELECT id, regexp_replace(CASE WHEN starts_with(t, '```') THEN regexp_replace(string_split(t, '```')[2], '^json', '') ELSE t END, '^\s+|\s+$', '', 'g') AS c FROM r
), f AS (
    SELECT id, starts_with(c, '{{') AND json_valid(c) AS fine, CASE WHEN starts_with(c, '{{') AND json_valid(c) THEN c ELSE '{{}}' END AS j FROM c
)
SELECT id, lower(coalesce(json_extract_string(j, '$.violates_policy'), 'false')) = 'true' AS label,
    coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5) AS confidence,
    coalesce(array_to_string(json_extract_string(j, '$.key_signals[*]'), '|'), '') AS key_signals,
    CASE WHEN fine THEN coalesce(json_extract_string(j, '$.reasoning'), '') ELSE 'Parse error: not a JSON object' END AS reasoning
FROM f"""


@query("parse_model_json", PARSE_SQL)
def parse_model_json(spark, sf):
    df = spark.createDataFrame(RESPONSES, "id int, raw_response string")
    return classify.parse_responses(df).drop("raw_response").withColumn("key_signals", F.array_join("key_signals", "|"))


def _texts(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", "text")


@query("prompt_build", "SELECT conv_id, turn, 'Content: ' || coalesce(text, '') AS user_prompt FROM conversations")
def prompt_build(spark, sf):
    return classify.user_prompts(_texts(spark, sf), "zero_shot").drop("text")


@query("offline_classify")
def offline_classify(spark, sf):
    return rounded(classify.HarmClassifier(spark).batch_classify(_texts(spark, sf), "platform_abuse").drop("timestamp"))


WORDS = "[" + ", ".join(f"'{w}'" for w in classify.OfflineBackend().words) + "]"
# words of the prompt; the answer has four keys, at least one signal or an empty list, and a reason of two words
FIXED_WORDS = len((classify.system_prompt("platform_abuse") + "Content: ").split())
OFFLINE_SQL = f"""o AS (
    SELECT conv_id, turn, text, {FIXED_WORDS} + len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n_in, len(list_filter({WORDS}, lambda w: list_contains(regexp_extract_all(lower(coalesce(text, '')), '\\S+'), w))) AS found
    FROM conversations
)"""


@query("usage_summary", f"WITH {OFFLINE_SQL} SELECT 'offline' AS provider, 'word-list' AS model, count(*) AS calls, sum(n_in)::BIGINT AS input_tokens, sum(8 + greatest(1, found))::BIGINT AS output_tokens, 0.0::DOUBLE AS cost_usd, 0.0::DOUBLE AS cost_per_1k FROM o")
def usage_summary(spark, sf):
    return rounded(classify.usage_summary(classify.HarmClassifier(spark).batch_classify(_texts(spark, sf), "platform_abuse")))


@query("mode_comparison", f"WITH {OFFLINE_SQL} SELECT conv_id, turn, found > 0 AS zero_shot_label, found > 0 AS few_shot_label, true AS agree FROM o")
def mode_comparison(spark, sf):
    ids, classifier = ("conv_id", "turn"), classify.HarmClassifier(spark)
    zero, few = (classifier.batch_classify(_texts(spark, sf), "platform_abuse", mode, id_cols=ids) for mode in classify.MODES)
    return classify.compare_modes(zero, few, list(ids)).select(*ids, "zero_shot_label", "few_shot_label", "agree")


@query("hash_uniform_draw", f"SELECT event_id, {_r(adapters._u('event_id', 'x'), 'u')} FROM events")
def hash_uniform_draw(spark, sf):
    return rounded(read(spark, sf, "events").select("event_id", hash_uniform(F.col("event_id"), "x").alias("u")))

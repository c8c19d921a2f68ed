import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import actors, bayes, calibration, classify, funnel, monitor, networks, sampling, simulate, thresholds
from tidemark.operators.sampling import StratifiedHarmSampler
from tidemark.plans import enforcement_gap, rollup, sampling_frame


# ---- sampling design ----


def test_srs_sizes(spark):
    s = StratifiedHarmSampler(spark)
    assert 7000 <= s.minimum_sample_size_srs(0.05, 0.005) <= 8000
    assert 3500 <= s.minimum_sample_size_srs(0.001, 0.001) <= 4000


@pytest.mark.parametrize("strategy", sampling.STRATEGIES)
def test_designs(spark, strategy):
    d = StratifiedHarmSampler(spark).design_sample(1_000_000, 0.01, 0.005, strategy=strategy)
    assert d.n_total == sum(d.allocation.values()) and d.half_width > 0
    high = d.allocation["high_risk"] / d.n_total
    assert {"proportional": high < 0.12, "neyman": high > 0.2, "risk_stratified": high > 0.55}[strategy]
    assert d.summary_table(spark).count() == 2


def test_single_stratum_and_unknown_strategy(spark):
    s = StratifiedHarmSampler(spark)
    assert s.design_sample(10_000, 0.05, 0.02, {"all": 1.0}).allocation.keys() == {"all"}
    with pytest.raises(ValueError):
        s.design_sample(10_000, 0.05, 0.02, strategy="banana")


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("w", (F.col("id") % 7).cast("double"))
    for draw in (lambda d: sampling.srs(d, "id", 50, "a"), lambda d: sampling.weighted_sample(d, "id", F.col("w"), 50, "a")):
        assert {r.id for r in draw(df).collect()} == {r.id for r in draw(df.repartition(7)).collect()}
    assert all(r.w > 0 for r in sampling.weighted_sample(df, "id", F.col("w"), 900).collect())


def test_sampling_frame_edges(spark):
    rows = [(str(k), "a", "high" if k < 3 else None, 0.5, "x", None) for k in range(10)]
    items = spark.createDataFrame(rows, "item_id string, actor_id string, risk_tier string, classifier_score double, classifier_label string, reviewed_at timestamp").withColumn("week", F.to_date(F.lit("2025-01-06")))
    frame = sampling_frame.sampling_frame(items, "2025-01-06", 10)
    assert {r.stratum: r.n for r in sampling_frame.frame_counts(frame).collect()} == {"high_risk": 3, "low_risk": 1}
    assert sampling_frame.weight_range(frame).first().asDict() == {"min_weight": 1.0, "max_weight": 7.0}
    assert sampling_frame.sampling_frame(items.limit(0), "2025-01-06").count() == 0


# ---- thresholds and calibration ----


def scored(spark, n=400, seed=3, ties=20):
    rng = random.Random(seed)
    rows = [(round(rng.random() * ties) / ties, rng.random() < 0.3) for _ in range(n)] + [(None, True), (0.5, None)]
    return rows, spark.createDataFrame(rows, "score double, label boolean")


def test_auc_and_ap_by_brute_force(spark):
    rows, df = scored(spark)
    pos, neg = [s for s, y in rows if y and s is not None], [s for s, y in rows if y is False]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert thresholds.roc_auc(df).first()[0] == pytest.approx(auc)
    ap = 0.0
    for s in sorted({s for s, y in rows if s is not None and y is not None}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        ap += sum(p == s for p in pos) / len(pos) * tp / (tp + fp)
    assert thresholds.average_precision(df).first()[0] == pytest.approx(ap)
    one = df.filter("label")
    assert thresholds.roc_auc(one).first()[0] is None


def test_sweep_equals_one_by_one(spark):
    _, df = scored(spark)
    marks = spark.createDataFrame([(t / 10,) for t in range(-1, 12)], "threshold double")
    swept = {r.threshold: r for r in thresholds.sweep(df, marks).collect()}
    for t, r in swept.items():
        assert (r.tp, r.fp, r.tn, r.fn) == tuple(thresholds.metrics_at(df, t).first())[:4]
    best = thresholds.best_by_f1(thresholds.sweep(df, marks)).first()
    assert best.f1 == max(r.f1 for r in swept.values())


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, False), (0.3, True), (0.6, True), (0.7, False), (1.0, True), (None, True)], "score double, label boolean")
    bins = {r.score: (r.a, r.b) for r in df.select("score", calibration.left_closed_bin(F.col("score")).alias("a"), calibration.right_closed_bin(F.col("score")).alias("b")).collect()}
    assert bins[0.3] == (2, 2) and bins[0.0] == (0, 0) and bins[1.0] == (None, 9)
    wrong = spark.range(500).select(F.lit(0.99).alias("score"), F.lit(False).alias("label"))
    assert calibration.ClassifierCalibrator().expected_calibration_error(wrong) > 0.5


def test_platt_and_isotonic(spark):
    df = simulate.miscalibrated_scores(spark, 4000, 0.3)
    c = calibration.ClassifierCalibrator()
    before = c.expected_calibration_error(df)
    assert c.expected_calibration_error(c.platt_scale(df).drop("score").withColumnRenamed("calibrated", "score")) < before
    iso = c.isotonic_regression(df).orderBy("score").toPandas()
    assert (np.diff(iso["calibrated"]) >= -1e-12).all()
    for method in ("platt_transform", "isotonic_transform"):
        with pytest.raises(RuntimeError):
            getattr(calibration.ClassifierCalibrator(), method)(df)


def test_error_propagation():
    c = calibration.ClassifierCalibrator()
    a = c.propagate_calibration_error_to_prevalence(0.12, 0.004, 0.82, 0.06, 5000)
    assert (a["full_width"], a["amplification"]) == pytest.approx((0.30874, 17.416), abs=2e-3)
    assert c.propagate_calibration_error_to_prevalence(0.0, 0.02, 0.85, 0.05, 5000)["amplification"] == pytest.approx(1)
    with pytest.raises(ValueError):
        c.propagate_calibration_error_to_prevalence(0.1, 0.1, 0.5, 0.5, 100)


# ---- actors and networks ----

FIVE = [
    ("a0", 365, 1, 4, 100, 0.95, 120.0, 0.02, 0, False),
    ("a1", 730, 2, 8, 500, 0.90, 200.0, 0.05, 0, True),
    ("a2", 5, 200, 800, 900, 0.10, 30.0, 0.80, 2, False),
    ("a3", 1, 500, 2000, 2100, 0.05, 25.0, 0.95, 5, False),
    ("a4", 1000, 3, 12, 3000, 0.80, 150.0, 0.10, 0, True),
]
ACTOR_SCHEMA = "actor_id string, account_age_days long, post_count_7d long, post_count_30d long, post_count_total long, unique_content_ratio double, avg_content_length double, api_usage_fraction double, prior_enforcement_count long, is_verified boolean"


def test_actor_scores(spark):
    got = {r.actor_id: r for r in actors.ActorFeatureExtractor().compute_risk_scores(spark.createDataFrame(FIVE, ACTOR_SCHEMA)).collect()}
    assert all(0 <= r.composite_score <= 1 for r in got.values())
    assert got["a3"].composite_score > got["a0"].composite_score and got["a3"].newness_score > 0.8 and got["a4"].newness_score < 0.2
    weights = actors.ActorFeatureExtractor().stratum_sampling_weights(actors.ActorFeatureExtractor().compute_risk_scores(spark.createDataFrame(FIVE, ACTOR_SCHEMA)))
    assert weights.agg(F.sum("sampling_weight")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        actors.ActorFeatureExtractor({"velocity": 0.5})


def greedy(n, edges, least):
    near = {i: {i} for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seed = {}
    for i in range(n):
        if i not in seed and len(near[i]) >= least:
            for j in sorted(near[i]):
                seed.setdefault(j, i)
    return seed


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_equal_the_scan(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(70)}) if seed else [(i, i + 1) for i in range(9)]
    nodes = spark.range(n)
    got = networks.leader_clusters(nodes, spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, sim double"), 3)
    assert {r.id: r.seed for r in got.collect()} == greedy(n, edges, 3)


def test_networks(spark):
    scored_actors = actors.ActorFeatureExtractor().compute_risk_scores(simulate.simulate_actor_corpus(spark, 300, 0.1, 0.6))
    out, report = networks.detect_coordination_networks(scored_actors, 0.97, 3)
    assert report.count() >= 1 and all(r.size >= 3 and -1 <= r.avg_similarity <= 1 + 1e-9 for r in report.collect())
    assert out.filter("network_cluster_id >= 0").count() >= 3
    empty, none = networks.detect_coordination_networks(spark.createDataFrame([("x",)], "actor_id string"))
    assert empty.first().network_cluster_id == -1 and none.count() == 0


def unit_rows(seed, n, d):
    """Unit vectors of which some are equal and some far from all others, with string ids not in row order."""
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, d)))
    x[: n // 5] = x[0]
    x[-6:] = -np.eye(d)[:6]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(f"a{k}", [float(c) for c in x[k]]) for k in rng.permutation(n)]


def edges_of(rows, threshold):
    return sorted((a, b, round(sim, 9)) for a, x in rows for b, y in rows if a < b and round(sim := float(np.dot(x, y)), 12) >= threshold)


@pytest.mark.parametrize("at_once", [7, 8192])
def test_vector_leaders_equal_the_scan_over_edges(spark, at_once):
    rows = unit_rows(0, 90, 6)
    ids = sorted(a for a, _ in rows)
    edges = [(ids.index(a), ids.index(b)) for a, b, _ in edges_of(rows, 0.8)]
    odd = [(None, dict(rows)["a0"]), ("zz", [math.nan] * 6)]
    got = {r.id: r.seed for r in networks.vector_leaders(spark.createDataFrame(rows + odd, "id string, v array<double>"), 0.8, 3, at_once).collect()}
    want = {ids[k]: ids[s] for k, s in greedy(len(ids), edges, 3).items()}
    assert len(set(want.values())) > 3 and len(want) < len(ids)
    assert got.pop(None) == want["a0"] and got == want


def test_networks_form_no_pairs(spark, monkeypatch):
    scored = actors.ActorFeatureExtractor().compute_risk_scores(simulate.simulate_actor_corpus(spark, 300, 0.1, 0.6))
    monkeypatch.setattr(networks, "similarity_edges", lambda *a, **k: pytest.fail("pairs of actors grow with their square"))
    assert networks.detect_coordination_networks(scored, 0.97, 3)[1].count() >= 1


@pytest.mark.parametrize("threshold", [0.8, -2.0])
def test_edges_equal_all_pairs_and_shuffle_vectors_once(spark, threshold):
    rows = unit_rows(1, 90, 6)
    edges = networks.similarity_edges(spark.createDataFrame([*rows, (None, rows[0][1])], "id string, v array<double>"), threshold, block_rows=16)
    assert sorted((r.src, r.dst, round(r.sim, 9)) for r in edges.collect()) == edges_of(rows, threshold)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


# ---- monitors, evidence, funnel ----


def test_cusum_equals_the_recursion(spark):
    rng = random.Random(1)
    x = [0.01 + rng.gauss(0, 0.004) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(x)), "t int, x double")
    mu, k = sum(x[:8]) / 8, 0.002
    for lower in (False, True):
        level, want = 0.0, [0.0]
        for v in x[1:]:
            level = max(0.0, level + (mu - v if lower else v - mu) - k)
            want.append(level)
        got = [r.cusum for r in monitor.cusum(df, "x", "t", k, 0.01, lower=lower).orderBy("t").collect()]
        assert got == pytest.approx(want, abs=1e-12)


def test_short_series(spark):
    df = spark.createDataFrame([(1, 0.5)], "t int, x double")
    assert monitor.rolling_zscore(df, "x", "t").first().anomaly is False
    assert monitor.baseline_zscore(df, "x", "t").first().z is None
    assert monitor.last_against_prior(df, ["x"], "t").first().x_prior is None


def test_bayes_edges(spark):
    df = spark.createDataFrame([(0.1, [(0.0, 0.0, True)]), (0.1, None)], "prior double, signals array<struct<tpr:double,fpr:double,present:boolean>>")
    assert [r[0] for r in df.select(bayes.sequential(F.col("prior"), F.col("signals"))).collect()] == [0.1, 0.1]


def test_lights(spark):
    row = spark.range(1).select(*[funnel.light("gap_rate_pct", F.lit(v).cast("double")).alias(f"v{k}") for k, v in enumerate((10, 25, 35, None))], funnel.light("flag_rate_pct", F.lit(1.0)).alias("x")).first()
    assert tuple(row) == ("green", "amber", "red", "white", "white")


# ---- enforcement ----


def test_enforcement_window_and_fan_out(spark):
    items = spark.sql("SELECT * FROM VALUES ('i0','a',TIMESTAMP'2025-01-06 00:00:00','high',0.9,'v',DATE'2025-01-06'), ('i1','a',TIMESTAMP'2025-01-06 00:00:00','high',0.5,'v',DATE'2025-01-06'), ('i2','b',TIMESTAMP'2025-01-06 00:00:00',NULL,0.6,'v',DATE'2025-01-06'), ('i3','b',TIMESTAMP'2025-01-06 00:00:00','low',0.49,'v',DATE'2025-01-06') t(item_id,actor_id,created_at,risk_tier,classifier_score,classifier_label,week)")
    who = spark.sql("SELECT 'a' AS actor_id, 'high' AS risk_tier, 0.7D AS composite_risk_score")
    acts = spark.sql("SELECT * FROM VALUES ('x','i0','v','remove','human',TIMESTAMP'2025-01-13 23:00:00'), ('y','i0','v','warn','classifier',TIMESTAMP'2025-01-20 00:00:00'), ('z','i1','v','warn','human',TIMESTAMP'2025-01-14 00:00:00'), ('q','i2','w','warn','human',TIMESTAMP'2025-01-06 01:00:00') t(action_id,item_id,harm_vertical,action_type,actioned_by,actioned_at)")
    found = enforcement_gap.detections(items, who, "2025-01-06", "2025-01-06")
    one = {r.item_id: r for r in enforcement_gap.deduplicated(enforcement_gap.matched(found, acts)).collect()}
    assert set(one) == {"i0", "i1", "i2"}
    assert one["i0"].was_enforced and one["i0"].action_types_taken == "remove,warn" and one["i0"].min_hours_to_action == 191
    assert not one["i1"].was_enforced and one["i1"].min_hours_to_action == 192
    assert not one["i2"].was_enforced and one["i2"].action_types_taken is None and one["i2"].actor_risk_tier is None
    report = enforcement_gap.enforcement_gap(items, who, acts, "2025-01-06", "2025-01-06")
    assert {r.trend_flag for r in report.collect()} == {"STABLE"}


def test_rollup_keeps_missing_adjustments_null(spark):
    gold = spark.sql("SELECT DATE'2025-01-06' AS week, 'v' AS harm_vertical, true AS true_harmful, true AS predicted_harmful, 2.0D AS sample_weight, TIMESTAMP'2025-01-07 00:00:00' AS reviewed_at")
    items = spark.sql("SELECT DATE'2025-01-06' AS week, 'w' AS classifier_label, 0.9D AS classifier_score")
    row = rollup.prevalence_rollup(items, gold).first()
    assert row.ht_prevalence == 1.0 and row.adjusted_prevalence is None and row.adj_ci_upper is None
    assert rollup.prevalence_rollup(items.limit(0), gold.limit(0)).count() == 0


# ---- simulation ----


def test_simulation_config():
    for bad in ({"true_prevalence": 0}, {"tpr_a": 0.01}, {"fpr_b": 0.9}):
        with pytest.raises(ValueError):
            simulate.SimulationConfig(**bad)


def test_corpus_is_reproducible(spark):
    config = simulate.SimulationConfig(n_corpus=3000, true_prevalence=0.1)
    a = simulate.generate_corpus(spark, config).orderBy("item_id").toPandas()
    b = simulate.generate_corpus(spark, config).repartition(3).orderBy("item_id").toPandas()
    assert a.equals(b)
    assert abs(a["true_label"].mean() - 0.1) < 0.03 and a["score_a"].between(0, 1).all()
    assert a[a["true_label"]]["score_a"].mean() > a[~a["true_label"]]["score_a"].mean() + 0.3


def test_coverage(spark):
    s = {r.method: r for r in simulate.coverage_summary(simulate.run_coverage_simulation(spark, simulate.SimulationConfig(true_prevalence=0.05), 100, 1000), 0.05).collect()}
    assert s["direct"].coverage > 0.85 and s["adjusted"].coverage > 0.85


# ---- classification ----


def test_batch_errors_become_rows(spark):
    class Flaky:
        def complete(self, system, user):
            if "bad" in user:
                raise RuntimeError("down") if "worse" in user else classify.ProviderError("down")
            return '{"violates_policy": true, "confidence": 0.7}', 3, 2

    c = classify.HarmClassifier(spark, backend=Flaky(), sleep=lambda s: None, requests_per_minute=1e9)
    got = {r.text: r for r in c.batch_classify(spark.createDataFrame([("good",), ("bad one",), ("",)], "text string"), "platform_abuse").collect()}
    assert got["good"].label is True and got["good"].cost_usd == pytest.approx(3 * 3e-6 + 2 * 15e-6)
    assert got["bad one"].label is None and "3 attempts" in got["bad one"].error
    for args in (("nope", "zero_shot"), ("platform_abuse", "nope")):
        with pytest.raises(ValueError):
            c.batch_classify(spark.createDataFrame([("x",)], "text string"), *args)
    with pytest.raises(ValueError):
        classify.HarmClassifier(spark, provider="nobody")


def test_parsing(spark):
    from tidemark.plans.catalogue import RESPONSES

    got = {r.id: r for r in classify.parse_responses(spark.createDataFrame(RESPONSES, "id int, raw_response string")).collect()}
    assert (got[1].label, got[1].confidence, got[1].key_signals, got[1].reasoning) == (True, 0.9, ["a b"], "r")
    assert (got[2].label, got[2].confidence, got[2].reasoning) == (False, 0.2, "")
    assert got[3].reasoning.startswith("Parse error") and got[4].reasoning.startswith("Parse error") and got[7].confidence == 0.5
    assert got[5].label is True and got[5].confidence == 0.5 and got[6].label is False


def test_few_shot_prompt(spark):
    examples = spark.createDataFrame([(1, "b", True, "r2"), (0, "a", False, "r1")], "position int, text string, label boolean, reasoning string")
    prompt = classify.user_prompts(spark.createDataFrame([("t",)], "text string"), "few_shot", examples).first().user_prompt
    assert prompt.index("Content: a") < prompt.index("Content: b") < prompt.index("Content: t")

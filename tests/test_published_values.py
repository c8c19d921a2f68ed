"""Values that are known apart from this code: published figures, and the moments of the laws that simulations follow."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, classify, estimators, experiment, networks, simulate
from tidemark.operators.actors import ActorFeatureExtractor
from tidemark.streaming import weekly


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chapman_by_hand(spark):
    # (80 + 1) (75 + 1) / (60 + 1) - 1 = 99.918 of 1000
    got = one(spark, estimators.chapman(F.lit(80), F.lit(75), F.lit(60), F.lit(1000)))
    assert got.estimate == pytest.approx(0.0999180328) and got.method == "chapman_capture_recapture"
    assert estimators.PrevalenceEstimator().chapman(80, 75, 60, 1000).estimate == pytest.approx(0.0999180328)


@pytest.mark.parametrize("ece,pi,want", [(0.12, 0.004, 17.42), (0.02, 0.004, 3.07), (0.05, 0.001, 7.46), (0.05, 0.15, 4.15)])
def test_amplification(spark, ece, pi, want):
    got = one(spark, calibration.propagated(F.lit(ece), F.lit(pi), F.lit(0.82), F.lit(0.06), F.lit(5000)))
    assert got.amplification == pytest.approx(want, abs=0.006)


def test_power_from_the_review_budget(spark):
    grid = spark.createDataFrame([(0.005, 0.004, 2000.0), (0.005, 0.005, 2000.0)], "baseline double, treatment double, review_budget double")
    first, none = experiment.power_prevalence_test(grid).collect()
    naive = (1.959963985 + 0.841621234) ** 2 * (0.005 * 0.995 + 0.004 * 0.996) / 0.001**2
    assert first.n_naive == np.ceil(naive) and first.inflation == pytest.approx(1 + 2 * naive / 2000, rel=1e-6)
    assert first.n_per_arm == pytest.approx(naive * first.inflation, rel=1e-6) and none.n_per_arm is None


def test_scores_follow_their_beta_laws(spark):
    config = simulate.SimulationConfig(n_corpus=40_000, true_prevalence=0.5)
    rows = simulate.generate_corpus(spark, config).toPandas()
    for column, t, f in (("score_a", 0.80, 0.05), ("score_b", 0.75, 0.03)):
        for label, r in ((True, t), (False, f)):
            x, a, b = rows[rows["true_label"] == label][column], 6 * r + 1, 6 * (1 - r) + 1
            assert x.mean() == pytest.approx(a / (a + b), abs=0.01)
            assert x.var() == pytest.approx(a * b / (a + b) ** 2 / (a + b + 1), rel=0.06)
    assert rows[["score_a", "score_b"]].corr().iloc[0, 1] > 0.3  # both follow the label


def test_arms_differ_by_prevalence_alone(spark):
    rows = simulate.simulate_arms(spark, 20_000, {"control": 0.3, "treatment": 0.1}).toPandas()
    for arm, pi in (("control", 0.3), ("treatment", 0.1)):
        here = rows[rows["arm"] == arm]
        assert here["harmful"].mean() == pytest.approx(pi, abs=0.02)
        for harmful, r in ((True, 0.90), (False, 0.05)):
            x = here[here["harmful"] == harmful]["score"]
            assert x.mean() == pytest.approx(r, abs=0.01) and x.var() == pytest.approx(r * (1 - r) / 11, rel=0.15)


def test_weekly_rates(spark):
    rows = simulate.weekly_platform(spark).orderBy("week_number").toPandas()
    assert rows[rows["spike"]]["week_number"].tolist() == list(range(26, 36)) and len(rows) == 52
    p = rows["true_prevalence"].mean()
    assert rows["n1"].mean() / 2000 == pytest.approx(0.82 * p + 0.04 * (1 - p), rel=0.06)
    assert rows["n2"].mean() / 2000 == pytest.approx(0.74 * p + 0.03 * (1 - p), rel=0.06)


def test_actor_populations(spark):
    rows = simulate.simulate_actor_corpus(spark, 4000, 0.2, 0.5).toPandas()
    assert rows["is_bad_actor"].sum() == 800 and rows["is_network_actor"].sum() == 400 and rows["actor_id"].is_unique
    good, net = rows[~rows["is_bad_actor"]], rows[rows["is_network_actor"]]
    assert good["account_age_days"].between(60, 1999).all() and net["account_age_days"].between(0, 19).all()
    assert good["unique_content_ratio"].mean() == pytest.approx(0.8, abs=0.02) and net["prior_enforcement_count"].mean() == pytest.approx(0.3, abs=0.1)
    again = simulate.simulate_actor_corpus(spark, 4000, 0.2, 0.5).repartition(7).toPandas()
    assert rows.sort_values("actor_id").reset_index(drop=True).equals(again.sort_values("actor_id").reset_index(drop=True))


def test_coverage_trials_keep_their_intervals(spark):
    config = simulate.SimulationConfig(n_corpus=5000, true_prevalence=0.05)
    rows = simulate.run_coverage_simulation(spark, config, 40, 500).toPandas()
    assert len(rows) == 40 and {f"{m}_{c}" for m in ("direct", "adjusted", "chapman") for c in ("estimate", "ci_lower", "ci_upper", "covered")} < set(rows.columns)
    assert ((rows["direct_ci_lower"] <= 0.05) & (rows["direct_ci_upper"] >= 0.05)).equals(rows["direct_covered"])


def greedy(vectors, threshold, least):
    """The scan itself, in order of ids."""
    ids = sorted(vectors)
    lo, hi = np.min(list(vectors.values()), axis=0), np.max(list(vectors.values()), axis=0)
    x = np.array([[(a - b) / (c - b) if c > b else 0.0 for a, b, c in zip(vectors[i], lo, hi)] for i in ids])
    norm = np.linalg.norm(x, axis=1)
    sim = x @ x.T / np.where(norm > 0, norm, 1)[:, None] / np.where(norm > 0, norm, 1)[None, :]
    cluster, n = dict.fromkeys(ids, -1), 0
    for k, i in enumerate(ids):
        near = [j for j, s in zip(ids, sim[k]) if round(s, 12) >= threshold]
        if cluster[i] == -1 and len(near) >= least:
            for j in near:
                cluster[j] = n if cluster[j] == -1 else cluster[j]
            n += 1
    return cluster


@pytest.mark.parametrize("copies", [1, 6])
def test_clusters_equal_the_scan(spark, copies):
    rows = simulate.simulate_actor_corpus(spark, 120, 0.3, 0.6)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("actor_id", F.concat_ws("-", "copy", "actor_id")).drop("copy")
    scored = ActorFeatureExtractor().compute_risk_scores(many).cache()
    want = greedy({r["actor_id"]: [r[c] for c in networks.FEATURES] for r in scored.collect()}, 0.98, 4)
    out, report = networks.detect_coordination_networks(scored, 0.98, 4)
    got = {r.actor_id: r.network_cluster_id for r in out.collect()}
    assert got == want and max(want.values()) > 0
    found = {r.cluster_id: r.size for r in report.collect()}
    assert found == {c: n for c in set(want.values()) - {-1} if (n := list(want.values()).count(c)) >= 4}


def test_network_actors_cluster_together(spark):
    scored = ActorFeatureExtractor().compute_risk_scores(simulate.simulate_actor_corpus(spark, 300, 0.1, 0.6))
    rows = networks.detect_coordination_networks(scored, 0.95, 3)[0].toPandas()
    network = rows[rows["is_network_actor"]]
    assert (network["network_cluster_id"] >= 0).mean() > 0.9 and network["network_cluster_id"].value_counts().iloc[0] >= 0.5 * len(network)


def test_offline_rows_say_so(spark):
    row = classify.HarmClassifier(spark).classify("a fake offer", "platform_abuse")
    assert (row["provider"], row["model"], row["cost_usd"]) == ("offline", "word-list", 0.0)
    assert isinstance(classify.HarmClassifier(spark, api_key="k").backend, classify.MessagesBackend)
    for provider in ("openai", "groq"):
        backend = classify.HarmClassifier(spark, provider, api_key="very-secret").backend
        assert isinstance(backend, classify.ChatBackend) and backend.url == classify.BASE_URLS[provider] and "very-secret" not in repr(backend)


def test_few_shot_needs_examples(spark):
    texts = spark.createDataFrame([("t",)], "text string")
    with pytest.raises(ValueError):
        classify.user_prompts(texts, "few_shot")

    class Echo:
        def complete(self, system, user):
            return json.dumps({"reasoning": user}), 1, 1

    for category in classify.POLICIES:
        prompt = classify.HarmClassifier(spark, backend=Echo(), requests_per_minute=1e9).classify("t", category, "few_shot")["reasoning"]
        assert all(text in prompt for text, *_ in classify.EXAMPLES[category]) and prompt.endswith("Content: t")


def streamed(spark, tmp_path, name, rows):
    rows.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))


def finished(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streaming_joins(spark, tmp_path):
    items = spark.sql("SELECT * FROM VALUES ('i1', 'a', TIMESTAMP'2025-01-06 01:00:00'), ('i2', 'b', TIMESTAMP'2025-01-07 01:00:00'), ('i3', 'z', TIMESTAMP'2025-03-07 01:00:00') t(item_id, actor_id, created_at)")
    actions = spark.sql("SELECT * FROM VALUES ('x', 'i1', 'remove', TIMESTAMP'2025-01-13 23:00:00'), ('y', 'i1', 'warn', TIMESTAMP'2025-01-15 01:00:00'), ('w', 'i3', 'warn', TIMESTAMP'2025-03-07 02:00:00') t(action_id, item_id, action_type, actioned_at)")
    static = spark.createDataFrame([("a", "high")], "actor_id string, risk_tier string")
    tiers = {r.item_id: r.actor_risk_tier for r in finished(weekly.with_actor_tiers(streamed(spark, tmp_path, "t", items), static), "tiers")}
    assert tiers == {"i1": "high", "i2": None, "i3": None}
    joined = finished(weekly.responses(streamed(spark, tmp_path, "i", items), streamed(spark, tmp_path, "a", actions)), "responses")
    assert {(r.item_id, r.action_id) for r in joined} >= {("i1", "x"), ("i2", None), ("i3", "w")} and ("i1", "y") not in {(r.item_id, r.action_id) for r in joined}


def test_weekly_ht_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('v', true, 2D, TIMESTAMP'2025-01-06 01:00:00'), ('v', false, 6D, TIMESTAMP'2025-01-12 23:00:00'), ('v', true, 1D, NULL), ('v', true, 1D, TIMESTAMP'2025-03-12 00:00:00') t(harm_vertical, true_harmful, sample_weight, reviewed_at)")
    got = finished(weekly.weekly_ht(streamed(spark, tmp_path, "g", rows)), "ht")
    assert [(str(r.week), r.n_reviewed, r.ht_prevalence) for r in got] == [("2025-01-06", 2, 0.25)]


def test_classification_holds_small_batches(spark):
    session = spark.newSession()
    classify.HarmClassifier(session).batch_classify(session.createDataFrame([("t",)], "text string"), "platform_abuse")
    assert session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1024"

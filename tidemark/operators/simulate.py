"""Synthetic data: every draw is a hash of (seed, id, purpose), so any partitioning gives the same data.

Beta and other variates come from seeded NumPy generators, one per block of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import hash_uniform, ratio
from tidemark.operators import estimators


@dataclass(frozen=True)
class SimulationConfig:
    n_corpus: int = 100_000
    true_prevalence: float = 0.01
    tpr_a: float = 0.80
    fpr_a: float = 0.05
    tpr_b: float = 0.75
    fpr_b: float = 0.03
    random_seed: int = 42
    harm_category: str = "generic"

    def __post_init__(self):
        if not 0 < self.true_prevalence < 1:
            raise ValueError("true_prevalence must lie strictly between 0 and 1")
        for name, t, f in (("a", self.tpr_a, self.fpr_a), ("b", self.tpr_b, self.fpr_b)):
            if not 0 <= f < t <= 1:
                raise ValueError(f"system {name}: need 0 <= fpr < tpr <= 1")


def _draw(key: Column, seed, purpose: str) -> Column:
    return hash_uniform(F.concat_ws(":", F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string"), key.cast("string")), f":{purpose}")


def detections(ids: DataFrame, config: SimulationConfig, seed=None) -> DataFrame:
    """``ids`` (item_id) with true_label, detected_a, detected_b."""
    s = config.random_seed if seed is None else seed
    key = F.col("item_id")
    truth = _draw(key, s, "y") < config.true_prevalence
    hit = lambda t, f, p: _draw(key, s, p) < F.when(F.col("true_label"), t).otherwise(f)
    return ids.withColumn("true_label", truth).withColumn("detected_a", hit(config.tpr_a, config.fpr_a, "a")).withColumn("detected_b", hit(config.tpr_b, config.fpr_b, "b"))


_BLOCK = 1024


def _by_block(ids: np.ndarray, draw) -> np.ndarray:
    """Draws of a block of ids at a time, each from a generator of its own, so that any partitioning gives the same."""
    out = None
    for block in np.unique(ids // _BLOCK):
        here, made = np.flatnonzero(ids // _BLOCK == block), draw(int(block))
        out = np.empty(len(ids), dtype=made.dtype) if out is None else out
        out[here] = made[ids[here] % _BLOCK]
    return np.empty(0) if out is None else out


def _beta_scores(columns: list[tuple[str, float, float]], seed: int):
    """Scores by Beta(6 r + 1, 6 (1 - r) + 1), r the system's rate for the item's label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, truth = batch["item_id"].to_numpy(), batch["true_label"].to_numpy()
            for k, (name, *rates) in enumerate(columns):
                high, low = (_by_block(ids, lambda block, r=r, j=j: np.random.default_rng((seed, k, j, block)).beta(6 * r + 1, 6 * (1 - r) + 1, _BLOCK)) for j, r in enumerate(rates))
                batch[name] = np.where(truth, high, low)
            yield batch

    return run


def generate_corpus(spark: SparkSession, config: SimulationConfig) -> DataFrame:
    """item_id, true_label, score_a, score_b, detected_a, detected_b, harm_category."""
    rows = detections(spark.range(config.n_corpus).withColumnRenamed("id", "item_id"), config)
    scores = _beta_scores([("score_a", config.tpr_a, config.fpr_a), ("score_b", config.tpr_b, config.fpr_b)], config.random_seed)
    out = rows.mapInPandas(scores, "item_id long, true_label boolean, detected_a boolean, detected_b boolean, score_a double, score_b double")
    return out.select("item_id", "true_label", "score_a", "score_b", "detected_a", "detected_b", F.lit(config.harm_category).alias("harm_category"))


def simulate_detection_systems(corpus: DataFrame, config: SimulationConfig, sample_size: int | None = None) -> tuple[DataFrame, dict]:
    """An optional hash sample, and the true parameters with the number of true positives in the corpus."""
    out = corpus
    if sample_size is not None:
        out = corpus.orderBy(F.md5(F.concat(F.col("item_id").cast("string"), F.lit(f":{config.random_seed + 1}"))), "item_id").limit(sample_size)
    truth = {"true_prevalence": config.true_prevalence, "tpr_a": config.tpr_a, "fpr_a": config.fpr_a, "tpr_b": config.tpr_b, "fpr_b": config.fpr_b}
    return out, truth | {"n_true_positives": corpus.agg(F.count_if("true_label").alias("n")).first()["n"]}


def run_coverage_simulation(spark: SparkSession, config: SimulationConfig, n_trials: int = 500, sample_size: int = 2000, confidence_level: float = 0.95, tpr_se: float = 0.02, fpr_se: float = 0.01) -> DataFrame:
    """One row a trial: three estimates with their intervals, and whether each covers the truth.

    Every trial has a corpus of ``n_corpus`` items of its own, of which a simple random sample is drawn (the least hashes of the trial's seed and the item).
    Labels and detections depend on seed and item alone, so they are computed for the sampled items. One aggregation serves all trials.
    """
    n, tasks = min(sample_size, config.n_corpus), spark.sparkContext.defaultParallelism
    grid = spark.range(n_trials * config.n_corpus, numPartitions=4 * tasks).select((F.col("id") / config.n_corpus).cast("long").alias("trial"), (F.col("id") % config.n_corpus).alias("item_id"))
    drawn = detections(simple_samples(grid, config, n), config, F.col("trial") + config.random_seed)
    counts = drawn.groupBy("trial").agg(F.count_if("true_label").alias("k"), F.count_if("detected_a").alias("n1"), F.count_if("detected_b").alias("n2"), F.count_if(F.col("detected_a") & F.col("detected_b")).alias("m"))
    size, pi = F.lit(n), F.lit(config.true_prevalence)
    three = {
        "direct": estimators.wilson(F.col("k"), size, confidence_level),
        "adjusted": estimators.rogan_gladen(F.col("n1") / size, F.lit(config.tpr_a), F.lit(config.fpr_a), size, F.lit(tpr_se), F.lit(fpr_se), confidence_level),
        "chapman": estimators.chapman(F.col("n1"), F.col("n2"), F.col("m"), size, confidence_level),
    }
    columns = [c for name, e in three.items() for c in (e["estimate"].alias(f"{name}_estimate"), e["ci_lower"].alias(f"{name}_ci_lower"), e["ci_upper"].alias(f"{name}_ci_upper"), pi.between(e["ci_lower"], e["ci_upper"]).alias(f"{name}_covered"))]
    return counts.select("trial", pi.alias("true_prevalence"), *columns)


def simple_samples(grid: DataFrame, config: SimulationConfig, n: int) -> DataFrame:
    """``n`` items of each trial's corpus, those with the least hashes. ``grid``: trial, item_id (below n_corpus).

    Hashes far above the expected n-th least are left out before the rows of a trial are ranked; a trial short of ``n`` then would be an error, not a smaller sample.
    """
    from pyspark.sql.window import Window

    share = n / config.n_corpus
    bound = min(1.0, share + 12 * (share / config.n_corpus) ** 0.5)  # twelve standard deviations
    key = _draw(F.col("item_id"), F.col("trial") + config.random_seed + 1, "s")
    near = grid.withColumn("key", key).filter(F.col("key") < F.lit(bound if bound < 1 else 2.0))
    order = Window.partitionBy("trial")
    ranked = near.withColumn("place", F.row_number().over(order.orderBy("key", "item_id"))).withColumn("held", F.count("*").over(order))
    whole = F.when(F.col("held") >= n, True).otherwise(F.raise_error(F.lit("a trial holds fewer items than its sample")).cast("boolean"))
    return ranked.filter((F.col("place") <= n) & whole).select("trial", "item_id")


def coverage_summary(trials: DataFrame, true_prevalence: float) -> DataFrame:
    """method, coverage, rmse, bias."""
    pi = F.lit(true_prevalence)
    stats = [F.struct(F.lit(m).alias("method"), F.avg(F.col(f"{m}_covered").cast("double")).alias("coverage"), F.sqrt(F.avg(F.pow(F.col(f"{m}_estimate") - pi, F.lit(2.0)))).alias("rmse"), F.avg(F.col(f"{m}_estimate") - pi).alias("bias")) for m in ("direct", "adjusted", "chapman")]
    return trials.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def synthetic_flags(spark: SparkSession, n: int, prevalences: dict[str, float], seed: int = 42) -> DataFrame:
    """item_id and one boolean column a category."""
    return spark.range(n).withColumnRenamed("id", "item_id").select("item_id", *[(_draw(F.col("item_id"), seed, c) < p).alias(c) for c, p in prevalences.items()])


def miscalibrated_scores(spark: SparkSession, n: int, prevalence: float, seed: int = 42) -> DataFrame:
    """label and a score drawn too near to the ends, within [.01, .99]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, score = batch["item_id"].to_numpy(), np.empty(len(batch))
            for block in np.unique(ids // 1024):
                rng, here = np.random.default_rng((seed, int(block))), np.flatnonzero(ids // 1024 == block)
                high, low = rng.beta(6, 1.5, 1024), rng.beta(1.5, 6, 1024)
                at = ids[here] % 1024
                score[here] = np.where(batch["label"].to_numpy()[here], high[at], low[at])
            yield batch.assign(score=score.clip(0.01, 0.99))

    rows = spark.range(n).withColumnRenamed("id", "item_id").withColumn("label", _draw(F.col("item_id"), seed, "y") < prevalence)
    return rows.mapInPandas(run, "item_id long, label boolean, score double")


#: Per population, the range or law of every column (kind, parameters).
POPULATIONS = {
    "good": {"account_age_days": ("int", 60, 2000), "post_count_7d": ("int", 0, 15), "post_count_30d": ("int", 5, 50), "post_count_total": ("int", 20, 1500), "unique_content_ratio": ("beta", 8, 2, 0.2, 1.0), "avg_content_length": ("normal", 160, 60, 30, 600), "api_usage_fraction": ("beta", 1, 9, 0.0, 1.0), "prior_enforcement_count": ("poisson", 0.04), "is_verified": ("bernoulli", 0.05)},
    "solo": {"account_age_days": ("int", 1, 45), "post_count_7d": ("int", 80, 600), "post_count_30d": ("int", 150, 1500), "post_count_total": ("int", 200, 3000), "unique_content_ratio": ("beta", 2, 8, 0.01, 0.5), "avg_content_length": ("normal", 70, 25, 10, 250), "api_usage_fraction": ("beta", 6, 2, 0.3, 1.0), "prior_enforcement_count": ("poisson", 2.0), "is_verified": ("bernoulli", 0.0)},
    "network": {"account_age_days": ("int", 0, 20), "post_count_7d": ("int", 30, 250), "post_count_30d": ("int", 35, 300), "post_count_total": ("int", 35, 600), "unique_content_ratio": ("beta", 1, 12, 0.01, 0.2), "avg_content_length": ("normal", 55, 15, 10, 150), "api_usage_fraction": ("beta", 8, 1.5, 0.6, 1.0), "prior_enforcement_count": ("poisson", 0.3), "is_verified": ("bernoulli", 0.0)},
}


def simulate_actor_corpus(spark: SparkSession, n_actors: int = 10_000, bad_actor_fraction: float = 0.05, network_fraction: float = 0.40, random_seed: int = 42) -> DataFrame:
    """Three populations of actors in one table, in an order unrelated to them; ``true_label`` is 1 for bad ones."""
    n_bad = int(n_actors * bad_actor_fraction)
    n_network = int(n_bad * network_fraction)
    first_solo, first_network = n_actors - n_bad, n_actors - n_network
    number = F.col("number")
    kind = F.when(number < first_solo, "good").when(number < first_network, "solo").otherwise("network")
    rows = spark.range(n_actors).withColumnRenamed("id", "number").withColumn("kind", kind)

    def draw(rng: np.random.Generator, law: str, p: list) -> np.ndarray:
        if law == "int":
            return rng.integers(*p, size=_BLOCK)
        if law == "poisson":
            return rng.poisson(*p, size=_BLOCK)
        if law == "bernoulli":
            return rng.random(_BLOCK) < p[0]
        return np.clip(getattr(rng, law)(p[0], p[1], _BLOCK), p[2], p[3])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, kinds = batch["number"].to_numpy(), batch["kind"].to_numpy()
            made = pd.DataFrame({"actor_id": [f"actor_{k:06d}" for k in numbers]})
            for at, column in enumerate(POPULATIONS["good"]):
                values = [_by_block(numbers, lambda block, j=j, laws=laws: draw(np.random.default_rng((random_seed, at, j, block)), laws[column][0], laws[column][1:])) for j, laws in enumerate(POPULATIONS.values())]
                made[column] = np.select([kinds == name for name in POPULATIONS], values)
            yield made.assign(is_bad_actor=kinds != "good", is_network_actor=kinds == "network", true_label=(kinds != "good").astype("int32"))

    columns = "actor_id string, " + ", ".join(f"{c} {'boolean' if law == 'bernoulli' else 'long' if law in ('int', 'poisson') else 'double'}" for c, (law, *_) in POPULATIONS["good"].items())
    out = rows.mapInPandas(run, columns + ", is_bad_actor boolean, is_network_actor boolean, true_label int")
    return out.orderBy(F.md5(F.concat("actor_id", F.lit(str(random_seed)))))


def weekly_platform(spark: SparkSession, weeks: int = 52, spike: tuple[int, int] = (26, 35), base: float = 0.015, high: float = 0.023, noise: float = 0.002, sampled: int = 2000, rates: tuple[float, float, float, float] = (0.82, 0.04, 0.74, 0.03), seed: int = 42) -> DataFrame:
    """A year of weekly samples with a spike (``rates``: tpr and fpr of both systems): per week n1, n2, m, the Chapman estimate over the sampled size and whether the week spiked."""
    week = F.col("week_number")
    spiking = week.between(*spike)
    wobble = (_draw(week, seed, "n1") + _draw(week, seed, "n2") + _draw(week, seed, "n3") - 1.5) * 2 * noise
    level = F.least(F.lit(0.20), F.greatest(F.lit(0.001), F.when(spiking, high).otherwise(base) + wobble))
    grid = spark.range(weeks * sampled).select((F.col("id") / sampled).cast("int").alias("week_number"), F.col("id").alias("item_id")).withColumn("true_prevalence", level)
    y = _draw(F.col("item_id"), seed, "y") < F.col("true_prevalence")
    a = _draw(F.col("item_id"), seed, "a") < F.when(y, rates[0]).otherwise(rates[1])
    b = _draw(F.col("item_id"), seed, "b") < F.when(y, rates[2]).otherwise(rates[3])
    counts = grid.groupBy("week_number").agg(F.first("true_prevalence").alias("true_prevalence"), F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.count_if(a & b).alias("m"))
    est = estimators.chapman(F.col("n1"), F.col("n2"), F.col("m"), F.lit(sampled))
    return counts.select("week_number", spiking.alias("spike"), "true_prevalence", "n1", "n2", "m", F.coalesce(est["estimate"], ratio(F.col("n1"), F.lit(sampled))).alias("estimated_prevalence"), est["ci_lower"].alias("ci_lower"), est["ci_upper"].alias("ci_upper"))


def sampling_efficiency(actors: DataFrame, budgets: list[int], trials: int, label: str = "true_label", weight: str = "sampling_weight", seed: int = 0) -> DataFrame:
    """Mean Wilson widths of uniform and weighted draws per budget, and the reduction; all trials of all budgets in one plan."""
    from pyspark.sql.window import Window

    spark = actors.sparkSession
    grid = spark.range(trials).withColumnRenamed("id", "trial")
    u = F.greatest(_draw(F.concat_ws("|", "trial", "actor_id"), seed, "u"), F.lit(1e-12))
    v = F.greatest(_draw(F.concat_ws("|", "trial", "actor_id"), seed, "v"), F.lit(1e-12))
    each = actors.select("actor_id", F.col(label).cast("double").alias("y"), F.col(weight).alias("w")).crossJoin(F.broadcast(grid))
    ranked = each.withColumn("ru", F.row_number().over(Window.partitionBy("trial").orderBy(u, "actor_id"))).withColumn("rw", F.row_number().over(Window.partitionBy("trial").orderBy(-F.log(v) / F.col("w"), "actor_id"))).filter((F.col("ru") <= max(budgets)) | (F.col("rw") <= max(budgets)))
    # a positive drawn by weight counts 1 / (weight * budget); the total is rounded and held within the budget
    sums = [c for n in budgets for c in (F.sum(F.when(F.col("ru") <= n, F.col("y"))).alias(f"u{n}"), F.least(F.lit(float(n)), F.bround(F.sum(F.when(F.col("rw") <= n, F.col("y") / (F.col("w") * n))), 0)).alias(f"h{n}"))]
    per_trial = ranked.groupBy("trial").agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("budget"), estimators.wilson(F.col(f"u{n}"), F.lit(n))["ci_width"].alias("uniform_width"), estimators.wilson(F.col(f"h{n}"), F.lit(n))["ci_width"].alias("weighted_width")) for n in budgets])
    means = per_trial.select(F.inline(rows)).groupBy("budget").agg(F.avg("uniform_width").alias("uniform_width"), F.avg("weighted_width").alias("weighted_width"))
    return means.withColumn("reduction", 1 - ratio(F.col("weighted_width"), F.col("uniform_width")))


def simulate_arms(spark: SparkSession, n: int, arms: dict[str, float], tpr: float = 0.90, fpr: float = 0.05, seed: int = 42) -> DataFrame:
    """item_id, arm, harmful, score: ``arms`` gives each arm's prevalence; scores are Beta(10 tpr, 10 (1 - tpr)) for harmful items and the same of fpr for others."""
    names = sorted(arms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, arm = batch["item_id"].to_numpy(), batch["arm"].to_numpy()
            score = np.empty(len(batch))
            for k, name in enumerate(names):
                here = np.flatnonzero(arm == name)
                high, low = (_by_block(ids[here], lambda block, r=r, j=j: np.random.default_rng((seed, k, j, block)).beta(10 * r, 10 * (1 - r), _BLOCK)) for j, r in enumerate((tpr, fpr)))
                score[here] = np.where(batch["harmful"].to_numpy()[here], high, low)
            yield batch.assign(score=score)

    rates = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(float(arms[a])).alias("prevalence")) for a in names])
    rows = spark.range(n).withColumnRenamed("id", "item_id").select("item_id", F.inline(rates))
    labelled = rows.withColumn("harmful", _draw(F.concat_ws("|", "arm", "item_id"), seed, "y") < F.col("prevalence")).drop("prevalence")
    return labelled.mapInPandas(run, "item_id long, arm string, harmful boolean, score double")


def signal_hits(ids: DataFrame, prevalence: float, tpr: float, fpr: float, seed: int = 42) -> DataFrame:
    """``ids`` (item_id) with true_label and an off-platform ``hit``."""
    key = F.col("item_id")
    labelled = ids.withColumn("true_label", _draw(key, seed, "y") < prevalence)
    return labelled.withColumn("hit", _draw(key, seed, "h") < F.when(F.col("true_label"), tpr).otherwise(fpr))


def with_seed(config: SimulationConfig, seed: int) -> SimulationConfig:
    return replace(config, random_seed=seed)

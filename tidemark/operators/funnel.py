"""The measurement funnel, enforcement indicators and the weekly scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio

# fixed values: direction, amber limit, red limit
TARGETS = {
    "ci_half_width_pp": ("max", 0.12, 0.20),
    "confirmation_rate_pct": ("min", 75.0, 65.0),
    "enforcement_rate_pct": ("min", 80.0, 70.0),
    "gap_rate_pct": ("max", 20.0, 30.0),
    "reversal_rate_pct": ("max", 8.0, 12.0),
    "p50_hours": ("max", 6.0, 12.0),
}
STAGES = ("Content corpus", "Pre-filter queue", "LLM-flagged items", "Review sample", "Confirmed harmful", "Enforcement actions", "Final enforcement")


def funnel(params: DataFrame) -> DataFrame:
    """Seven stage counts of each parameter row, truncated to whole items at each step, with their share of the corpus.

    ``params``: corpus_size long, prevalence, prefilter_recall, prefilter_fpr, tpr, fpr double, review_budget long, enforcement_rate, reversal_rate double.
    """
    whole = lambda c: c.cast("long")
    p = params.withColumn("harmful", whole(F.col("corpus_size") * F.col("prevalence")))
    p = p.withColumn("q_tp", whole(F.col("harmful") * F.col("prefilter_recall"))).withColumn("q_fp", whole((F.col("corpus_size") - F.col("harmful")) * F.col("prefilter_fpr")))
    p = p.withColumn("f_tp", whole(F.col("q_tp") * F.col("tpr"))).withColumn("f_fp", whole(F.col("q_fp") * F.col("fpr")))
    p = p.withColumn("confirmed", whole(F.col("review_budget") * ratio(F.col("f_tp"), F.col("f_tp") + F.col("f_fp"))))
    p = p.withColumn("actioned", whole(F.col("confirmed") * F.col("enforcement_rate")))
    p = p.withColumn("final", whole(F.col("actioned") * (1 - F.col("reversal_rate"))))
    counts = (F.col("corpus_size"), F.col("q_tp") + F.col("q_fp"), F.col("f_tp") + F.col("f_fp"), F.col("review_budget"), F.col("confirmed"), F.col("actioned"), F.col("final"))
    rows = F.array(*[F.struct(F.lit(k).alias("stage_number"), F.lit(name).alias("stage"), n.cast("long").alias("n"), (100.0 * n / F.col("corpus_size")).alias("pct_of_corpus")) for k, (name, n) in enumerate(zip(STAGES, counts))])
    return p.select(F.inline(rows))


def prefilter_metrics(df: DataFrame, passed: Column, label: Column) -> DataFrame:
    """Recall, precision and queue reduction of a pre-filter."""
    return df.agg(ratio(F.count_if(passed & label), F.count_if(label)).alias("recall"), ratio(F.count_if(passed & label), F.count_if(passed)).alias("precision"), (1 - ratio(F.count_if(passed), F.count("*"))).alias("queue_reduction"))


def enforcement_kpis(df: DataFrame) -> DataFrame:
    """Gap, final rate, share reversed (these three add to 1 with the final rate) and naive bias of each vertical."""
    e, r = F.col("enforcement_rate"), F.col("reversal_rate")
    return df.select("*", (1 - e).alias("gap_rate"), (e * (1 - r)).alias("final_enforcement_rate"), (e * r).alias("reversed_share"), ratio(F.col("flag_rate"), F.col("true_prevalence")).alias("naive_bias"))


def light(metric: str, value: Column) -> Column:
    """red, amber or green against the metric's targets; white without any, or without a value."""
    if metric not in TARGETS:
        return F.lit("white")
    direction, amber, red = TARGETS[metric]
    beyond = (lambda limit: value > limit) if direction == "max" else (lambda limit: value < limit)
    return F.when(value.isNull(), "white").when(beyond(red), "red").when(beyond(amber), "amber").otherwise("green")


def scorecard(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Long form: key, metric, value, light."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), light(m, F.col(m)).alias("light")) for m in metrics])
    return df.select(key, F.inline(rows))


def prevalence_by_flag(df: DataFrame, flags: list[str]) -> DataFrame:
    """Share of rows per boolean column, highest first; one pass over the rows."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    return means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("prevalence")) for c in flags]))).orderBy(F.desc("prevalence"), "flag")


def correlations(df: DataFrame, flags: list[str], strong: float = 0.15) -> DataFrame:
    """Pearson correlation of each pair of columns (null where one does not vary), and whether it is strong."""
    pairs = [(a, b) for k, a in enumerate(flags) for b in flags[k + 1 :]]
    x = {c: F.col(c).cast("double") for c in flags}
    moments = [F.count("*").alias("n")] + [F.sum(v).alias(f"s_{c}") for c, v in x.items()] + [F.sum(v * v).alias(f"q_{c}") for c, v in x.items()] + [F.sum(x[a] * x[b]).alias(f"p_{a}_{b}") for a, b in pairs]
    m, n = df.dropna(subset=flags).agg(*moments), F.col("n")
    spread = lambda c: n * F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}")
    r = lambda a, b: ratio(n * F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}"), F.sqrt(spread(a) * spread(b)))
    out = m.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in pairs])))
    return out.withColumn("strong", F.coalesce(F.abs("r") > strong, F.lit(False)))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins with counts and density; the last includes its right edge, values outside are left out."""
    x, width = F.col(column), (high - low) / bins
    cell = F.least(F.floor((x - low) / width).cast("int"), F.lit(bins - 1))
    inside = df.filter(x.between(low, high)).withColumn("bin", cell)
    counts = inside.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or []))) / width)

"""Threshold metrics, sweeps and ranking quality of scored, labelled rows.

``label`` is boolean, ``score`` double. Rows with a null of either do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.columns import clamp, hash_uniform, ratio


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates of a confusion table, 0 on an empty denominator."""
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return {
        "precision": zero(tp, tp + fp),
        "recall": zero(tp, tp + fn),
        "fpr": zero(fp, fp + tn),
        "fnr": zero(fn, fn + tp),
        "specificity": zero(tn, tn + fp),
        "f1": zero(2 * tp, 2 * tp + fp + fn),
    }


def _with_rates(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in rates(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))).items()])


def metrics_at(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and rates at ``score >= threshold`` in one pass."""
    hit, y = F.col(score) >= threshold, F.col(label)
    usable = df.filter(F.col(score).isNotNull() & y.isNotNull())
    counts = usable.groupBy(*(by or [])).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    return _with_rates(counts)


def sweep(df: DataFrame, thresholds: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Metrics at every ``threshold``: scores fall into the cell of the last threshold at or below them, then cumulative sums.

    Rows meet the thresholds once, as a sorted array, instead of once per threshold.
    """
    marks = F.broadcast(thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("marks")))
    usable = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    cells = usable.crossJoin(marks).withColumn("cell", F.size(F.filter("marks", lambda t: t <= F.col("s")))).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = thresholds.select("threshold").distinct().withColumn("cell", F.row_number().over(Window.orderBy("threshold")))
    full = grid.unionByName(F.broadcast(grid.limit(1)).select(F.lit(None).cast("double").alias("threshold"), F.lit(0).alias("cell"))).join(cells, "cell", "left").fillna(0, ["pos", "neg"])
    above, everything = Window.orderBy(F.desc("cell")), Window.partitionBy()
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    counted = full.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.sum("neg").over(everything) - fp).alias("tn"), (F.sum("pos").over(everything) - tp).alias("fn"))
    return _with_rates(counted.filter(F.col("threshold").isNotNull()))


def best_by_f1(swept: DataFrame) -> DataFrame:
    """The row of the largest f1; ties go to the lowest threshold."""
    return swept.agg(F.max_by(F.struct(*swept.columns), F.struct("f1", -F.col("threshold"))).alias("r")).select("r.*")


def cost_optimal(swept: DataFrame, cost_fn: float = 1.0, cost_fp: float = 0.1) -> DataFrame:
    """The threshold of least cost; ties go to the lowest."""
    cost = F.col("fn") * cost_fn + F.col("fp") * cost_fp
    return swept.withColumn("cost", cost).agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"), F.min("cost").alias("cost"))


def nearest_threshold(swept: DataFrame, optimum: float) -> DataFrame:
    """The row whose threshold is nearest to ``optimum``."""
    return swept.agg(F.min_by(F.struct(*swept.columns), F.struct(F.abs(F.col("threshold") - optimum), F.col("threshold"))).alias("r")).select("r.*")


def curve(df: DataFrame, score: str = "score", label: str = "label", cells: int = 4096) -> DataFrame:
    """Cumulative counts at every distinct score, highest first: the points of ROC and precision-recall curves.

    Prefix sums in two levels: scores are summed to distinct values, these fall into at most ``cells`` ranges of equal width whose totals one
    small window adds up, and within a range a window per range does. No task ever sees all distinct scores.
    """
    points = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    ends = F.broadcast(points.agg(F.min("threshold").alias("_lo"), F.max("threshold").alias("_hi")))
    place = F.floor(F.coalesce(ratio(F.col("threshold") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * (cells - 1)).cast("int")
    placed = points.crossJoin(ends).withColumn("_cell", place).drop("_lo", "_hi")
    higher, everything = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = placed.groupBy("_cell").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0))
    totals = totals.select("_cell", before("_p").alias("_p0"), before("_n").alias("_n0"), F.sum("_p").over(everything).alias("_pos"), F.sum("_n").over(everything).alias("_neg"))
    down = Window.partitionBy("_cell").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(totals), "_cell")
    tp, fp = F.col("_p0") + F.sum("pos").over(down), F.col("_n0") + F.sum("neg").over(down)
    return joined.select("threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "_pos", "_neg").select("threshold", "pos", "neg", "tp", "fp", ratio(F.col("tp"), F.col("_pos")).alias("tpr"), ratio(F.col("fp"), F.col("_neg")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Probability that a positive outranks a negative, ties a half; null with one class only."""
    c = curve(df, score, label)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return c.agg(ratio(won, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum over distinct scores of the recall gained times the precision there; null without positives."""
    c = curve(df, score, label)
    return c.agg(ratio(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("average_precision"))


def label_metrics(df: DataFrame, predicted: str, label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates of a predicted boolean against the label; rows with a null of either do not count."""
    hit, y = F.col(predicted), F.col(label)
    counts = df.filter(hit.isNotNull() & y.isNotNull()).groupBy(*(by or [])).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    return _with_rates(counts)


def prompt_sensitivity(df: DataFrame, variants: DataFrame, key: str, threshold: float = 0.5, score: str = "score", label: str = "label", seed: str = "noise") -> DataFrame:
    """Metrics of every variant (variant, bias, noise): the score shifted by its bias and by a hashed noise of that half-width, kept within [0, 1]."""
    wobble = (hash_uniform(F.concat_ws("|", F.col(key).cast("string"), "variant"), seed) * 2 - 1) * F.col("noise")
    moved = df.crossJoin(F.broadcast(variants)).withColumn("_moved", clamp(F.col(score) + F.col("bias") + wobble))
    return metrics_at(moved, threshold, ["variant"], "_moved", label)

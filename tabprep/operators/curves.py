"""ROC and precision-recall curves of any size, and what is read from them.

Scores are summed per distinct score first; cumulative sums are made within ranges of scores, to which the sums of all ranges
before are added: no task sees all scores of a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.scalar import ratio
from ..storage import materialize


def cumulative(scores: DataFrame) -> DataFrame:
    """From (model, truth 0/1, score): per model and distinct score pos, neg, and tp, fp at that threshold, with all P and N."""
    groups = scores.groupBy("model", "score").agg(F.sum("truth").cast("long").alias("pos"), F.sum(1 - F.col("truth")).cast("long").alias("neg"))
    ranged = materialize(groups.repartitionByRange("model", F.desc("score")).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("model", "_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = Window.partitionBy("model").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("model")
    first = sums.select("model", "_part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"))
    inside = Window.partitionBy("model", "_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(first, ["model", "_part"]).select("model", "score", "pos", "neg", (F.col("_p") + F.sum("pos").over(inside)).alias("tp"), (F.col("_n") + F.sum("neg").over(inside)).alias("fp"), "P", "N")


def roc_curve(scores: DataFrame) -> DataFrame:
    return cumulative(scores).select("model", "score", F.round(ratio(F.col("fp"), F.col("N")), 6).alias("fpr"), F.round(ratio(F.col("tp"), F.col("P")), 6).alias("tpr"))


def pr_table(scores: DataFrame) -> DataFrame:
    """Per threshold: precision and recall of calling scores at or above it positive."""
    return cumulative(scores).select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("P")).alias("recall"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """The points of pr_table and a last one without threshold (precision 1, recall 0) for each model."""
    points = pr_table(scores).select("model", F.col("score").alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
    return points.unionByName(points.select("model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")).distinct())


def roc_auc(scores: DataFrame) -> DataFrame:
    """The trapezoid area: tied scores count half."""
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0) / (F.max("P") * F.max("N"))
    return cumulative(scores).groupBy("model").agg(F.round(area, 6).alias("roc_auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """The sum of recall steps times precision, not a trapezoid."""
    return pr_table(scores).groupBy("model").agg(F.round(F.sum(ratio(F.col("pos"), F.col("P")) * F.col("precision")), 6).alias("pr_auc"))


def confusion_matrix(scores: DataFrame, threshold: float) -> DataFrame:
    said = F.col("score") >= threshold
    cells = {"tn": ~said & (F.col("truth") == 0), "fp": said & (F.col("truth") == 0), "fn": ~said & (F.col("truth") == 1), "tp": said & (F.col("truth") == 1)}
    return scores.groupBy("model").agg(*(F.sum(c.cast("long")).alias(k) for k, c in cells.items()))


def prf_metrics(scores: DataFrame, threshold: float) -> DataFrame:
    m = confusion_matrix(scores, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    made = m.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))
    return made.select("model", "tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def optimize_threshold(scores: DataFrame, least_recall: float) -> DataFrame:
    """Per model the threshold of the highest precision (then recall, then threshold) among those with enough recall; feasible or not; F1 and the matrix there."""
    best = pr_table(scores).where((F.col("recall") >= least_recall) & (F.col("P") > 0)).groupBy("model").agg(F.max(F.struct("precision", "recall", F.col("score").alias("threshold"), (F.col("N") - F.col("fp")).alias("tn"), "fp", (F.col("P") - F.col("tp")).alias("fn"), "tp")).alias("b"))
    f1 = ratio(2 * F.col("b.tp"), 2 * F.col("b.tp") + F.col("b.fp") + F.col("b.fn"))
    return scores.select("model").distinct().join(best, "model", "left").select("model", F.col("b").isNotNull().alias("feasible"), F.col("b.threshold").alias("threshold"), F.round("b.precision", 6).alias("precision"), F.round("b.recall", 6).alias("recall"), F.when(F.col("b").isNotNull(), F.round(f1, 6)).alias("f1"), *(F.col(f"b.{c}").alias(c) for c in ("tn", "fp", "fn", "tp")))


def candidate_thresholds(scores: DataFrame, candidates: list[float]) -> DataFrame:
    """Metrics at the given thresholds that lie within [0, 1]; others are left out. One conditional sum each over the summed scores."""
    wanted = sorted({float(c) for c in candidates if 0 <= c <= 1})
    if not wanted:
        raise Refused("no_candidate_thresholds")
    groups = scores.groupBy("model", "score").agg(F.sum("truth").alias("pos"), F.sum(1 - F.col("truth")).alias("neg"))
    sums = [F.struct(F.lit(t).alias("threshold"), *(F.sum(F.when(F.col("score") >= t, F.col(c)).otherwise(0)).cast("long").alias(k) for c, k in (("pos", "tp"), ("neg", "fp"))), F.sum("pos").cast("long").alias("P")) for t in wanted]
    rows = groups.groupBy("model").agg(F.array(*sums).alias("r")).select("model", F.inline("r"))
    return rows.select("model", "threshold", "tp", "fp", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("P")), 6).alias("recall"))


def recommend_model(scores: DataFrame, least_recall: float) -> DataFrame:
    """The feasible model of the highest precision, then average precision, then recall."""
    both = optimize_threshold(scores, least_recall).where("feasible").join(average_precision(scores), "model")
    return both.orderBy(F.desc("precision"), F.desc("pr_auc"), F.desc("recall"), "model").limit(1).select("model", "threshold", "precision", "pr_auc", "recall")

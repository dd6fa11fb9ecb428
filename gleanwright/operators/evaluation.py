"""Votes, metrics, confusion matrices and comparisons of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_size


def majority(runs: DataFrame, item: str = "item", prediction: str = "prediction", seq: str = "seq") -> DataFrame:
    """(item, prediction, votes, runs): the most frequent prediction; ties go to the one seen first."""
    votes = runs.groupBy(item, prediction).agg(F.count(F.lit(1)).alias("votes"), F.min(seq).alias("first"))
    order = Window.partitionBy(item).orderBy(F.desc("votes"), "first")
    ranked = votes.withColumns({"runs": F.sum("votes").over(Window.partitionBy(item)), "n": F.row_number().over(order)})
    return ranked.filter("n = 1").select(item, prediction, "votes", "runs")


def agreement(runs: DataFrame, item: str = "item", prediction: str = "prediction", seq: str = "seq", seconds: str = "seconds") -> DataFrame:
    """Majority with "k/n", total time, and the first run's prediction that agrees with it."""
    total = runs.groupBy(item).agg(F.round(F.sum(seconds), 4).alias("total_seconds"))
    m = majority(runs, item, prediction, seq)
    return m.join(total, item).withColumn("agreement", F.concat_ws("/", F.col("votes").cast("string"), F.col("runs").cast("string")))


def counts(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(label, support, precision, recall, f1) over the given labels, or over all that occur; an undefined value is 0."""
    c = counts(pairs)
    by_truth = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    by_pred = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = c.filter("truth = prediction").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    base = labels if labels is not None else by_truth.select("label").union(by_pred.select("label")).distinct()
    out = base.join(by_truth, "label", "left").join(by_pred, "label", "left").join(hit, "label", "left").na.fill(0, ["support", "predicted", "tp"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "support", "precision", "recall", "f1")


METRICS = ("macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def metrics(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: accuracy over all pairs, macro and support-weighted means over the labels."""
    r = class_report(pairs, labels)
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs += [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(f"macro_{m}"), F.round(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias(f"weighted_{m}")]
    acc = pairs.agg(F.round(F.coalesce(F.avg((F.col("truth") == F.col("prediction")).cast("int")), F.lit(0.0)), 6).alias("accuracy"))
    return acc.join(r.agg(*aggs))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row a truth, one column a label, and `other` for predictions off the labels."""
    known = pairs.withColumn("p", F.when(F.col("prediction").isin(*labels), F.col("prediction")).otherwise("other"))
    return known.groupBy("truth").pivot("p", [*labels, "other"]).count().na.fill(0)


def confusion_long(pairs: DataFrame) -> DataFrame:
    """(truth, prediction, n) for all pairs of labels that occur as either; the label set is small by nature."""
    c = counts(pairs)
    labels = c.select(F.col("truth").alias("l")).union(c.select("prediction")).distinct()
    grid = labels.select(F.col("l").alias("truth")).join(by_size(labels.select(F.col("l").alias("prediction"))))
    return grid.join(c, ["truth", "prediction"], "left").na.fill(0, ["n"])


def verdict(truth: str, base: str, other: str) -> Column:
    b, o = F.col(base) == F.col(truth), F.col(other) == F.col(truth)
    return F.when(b & o, "BOTH CORRECT").when(~b & o, "IMPROVED").when(b & ~o, "REGRESSED").otherwise("BOTH INCORRECT")


def metric_delta(base: DataFrame, other: DataFrame) -> DataFrame:
    """(metric, base, other, delta) of two metric rows."""
    long = lambda df, name: df.unpivot([], ["accuracy", *METRICS], "metric", name)
    return long(base, "base").join(long(other, "other"), "metric").withColumn("delta", F.round(F.col("other") - F.col("base"), 6))


def geometric_confidence(p: Column | str) -> Column:
    """The geometric mean of token probabilities, each within [1e-12, 1], in percent; an aggregate."""
    return F.exp(F.avg(F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))) * 100

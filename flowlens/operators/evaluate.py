"""Confusion matrices, reports, recalls, sweeps and score health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.cleaning import is_attack
from flowlens.schema import BENIGN, FILE_KEY


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Counts of every (true, pred) pair of occurring classes, zeros included.

    The pairs are counted once and gathered into one row, whose size is the number
    of classes squared; zeros are filled in there.
    """
    pairs = df.groupBy(F.col(true).alias("true_class"), F.col(pred).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    gathered = pairs.agg(F.collect_list(F.struct("true_class", "pred_class", "n")).alias("ps"))
    names = F.array_sort(F.array_distinct(F.concat(F.col("ps.true_class"), F.col("ps.pred_class"))))
    cells = gathered.select("ps", names.alias("cs")).select("ps", "cs", F.explode("cs").alias("true_class"))
    cells = cells.select("ps", "true_class", F.explode("cs").alias("pred_class"))
    here = F.expr("aggregate(filter(ps, p -> p.true_class <=> true_class and p.pred_class <=> pred_class), 0L, (a, p) -> a + p.n)")
    return cells.select("true_class", "pred_class", here.alias("n"))


def classification_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    A zero denominator gives 0.
    """
    pairs = df.groupBy(F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    parts = pairs.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).cast("bigint").alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("e")).select("e.*")
    sums = parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = sums.withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("hits"), F.col("support"))
    )
    rows = rows.withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    names = ["precision", "recall", "f1"]
    accuracy = F.sum("hits") / total
    summary = rows.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in names], total.alias("support")),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], total.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), *[weighted(c).alias(c) for c in names], total.alias("support")),
    ).alias("s")).select(F.inline("s"))
    return rows.select("class", *names, "support").unionByName(summary)


def attack_recall(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Flagged share per label; for Benign the share left alone."""
    flagged = F.avg(F.col(pred).cast("double"))
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.col(label) == BENIGN, 1 - flagged).otherwise(flagged).alias("recall"),
    )


def class_recall(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(true) == F.col(pred)).cast("double")).alias("recall"),
    )


def overall_recall(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    hit, attack = F.col(pred).cast("double"), F.col(label) != BENIGN
    return df.agg(
        F.avg(F.when(attack, hit)).alias("attack_recall"),
        F.avg(F.when(~attack, 1 - hit)).alias("benign_recall"),
    )


def threshold_sweep(df: DataFrame, score: str, thresholds: Sequence[float], label: str = "label") -> DataFrame:
    """False-positive rate and recall at each threshold, all in one pass."""
    attack, s = F.col(label) != BENIGN, F.col(score)
    over = lambda t: (s > t).cast("double")
    points = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.avg(F.when(~attack, over(t))).alias("fp_rate"),
            F.avg(F.when(attack, over(t))).alias("recall"),
        )
        for t in thresholds
    ])
    return df.filter(s.isNotNull()).agg(points.alias("p")).select(F.inline("p"))


def accuracy_gap(df: DataFrame, true: str, pred: str, split: str = "split") -> DataFrame:
    """Accuracy of the train and the test side, and their distance, in one aggregate."""
    hit = (F.col(true) == F.col(pred)).cast("double")
    side = lambda name: F.avg(F.when(F.col(split) == name, hit))
    return df.agg(side("train").alias("train_accuracy"), side("test").alias("test_accuracy")).withColumn(
        "gap", F.abs(F.col("train_accuracy") - F.col("test_accuracy")))


def score_health(df: DataFrame, score: str, collapse_below: float = 0.1, label: str = "label") -> DataFrame:
    """Range, mean, attack mean and spread of a score per file and overall (NULL file)."""
    return (
        df.filter(F.col(score).isNotNull()).groupingSets([FILE_KEY, []], *FILE_KEY)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(score).alias("low"), F.max(score).alias("high"),
            F.avg(score).alias("mean"),
            F.avg(F.when(F.col(label) != BENIGN, F.col(score))).alias("attack_mean"),
            F.stddev_pop(score).alias("std"),
        )
        .withColumn("collapsed", F.col("std") < collapse_below)
    )


def day_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    attack = is_attack(label)
    return df.groupBy("capture_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(attack).alias("attacks"),
        F.avg((attack == F.col(pred)).cast("double")).alias("accuracy"),
        F.avg(F.when(attack == 1, F.col(pred).cast("double"))).alias("attack_recall"),
    )


def score_means(df: DataFrame, scores: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(is_attack(label).alias("is_attack")).agg(
        *[F.avg(s).alias(f"mean_{s}") for s in scores]
    )

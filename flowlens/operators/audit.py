"""Checks over labelled tables: balance, coverage, schema, health, readiness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.schema import BENIGN, FILE_KEY, WINDOW_SIZE, SEQUENCE_FEATURES


def _benign() -> Column:
    return F.count_if(F.col("label") == BENIGN)


def _attack() -> Column:
    return F.count_if(F.col("label") != BENIGN)


def class_balance(flows: DataFrame, current_weight: float = 18.0, tolerance: float = 5.0) -> DataFrame:
    """Benign:attack ratio, the positive weight it asks for, and whether the current one fits."""
    return (
        flows.agg(F.count(F.lit(1)).alias("total"), _benign().alias("benign"), _attack().alias("attack"))
        .withColumn("ratio", F.when(F.col("attack") > 0, F.col("benign") / F.col("attack")))
        .withColumn("recommended_weight", F.bround("ratio", 0).cast("bigint"))
        .withColumn(
            "verdict",
            F.when(F.abs(F.col("ratio") - current_weight) < tolerance, "ok").otherwise("fix"),
        )
    )


def day_audit(flows: DataFrame) -> DataFrame:
    """Benign, attack, ratio and attack types per day, plus a grand total row (NULL day)."""
    return (
        flows.rollup("capture_day")
        .agg(
            _benign().alias("benign"), _attack().alias("attack"),
            F.concat_ws(", ", F.array_sort(F.collect_set(F.when(F.col("label") != BENIGN, F.col("label"))))).alias("attacks"),
        )
        .withColumn("ratio", F.when(F.col("attack") > 0, F.col("benign") / F.col("attack")))
    )


def day_inventory(flows: DataFrame, windows: DataFrame) -> DataFrame:
    """Flows and windows per day and label."""
    key = ["capture_day", "label"]
    flow_counts = flows.groupBy(*key).agg(F.count(F.lit(1)).alias("flows"))
    window_counts = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"))
    return flow_counts.join(window_counts, key, "full").select(
        *key, F.coalesce("flows", F.lit(0)).alias("flows"), F.coalesce("windows", F.lit(0)).alias("windows")
    )


def day_label_pivot(flows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Wide form: one row per day, one count column per label."""
    names = {label: label.lower().replace("-", "_") for label in labels}
    return flows.groupBy("capture_day").agg(
        *[F.count_if(F.col("label") == label).alias(name) for label, name in names.items()]
    )


def label_family(flows: DataFrame, needle: str = "DDoS") -> DataFrame:
    """Files that hold a label family, and its rows."""
    per_file = flows.groupBy(*FILE_KEY).agg(F.count_if(F.col("label").contains(needle)).alias("hits"))
    return per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("hits") > 0).alias("files_with_family"),
        F.sum("hits").alias("family_rows"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column; columns of standard deviations may hold them."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column_name", "nulls").withColumn(
        "unexpected", (F.col("nulls") > 0) & ~F.col("column_name").contains("std")
    )


def file_classes(flows: DataFrame) -> DataFrame:
    """Attack-bearing against benign-only files."""
    return flows.groupBy(*FILE_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("label") != BENIGN).alias("has_attack")
    )


def file_health(
    flows: DataFrame, manifest: DataFrame, known_labels: Sequence[str], max_ratio: float = 100.0
) -> DataFrame:
    """Per listed file: rows, classes, imbalance, missing and unexpected labels."""
    unknown = F.col("label").isNotNull() & ~F.col("label").isin(*known_labels)
    stats = flows.groupBy(*FILE_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.size(F.collect_set("label")).cast("bigint").alias("classes"),
        _benign().alias("benign"), _attack().alias("attack"),
        F.count_if(F.col("label").isNull()).alias("missing_labels"),
        F.count_if(unknown).alias("unexpected_labels"),
    )
    zeroed = ["n", "classes", "benign", "attack", "missing_labels", "unexpected_labels"]
    filled = manifest.select(*FILE_KEY).distinct().join(stats, FILE_KEY, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in zeroed}
    )
    return filled.withColumns({
        "is_empty": F.col("n") == 0,
        "single_class": F.col("classes") == 1,
        "extreme_imbalance": (F.col("attack") > 0) & (F.col("benign") > F.col("attack") * max_ratio),
    })


def vector_lengths(windows: DataFrame, expected: int = WINDOW_SIZE * len(SEQUENCE_FEATURES)) -> DataFrame:
    return windows.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.size("sequence_features") == expected).alias("right_length"),
    )


def readiness(checks: DataFrame) -> DataFrame:
    """Passed, warned and failed checks with the passed share, from (check_name, status) rows."""
    return checks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "warn").alias("warned"),
        F.count_if(F.col("status") == "fail").alias("failed"),
    ).withColumn("score", F.col("passed") * 100.0 / F.col("total"))


def union_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def severe_imbalance(flows: DataFrame, max_ratio: float = 1000.0) -> DataFrame:
    """Benign rows per attack row of each attack label."""
    counts = flows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    benign = F.sum(F.when(F.col("label") == BENIGN, F.col("n")).otherwise(0)).over(Window.partitionBy())
    return (
        counts.withColumn("benign_per_attack", benign / F.col("n"))
        .filter(F.col("label") != BENIGN)
        .withColumn("severe", F.col("benign_per_attack") > max_ratio)
    )


def signature_check(flows: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean rate and duration per label against ``expected`` ranges; score is passes over checks."""
    means = flows.groupBy("label").agg(
        F.avg("packet_rate").alias("packet_rate"), F.avg("flow_duration_sec").alias("flow_duration_sec")
    ).unpivot(["label"], ["packet_rate", "flow_duration_sec"], "feature", "mean")
    judged = means.join(expected, "feature").withColumn(
        "passes", F.col("mean").between(F.col("low"), F.col("high")).cast("int")
    )
    return judged.groupBy("label").agg(
        F.sum("passes").alias("passes"), F.count(F.lit(1)).alias("checks")
    ).withColumn("score", F.col("passes") / F.col("checks"))


def label_coverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labels with their train and test counts; flags those on one side only."""
    side = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias(name))
    both = side(train, "train_rows").join(side(test, "test_rows"), "label", "full")
    return both.select(
        "label", F.coalesce("train_rows", F.lit(0)).alias("train_rows"),
        F.coalesce("test_rows", F.lit(0)).alias("test_rows"),
    ).withColumn(
        "status",
        F.when(F.col("train_rows") == 0, "test_only").when(F.col("test_rows") == 0, "train_only").otherwise("both"),
    )


def shared_files(train: DataFrame, test: DataFrame) -> DataFrame:
    """File names present on both sides of a split."""
    return train.select(*FILE_KEY).distinct().intersect(test.select(*FILE_KEY).distinct())

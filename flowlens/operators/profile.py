"""Distributions, correlations and distances over flow and packet columns.

Order statistics are exact: values are first reduced to (value, count), then
cumulative counts are taken slice by slice, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.cleaning import is_attack
from flowlens.functions.ordering import running_sums, value_slice
from flowlens.schema import BENIGN


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per label; the total is summed over the counts, one row per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def long_form(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(ids, feature, value) rows with a double value; NULL and NaN values are left out."""
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(list(ids), list(values), "feature", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def value_counts(df: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    counts: DataFrame, group: Sequence[str], probs: dict[str, float], value: str = "value"
) -> DataFrame:
    """Linearly interpolated quantiles from (group, value, n) rows, with n, min and max."""
    ranked = running_sums(
        counts.withColumn("_slice", value_slice(value)),
        {"_upto": "n"}, group, [value], ["_slice"], totals=True,
    )
    picks = []
    for name, p in probs.items():
        at = (F.col("_upto_total") - 1) * F.lit(float(p))
        for suffix, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_upto") - F.col("n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{suffix}"))
    grouped = ranked.groupBy(*group).agg(
        F.sum("n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), *picks
    )
    out = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return grouped.select(*group, "n", "min", "max", *out)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def boxplot_stats(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Five-number summary and 1.5 IQR whiskers per label and feature."""
    group = [label, "feature"]
    counts = value_counts(long_form(df, [label], features), group)
    boxes = exact_quantiles(counts, group, QUARTILES)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col("value")
    fences = boxes.select(
        *group, (F.col("q1") - reach).alias("_low"), (F.col("q3") + reach).alias("_high")
    )
    whiskers = counts.join(fences, group).groupBy(*group).agg(
        F.min(F.when(value >= F.col("_low"), value)).alias("whisker_low"),
        F.max(F.when(value <= F.col("_high"), value)).alias("whisker_high"),
    )
    return boxes.join(whiskers, group)


def duration_distribution(flows: DataFrame) -> DataFrame:
    """Quartiles of flow duration per attack; Benign is left out."""
    attacks = flows.filter(F.col("label") != BENIGN)
    counts = value_counts(long_form(attacks, ["label"], ["flow_duration_sec"]), ["label"])
    return exact_quantiles(counts, ["label"], QUARTILES)


def outlier_rate(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Share of rows outside the quartiles by more than ``reach`` IQRs."""
    counts = value_counts(long_form(df, [], [column]), [])
    box = exact_quantiles(counts, [], QUARTILES).select(
        F.struct(
            (F.col("q1") - (F.col("q3") - F.col("q1")) * reach).alias("low"),
            (F.col("q3") + (F.col("q3") - F.col("q1")) * reach).alias("high"),
        ).alias("fence")
    )
    outside = (F.col("value") < F.col("fence.low")) | (F.col("value") > F.col("fence.high"))
    return counts.withColumn("fence", box.scalar()).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outliers"),
    ).withColumn("outlier_rate", F.col("outliers") / F.col("n"))


def label_means(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of each feature per label, and its difference from the Benign mean in percent.

    Both come from one aggregate: the (label, feature) means are few, and the
    Benign ones are read back by feature.
    """
    means = long_form(df, ["label"], features).groupBy("label", "feature").agg(F.avg("value").alias("mean"))
    base = means.filter(F.col("label") == BENIGN).select("feature", F.col("mean").alias("benign_mean"))
    return means.join(base, "feature", "left").withColumn(
        "diff_pct",
        F.when(F.col("benign_mean") != 0, (F.col("mean") - F.col("benign_mean")) * 100.0 / F.col("benign_mean")),
    )


class _Moments:
    """Sums for Pearson's r of every column pair over the rows that have both: n, means, squares and products about them.

    Entry (a, b) of ``mean`` and ``square`` is of column a where b is there too.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, product: np.ndarray):
        self.n, self.mean, self.square, self.product = n, mean, square, product

    @staticmethod
    def of(values: np.ndarray, there: np.ndarray) -> "_Moments":
        """Rows with the same columns present are centred together; the first row comes off first, so a constant leaves zeros."""
        patterns, which = np.unique(there, axis=0, return_inverse=True)
        total = None
        for k, pattern in enumerate(patterns):
            cols = np.flatnonzero(pattern)
            x = values[which.ravel() == k][:, cols]
            first = x[0]
            x = x - first
            middle = x.mean(axis=0)
            x -= middle
            part = _Moments(*np.zeros((4, len(pattern), len(pattern))))
            inner = np.ix_(cols, cols)
            part.n[inner], part.mean[inner] = len(x), (first + middle)[:, None]
            part.square[inner], part.product[inner] = (x * x).sum(axis=0)[:, None], x.T @ x
            total = part if total is None else total.add(part)
        return total

    def add(self, other: "_Moments") -> "_Moments":
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        step = np.where(other.n > 0, np.where(self.n > 0, other.mean - self.mean, 0), 0)
        mean = np.where(self.n > 0, self.mean + step * share, other.mean)
        weight = self.n * share
        return _Moments(
            n, mean, self.square + other.square + step * step * weight, self.product + other.product + step * step.T * weight)

    def pack(self) -> bytes:
        return np.stack([self.n, self.mean, self.square, self.product]).tobytes()

    @staticmethod
    def unpack(data: bytes, width: int) -> "_Moments":
        return _Moments(*np.frombuffer(data).reshape(4, width, width))


def correlation_matrix(df: DataFrame, columns: Sequence[str], merge_tasks: int = 32) -> DataFrame:
    """Pearson r of every pair below the diagonal, pairwise complete; NaN where a column does not vary, NULL without rows.

    Each task turns its rows into one masked Gram matrix, so a scan is all the rows cost, and
    one row per task is shuffled: to ``merge_tasks`` tasks that add them up, then to one.
    """
    width = len(columns)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            with np.errstate(invalid="ignore", over="ignore"):
                part = _Moments.of(values, there)
                total = part if total is None else total.add(part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["m"])

    def merged(batches: Iterator[pa.RecordBatch]) -> _Moments | None:
        parts = (_Moments.unpack(m, width) for batch in batches for m in batch.column("m").to_pylist())
        with np.errstate(invalid="ignore", over="ignore"):
            return reduce(lambda a, b: b if a is None else a.add(b), parts, None)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = merged(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["m"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = merged(batches)
        pairs = [(b, a) for a, b in combinations(range(width), 2)]
        r: list[float | None] = [None] * len(pairs)
        if total is not None:
            with np.errstate(invalid="ignore", divide="ignore"):
                scale = np.sqrt(total.square) * np.sqrt(total.square.T)
                matrix = np.where(scale == 0, np.nan, total.product / scale)
            r = [float(matrix[a, b]) if total.n[a, b] else None for a, b in pairs]
        names = [pa.array([columns[p[k]] for p in pairs], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*names, pa.array(r, pa.float64())], names=["feature_a", "feature_b", "r"])

    sums = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(moments, "m binary")
    # one task a partition: adaptive execution must not make the merging one task too early
    sums = sums.repartition(merge_tasks, F.monotonically_increasing_id()).mapInArrow(merge, "m binary")
    return sums.repartition(1).mapInArrow(finish, "feature_a string, feature_b string, r double")


def redundant_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    return correlation_matrix(df, columns).filter(F.abs("r") > threshold)


def target_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson r of each feature with being an attack; NaN where either does not vary, NULL without rows.

    Spark's own ``corr`` divides by zero there, for instance where all flows are Benign.
    """
    rows = df.select(is_attack().alias("_attack"), *[F.col(c).alias(c) for c in features])
    pairs = correlation_matrix(rows, ["_attack", *features])
    return pairs.filter(F.col("feature_b") == "_attack").select(F.col("feature_a").alias("feature"), "r")


def skewed_features(df: DataFrame, features: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """Population skewness per feature."""
    row = df.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in features])
    return row.unpivot([], list(features), "feature", "skewness").withColumn(
        "flagged", F.abs("skewness") > threshold
    )


def ks_distance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of Benign against attack rows per feature."""
    rows = long_form(df.withColumn("_attack", is_attack()), ["_attack"], features)
    counts = rows.groupBy("feature", "value").agg(
        F.sum(F.lit(1) - F.col("_attack")).alias("b"), F.sum("_attack").alias("a")
    ).withColumn("_slice", value_slice("value"))
    cdf = running_sums(counts, {"cb": "b", "ca": "a"}, ["feature"], ["value"], ["_slice"], totals=True)
    return cdf.groupBy("feature").agg(
        F.max("cb_total").alias("n_benign"), F.max("ca_total").alias("n_attack"),
        F.max(F.abs(
            F.col("cb") / F.nullif(F.col("cb_total"), F.lit(0)) - F.col("ca") / F.nullif(F.col("ca_total"), F.lit(0))
        )).alias("ks"),
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each distinct combination, and their rate."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("row_count"), F.sum(F.col("n") - 1).alias("duplicates")
    ).withColumn("duplicate_rate", F.col("duplicates") / F.col("row_count"))


def histogram(df: DataFrame, value: Column, bins: int = 100) -> DataFrame:
    """Equal-width counts between min and max, last bin closed, empty bins 0."""
    rows = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e"))
    placed = rows.withColumn("e", ends.scalar()).withColumn(
        "bin",
        F.when(F.col("e.hi") == F.col("e.lo"), F.lit(0)).otherwise(
            F.least(F.floor((F.col("v") - F.col("e.lo")) * bins / (F.col("e.hi") - F.col("e.lo"))), F.lit(bins - 1))
        ).cast("int"),
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("e", ends.scalar())
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("e.lo") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def time_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first_seen"), F.max(column).alias("last_seen"))

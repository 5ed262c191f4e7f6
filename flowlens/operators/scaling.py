"""Z-score scaling of flow features and of sequence vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.cleaning import clamp_scaled
from flowlens.schema import SEQUENCE_FEATURES


def fit_flow_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std) rows: population std over non-NULL values, one aggregate."""
    stats = ", ".join(
        f"named_struct('feature', '{c}', 'mean', avg(double(`{c}`)), 'std', stddev_pop(double(`{c}`)))" for c in features
    )
    return df.agg(F.expr(f"array({stats})").alias("s")).select(F.inline("s"))


def _one_row(scaler: DataFrame, features: Sequence[str]) -> Column:
    """The scaler as one struct; its size is the number of features."""
    picks = ", ".join(
        f"'mean_{c}', max(mean) filter (where feature = '{c}'), "
        f"'std_{c}', max(if(std = 0, 1.0d, std)) filter (where feature = '{c}')"
        for c in features
    )
    return scaler.agg(F.expr(f"named_struct({picks})").alias("s")).scalar()


def apply_flow_scaler(
    df: DataFrame, scaler: DataFrame, features: Sequence[str], clamp: bool = False
) -> DataFrame:
    """Replace features by (x - mean) / std; a zero std divides by 1."""
    scaled = df.withColumn("_s", _one_row(scaler, features)).withColumns({
        c: F.expr(f"(double(`{c}`) - _s.`mean_{c}`) / _s.`std_{c}`") for c in features
    })
    if clamp:
        scaled = scaled.withColumns({c: clamp_scaled(c) for c in features})
    return scaled.drop("_s")


def scaled_ranges(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and std of each scaled feature."""
    return fit_flow_scaler(apply_flow_scaler(df, scaler, features), features)


def fit_sequence_scaler(windows: DataFrame, width: int = len(SEQUENCE_FEATURES)) -> DataFrame:
    """(feature_idx, mean, std) pooled over all steps of all windows, padding included.

    Element moments come from one vector summary; the pooled ones follow from
    them, so vectors are never exploded into rows.
    """
    vector = array_to_vector(F.col("sequence_features").cast("array<double>"))
    summary = windows.select(vector.alias("v")).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")
    )
    per_element = summary.select(
        F.col("s.count").alias("n"),
        F.posexplode(F.arrays_zip(
            vector_to_array("s.mean").alias("m"), vector_to_array("s.variance").alias("v")
        )).alias("i", "e"),
    ).select(
        F.pmod("i", F.lit(width)).cast("int").alias("feature_idx"),
        F.col("e.m").alias("m"),
        (F.col("e.v") * (F.col("n") - 1) / F.col("n")).alias("v"),
    )
    return per_element.groupBy("feature_idx").agg(
        F.avg("m").alias("mean"), F.sqrt(F.avg("v") + F.var_pop("m")).alias("std")
    )


def apply_sequence_scaler(windows: DataFrame, scaler: DataFrame) -> DataFrame:
    """Scale every step of ``sequence_features``."""
    packed = scaler.agg(
        F.array_sort(F.collect_list(F.struct(
            "feature_idx", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std")
        ))).alias("s")
    ).scalar()
    width = F.size("_s")
    scaled = F.transform(
        "sequence_features",
        lambda x, i: (
            (x.cast("double") - F.col("_s")[i % width]["mean"]) / F.col("_s")[i % width]["std"]
        ).cast("float"),
    )
    return windows.withColumn("_s", packed).withColumn("sequence_features", scaled).drop("_s")


def principal_components(df: DataFrame, features: Sequence[str], k: int = 2):
    """PCA of z-scored columns: (projected rows with an array ``components``, explained shares)."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    scaled = apply_flow_scaler(filled, fit_flow_scaler(filled, features), features)
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(scaled)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vectors)
    projected = model.transform(vectors).withColumn("components", vector_to_array("_pc")).drop("_v", "_pc")
    return projected, [float(x) for x in model.explainedVariance]

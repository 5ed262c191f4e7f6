"""Parquet tables laid out by capture day, and the build manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.schema import FILE_KEY


def write_by_day(df: DataFrame, path: str, columns: Sequence[str] = ("capture_day",)) -> None:
    """Write Parquet partitioned by day; only the days present are replaced.

    The rebalance hint gathers a day's rows into few files and splits a day too
    large for one task.
    """
    (
        df.hint("rebalance", *columns).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    )


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def training_scan(table: DataFrame, exclude_days: Sequence[str] = ()) -> DataFrame:
    """Train rows of real capture days, minus excluded days."""
    kept = table.filter((F.col("split") == "train") & (F.col("capture_day") != "pcap"))
    return kept.filter(~F.col("capture_day").isin(*exclude_days)) if exclude_days else kept


def golden_scan(table: DataFrame) -> DataFrame:
    return table.filter(F.col("split") == "test")


def built_files(spark: SparkSession, path: str) -> DataFrame:
    """Captures that a table written by day already holds; none where there is no table yet."""
    try:
        return spark.read.parquet(path).select(*FILE_KEY).distinct()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in FILE_KEY))


def pending_inputs(inputs: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """Inputs to build: those not yet processed, or all of them when forced."""
    names = inputs.select("capture_day", "capture_file").distinct()
    return names if force else names.join(processed, ["capture_day", "capture_file"], "left_anti")


def build_status(inputs: DataFrame, pending: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(capture_day, capture_file, status): success, skipped, or error."""
    key = ["capture_day", "capture_file"]
    names = inputs.select(*key).distinct()
    marked = names.join(pending.select(*key, F.lit(1).alias("_pending")), key, "left")
    status = F.when(F.col("_pending").isNull(), "skipped").otherwise("success")
    if errors is not None:
        marked = marked.join(errors.select(*key, F.lit(1).alias("_error")).distinct(), key, "left")
        status = F.when(F.col("_error") == 1, "error").otherwise(status)
    return marked.select(*key, status.alias("status"))


def run_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("files"))

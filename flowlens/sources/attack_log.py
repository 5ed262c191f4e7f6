"""Attack logs as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def parse_attack_log(text: DataFrame) -> DataFrame:
    """Date, Start_Time, End_Time, Target_IP and Attack_Type text to typed windows; keeps ``log_id``.

    A window ends on the day it starts, unless the log has a column End_Date.
    """
    at = lambda day, c: F.to_timestamp_ntz(F.concat_ws(" ", day, c))
    last = F.coalesce("End_Date", "Date") if "End_Date" in text.columns else F.col("Date")
    return text.select(
        "log_id", at(F.col("Date"), "Start_Time").alias("start_ts"), at(last, "End_Time").alias("end_ts"),
        F.col("Target_IP").alias("target_ip"), F.col("Attack_Type").alias("attack_type"),
    )


def read_attack_log(spark: SparkSession, path: str) -> DataFrame:
    """The log in file order, which decides between overlapping windows.

    ``multiLine`` keeps the file in one partition, so the generated ids follow
    its lines.
    """
    text = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return parse_attack_log(text.withColumn("log_id", F.monotonically_increasing_id().cast("int")))

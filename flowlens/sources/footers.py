"""Schemas of Parquet files as rows, from their footers, and where they differ from what a table should have."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.session import materialize

FOOTER = "uri string, folder string, rows long, column_name string, type string"
#: Arrow's names of the types Spark writes, where they differ from Spark's.
SPARK_NAMES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "bool": "boolean", "date32[day]": "date",
    "timestamp[us]": "timestamp_ntz", "timestamp[us, tz=UTC]": "timestamp", "timestamp[ns]": "timestamp_ntz",
}


def parquet_files(spark: SparkSession, root: str, by: str) -> DataFrame:
    """The Parquet files below ``root`` with the value of their ``by=...`` folder: uri, folder. Only the listing is read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    value = F.try_url_decode(F.replace(F.regexp_extract("path", f"{by}=([^/]+)", 1), F.lit("+"), F.lit("%2B")))
    return listing.select(F.col("_metadata.file_path").alias("uri"), value.alias("folder"))


def footer_rows(spark: SparkSession, root: str, by: str, tasks: int | None = None) -> DataFrame:
    """A row per file and column: uri, folder, rows, column_name, type (NULL and '' for a file that cannot be read).

    Footers are read where the tasks run, one job over the listing; no data page is.
    """
    files = parquet_files(spark, root, by)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for uri, folder in zip(batch["uri"], batch["folder"]):
                try:
                    system, place = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                    with system.open_input_file(place) as file:
                        footer = pq.ParquetFile(file)
                        rows = footer.metadata.num_rows
                        found += [(uri, folder, rows, f.name, SPARK_NAMES.get(str(f.type), str(f.type))) for f in footer.schema_arrow]
                except (OSError, ValueError):  # Arrow's errors are of these kinds
                    found.append((uri, folder, None, None, ""))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in FOOTER.split(", ")]).astype({"rows": "Int64"})

    spread = tasks or spark.sparkContext.defaultParallelism * 4
    return materialize(files.repartition(spread, "uri").mapInPandas(read, FOOTER), "footers")


def schema_drift(footers: DataFrame, expected: T.StructType) -> DataFrame:
    """folder, column_name, problem, found, files: columns of ``expected`` that files lack or have with another type, and unreadable files.

    A column that is there with NULLs only is no drift. Types are Spark's names.
    """
    spark = footers.sparkSession
    want = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in expected], "column_name string, wanted string")
    per_file = footers.groupBy("uri", "folder").agg(
        F.collect_list(F.struct("column_name", "type")).alias("have"), F.max(F.col("column_name").isNull()).alias("unreadable"))
    columns = want.agg(F.collect_list(F.struct("column_name", "wanted"))).scalar()
    one = per_file.withColumn("_w", F.explode(F.when(F.col("unreadable"), F.slice(columns, 1, 1)).otherwise(columns)))
    found = F.try_element_at(F.filter("have", lambda h: h["column_name"] == F.col("_w.column_name")), F.lit(1))["type"]
    judged = one.select(
        "folder", F.when(~F.col("unreadable"), F.col("_w.column_name")).alias("column_name"),
        F.when(~F.col("unreadable"), found).alias("found"), F.col("_w.wanted").alias("wanted"), "unreadable")
    problem = F.when(F.col("unreadable"), "unreadable").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("wanted"), "type")
    return judged.withColumn("problem", problem).filter("problem is not null").groupBy("folder", "column_name", "problem", "found").agg(
        F.count(F.lit(1)).alias("files"))

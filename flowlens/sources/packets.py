"""Packet capture CSVs: discovery, folders of one format, and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.cleaning import rename_raw
from flowlens.schema import FILE_KEY, RAW_PACKET_COLUMNS

TIME_COLUMN = "frame.time_epoch"


def _folder_value(name: str) -> Column:
    """The value of a ``name=value`` folder, as a partitioned read gives it; '' where there is none."""
    return F.try_url_decode(F.replace(F.regexp_extract("path", f"{name}=([^/]+)", 1), F.lit("+"), F.lit("%2B")))


def discover(
    spark: SparkSession, root: str, day: str | None = None, limit: int | None = None, priority_day: str | None = None
) -> DataFrame:
    """CSV files below ``root`` with their capture day and name, one row per file.

    Only the listing is read, never the content. A priority day sorts first.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").load(root).select("path", "length", F.col("_metadata.file_path").alias("uri"))
    )
    files = listing.select(
        "path", "uri", "length",
        *[_folder_value(name).alias(name) for name in FILE_KEY],
    )
    if day:
        files = files.filter(F.col("capture_day") == day)
    if limit is not None:
        first = (F.col("capture_day") != priority_day).cast("int") if priority_day else F.lit(0)
        files = files.orderBy(first, "path").limit(limit)
    return files


def _reader(spark: SparkSession, encoding: str):
    reader = spark.read.option("header", "true").option("encoding", encoding).option("enforceSchema", "false")
    # line splitting on raw bytes garbles two-byte encodings
    return reader.option("multiLine", "true") if encoding.upper().startswith("UTF-16") else reader


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or UTF-16 when the header does not decode as UTF-8."""
    header = "".join(_reader(spark, "UTF-8").csv(path).columns)
    return "UTF-16" if "\x00" in header or "�" in header else "UTF-8"


def read_packets(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A folder of captures of one encoding and header as text columns with plain names.

    A file whose header differs is an error, not silently shifted columns; ``ingest``
    reads folders of mixed files.
    """
    reader = _reader(spark, encoding or detect_encoding(spark, path))
    return rename_raw(reader.csv(path))


def write_packets(
    packets: DataFrame, path: str, encoding: str = "UTF-8", partitions: Sequence[str] = (), mode: str = "error"
) -> None:
    """Packets as quoted capture CSVs with dotted column names."""
    names = {plain: dotted for dotted, plain in RAW_PACKET_COLUMNS.items() if plain in packets.columns}
    renamed = packets.withColumnsRenamed(names)
    writer = renamed.write.mode(mode).option("header", "true").option("quoteAll", "true").option("encoding", encoding)
    (writer.partitionBy(*partitions) if partitions else writer).csv(path)

"""A folder of capture CSVs whose files differ in encoding and columns, read as one table.

Each file is judged on its own. A look at the first and last bytes of every file, one job over
the listing, gives its encoding, columns and status; files of one format are then one scan,
cut into byte ranges at record ends in every encoding. Records that do not fit their header
turn a file's status into an error, and the other files are read as if it were not there.
"""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO, NamedTuple

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.cleaning import rename_raw
from flowlens.schema import FILE_KEY
from flowlens.session import materialize
from flowlens.sources.packets import TIME_COLUMN, discover

BLOCK = 1 << 16
MISFIT = "_misfit"
LOOKED = "encoding string, columns array<string>, status string, reason string"


def encoding_of(head: bytes) -> str:
    """By byte order mark, else by where the zero bytes of two-byte characters are, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if head.startswith(mark):
            return name
    zeros = [head[start::2].count(0) for start in (0, 1)]
    return "UTF-8" if not any(zeros) else "UTF-16BE" if zeros[0] > zeros[1] else "UTF-16LE"


def _record(line: str) -> list[str]:
    return next(csv.reader([line], strict=True), [])


def look(file: BinaryIO, size: int) -> tuple[str | None, list[str] | None, str, str | None]:
    """(encoding, columns, status, reason) of one capture from its first and last lines."""
    head = file.read(BLOCK)
    encoding = encoding_of(head)
    end = "\n".encode(encoding)
    while end not in head and len(head) < size:
        more = file.read(BLOCK)
        if not more:
            break
        head += more
    first = head.split(end)[0].decode(encoding).lstrip("﻿").rstrip("\r\n\x00")
    if not first.strip():
        return encoding, None, "error", "no header"
    columns = _record(first)
    if TIME_COLUMN not in columns:
        return encoding, columns, "skipped", f"no {TIME_COLUMN} column"
    if len(set(columns)) < len(columns):
        return encoding, columns, "error", "a column is named twice"
    width = len("a".encode(encoding))
    reach = BLOCK
    while True:  # the last line, however long
        start = max(0, size - reach) // width * width
        file.seek(start)
        lines = file.read(size - start).decode(encoding, "replace").rstrip("\r\n").split("\n")
        if len(lines) > 1 or not start:
            break
        reach *= 4
    try:
        fields = len(_record(lines[-1].rstrip("\r")))
    except csv.Error:
        fields = -1
    if (start or len(lines) > 1) and fields != len(columns):
        return encoding, columns, "error", (
            "the last record is cut off" if fields < 0 else f"the last record has {fields} fields, the header {len(columns)}")
    return encoding, columns, "success", None


def inspect_files(spark: SparkSession, root: str, files: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The rows of ``discover`` with encoding, columns, status and reason of each file.

    ``status`` is ``success``, ``skipped`` (no time column) or ``error`` (unreadable, no header, bad text,
    cut off). Two blocks of each file are read, in ``tasks`` tasks. Files without a byte are
    not in Spark's listings.
    """
    files = discover(spark, root) if files is None else files
    schema = T.StructType([*files.schema, *T.StructType.fromDDL(LOOKED)])

    def looked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for uri in batch["uri"]:
                try:
                    system, place = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
                    with system.open_input_file(place) as file:
                        found.append(look(file, file.size()))
                except UnicodeDecodeError as bad:
                    found.append((None, None, "error", f"not {bad.encoding} text"))
                except (OSError, csv.Error) as bad:
                    found.append((None, None, "error", f"unreadable: {type(bad).__name__}"))
            columns = [f.split()[0] for f in LOOKED.split(", ")]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(found, columns=columns, dtype=object)], axis=1)

    spread = tasks or spark.sparkContext.defaultParallelism * 4
    return materialize(files.repartition(spread, "uri").mapInPandas(looked, schema), "inspected")


def _one_format(spark: SparkSession, root: str, encoding: str, columns: list[str], paths: list[str]) -> DataFrame:
    """Files of one encoding and header: their columns as text, ``uri``, and whether a record misfits the header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, MISFIT]])
    reader = spark.read.schema(schema).options(
        header="true", enforceSchema="true", encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=MISFIT,
        basePath=root, columnPruning="false")
    if encoding != "UTF-8":  # a line end of two bytes, which splits need to know
        reader = reader.option("lineSep", "\n")
    last = F.regexp_replace(F.col(f"`{columns[-1]}`"), "\r$", "")
    rows = reader.csv(paths).withColumn(columns[-1], last)
    return rename_raw(rows).withColumn("uri", F.col("_metadata.file_path")).withColumn(MISFIT, F.col(MISFIT).isNotNull())


class Ingested(NamedTuple):
    """``packets``: text columns of all good files; ``manifest``: a row per file with records, status and reason."""

    packets: DataFrame
    manifest: DataFrame


def ingest(spark: SparkSession, root: str, files: DataFrame | None = None) -> Ingested:
    """Every readable capture below ``root`` stacked by column name, and what became of each file.

    ``files`` may be a part of the listing. There is one scan per format (encoding and header), and
    their number, not that of the files, is the number of branches in the plan. The text is
    parsed once and stored; a file with a record that has more or fewer fields than its
    header is an error as a whole, and none of its rows are in ``packets``. Without any good
    file ``packets`` has no rows.
    """
    found = inspect_files(spark, root, files)
    good = found.filter("status = 'success'")
    formats = good.groupBy("encoding", "columns").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    if not formats:
        empty = spark.createDataFrame([], f"frame_time_epoch string, {', '.join(f'{c} string' for c in FILE_KEY)}")
        return Ingested(empty, found.withColumn("records", F.lit(None).cast("bigint")))
    frames = [_one_format(spark, root, f["encoding"], list(f["columns"]), list(f["paths"])) for f in formats]
    stored = materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), "captures")
    counted = stored.groupBy("uri").agg(F.count(F.lit(1)).alias("records"), F.count_if(MISFIT).alias("misfits"))
    bad = F.col("misfits") > 0
    misfits = F.concat("misfits", F.lit(" of "), "records", F.lit(" records do not fit the header"))
    manifest = materialize(found.join(counted, "uri", "left").withColumns({
        "status": F.when(bad, "error").otherwise(F.col("status")),
        "reason": F.when(bad, misfits).otherwise(F.col("reason")),
        "records": F.when(F.col("status") == "success", F.coalesce("records", F.lit(0).cast("bigint"))),
    }).drop("misfits"), "manifest")
    broken = manifest.filter("status = 'error'").select("uri")
    return Ingested(stored.join(broken, "uri", "left_anti").drop("uri", MISFIT), manifest)

"""Exact duplicates by sorting the contents themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from flowlens.llm.rows import col, pack, unpack
from flowlens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marker(last_only: bool):
    """Per sorted partition: number the runs of equal texts, mark each run's last row and the partition's edges."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, held, first, fresh = TaskContext.get().partitionId(), 0, None, True, 1

        def emit(table: pa.Table, starts: np.ndarray, last: np.ndarray, edge: np.ndarray):
            nonlocal run
            runs = run + np.cumsum(starts)
            run = int(runs[-1])
            norm = table.column("_norm")
            out = table.drop_columns(["_norm"] if last_only else ["_norm", "text"])
            out = out.append_column("part", pa.array(np.full(len(runs), part, np.int32)))
            out = out.append_column("run", pa.array(runs.astype(np.int64))).append_column("last", pa.array(last))
            texts = [None] * len(runs)
            for i in np.flatnonzero(edge):
                texts[i] = norm[int(i)].as_py()
            out = out.append_column("edge", pa.array(texts, pa.string()))
            if last_only:
                out = out.filter(pa.array(last | edge))
            return out.combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            table = table.append_column("_norm", pc.ascii_lower(table.column("text").fill_null("")))
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            n = table.num_rows
            if n > 1:
                norm = table.column("_norm")
                differs = pc.not_equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy()
                edge = np.zeros(n - 1, bool)
                edge[0], first = first, False
                yield from emit(table.slice(0, n - 1), np.append(fresh, differs[:-1].astype(int)), differs, edge)
                fresh = int(differs[-1])
            held = table.slice(n - 1)
        if held is not None:
            yield from emit(held, np.array([fresh]), np.array([True]), np.array([True]))

    return mark


def content_sort(packed: DataFrame, last_only: bool = False) -> DataFrame:
    """Packed rows in content order with their digest, partition, run and edges; stored.

    Sampled splitters deal the normalised texts out by (first bytes, digest, id), so a
    group of copies of any size spreads over as many partitions as it needs; Spark's
    external sort puts equal texts side by side, and neighbours are compared in full.
    ``edge`` carries the whole text of each partition's first and last row, where a
    group may go on in the next partition. ``last_only`` keeps only rows that can stay.
    """
    norm = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    keyed = packed.withColumn("sha", F.sha2(norm.cast("binary"), 256)).withColumn("head", F.substring(norm, 1, 8))
    dealt = keyed.repartitionByRange("head", "sha", "id").sortWithinPartitions("head", "sha", "id").drop("head")
    schema = StructType([f for f in dealt.schema if last_only or f.name != "text"] + [
        StructField("part", IntegerType()), StructField("run", LongType()),
        StructField("last", BooleanType()), StructField("edge", StringType()),
    ])
    return materialize(dealt.mapInArrow(_marker(last_only), schema), "content-sort")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty. The row
    with the largest id of a group stays; NULL ids are the smallest, and of repeated rows
    with the largest id exactly one stays. An empty table gives an empty result; other
    columns of ``df`` are not read.
    """
    rows = content_sort(df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")))
    runs = rows.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.max("edge").alias("edge"))
    whole = runs.filter("edge is not null").groupBy("edge").agg(
        F.sum("n").alias("all_n"), F.max("top").alias("all_top"), F.max(F.struct("part", "run")).alias("end"))
    inner = runs.filter("edge is null").select(
        "part", "run", F.col("n").alias("group_size"), F.col("top").alias("keep_id"), F.lit(True).alias("final"))
    outer = runs.filter("edge is not null").join(whole, "edge").select(
        "part", "run", F.col("all_n").alias("group_size"), F.col("all_top").alias("keep_id"),
        (F.struct("part", "run") == F.col("end")).alias("final"))
    runs = inner.unionByName(outer)
    return rows.drop("edge").join(runs, ["part", "run"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("last") & F.col("final")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``df`` as they are; same rules as ``exact_duplicates``."""
    rows = content_sort(pack(df, id_col, text_col), last_only=True)
    edges = rows.filter("edge is not null").select("part", "run", "edge")
    ends = edges.groupBy("edge").agg(F.max(F.struct("part", "run")).alias("end"))
    inner = rows.filter("edge is null")
    outer = rows.filter("edge is not null and last").join(ends, "edge").filter(F.struct("part", "run") == F.col("end"))
    return unpack(inner.select("text", "rest").unionByName(outer.select("text", "rest")), df, text_col)

"""Captures to labelled flow and sequence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.cleaning import clean_packets, with_packet_id
from flowlens.operators.flows import build_flows
from flowlens.operators.joins import with_row_index
from flowlens.operators.labels import apply_labels, label_domain
from flowlens.operators.sequences import cap_per_file, window_vectors
from flowlens.schema import FILE_KEY, FLOW_KEY, FLOW_SCHEMA, WINDOW_SIZE, WINDOW_STRIDE
from flowlens.session import configure, materialize
from flowlens.sources.datasets import build_status, built_files, pending_inputs, write_by_day
from flowlens.sources.ingest import ingest
from flowlens.sources.packets import discover


def build_dataset(
    packets: DataFrame,
    attack_log: DataFrame,
    out: str,
    processed: DataFrame | None = None,
    force: bool = False,
    size: int = WINDOW_SIZE,
    stride: int = WINDOW_STRIDE,
    cap: int | None = None,
    captures: DataFrame | None = None,
) -> DataFrame:
    """Write ``out/flows`` and ``out/sequences`` by day for captures not yet built.

    ``packets`` carries capture_day and capture_file; a packet_id is derived
    where absent. Without ``processed``, the captures in ``out/flows`` count as
    built. ``captures`` is the list of inputs, from a listing, to spare a scan of
    the packets. Days are replaced whole, so a pending file brings its day along;
    their packets are parsed and cleaned once and stored for both tables. ``cap``
    bounds the windows per capture; by default all are written. Flows have the
    types of ``FLOW_SCHEMA``. Returns the status per capture.
    """
    spark = packets.sparkSession
    configure(packets.sparkSession)
    if "packet_ts" not in packets.columns:
        packets = clean_packets(packets)
    if "packet_id" not in packets.columns:
        packets = with_packet_id(packets)
    inputs = materialize((packets if captures is None else captures).select(*FILE_KEY).distinct(), "captures")
    done = built_files(spark, f"{out}/flows") if processed is None else processed
    pending = materialize(pending_inputs(inputs, done, force), "pending")
    days = pending.select("capture_day").distinct()
    clean = clean_packets(apply_labels(packets.join(days, "capture_day", "left_semi"), attack_log))
    clean = materialize(clean, "clean-packets")
    row_id = {"first_packet_id": F.min("packet_id")}
    flows = build_flows(clean, per_file=True, label_domain=label_domain(attack_log), extra=row_id)
    flows = flows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in FLOW_SCHEMA})
    write_by_day(with_row_index(flows, FLOW_KEY), f"{out}/flows")
    vectors = cap_per_file(window_vectors(clean, size, stride, per_file=True), cap)
    write_by_day(vectors.withColumnRenamed("seq_idx", "row_idx"), f"{out}/sequences")
    return build_status(inputs, pending).withColumn("built_to", F.lit(out))


def build_folder(spark: SparkSession, root: str, attack_log: DataFrame, out: str, force: bool = False, **options) -> DataFrame:
    """Build the captures below ``root`` that are not in ``out`` yet; the status and reason of every capture.

    Files may differ in encoding and columns. Days with a pending capture are read again whole. A
    capture of which a file cannot be read, is cut off or does not fit its header is an
    ``error``; one that is built already or has no time column is ``skipped``; the others are built.
    """
    listed = materialize(discover(spark, root), "listing")
    pending = pending_inputs(listed, built_files(spark, f"{out}/flows"), force)
    read = ingest(spark, root, listed.join(pending.select("capture_day").distinct(), "capture_day", "left_semi"))
    outcome = read.manifest.groupBy(*FILE_KEY).agg(
        F.count_if(F.col("status") == "error").alias("bad"), F.count_if(F.col("status") == "success").alias("good"),
        F.min_by("reason", F.col("status")).alias("why"))
    fit = outcome.filter("bad = 0 and good > 0")
    sound = read.packets.join(fit.select(*FILE_KEY), FILE_KEY, "left_semi")
    built = build_dataset(sound, attack_log, out, force=force, captures=fit, **options)
    known = listed.select(*FILE_KEY).distinct().join(outcome, FILE_KEY, "left").join(
        built.select(*FILE_KEY, F.col("status").alias("built")), FILE_KEY, "left")
    return known.select(
        *FILE_KEY, F.when(F.col("bad") > 0, "error").otherwise(F.coalesce("built", F.lit("skipped"))).alias("status"),
        F.when((F.col("bad") > 0) | (F.col("good") == 0), F.col("why")).alias("reason"))

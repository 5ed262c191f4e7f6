"""Streaming forms: minute counts, idle-timeout flows, labelling with triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.operators.flows import mode_in_domain
from flowlens.operators.labels import apply_labels
from flowlens.operators.triage import batch_triage
from flowlens.schema import FLOW_KEY
from flowlens.session import configure


def with_event_time(packets: DataFrame, delay: str) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need, and the watermark on it."""
    return packets.withColumn("event_time", F.col("packet_ts").cast("timestamp")).withWatermark("event_time", delay)


def minute_counts(packets: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Packets and bytes per minute, emitted once the watermark has passed the minute."""
    return (
        with_event_time(packets, delay)
        .groupBy(F.window("event_time", "1 minute").alias("_w"))
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("bin"), "packets", "bytes")
    )


def idle_timeout_flows(
    packets: DataFrame, label_domain: Sequence[str], gap: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """5-tuple flows that end after ``gap`` without a packet. The label comes from per-label counters."""
    rows = packets.filter(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())
    return (
        with_event_time(rows, delay)
        .groupBy(F.session_window("event_time", gap).alias("_w"), *FLOW_KEY)
        .agg(
            F.count(F.lit(1)).alias("frame_len_count"), F.sum("frame_len").alias("frame_len_sum"),
            mode_in_domain(label_domain).alias("label"),
        )
        .select(F.col("_w.start").cast("timestamp_ntz").alias("timestamp_min"), *FLOW_KEY,
                "frame_len_count", "frame_len_sum", "label")
    )


def _state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the last batch of a finished query left in its state store."""
    return spark.read.format("statestore").load(checkpoint)


def open_minutes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Minutes that :func:`minute_counts` has counted and not closed yet, with its columns."""
    return _state(spark, checkpoint).select(
        F.col("key.window.start").cast("timestamp_ntz").alias("bin"), F.col("value.count").alias("packets"), F.col("value.sum").alias("bytes"))


def open_flows(spark: SparkSession, checkpoint: str, label_domain: Sequence[str]) -> DataFrame:
    """Flows that :func:`idle_timeout_flows` has seen and not ended yet, with its columns.

    The state holds a counter per label in the order of ``label_domain``, under one name; they are told apart by place.
    """
    labels = [f"_label_{i}" for i in range(len(label_domain))]
    state = _state(spark, checkpoint)
    places = ["_w", *FLOW_KEY, "frame_len_count", "frame_len_sum", *labels]
    named = T.StructType([T.StructField(n, f.dataType) for n, f in zip(places, state.schema["value"].dataType.fields, strict=True)])
    flat = state.select(F.col("value").cast(named).alias("_v")).select("_v.*")
    names = F.array(*[F.lit(x) for x in label_domain])
    counters = F.array(*labels)
    return flat.select(
        F.col("_w.start").cast("timestamp_ntz").alias("timestamp_min"), *FLOW_KEY, "frame_len_count", "frame_len_sum",
        F.element_at(names, F.array_position(counters, F.array_max(counters)).cast("int")).alias("label"))


def late_minutes(packets: DataFrame, counted: DataFrame) -> DataFrame:
    """Packets of each minute that came behind the watermark: those of ``packets``, a batch read of the same
    input, that are in none of the ``counted`` minutes, closed or open."""
    given = packets.groupBy(F.date_trunc("minute", "packet_ts").cast("timestamp_ntz").alias("bin")).agg(F.count(F.lit(1)).alias("given"))
    seen = counted.groupBy("bin").agg(F.sum("packets").alias("seen"))
    missing = F.col("given") - F.coalesce("seen", F.lit(0))
    return given.join(seen, "bin", "left").select("bin", missing.alias("packets")).filter("packets > 0")


def label_and_triage(scored: DataFrame, attack_log: DataFrame) -> DataFrame:
    """Label and triage scored packets; stateless, so each batch is a projection."""
    return batch_triage(apply_labels(scored, attack_log))


def run_available(stream: DataFrame, path: str, checkpoint: str, more: bool = False) -> DataFrame:
    """Process everything available, append to Parquet, and read the result back.

    Another run on the same checkpoint goes on with what has come since. With ``more`` to come, the query
    ends without the closing batch that has no rows: a mark closes minutes in the batch after the one that
    moved it, and rows behind it are late in the batch after that.
    """
    conf, closing = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    given = conf.get(closing)
    if more:
        conf.set(closing, "false")
    try:  # a query keeps the settings it was started with
        query = (
            stream.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        conf.set(closing, given)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder of event files as a stream.

    Without ``files_per_batch`` all files present are one batch. With it, the watermark
    moves between batches, so rows older than an earlier batch's mark are late.
    """
    configure(spark)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)

"""Streams whose rows arrive in several batches, some behind the watermark."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from flowlens.plans import registry, stream_queries
from flowlens.session import scratch_path
from flowlens.streaming import packets as ST

START = datetime(2024, 1, 1)
SCHEMA = "packet_id int, packet_ts timestamp_ntz, frame_len bigint, ip_src string, ip_dst string, ip_proto int, tcp_srcport int, tcp_dstport int, label string"


def arrivals(spark, batches):
    """Files of packets (minute, label), read one per batch in order."""
    folder, rows = scratch_path(spark, "arrivals"), []
    for k, batch in enumerate(batches):
        part = [(100 * k + i, START + timedelta(minutes=m), 10 + i, "a", "b", 6, 1, 2, label) for i, (m, label) in enumerate(batch)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        rows += part
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return reader.parquet(folder), spark.createDataFrame(rows, SCHEMA)


def minutes(df, column="packets"):
    return {int((r["bin"] - START).total_seconds() // 60): r[column] for r in df.collect()}


def test_closed_open_and_late_minutes_are_all_packets(spark):
    stream, given = arrivals(spark, [[(m, "x") for m in range(0, 60)], [(m + 0.5, "x") for m in range(58, 70)], [(5, "x"), (5.2, "x"), (66, "x"), (100, "x")]])
    path, left = scratch_path(spark, "out"), scratch_path(spark, "left")
    closed = ST.run_available(ST.minute_counts(stream), path, left)
    open_ = ST.open_minutes(spark, left)
    late = ST.late_minutes(given, closed.unionByName(open_))
    done, rest, missed = minutes(closed), minutes(open_), minutes(late)
    assert missed == {5: 2} and rest == {100: 1} and not set(done) & set(rest)
    assert done[5] == 1 and done[66] == 2 and sum(done.values()) + sum(rest.values()) + sum(missed.values()) == given.count()
    both = closed.unionByName(open_).agg(F.sum("bytes")).first()[0]
    assert both + 10 + 11 == given.agg(F.sum("frame_len")).first()[0]


def test_ended_and_open_flows_are_all_packets(spark):
    stream, given = arrivals(spark, [[(0, "b"), (1, "b"), (2, "a")], [(200, "a"), (201, "b")]])
    path, left = scratch_path(spark, "out"), scratch_path(spark, "left")
    ended = ST.run_available(ST.idle_timeout_flows(stream, ["a", "b", "c"], gap="30 minutes"), path, left)
    open_ = ST.open_flows(spark, left, ["a", "b", "c"])
    assert ended.columns == open_.columns
    assert [(r["frame_len_count"], r["label"]) for r in ended.collect()] == [(3, "b")]
    assert [(r["frame_len_count"], r["frame_len_sum"], r["label"], r["timestamp_min"]) for r in open_.collect()] == [
        (2, 21, "a", START + timedelta(minutes=200))]


def test_nothing_is_late_or_open_without_rows(spark):
    given = spark.createDataFrame([], SCHEMA)
    counted = spark.createDataFrame([], "bin timestamp_ntz, packets bigint, bytes bigint")
    assert ST.late_minutes(given, counted).count() == 0


def late_events(spark, tmp_path):
    """Ids end in the digit that says when a row arrives: 1 to 8 first, 0 last, the rest between."""
    day = datetime(2024, 1, 1)
    at = lambda minute: None if minute is None else day + timedelta(minutes=minute)
    rows = [(11, 0), (12, 5), (13, 60), (18, 100), (21, None), (19, 1), (29, 104), (-7, 2), (10, 3), (20, 3.5), (30, 95), (40, 120), (None, 3), (None, 96)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    events = spark.createDataFrame([(i, at(m), 7, "click", 1.0 + k, None) for k, (i, m) in enumerate(rows)], schema)
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_rows_that_arrive_behind_the_watermark_are_dropped(spark, tmp_path):
    """The first two batches count whole; of the last, rows behind minute 90 are lost; minutes up to 110 are closed."""
    folder = late_events(spark, tmp_path)
    found = minutes(entry_module.queries()["str_04_late_rows"](spark, folder).drop("bytes"), "packets")
    assert found == {0: 1, 1: 1, 2: 1, 5: 1, 60: 1, 95: 1, 96: 1, 100: 1, 104: 1}
    kept = {r["state"]: r["packets"] for r in entry_module.queries()["str_04_accounted_rows"](spark, folder).collect()}
    assert kept == {"closed": 9, "open": 1, "late": 3}


def test_arrivals_without_rows_still_move_the_stream_on(spark, tmp_path):
    folder = late_events(spark, tmp_path)
    few = f"{folder}/few"
    spark.read.parquet(f"{folder}/events.parquet").filter("event_id in (11, 18, 10, 40)").write.parquet(f"{few}/events.parquet")
    found = minutes(entry_module.queries()["str_04_late_rows"](spark, few), "packets")
    assert found == {0: 1, 100: 1}


def test_no_task_writes_an_arrival_alone(spark, tmp_path):
    """Every batch has a file per task, and three batches with rows and one without make the stream."""
    folder = late_events(spark, tmp_path)
    given = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        closed, left = stream_queries._late_minutes(registry.Tables(spark, folder), "spread")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", given[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", given[1])
    assert closed.count() == 9
    batches = [f for f in os.listdir(f"{left}/commits") if f.isdigit()]
    seen = [f for f in os.listdir(f"{left}/sources/0") if f.isdigit()]
    files = sum(open(f"{left}/sources/0/{f}").read().count('"path"') for f in seen)
    assert len(batches) == 4 and len(seen) == 3 and files > 3
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"

"""Registered queries: sources and sinks, round-tripped through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import cleaning as C
from flowlens.functions.ordering import epoch_us
from flowlens.operators.labels import apply_labels
from flowlens.plans.dataset_build import build_dataset
from flowlens.plans.fixtures import ATTACK_WINDOWS
from flowlens.plans.registry import Tables, query
from flowlens.session import scratch_path
from flowlens.sources import datasets as D
from flowlens.sources import packets as PK
from flowlens.sources.attack_log import read_attack_log
from flowlens.sources.ingest import ingest


def capture_text(t: Tables):
    """Packets as a capture exporter writes them: everything text, times as epoch seconds."""
    us = epoch_us("packet_ts")
    epoch = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    return t.packets.select(
        "capture_day", "capture_file", epoch.alias("frame_time_epoch"), "ip_src", "ip_dst", "tcp_srcport", "tcp_dstport",
        "frame_len", "ip_proto", "tcp_flags", "udp_srcport", "udp_dstport", "ip_ttl", "tcp_window",
    )


READ_BACK = """
    select capture_day, packet_ts, ip_src, ip_dst, cast(ip_proto as double) as ip_proto, cast(tcp_srcport as double) as tcp_srcport,
      cast(tcp_dstport as double) as tcp_dstport, cast(frame_len as double) as frame_len, tcp_flags,
      round(payload_ratio, 9) as payload_ratio from clean"""
READ_COLUMNS = [
    "capture_day", "packet_ts", "ip_src", "ip_dst", "ip_proto", "tcp_srcport", "tcp_dstport", "frame_len", "tcp_flags",
]


@query("src_01_packet_csv", READ_BACK)
def _(t):
    path = scratch_path(t.spark, "csv")
    PK.write_packets(capture_text(t), path, partitions=["capture_day", "capture_file"])
    clean = C.clean_packets(PK.read_packets(t.spark, path))
    return clean.select(*READ_COLUMNS, F.round("payload_ratio", 9).alias("payload_ratio"))


@query("src_02_utf16_csv", READ_BACK)
def _(t):
    """The same captures with one file of each day in UTF-16, all in one folder; every file tells its own encoding."""
    path = scratch_path(t.spark, "csv16")
    text = capture_text(t)
    wide = F.col("capture_file").endswith("-1")
    PK.write_packets(text.filter(~wide), path, partitions=["capture_day", "capture_file"])
    PK.write_packets(text.filter(wide), path, encoding="UTF-16", partitions=["capture_day", "capture_file"], mode="append")
    clean = C.clean_packets(ingest(t.spark, path).packets)
    return clean.select(*READ_COLUMNS, F.round("payload_ratio", 9).alias("payload_ratio"))


UNTIMED = "(capture_day >= 'D05' and capture_file not like '%-2')"


@query("src_03_skip_untimed", f"""
    select case when {UNTIMED} then 'skipped' else 'success' end as status, case when {UNTIMED} then 'no frame.time_epoch column' end as reason,
      count(distinct (capture_day, capture_file)) as captures, cast(sum(case when {UNTIMED} then 0 else 1 end) as bigint) as packets
    from packets group by 1, 2""")
def _(t):
    """Some captures of each later day come from an old export without epoch times; they alone are left out."""
    path = scratch_path(t.spark, "mixed")
    text = capture_text(t)
    PK.write_packets(text.filter(f"not {UNTIMED}"), path, partitions=["capture_day", "capture_file"])
    PK.write_packets(text.filter(UNTIMED).drop("frame_time_epoch"), path, partitions=["capture_day", "capture_file"], mode="append")
    read = ingest(t.spark, path)
    packets = read.packets.groupBy("capture_day", "capture_file").agg(F.count(F.lit(1)).alias("n"))
    per_capture = read.manifest.groupBy("capture_day", "capture_file", "status", "reason").agg(F.sum("records").alias("records"))
    return per_capture.join(packets, ["capture_day", "capture_file"], "left").groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("captures"), F.coalesce(F.sum("n"), F.lit(0)).alias("packets"))


@query("src_04_discovery", """
    select distinct capture_day, capture_file from packets where capture_day = 'D03'
    union all (select capture_day, capture_file from (select distinct capture_day, capture_file from packets)
      order by (capture_day <> 'D07')::int, capture_day, capture_file limit 8)""")
def _(t):
    """Files of one day, then the first eight files with another day in front."""
    path = scratch_path(t.spark, "tree")
    PK.write_packets(capture_text(t).repartition("capture_day", "capture_file"), path, partitions=["capture_day", "capture_file"])
    found = lambda **kw: PK.discover(t.spark, path, **kw).select("capture_day", "capture_file")
    return found(day="D03").unionAll(found(limit=8, priority_day="D07"))


PROCESSED = "capture_day < 'D04' and capture_file like '%-2'"


@query("src_05_pending_inputs", f"select distinct capture_day, capture_file from packets where not ({PROCESSED})")
def _(t):
    done = t.packets.filter(PROCESSED).select("capture_day", "capture_file").distinct()
    return D.pending_inputs(t.packets, done)


@query("src_06_column_subset", "select label, packet_rate > 1 as fast, count(*) as n from file_flows group by 1, 2")
def _(t):
    path = scratch_path(t.spark, "flows")
    D.write_by_day(t.file_flows, path)
    rows = D.read_columns(t.spark, path, ["label", "packet_rate"])
    return rows.groupBy("label", (F.col("packet_rate") > 1).alias("fast")).agg(F.count(F.lit(1)).alias("n"))


@query("src_07_role_scan", """
    select 'train' as role, capture_day, count(*) as n from split_rows where split = 'train' and capture_day not in ('D02', 'D05') group by 2
    union all select 'golden', capture_day, count(*) from split_rows where split = 'test' group by 2""")
def _(t):
    path = scratch_path(t.spark, "split")
    D.write_by_day(t.split_rows, path, ["split", "capture_day"])
    table = t.spark.read.parquet(path)
    scans = [(D.training_scan(table, ["D02", "D05"]), "train"), (D.golden_scan(table), "golden")]
    counted = [df.groupBy(F.lit(role).alias("role"), "capture_day").agg(F.count(F.lit(1)).alias("n")) for df, role in scans]
    return counted[0].unionByName(counted[1])


@query("src_08_attack_log", "select label, count(*) as n from labelled group by 1")
def _(t):
    """The log written as CSV with separate date and time columns, read back and applied to all packets."""
    rows = [
        (start[:10], start[11:], end[:10], end[11:], target, attack) for _, start, end, target, attack in ATTACK_WINDOWS
    ]
    path = scratch_path(t.spark, "attack-log")
    text = t.spark.createDataFrame(
        rows, "Date string, Start_Time string, End_Date string, End_Time string, Target_IP string, Attack_Type string")
    text.coalesce(1).write.option("header", "true").csv(path)  # one small file, whose line order is the log's
    return apply_labels(t.packets, read_attack_log(t.spark, path)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("src_09_flow_sink", """
    select capture_day, count(*) as flows, cast(sum(frame_len_sum) as bigint) as bytes from file_flows
    where capture_day <> 'D01' or frame_len_count > 1 group by 1""")
def _(t):
    """Write all days, then replace one; the others stay as they were."""
    path = scratch_path(t.spark, "sink")
    D.write_by_day(t.file_flows, path)
    D.write_by_day(t.file_flows.filter("capture_day = 'D01' and frame_len_count > 1"), path)
    return t.spark.read.parquet(path).groupBy("capture_day").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("frame_len_sum").alias("bytes")
    )


BROKEN = "(capture_day = 'D09' and capture_file = 'cap-4')"


@query("src_10_run_summary", f"""
    select status, count(*) as files, cast(sum(records) as bigint) as records from (
      select capture_day, capture_file, case when {BROKEN} then 'error' when {PROCESSED} then 'skipped' else 'success' end as status,
        case when {BROKEN} then 0 else count(*) end as records
      from packets group by 1, 2) group by 1""")
def _(t):
    """A run over captures, of which some are built already and one has line ends inside its records."""
    path = scratch_path(t.spark, "captures")
    text = capture_text(t).withColumn("tcp_flags", F.when(F.expr(BROKEN), F.lit("0x\n02")).otherwise(F.col("tcp_flags")))
    PK.write_packets(text.repartition("capture_day", "capture_file"), path, partitions=["capture_day", "capture_file"])
    manifest = ingest(t.spark, path).manifest
    done = t.packets.filter(PROCESSED).select("capture_day", "capture_file").distinct()
    status = D.build_status(manifest, D.pending_inputs(manifest, done), manifest.filter("status = 'error'"))
    return status.join(manifest.drop("status"), ["capture_day", "capture_file"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("status") == "error", 0).otherwise(F.col("records"))).alias("records"))


@query("run_01_dataset_build", """
    select capture_day, flows, bytes, windows from (
      select capture_day, count(*) as flows, cast(sum(frame_len_sum) as bigint) as bytes from file_flows group by 1)
    join (select capture_day, count(*) as windows from seqs group by 1) using (capture_day)""")
def _(t):
    """The whole build: label, clean, flows and vectors, both tables written by day and read back."""
    out = scratch_path(t.spark, "build")
    build_dataset(t.packets, t.log, out, size=20, stride=5)
    flows, seqs = t.spark.read.parquet(f"{out}/flows"), t.spark.read.parquet(f"{out}/sequences")
    return flows.groupBy("capture_day").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("frame_len_sum").alias("bytes")
    ).join(seqs.groupBy("capture_day").agg(F.count(F.lit(1)).alias("windows")), "capture_day")

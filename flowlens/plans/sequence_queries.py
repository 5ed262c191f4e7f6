"""Registered queries: windows, timelines, rankings, samples, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import joins as J
from flowlens.operators import sequences as S
from flowlens.operators import split as SP
from flowlens.operators import timeline as TL
from flowlens.plans.oracle import FLOW_KEY as KEY_SQL
from flowlens.plans.registry import FILE_ORDER_KEY, ROW_KEY, Tables, query, r6
from flowlens.schema import FLOW_KEY, SEQUENCE_FEATURES

WINDOW_SUMS = """
    select w.ip_src, w.ip_dst, w.win, count(*) as packets, cast(sum(frame_len) as bigint) as bytes,
      cast(sum(tcp_flags) as bigint) as flags_sum, round(sum(payload_ratio), 6) as payload_ratio_sum,
      count(*) as direction_sum, any_value(l.label) as label
    from {rows} w join {labels} l using (ip_src, ip_dst, win) group by 1, 2, 3"""


@query("win_01_windows", WINDOW_SUMS.format(rows="window_rows", labels="window_labels"))
def _(t):
    return r6(S.session_windows(t.clean, label_domain=t.domain))


@query("win_01_windows_20_by_5", WINDOW_SUMS.format(rows="small_window_rows", labels="small_window_labels"))
def _(t):
    """Short windows slide on every session; labels come from ``mode``."""
    return r6(S.session_windows(t.clean, 20, 5))


WIDTH = len(SEQUENCE_FEATURES)


@query("win_02_vectors", """
    select ip_src, ip_dst, win, 1800 as length,
      cast(sum(case when feature_idx < 8 then v * (((step - 1) * 9 + feature_idx) % 1009 + 1) else 0 end) as bigint) as checksum,
      round(sum(case when feature_idx = 8 then v * (((step - 1) * 9 + feature_idx) % 1009 + 1) else 0 end), 4) as ratio_checksum
    from window_steps group by 1, 2, 3""")
def _(t):
    """Position-weighted sums of every padded vector."""
    weighted = lambda keep: F.aggregate(
        F.transform("sequence_features", lambda x, i: F.when(keep(i % WIDTH), x.cast("double") * (i % 1009 + 1)).otherwise(0.0)),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    return r6(S.window_vectors(t.clean).select(
        "ip_src", "ip_dst", "win", F.size("sequence_features").alias("length"),
        weighted(lambda k: k < 8).cast("bigint").alias("checksum"),
        weighted(lambda k: k == 8).alias("ratio_checksum"),
    ), digits=4)


@query("win_03_window_labels", "select ip_src, ip_dst, win, label from small_window_labels")
def _(t):
    return S.window_vectors(t.clean, 20, 5, blocks_per_group=8).select("ip_src", "ip_dst", "win", "label")


@query("win_04_capped_windows", """
    select capture_day, capture_file, ip_src, ip_dst, win, label, row_idx as seq_idx from seqs where row_idx < 40""")
def _(t):
    capped = S.cap_per_file(t.file_windows, cap=40)
    return capped.select("capture_day", "capture_file", "ip_src", "ip_dst", "win", "label", "seq_idx")


def _lag_sql(part, source):
    return f"""
    select packet_id, round((epoch_us(packet_ts) - lag(epoch_us(packet_ts)) over (partition by {part} order by packet_ts, packet_id)) / 1e6, 6)
      as interarrival_sec from {source}"""


@query("win_05_interarrival", _lag_sql("capture_day, capture_file", "packets"))
def _(t):
    return r6(TL.interarrival(t.packets).select("packet_id", "interarrival_sec"))


@query("win_05_interarrival_per_flow", _lag_sql(KEY_SQL, "(select * from clean where ip_src is not null and ip_dst is not null)"))
def _(t):
    rows = t.clean.filter(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())
    return r6(TL.interarrival(rows, FLOW_KEY, slice_seconds=3_600).select("packet_id", "interarrival_sec"))


@query("win_06_packet_rate", """
    with b as (select date_trunc('second', packet_ts) as bin, count(*) as n from packets group by 1),
      spine as (select unnest(generate_series(min(bin), max(bin), interval 1 second)) as bin from b)
    select date_trunc('hour', s.bin) as hour, count(*) as seconds, count(*) filter (n is null) as empty_seconds,
      cast(sum(coalesce(n, 0)) as bigint) as packets, max(coalesce(n, 0)) as peak
    from spine s left join b on s.bin = b.bin group by 1""")
def _(t):
    """The gap-filled per-second series, reported by hour."""
    return TL.packet_rate(t.packets).groupBy(TL.time_bin("bin", "hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("seconds"), F.count_if(F.col("packets") == 0).alias("empty_seconds"),
        F.sum("packets").alias("packets"), F.max("packets").alias("peak"),
    )


@query("win_07_intensity_by_label", """
    with b as (select label, date_trunc('minute', timestamp_min) as bin, cast(sum(frame_len_count) as bigint) as n from flows group by 1, 2),
      spine as (select label, unnest(generate_series(min(bin), max(bin), interval 1 minute)) as bin from b group by 1)
    select s.label, s.bin, coalesce(n, 0) as packets from spine s left join b on s.label = b.label and s.bin = b.bin""")
def _(t):
    return TL.intensity(t.flows, ["label"])


FILE_TIMELINE = """
    select s.bin, coalesce(n, 0) as packets from (
      select distinct bin from (select capture_day, capture_file, unnest(generate_series(min(date_trunc('minute', timestamp_min)),
        max(date_trunc('minute', timestamp_min)), interval 1 minute)) as bin from file_flows group by 1, 2)) s
    left join (select date_trunc('minute', timestamp_min) as bin, cast(sum(frame_len_count) as bigint) as n from file_flows group by 1) b
      on s.bin = b.bin"""


@query("win_08_file_timeline", FILE_TIMELINE)
def _(t):
    return TL.file_timeline(t.file_flows)


ENTROPY = """
    with p as (select {key} date_trunc('minute', packet_ts) as bin, tcp_dstport, count(*) as n from packets
        where tcp_dstport is not null group by all),
      h as (select {key} bin, -sum(n / total * ln(n / total)) as h from (
        select *, sum(n) over (partition by {key} bin) as total from p) group by all),
      spine as (select {key} unnest(generate_series(min(bin), max(bin), interval 1 minute)) as bin from p {group})
    select {shown} s.bin, round(coalesce(h, 0), 6) + 0.0e0 as port_entropy from spine s left join h on s.bin = h.bin {on}"""


@query("win_09_port_entropy", ENTROPY.format(key="", group="", shown="", on=""))
def _(t):
    return TL.port_entropy(t.packets).withColumn("port_entropy", F.round("port_entropy", 6) + 0.0)


@query("win_09_port_entropy_per_day", ENTROPY.format(
    key="capture_day,", group="group by 1", shown="s.capture_day,", on="and s.capture_day = h.capture_day"))
def _(t):
    return TL.port_entropy(t.packets, ["capture_day"]).withColumn("port_entropy", F.round("port_entropy", 6) + 0.0)


@query("win_10_attack_marks", f"""
    select f.bin, f.packets, count(a.log_id) as attack_windows, count(a.log_id) > 0 as in_attack from ({FILE_TIMELINE}) f
    left join attack_log a on f.bin between date_trunc('minute', a.start_ts) and date_trunc('minute', a.end_ts) group by 1, 2""")
def _(t):
    return TL.mark_windows(TL.file_timeline(t.file_flows), t.log)


@query("win_11_busiest_minutes", """
    select ip_dst, date_trunc('minute', timestamp_min) as minute, count(*) as flows from flows
    where ip_dst = (select ip_dst from flows where starts_with(ip_dst, '172.31.') group by 1 order by count(*) desc, ip_dst limit 1)
    group by 1, 2 order by flows desc, minute limit 10""")
def _(t):
    return TL.busiest_minutes(t.flows)


# ---- rankings ----------------------------------------------------------------


def _top(column, k, source="packets"):
    return f"select {column}, count(*) as n from {source} where {column} is not null group by 1 order by n desc, {column} limit {k}"


@query("top_01_sources", _top("ip_src", 20))
def _(t):
    return TL.top_values(t.packets, "ip_src", 20)


@query("top_01_destinations", _top("ip_dst", 20))
def _(t):
    return TL.top_values(t.packets, "ip_dst", 20)


@query("top_02_ports", _top("tcp_dstport", 20))
def _(t):
    return TL.top_values(t.packets, "tcp_dstport", 20)


@query("top_02_flags", _top("tcp_flags", 10))
def _(t):
    return TL.top_values(t.packets, "tcp_flags", 10)


@query("top_03_internal_targets", _top("ip_dst", 5, "(select * from flows where starts_with(ip_dst, '172.31.'))"))
def _(t):
    return TL.top_internal_targets(t.flows)


@query("top_04_time_order", "select packet_ts, packet_id from packets order by packet_ts, packet_id")
def _(t):
    return t.packets.select("packet_ts", "packet_id").orderBy("packet_ts", "packet_id")


# ---- samples and splits ------------------------------------------------------


@query("smp_01_sample", """
    select packet_id, label from labelled order by (packet_id * 7919 + 104729) % 1000003, packet_id limit 1000""")
def _(t):
    key = F.expr("(packet_id * 7919 + 104729) % 1000003")
    return SP.sample_rows(t.labelled, 1000, ["packet_id"], key).select("packet_id", "label")


@query("smp_02_first_files", """
    select capture_day, capture_file, first_packet_id, label from file_flows
    where (capture_day, capture_file) in (select distinct capture_day, capture_file from file_flows order by 1, 2 limit 10)""")
def _(t):
    return SP.first_files(t.file_flows, 10).select("capture_day", "capture_file", "first_packet_id", "label")


@query("smp_02_files_up_to", """
    select capture_day, capture_file, first_packet_id from file_flows where (capture_day, capture_file) in (
      select capture_day, capture_file from (select capture_day, capture_file, n, sum(n) over (order by capture_day, capture_file) as upto from files) where upto - n < 2000)""")
def _(t):
    return SP.files_up_to(t.file_flows, 2000).select("capture_day", "capture_file", "first_packet_id")


@query("smp_03_attack_priority", """
    select capture_day, capture_file, first_packet_id, label from file_flows where (capture_day, capture_file) in (
      select capture_day, capture_file from (select *, sum(n) over (order by not has_attack, file_key, capture_day, capture_file) as upto from files)
      where has_attack or upto - n < 7000)""")
def _(t):
    return SP.attack_priority(t.file_flows, 7000, FILE_ORDER_KEY()).select("capture_day", "capture_file", "first_packet_id", "label")


@query("smp_04_stratified_split", "select capture_day, capture_file, first_packet_id, label, split from split_rows")
def _(t):
    return t.split_rows.select("capture_day", "capture_file", "first_packet_id", "label", "split")


@query("smp_05_split_summary", """
    select label, train, test, round(test * 100.0e0 / (train + test), 6) as test_pct,
      case when label = 'Benign' then 'n/a' when train > 0 and test > 0 then 'ok' else 'fail' end as coverage
    from (select label, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test from split_rows group by 1)""")
def _(t):
    return r6(SP.split_summary(t.split_rows))


def golden(t: Tables):
    return SP.golden_files(t.files, file_key=FILE_ORDER_KEY())


@query("smp_06_golden_flows", """
    select f.capture_day, f.capture_file, f.first_packet_id, f.label from file_flows f join golden g using (capture_day, capture_file)""")
def _(t):
    return SP.golden_set(t.file_flows, golden(t)).select("capture_day", "capture_file", "first_packet_id", "label")


@query("smp_06_golden_sequences", """
    select s.capture_day, s.capture_file, s.row_idx, s.label from seqs s join golden g using (capture_day, capture_file)""")
def _(t):
    t.store("file_flows", "file_windows")
    return SP.golden_set(t.seqs, golden(t)).select("capture_day", "capture_file", "row_idx", "label")


@query("smp_07_repaired_sequences", """
    with tested as (select f.capture_day, f.capture_file, f.row_idx from indexed_flows f join split_rows r using (capture_day, capture_file, first_packet_id)
        where r.split = 'test'),
      ranked as (select s.*, row_number() over (partition by capture_day, capture_file order by (row_idx * 7919 + 104729) % 1000003, row_idx) as r,
          count(*) over (partition by capture_day, capture_file) as n, x.row_idx is not null as hit
        from seqs s left join tested x using (capture_day, capture_file, row_idx)),
      rule as (select capture_day, capture_file, max(n) > max(top) and bool_or(hit) as by_index
        from ranked join (select capture_day, capture_file, max(row_idx) as top from tested group by 1, 2) using (capture_day, capture_file) group by 1, 2)
    select capture_day, capture_file, row_idx, label, case when by_index then 'index' else 'sample' end as picked_by
    from ranked join rule using (capture_day, capture_file)
    where case when by_index then hit else r <= greatest(1, floor(n * 0.15e0)) end""")
def _(t):
    t.store("file_flows", "file_windows").store("seqs", "indexed_flows", "split_rows")
    tested = t.indexed_flows.join(
        t.split_rows.filter("split = 'test'").select("capture_day", "capture_file", "first_packet_id"), ["capture_day", "capture_file", "first_packet_id"]
    )
    key = F.expr("(row_idx * 7919 + 104729) % 1000003")
    return SP.repair_sequences(t.seqs, tested, ["row_idx"], key).select("capture_day", "capture_file", "row_idx", "label", "picked_by")


QUOTA = {
    "quota": """
    select capture_day, capture_file, n, triggers, least(n, 4000 - (upto - n)) as take,
      cast(case when least(n, 4000 - (upto - n)) = n then triggers
        else floor(triggers * (least(n, 4000 - (upto - n)) / n)) end as bigint) as triggers_counted
    from (select *, cast(sum(n) over (order by file_key, capture_day, capture_file) as bigint) as upto from (
      select f.capture_day, f.capture_file, f.file_key, count(*) as n, cast(sum(triggered) as bigint) as triggers
      from file_triaged join files f using (capture_day, capture_file) group by 1, 2, 3)) where 4000 - (upto - n) > 0"""
}


def quota(t: Tables):
    files = t.file_triaged.groupBy("capture_day", "capture_file").agg(F.count(F.lit(1)).alias("n"), F.sum("triggered").alias("triggers"))
    return SP.evaluation_quota(files, 4000, FILE_ORDER_KEY())


@query("smp_08_evaluation_quota", "select capture_day, capture_file, n, triggers, take, triggers_counted from quota", QUOTA)
def _(t):
    return quota(t)


@query("smp_08_evaluation_rows", """
    select i.capture_day, i.capture_file, i.row_idx, i.first_packet_id from indexed_flows i join quota q
      on i.capture_day = q.capture_day and i.capture_file = q.capture_file and i.row_idx < q.take""", QUOTA)
def _(t):
    return SP.evaluation_rows(t.indexed_flows, quota(t)).select("capture_day", "capture_file", "row_idx", "first_packet_id")


@query("smp_08_evaluation_all_rows", """
    select f.capture_day, f.capture_file, f.row_idx, f.first_packet_id, q.triggers from indexed_flows f join (
      select capture_day, capture_file, count(*) filter (triggered = 1) as triggers from file_triaged group by 1, 2) q using (capture_day, capture_file)""")
def _(t):
    """The default: every row of every file, and each file's triggers as counted."""
    t.store("file_flows", "file_scored")
    files = t.file_triaged.groupBy("capture_day", "capture_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum("triggered").alias("triggers"))
    quota = SP.evaluation_quota(files, file_key=FILE_ORDER_KEY())
    rows = SP.evaluation_rows(t.indexed_flows, quota)
    return rows.join(quota.select("capture_day", "capture_file", F.col("triggers_counted").alias("triggers")), ["capture_day", "capture_file"]).select(
        "capture_day", "capture_file", "row_idx", "first_packet_id", "triggers")


@query("smp_09_permutation_split", """
    select first_packet_id, capture_day, capture_file, case when r <= floor(n * 0.9e0) then 'train' else 'eval' end as split
    from (select *, row_number() over (order by (first_packet_id * 7919 + 104729) % 1000003, first_packet_id) as r,
      count(*) over () as n from file_flows)""")
def _(t):
    flows = t.store("file_flows").file_flows  # counted twice and split: three reads of the stored rows
    split = SP.permutation_split(flows, ["first_packet_id"], key=ROW_KEY())
    return split.select("first_packet_id", "capture_day", "capture_file", "split")


@query("smp_10_mixed_batches", """
    select batch, capture_day, count(*) as n, count(*) filter (label <> 'Benign') as attacks
    from (select *, cast((first_packet_id * 7919 + 104729) % 1000003 % 8 as int) as batch from file_flows) group by 1, 2""")
def _(t):
    batches = SP.mixed_batches(t.file_flows, ["first_packet_id"], 8, ROW_KEY())
    return batches.groupBy("batch", "capture_day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != "Benign").alias("attacks")
    )


# ---- set operations ----------------------------------------------------------


@query("set_01_union", """
    select capture_day, count(*) as flows, count(case when capture_day < 'D05' then frame_len_std end) as with_std from file_flows group by 1""")
def _(t):
    """Two exports, the second without a deviation column, stacked by name."""
    early = t.file_flows.filter("capture_day < 'D05'")
    late = t.file_flows.filter("capture_day >= 'D05'").drop("frame_len_std")
    return early.unionByName(late, allowMissingColumns=True).groupBy("capture_day").agg(
        F.count(F.lit(1)).alias("flows"), F.count("frame_len_std").alias("with_std")
    )


@query("set_02_set_operations", """
    select 'attack_only' as kind, ip_src from (select ip_src from flows where label = 'DDoS-HOIC' except select ip_src from flows where label = 'Web-XSS')
    union all select 'both', ip_src from (select ip_src from flows where label = 'DDoS-HOIC' intersect select ip_src from flows where label = 'Web-XSS')""")
def _(t):
    ddos = t.flows.filter("label = 'DDoS-HOIC'").select("ip_src")
    web = t.flows.filter("label = 'Web-XSS'").select("ip_src")
    return (
        ddos.subtract(web).select(F.lit("attack_only").alias("kind"), "ip_src")
        .unionByName(ddos.intersect(web).select(F.lit("both").alias("kind"), "ip_src"))
    )


@query("set_03_zero_overlap", """
    select count(*) as overlapping from (select capture_day, capture_file, first_packet_id from split_rows where split = 'train'
      intersect select capture_day, capture_file, first_packet_id from split_rows where split = 'test')""")
def _(t):
    shared = SP.overlap_rows(t.split_rows, ["capture_day", "capture_file", "first_packet_id"])
    return shared.agg(F.count(F.lit(1)).alias("overlapping"))

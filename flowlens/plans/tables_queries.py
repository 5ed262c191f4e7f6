"""Registered queries: projections, joins and aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from flowlens.functions import cleaning as C
from flowlens.functions.ordering import epoch_us
from flowlens.operators import audit as A
from flowlens.operators import flows as FL
from flowlens.operators import joins as J
from flowlens.operators import labels as L
from flowlens.operators import profile as P
from flowlens.operators import sequences as S
from flowlens.operators import triage as TR
from flowlens.plans.oracle import FLOW_KEY as KEY_SQL
from flowlens.plans.registry import FILE_ORDER_KEY, Tables, query, r6
from flowlens.schema import FILE_KEY, FLOW_COLUMNS, FLOW_FEATURES, FLOW_KEY, LABELS
from flowlens.session import scratch_path
from flowlens.sources.datasets import built_files, write_by_day
from flowlens.sources.footers import footer_rows, schema_drift

# ---- projections -------------------------------------------------------------

RAW_SQL = {
    "raw": """
    select packet_id, ip_src, ip_dst,
      case when packet_id % 13 = 0 then 'n/a' else concat(cast(epoch_us(packet_ts) // 1000000 as varchar), '.',
        lpad(cast(epoch_us(packet_ts) % 1000000 as varchar), 6, '0'), '789') end as frame_time_epoch,
      case when packet_id % 17 = 0 then 'oops' else cast(frame_len as varchar) end as frame_len,
      cast(ip_proto as varchar) as ip_proto, cast(tcp_srcport as varchar) as tcp_srcport,
      cast(tcp_dstport as varchar) as tcp_dstport, cast(ip_ttl as varchar) as ip_ttl, tcp_flags
    from packets"""
}


def raw_text(t: Tables):
    """Packets as capture text, with unreadable times and lengths in between; no window column."""
    us = epoch_us("packet_ts")
    text = F.concat(
        F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"), F.lit("789")
    )
    return t.packets.select(
        "packet_id", "ip_src", "ip_dst",
        F.when(F.col("packet_id") % 13 == 0, "n/a").otherwise(text).alias("frame_time_epoch"),
        F.when(F.col("packet_id") % 17 == 0, "oops").otherwise(F.col("frame_len").cast("string")).alias("frame_len"),
        *[F.col(c).cast("string").alias(c) for c in ("ip_proto", "tcp_srcport", "tcp_dstport", "ip_ttl")],
        "tcp_flags",
    )


@query("prj_01_packet_time", """
    select packet_id, make_timestamp(cast(floor(try_cast(frame_time_epoch as decimal(20,9)) * 1000000) as bigint)) as packet_ts
    from raw where try_cast(frame_time_epoch as decimal(20,9)) is not null""", RAW_SQL)
def _(t):
    return raw_text(t).select("packet_id", C.packet_time("frame_time_epoch").alias("packet_ts")).filter(
        F.col("packet_ts").isNotNull()
    )


@query("prj_02_numeric_coercion", """
    select packet_id, coalesce(try_cast(frame_len as double), 0) as frame_len,
      coalesce(try_cast(tcp_srcport as double), 0) as tcp_srcport, coalesce(try_cast(ip_ttl as double), 0) as ip_ttl
    from raw""", RAW_SQL)
def _(t):
    raw = raw_text(t)
    return raw.select("packet_id", *[C.number_or_zero(raw, c).alias(c) for c in ("frame_len", "tcp_srcport", "ip_ttl")])


@query("prj_03_absent_columns", """
    select packet_id, 0 as tcp_window, coalesce(try_cast(ip_proto as double), 0) as ip_proto,
      coalesce(try_cast(tcp_dstport as double), 0) as tcp_dstport
    from raw where try_cast(frame_time_epoch as decimal(20,9)) is not null""", RAW_SQL)
def _(t):
    return C.clean_packets(raw_text(t)).select("packet_id", "tcp_window", "ip_proto", "tcp_dstport")


@query("prj_04_tcp_flags", "select packet_id, tcp_flags from clean")
def _(t):
    return t.packets.select("packet_id", C.flags_value("tcp_flags").alias("tcp_flags"))


@query("prj_05_payload_ratio", "select packet_id, round(payload_ratio, 9) as payload_ratio from clean")
def _(t):
    return t.packets.select("packet_id", F.round(C.payload_ratio("frame_len"), 9).alias("payload_ratio"))


@query("prj_06_packet_direction", """
    select least(ip_src, ip_dst) as host_a, greatest(ip_src, ip_dst) as host_b, count(*) as packets,
      cast(sum(case when ip_src = first_src then 1 else 0 end) as bigint) as from_initiator
    from (select *, first_value(ip_src) over (partition by least(ip_src, ip_dst), greatest(ip_src, ip_dst)
            order by packet_ts, packet_id) as first_src
          from (select packet_id, packet_ts, case when packet_id % 3 = 1 then ip_dst else ip_src end as ip_src,
                  case when packet_id % 3 = 1 then ip_src else ip_dst end as ip_dst
                from clean where ip_src is not null))
    group by 1, 2""")
def _(t):
    """Direction in two-way sessions; every third packet is turned round to make replies."""
    reply = F.col("packet_id") % 3 == 1
    mixed = t.clean.filter(F.col("ip_src").isNotNull()).withColumns({
        "ip_src": F.when(reply, F.col("ip_dst")).otherwise(F.col("ip_src")),
        "ip_dst": F.when(reply, F.col("ip_src")).otherwise(F.col("ip_dst")),
    })
    numbered = S.number_packets(mixed, bidirectional=True)
    return numbered.groupBy(F.col("ip_src").alias("host_a"), F.col("ip_dst").alias("host_b")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_direction").alias("from_initiator")
    )


@query("prj_07_protocol_names", """
    select case ip_proto when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP'
      else concat('Other(', cast(ip_proto as varchar), ')') end as protocol, count(*) as n from packets group by 1""")
def _(t):
    return t.packets.groupBy(C.protocol_name("ip_proto").alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_08_binary_label", "select packet_id, cast(label <> 'Benign' as int) as is_attack from labelled")
def _(t):
    return t.labelled.select("packet_id", C.is_attack().alias("is_attack"))


@query("prj_09_feature_matrix", """
    select round(cast(cast(frame_len_count as float) as double), 3) as frame_len_count,
      round(cast(cast(frame_len_sum as float) as double), 3) as frame_len_sum,
      round(cast(cast(frame_len_mean as float) as double), 3) as frame_len_mean,
      round(cast(cast(ip_ttl_mean as float) as double), 3) as ip_ttl_mean from flows""")
def _(t):
    picked = FL.feature_matrix(t.flows).select("frame_len_count", "frame_len_sum", "frame_len_mean", "ip_ttl_mean")
    return r6(picked, digits=3)


@query("prj_10_label_column", "select label, count(*) as n from flows group by 1")
def _(t):
    """An export with the older label and dotted column names, normalised and counted."""
    older = t.flows.withColumnsRenamed({"label": "label_<lambda>", "frame_len_count": "frame.len_count"})
    return C.normalize_flow_names(older).groupBy("label").agg(F.count("frame_len_count").alias("n"))


@query("prj_11_internal_hosts", """
    select ip_dst, ip_src, count(*) as n from packets
    where starts_with(ip_dst, '172.31.') and starts_with(ip_src, '172.31.') group by 1, 2""")
def _(t):
    inside = t.packets.filter(C.is_internal("ip_dst") & C.is_internal("ip_src"))
    return inside.groupBy("ip_dst", "ip_src").agg(F.count(F.lit(1)).alias("n"))


@query("prj_12_numeric_columns", """
    select ip_proto, tcp_srcport, tcp_dstport, frame_len_count, frame_len_sum from flows""")
def _(t):
    names = C.numeric_columns(t.flows)
    return t.flows.select(*names).drop(*[c for c in names if c.endswith(("mean", "std", "sec", "rate"))])


@query("prj_13_finite_values", """
    select packet_id,
      case when isnan(v) or isinf(v) then 0 else round(v, 6) end as cleaned,
      case when isnan(v) then 0 when v = 'inf'::double then 10 when v = '-inf'::double then -10 else round(v, 6) end as clamped
    from (select packet_id, case packet_id % 5 when 0 then 'nan'::double when 1 then 'inf'::double
            when 2 then '-inf'::double else frame_len / 7.0e0 end as v from packets)""")
def _(t):
    v = (
        F.when(F.col("packet_id") % 5 == 0, float("nan")).when(F.col("packet_id") % 5 == 1, float("inf"))
        .when(F.col("packet_id") % 5 == 2, float("-inf")).otherwise(F.col("frame_len") / F.lit(7.0))
    )
    rows = t.packets.select("packet_id", v.alias("v"))
    return r6(rows.select("packet_id", C.finite_or_zero(F.col("v")).alias("cleaned"), C.clamp_scaled("v").alias("clamped")))


@query("prj_14_log_shift", """
    select label, count(*) as n from (
      select p.packet_id, coalesce((select arg_max(a.attack_type, a.log_id) from (
          select log_id, attack_type, start_ts + interval 4 hour as start_ts, end_ts + interval 4 hour as end_ts,
            case when target_ip = '192.168.10.50' then '172.31.67' else target_ip end as target_ip from attack_log) a
        where p.packet_ts between a.start_ts and a.end_ts
          and (a.target_ip is null or starts_with(p.ip_src, a.target_ip) or starts_with(p.ip_dst, a.target_ip))),
        'Benign') as label from packets p) group by 1""")
def _(t):
    """Labels after moving the log by four hours and remapping one target."""
    remap = t.spark.createDataFrame([("192.168.10.50", "172.31.67")], "target_ip string, new_target_ip string")
    log = L.remap_targets(L.shift_log(t.log, 4), remap)
    return L.apply_labels(t.packets, log).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("prj_15_canonical_labels", """
    select case label when 'DDoS-HOIC' then 'DDoS' when 'DDoS-LOIC-HTTP' then 'DDoS' when 'Web-XSS' then 'Web' else label end
      as label, count(*) as n from labelled group by 1""")
def _(t):
    spelling = t.spark.createDataFrame(
        [("DDoS-HOIC", "DDoS"), ("DDoS-LOIC-HTTP", "DDoS"), ("Web-XSS", "Web")], "variant string, canonical string"
    )
    return L.canonical_labels(t.labelled, spelling).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- joins -------------------------------------------------------------------


@query("join_01_labels", "select packet_id, label from labelled")
def _(t):
    return t.labelled.select("packet_id", "label")


@query("join_01_labels_long_log", "select packet_id, label from labelled")
def _(t):
    """The bucketed form used when the log is too long to inline."""
    return L.join_labels(t.packets, t.log).select("packet_id", "label")


@query("join_01_labels_octet", """
    select label, count(*) as n from (
      select p.packet_id, coalesce((select arg_max(a.attack_type, a.log_id) from attack_log a
        where p.packet_ts between a.start_ts and a.end_ts
          and (a.target_ip is null or p.ip_src = a.target_ip or p.ip_dst = a.target_ip
            or starts_with(p.ip_src, concat(a.target_ip, '.')) or starts_with(p.ip_dst, concat(a.target_ip, '.')))),
        'Benign') as label from packets p) group by 1""")
def _(t):
    return L.apply_labels(t.packets, t.log, match="octet").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("join_02_positional", f"""
    select f.capture_day, f.capture_file, f.row_idx, f.ip_src, f.ip_dst, f.label, s.ip_src as ip_src_seq, s.win, s.label as label_seq
    from indexed_flows f join seqs s on f.capture_day = s.capture_day and f.capture_file = s.capture_file and f.row_idx = s.row_idx""")
def _(t):
    t.store("file_flows", "file_windows")
    return J.positional_join(t.indexed_flows, t.seqs).select(
        "capture_day", "capture_file", "row_idx", "ip_src", "ip_dst", "label", "ip_src_seq", "win", "label_seq"
    )


@query("join_03_session_scores", f"""
    select capture_day, capture_file, {KEY_SQL}, f.label, s.t_score from file_flows f left join (
      select capture_day, capture_file, ip_src, ip_dst, max((win * 37 + 11) % 100) / 100.0e0 as t_score
      from file_window_labels group by 1, 2, 3, 4) s
    using (capture_day, capture_file, ip_src, ip_dst)""")
def _(t):
    windows = t.file_windows.withColumn("t_score", (F.col("win") * 37 + 11) % 100 / F.lit(100.0))
    return J.session_join(t.file_flows, windows).select(*FILE_KEY, *FLOW_KEY, "label", "t_score")


@query("join_04_flow_only_fallback", """
    select ip_src, ip_dst, count(*) as flows, cast(sum(case when s.t is null then 1 else 0 end) as bigint) as flow_only,
      cast(sum(case when s.t is null and x_score > 0.5 then 1 else 0 end) as bigint) as flagged_by_flow
    from file_scored f left join (select capture_day, capture_file, ip_src, ip_dst, 1 as t from file_window_labels
        where label <> 'Benign' group by 1, 2, 3, 4) s
      using (capture_day, capture_file, ip_src, ip_dst) group by 1, 2""")
def _(t):
    """Sessions without an attack window have no sequence score, so the flow score decides."""
    scores = t.file_windows.filter(F.col("label") != "Benign").withColumn("t_score", F.lit(1.0))
    triaged = TR.batch_triage(J.session_join(t.file_scored.drop("t_score"), scores))
    alone = F.col("outcome") == "flow_only"
    return triaged.groupBy("ip_src", "ip_dst").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(alone).alias("flow_only"),
        F.count_if(alone & (F.col("pred") == 1)).alias("flagged_by_flow"),
    )


@query("join_05_matching_sequences", """
    select s.capture_day, s.capture_file, s.row_idx, s.label from seqs s where exists (
      select 1 from indexed_flows f join split_rows r using (capture_day, capture_file, first_packet_id)
      where r.split = 'test' and f.capture_day = s.capture_day and f.capture_file = s.capture_file and f.row_idx = s.row_idx)""")
def _(t):
    t.store("file_flows", "file_windows")
    tested = t.indexed_flows.join(
        t.split_rows.filter("split = 'test'").select("capture_day", "capture_file", "first_packet_id"), ["capture_day", "capture_file", "first_packet_id"]
    )
    return J.matching_sequences(t.seqs, tested).select("capture_day", "capture_file", "row_idx", "label")


@query("join_06_shared_files", """
    select distinct capture_day, capture_file from split_rows where split = 'train'
    intersect select capture_day, capture_file from split_rows where split = 'test'""")
def _(t):
    return A.shared_files(t.split_rows.filter("split = 'train'"), t.split_rows.filter("split = 'test'"))


@query("join_07_label_coverage", """
    select label, cast(sum(case when split = 'train' then 1 else 0 end) as bigint) as train_rows,
      cast(sum(case when split = 'test' then 1 else 0 end) as bigint) as test_rows,
      case when sum(case when split = 'train' then 1 else 0 end) = 0 then 'test_only'
           when sum(case when split = 'test' then 1 else 0 end) = 0 then 'train_only' else 'both' end as status
    from split_rows group by 1""")
def _(t):
    return A.label_coverage(t.split_rows.filter("split = 'train'"), t.split_rows.filter("split = 'test'"))


@query("join_08_capture_gaps", """
    with days as (select cast(packet_ts as date) as day, min(packet_ts) as lo, max(packet_ts) as hi from packets group by 1),
      w as (select *, unnest(generate_series(date_trunc('day', start_ts), date_trunc('day', end_ts), interval 1 day)) as day from attack_log)
    select log_id, attack_type, start_ts, end_ts,
      cast(sum(case when start_ts <= hi and end_ts >= lo then 1 else 0 end) as bigint) as days_covered,
      min(lo) as capture_start, max(hi) as capture_end,
      case when sum(case when start_ts <= hi and end_ts >= lo then 1 else 0 end) > 0 then 'covered' else 'gap' end as status
    from w left join days on cast(w.day as date) = days.day group by 1, 2, 3, 4""")
def _(t):
    return L.capture_gaps(t.packets, t.log)


@query("join_09_file_parity", """
    select capture_day, capture_file from packets where capture_day = 'D03' or capture_file = 'cap-2' group by 1, 2""")
def _(t):
    """Inputs without a counterpart among the files of a built table: one day was not built, and one capture of each."""
    path = scratch_path(t.spark, "built")
    write_by_day(t.file_flows.filter("capture_day <> 'D03' and capture_file <> 'cap-2'"), path)
    return J.unprocessed(t.packets, built_files(t.spark, path))


# ---- aggregates --------------------------------------------------------------

ROUNDED_FLOWS = f"""
    select {{key}}, frame_len_count, frame_len_sum, round(frame_len_mean, 6) as frame_len_mean,
      round(frame_len_std, 6) as frame_len_std, timestamp_min, timestamp_max, round(ip_ttl_mean, 6) as ip_ttl_mean,
      round(tcp_window_mean, 6) as tcp_window_mean, label, round(flow_duration_sec, 6) as flow_duration_sec,
      round(packet_rate, 6) as packet_rate from {{table}}"""


@query("agg_01_flows", ROUNDED_FLOWS.format(key=KEY_SQL, table="flows"))
def _(t):
    return r6(t.flows).select(*FLOW_COLUMNS)


@query("agg_01_flows_per_file", ROUNDED_FLOWS.format(key="capture_day, capture_file, " + KEY_SQL, table="file_flows"))
def _(t):
    """Per capture file, with the label from ``mode`` instead of a label domain."""
    return r6(FL.build_flows(t.clean, per_file=True)).select("capture_day", "capture_file", *FLOW_COLUMNS)


@query("agg_01_flows_udp_ports", """
    select ip_src, ip_dst, ip_proto, case when tcp_srcport > 0 then tcp_srcport else coalesce(udp_srcport, 0) end as tcp_srcport,
      case when tcp_dstport > 0 then tcp_dstport else coalesce(udp_dstport, 0) end as tcp_dstport,
      count(*) as frame_len_count, cast(sum(frame_len) as bigint) as frame_len_sum
    from clean where ip_src is not null and ip_dst is not null group by 1, 2, 3, 4, 5""")
def _(t):
    flows = FL.build_flows(t.clean, label_domain=t.domain, use_udp_ports=True)
    return flows.select(*FLOW_KEY, "frame_len_count", "frame_len_sum")


@query("agg_02_rates", f"""
    select {KEY_SQL}, round(flow_duration_sec, 6) as flow_duration_sec, round(packet_rate, 6) as packet_rate from flows""")
def _(t):
    return r6(t.flows.select(*FLOW_KEY, "flow_duration_sec", "packet_rate"))


@query("agg_03_label_distribution", """
    select label, count(*) as n, round(count(*) * 100.0e0 / (select count(*) from flows), 6) as pct from flows group by 1""")
def _(t):
    return r6(P.label_distribution(t.flows))


@query("agg_04_class_balance", """
    select total, benign, attack, round(benign / attack, 6) as ratio, cast(round_even(benign / attack, 0) as bigint) as recommended_weight,
      case when abs(benign / attack - 18) < 5 then 'ok' else 'fix' end as verdict
    from (select count(*) as total, count(*) filter (label = 'Benign') as benign, count(*) filter (label <> 'Benign') as attack from flows)""")
def _(t):
    return r6(A.class_balance(t.flows))


@query("agg_05_day_audit", """
    select capture_day, count(*) filter (label = 'Benign') as benign, count(*) filter (label <> 'Benign') as attack,
      coalesce(string_agg(distinct label, ', ' order by label) filter (label <> 'Benign'), '') as attacks,
      round(case when count(*) filter (label <> 'Benign') > 0
        then count(*) filter (label = 'Benign') / count(*) filter (label <> 'Benign') end, 6) as ratio
    from file_flows group by rollup (capture_day)""")
def _(t):
    return r6(A.day_audit(t.file_flows))


@query("agg_06_day_inventory", """
    select coalesce(f.capture_day, w.capture_day) as capture_day, coalesce(f.label, w.label) as label,
      coalesce(flows, 0) as flows, coalesce(windows, 0) as windows
    from (select capture_day, label, count(*) as flows from file_flows group by 1, 2) f
    full join (select capture_day, label, count(*) as windows from file_window_labels group by 1, 2) w
      on f.capture_day = w.capture_day and f.label = w.label""")
def _(t):
    return A.day_inventory(t.file_flows, t.file_windows)


@query("agg_06_day_label_pivot", "select capture_day, " + ", ".join(
    f"count(*) filter (label = '{x}') as {x.lower().replace('-', '_')}" for x in LABELS) + " from file_flows group by 1")
def _(t):
    return A.day_label_pivot(t.file_flows, LABELS)


@query("agg_07_label_family", """
    select count(*) as files, count(*) filter (hits > 0) as files_with_family, cast(sum(hits) as bigint) as family_rows
    from (select capture_day, capture_file, count(*) filter (contains(label, 'DDoS')) as hits from file_flows group by 1, 2)""")
def _(t):
    return A.label_family(t.file_flows)


@query("agg_08_null_counts", " union all ".join(
    f"select '{c}' as column_name, count(*) filter ({c} is null) as nulls, "
    f"count(*) filter ({c} is null) > 0 and not contains('{c}', 'std') as unexpected from flows" for c in FLOW_COLUMNS))
def _(t):
    return A.null_counts(t.flows.select(*FLOW_COLUMNS))


@query("agg_09_time_range", "select min(timestamp_min) as first_seen, max(timestamp_min) as last_seen from flows")
def _(t):
    return P.time_range(t.flows, "timestamp_min")


def _unpivot(features, table, ids=()):
    keys = "".join(f"{i}, " for i in ids)
    return " union all ".join(
        f"select {keys}'{c}' as feature, cast({c} as double) as value from {table} where {c} is not null" for c in features
    )


SIGNATURE = ["packet_rate", "flow_duration_sec", "frame_len_mean", "ip_ttl_mean"]


@query("agg_10_label_means", """
    select m.label, m.feature, round(m.mean, 5) as mean, round(b.mean, 5) as benign_mean,
      round((m.mean - b.mean) * 100.0e0 / nullif(b.mean, 0), 5) as diff_pct
    from means m left join means b on m.feature = b.feature and b.label = 'Benign'""",
    {"long": _unpivot(SIGNATURE, "flows", ["label"]),
     "means": "select label, feature, avg(value) as mean from long group by 1, 2"})
def _(t):
    return r6(P.label_means(t.flows, SIGNATURE), digits=5)


BOX_FEATURES = ["frame_len_mean", "flow_duration_sec", "packet_rate", "ip_ttl_mean"]


@query("agg_11_boxplots", """
    select q.label, q.feature, n, round(lo, 6) as min, round(hi, 6) as max, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
      round((select min(value) from long l where l.label = q.label and l.feature = q.feature and l.value >= q1 - (q3 - q1) * 1.5e0), 6) as whisker_low,
      round((select max(value) from long l where l.label = q.label and l.feature = q.feature and l.value <= q3 + (q3 - q1) * 1.5e0), 6) as whisker_high
    from (select label, feature, count(*) as n, min(value) as lo, max(value) as hi, quantile_cont(value, 0.25) as q1,
            quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from long group by 1, 2) q""",
    {"long": _unpivot(BOX_FEATURES, "flows", ["label"])})
def _(t):
    return r6(P.boxplot_stats(t.flows, BOX_FEATURES))


@query("agg_12_attack_durations", """
    select label, count(*) as n, round(min(flow_duration_sec), 6) as min, round(max(flow_duration_sec), 6) as max,
      round(quantile_cont(flow_duration_sec, 0.25), 6) as q1, round(quantile_cont(flow_duration_sec, 0.5), 6) as median,
      round(quantile_cont(flow_duration_sec, 0.75), 6) as q3 from flows where label <> 'Benign' group by 1""")
def _(t):
    return r6(P.duration_distribution(t.flows))


NUMERIC = ["ip_proto", "tcp_srcport", "tcp_dstport", *FLOW_FEATURES]
PAIRS = [(NUMERIC[j], NUMERIC[i]) for i in range(len(NUMERIC)) for j in range(i + 1, len(NUMERIC))]
CORR_SQL = " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, corr(cast({a} as double), cast({b} as double)) as r from flows" for a, b in PAIRS)


@query("agg_13_correlation_matrix", "select feature_a, feature_b, round(r, 6) as r from pairs", {"pairs": CORR_SQL})
def _(t):
    return r6(P.correlation_matrix(t.flows, NUMERIC))


@query("agg_14_redundant_pairs", "select feature_a, feature_b, round(r, 6) as r from pairs where abs(r) > 0.5", {"pairs": CORR_SQL})
def _(t):
    """Pairs above 0.5: the generated traffic has none above the usual 0.95."""
    return r6(P.redundant_pairs(t.flows, NUMERIC, 0.5))


SEEN = ["first_seen", "last_seen"]
SEEN_SQL = " union all ".join(
    f"select '{b}' as feature_a, '{a}' as feature_b, corr({b}, {a}) as r from seen" for a, b in combinations([*FLOW_FEATURES, *SEEN], 2))


@query("agg_14_usual_threshold", "select feature_a, feature_b, round(r, 6) as r from pairs where abs(r) > 0.95", {
    "seen": "select " + ", ".join(f"cast({c} as double) as {c}" for c in FLOW_FEATURES) + """,
        epoch_us(timestamp_min) / 1e6 as first_seen, epoch_us(timestamp_max) / 1e6 as last_seen from file_flows""",
    "pairs": SEEN_SQL})
def _(t):
    """Pairs above 0.95 of each capture's flows, with when a flow was first and last seen."""
    seen = t.file_flows.withColumns({"first_seen": epoch_us("timestamp_min") / 1e6, "last_seen": epoch_us("timestamp_max") / 1e6})
    return r6(P.redundant_pairs(seen, [*FLOW_FEATURES, *SEEN]))


@query("agg_15_target_correlation", " union all ".join(
    f"select '{c}' as feature, round(corr(cast({c} as double), case when label <> 'Benign' then 1.0e0 else 0.0e0 end), 6) as r from flows"
    for c in FLOW_FEATURES))
def _(t):
    return r6(P.target_correlation(t.flows, FLOW_FEATURES))


@query("agg_16_skewness", """
    select feature, round(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5e0), 5) as skewness,
      abs(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5e0)) > 5 as flagged
    from (select *, avg(value) over (partition by feature) as mu from long) group by 1""",
    {"long": _unpivot(FLOW_FEATURES, "flows")})
def _(t):
    return r6(P.skewed_features(t.flows, FLOW_FEATURES), digits=5)


KS_FEATURES = ["frame_len_count", "frame_len_sum", "frame_len_mean", "flow_duration_sec"]


@query("agg_17_ks_distance", """
    select feature, cast(max(nb) as bigint) as n_benign, cast(max(na) as bigint) as n_attack, round(max(abs(cb / nb - ca / na)), 9) as ks
    from (select feature, value, sum(1 - a) over (partition by feature order by value) as cb, sum(a) over (partition by feature order by value) as ca,
            cast(sum(1 - a) over (partition by feature) as double) as nb, cast(sum(a) over (partition by feature) as double) as na
          from (select feature, value, case when label <> 'Benign' then 1 else 0 end as a from long)) group by 1""",
    {"long": _unpivot(KS_FEATURES, "flows", ["label"])})
def _(t):
    return r6(P.ks_distance(t.flows, KS_FEATURES), digits=9)


@query("agg_18_outlier_rate", """
    select count(*) as n, count(*) filter (packet_rate < q1 - (q3 - q1) * 1.5e0 or packet_rate > q3 + (q3 - q1) * 1.5e0) as outliers,
      round(count(*) filter (packet_rate < q1 - (q3 - q1) * 1.5e0 or packet_rate > q3 + (q3 - q1) * 1.5e0) / count(*), 9) as outlier_rate
    from flows, (select quantile_cont(packet_rate, 0.25) as q1, quantile_cont(packet_rate, 0.75) as q3 from flows)""")
def _(t):
    return r6(P.outlier_rate(t.flows, "packet_rate"), digits=9)


@query("agg_19_duplicates", f"""
    select cast(sum(n) as bigint) as row_count, cast(sum(n - 1) as bigint) as duplicates, round(sum(n - 1) / sum(n), 9) as duplicate_rate
    from (select count(*) as n from file_flows group by {KEY_SQL}, label)""")
def _(t):
    return r6(P.duplicate_rows(t.file_flows, [*FLOW_KEY, "label"]), digits=9)


def _histogram_sql(value, table):
    return f"""
    with v as (select cast({value} as double) as v from {table}), e as (select min(v) as lo, max(v) as hi from v),
      h as (select cast(least(floor((v - lo) * 100 / (hi - lo)), 99) as int) as bin, count(*) as n from v, e group by 1)
    select cast(r.range as int) as bin, round(lo + r.range * ((hi - lo) / 100), 6) as bin_start, coalesce(n, 0) as n
    from range(100) r cross join e left join h on h.bin = r.range"""


@query("agg_20_packet_sizes", _histogram_sql("frame_len", "packets"))
def _(t):
    return r6(P.histogram(t.packets, F.col("frame_len")))


@query("agg_20_flow_durations", _histogram_sql("flow_duration_sec", "(select * from flows where flow_duration_sec > 0)"))
def _(t):
    return r6(P.histogram(FL.flow_durations(t.packets), F.col("duration_sec")))


@query("agg_21_flow_durations", f"""
    select {KEY_SQL}, round(flow_duration_sec, 6) as duration_sec from flows where flow_duration_sec > 0""")
def _(t):
    return r6(FL.flow_durations(t.packets))


@query("agg_22_flags_protocols", """
    select 'tcp_flags' as field, coalesce(tcp_flags, 'none') as value, count(*) as n from packets group by 1, 2
    union all select 'ip_proto', cast(ip_proto as varchar), count(*) from packets group by 1, 2""")
def _(t):
    """Both distributions from one scan."""
    fields = F.array(
        F.struct(F.lit("tcp_flags").alias("field"), F.coalesce("tcp_flags", F.lit("none")).alias("value")),
        F.struct(F.lit("ip_proto").alias("field"), F.col("ip_proto").cast("string").alias("value")),
    )
    return t.packets.select(F.inline(fields)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("agg_23_file_classes", "select capture_day, capture_file, n, has_attack from files")
def _(t):
    return A.file_classes(t.file_flows)


@query("agg_24_file_health", """
    select m.capture_day, m.capture_file, coalesce(n, 0) as n, coalesce(classes, 0) as classes, coalesce(benign, 0) as benign, coalesce(attack, 0) as attack,
      coalesce(missing_labels, 0) as missing_labels, coalesce(unexpected_labels, 0) as unexpected_labels,
      coalesce(n, 0) = 0 as is_empty, coalesce(classes, 0) = 1 as single_class,
      coalesce(attack, 0) > 0 and coalesce(benign, 0) > coalesce(attack, 0) * 100 as extreme_imbalance
    from (select distinct capture_day, capture_file from packets) m left join (
      select capture_day, capture_file, count(*) as n, count(distinct label) as classes, count(*) filter (label = 'Benign') as benign,
        count(*) filter (label <> 'Benign') as attack, count(*) filter (label is null) as missing_labels,
        count(*) filter (label not in (select attack_type from attack_log union all select 'Benign')) as unexpected_labels
      from file_flows group by 1, 2) s using (capture_day, capture_file)""")
def _(t):
    return A.file_health(t.file_flows, t.packets, t.domain)


@query("agg_25_schema_parity", """
    select distinct capture_day, column_name, problem, found from file_flows, (values
      ('D02', 'flow_duration_sec', 'missing', null), ('D02', 'packet_rate', 'missing', null), ('D02', 'tcp_window_mean', 'missing', null),
      ('D04', 'frame_len_sum', 'type', 'string')) as c(folder, column_name, problem, found) where capture_day = folder""")
def _(t):
    """Files of one day come from an older export without three columns, of another with a number as text.

    Both are named by their footers; a third day whose window sizes are all NULL is not.
    """
    path = scratch_path(t.spark, "exports")
    flows = t.store("file_flows").file_flows
    for day, change in {
        "D02": lambda df: df.drop("flow_duration_sec", "packet_rate", "tcp_window_mean"),
        "D04": lambda df: df.withColumn("frame_len_sum", F.col("frame_len_sum").cast("string")),
        "D06": lambda df: df.withColumn("tcp_window_mean", F.lit(None).cast("double")),
    }.items():
        change(flows.filter(F.col("capture_day") == day)).write.mode("append").partitionBy("capture_day").parquet(path)
    flows.filter("capture_day not in ('D02', 'D04', 'D06')").write.mode("append").partitionBy("capture_day").parquet(path)
    expected = flows.select(*FLOW_COLUMNS).schema
    drift = schema_drift(footer_rows(t.spark, path, "capture_day"), expected)
    return drift.select(F.col("folder").alias("capture_day"), "column_name", "problem", "found")


@query("agg_26_vector_lengths", "select count(*) as windows, count(*) as right_length from window_labels")
def _(t):
    return A.vector_lengths(S.window_vectors(t.clean))


READINESS_SQL = f"""
    select 'no unexpected nulls' as check_name, case when count(*) filter (ip_ttl_mean is null or packet_rate is null or label is null) = 0
      then 'pass' else 'warn' end as status from flows
    union all select 'class ratio near the weight', case when abs(count(*) filter (label = 'Benign') / count(*) filter (label <> 'Benign') - 18) < 5
      then 'pass' else 'warn' end from flows
    union all select 'no duplicate flows across captures', case when count(*) = count(distinct ({KEY_SQL})) then 'pass' else 'warn' end from file_flows
    union all select 'train covers every test label', case when count(*) = 0 then 'pass' else 'fail' end from (
      select label from split_rows where split = 'test' except select label from split_rows where split = 'train')
    union all select 'labels are known', case when count(*) filter (label not in ({", ".join(f"'{x}'" for x in LABELS)})) = 0
      then 'pass' else 'fail' end from flows"""


def readiness_checks(t: Tables):
    nulls = A.null_counts(t.flows.select("ip_ttl_mean", "packet_rate", "label"))
    graded = lambda df, name, ok, bad: df.select(
        F.lit(name).alias("check_name"), F.when(ok, "pass").otherwise(bad).alias("status")
    )
    coverage = A.label_coverage(t.split_rows.filter("split = 'train'"), t.split_rows.filter("split = 'test'"))
    return A.union_checks([
        graded(nulls.agg(F.count_if("unexpected").alias("k")), "no unexpected nulls", F.col("k") == 0, "warn"),
        graded(A.class_balance(t.flows), "class ratio near the weight", F.col("verdict") == "ok", "warn"),
        graded(P.duplicate_rows(t.file_flows, FLOW_KEY), "no duplicate flows across captures", F.col("duplicates") == 0, "warn"),
        graded(coverage.agg(F.count_if(F.col("status") == "test_only").alias("k")), "train covers every test label", F.col("k") == 0, "fail"),
        graded(t.flows.agg(F.count_if(~F.col("label").isin(*LABELS)).alias("k")), "labels are known", F.col("k") == 0, "fail"),
    ])


@query("agg_27_readiness", """
    select count(*) as total, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'warn') as warned,
      count(*) filter (status = 'fail') as failed, round(count(*) filter (status = 'pass') * 100.0e0 / count(*), 6) as score from checks""",
    {"checks": READINESS_SQL})
def _(t):
    t.store("file_flows", "flows")
    return r6(A.readiness(readiness_checks(t)))


@query("agg_27_readiness_checks", "select check_name, status from checks", {"checks": READINESS_SQL})
def _(t):
    return readiness_checks(t.store("file_flows", "flows"))


@query("agg_28_severe_imbalance", """
    select label, count(*) as n, round((select count(*) from flows where label = 'Benign') / count(*), 6) as benign_per_attack,
      (select count(*) from flows where label = 'Benign') / count(*) > 1000 as severe from flows where label <> 'Benign' group by 1""")
def _(t):
    return r6(A.severe_imbalance(t.flows))


@query("agg_29_signature_check", """
    select label, cast(sum(ok) as bigint) as passes, count(*) as checks, round(sum(ok) / count(*), 6) as score from (
      select label, case when avg(packet_rate) between 0.1 and 10 then 1 else 0 end as ok from flows group by 1
      union all select label, case when avg(flow_duration_sec) between 60 and 900 then 1 else 0 end from flows group by 1) group by 1""")
def _(t):
    expected = t.spark.createDataFrame(
        [("packet_rate", 0.1, 10.0), ("flow_duration_sec", 60.0, 900.0)], "feature string, low double, high double"
    )
    return r6(A.signature_check(t.flows, expected))

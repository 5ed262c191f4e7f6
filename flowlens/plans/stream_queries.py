"""Registered queries: streaming forms, run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.cleaning import clean_packets
from flowlens.operators.labels import apply_labels
from flowlens.plans.fixtures import EVENT_SCHEMA, events, packets_of
from flowlens.plans.registry import Tables, query
from flowlens.session import scratch_path
from flowlens.streaming import packets as ST


def _events(t: Tables):
    return ST.event_stream(t.spark, t.sf_dir, EVENT_SCHEMA)


def _finish(t: Tables, stream, name):
    return ST.run_available(stream, scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-state"))


def _finish_with_state(t: Tables, stream, name):
    """The rows a stream has emitted, and the checkpoint that holds what it has not."""
    left = scratch_path(t.spark, f"{name}-state")
    return ST.run_available(stream, scratch_path(t.spark, name), left), left


@query("str_01_minute_counts", """
    select date_trunc('minute', packet_ts) as bin, count(*) as packets, cast(sum(frame_len) as bigint) as bytes from packets
    group by 1 having date_trunc('minute', packet_ts) + interval 1 minute <= (select max(packet_ts) - interval 10 minute from packets)""")
def _(t):
    """Minutes the watermark has closed."""
    return _finish(t, ST.minute_counts(packets_of(_events(t))), "minutes")


@query("str_01_every_minute", """
    select date_trunc('minute', packet_ts) as bin, case when date_trunc('minute', packet_ts) + interval 1 minute
      <= (select max(packet_ts) - interval 10 minute from packets) then 'closed' else 'open' end as state,
      count(*) as packets, cast(sum(frame_len) as bigint) as bytes from packets group by 1""")
def _(t):
    """Closed minutes from the sink and open ones from the state: all packets of the table."""
    closed, left = _finish_with_state(t, ST.minute_counts(packets_of(_events(t))), "every-minute")
    return closed.withColumn("state", F.lit("closed")).unionByName(
        ST.open_minutes(t.spark, left).withColumn("state", F.lit("open")))


FLOW_PARTS = """
    with gaps as (select *, case when packet_ts < lag(packet_ts) over (partition by ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport
          order by packet_ts, packet_id) + interval 6 hour then 0 else 1 end as starts from clean where ip_src is not null and ip_dst is not null),
      parts as (select *, sum(starts) over (partition by ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport order by packet_ts, packet_id) as part from gaps),
      labels as (select ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport, part, label, row_number() over (
          partition by ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport, part order by count(*) desc, label) as r
        from parts group by 1, 2, 3, 4, 5, 6, 7)
    select min(packet_ts) as timestamp_min, p.ip_src, p.ip_dst, p.ip_proto, p.tcp_srcport, p.tcp_dstport, count(*) as frame_len_count,
      cast(sum(frame_len) as bigint) as frame_len_sum, any_value(l.label) as label
    from parts p join (select * from labels where r = 1) l using (ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport, part)
    group by 2, 3, 4, 5, 6, part
"""


@query("str_02_idle_timeout_flows", FLOW_PARTS + """
    having max(packet_ts) + interval 6 hour <= (select max(packet_ts) - interval 10 minute from clean where ip_src is not null)""")
def _(t):
    """Flows closed by six idle hours and the watermark."""
    clean = clean_packets(apply_labels(packets_of(_events(t)), t.log))
    return _finish(t, ST.idle_timeout_flows(clean, t.domain, gap="6 hours"), "idle")


@query("str_02_every_flow", FLOW_PARTS.replace("any_value(l.label) as label", """any_value(l.label) as label,
      case when max(packet_ts) + interval 6 hour <= (select max(packet_ts) - interval 10 minute from clean where ip_src is not null)
        then 'closed' else 'open' end as state"""))
def _(t):
    """Ended flows from the sink and those still open from the state, with their labels: all packets of the table."""
    clean = clean_packets(apply_labels(packets_of(_events(t)), t.log))
    closed, left = _finish_with_state(t, ST.idle_timeout_flows(clean, t.domain, gap="6 hours"), "every-flow")
    return closed.withColumn("state", F.lit("closed")).unionByName(
        ST.open_flows(t.spark, left, t.domain).withColumn("state", F.lit("open")))


@query("str_03_label_and_triage", """
    select packet_id, label, outcome, pred from (
      select *, case outcome when 'verified' then 1 when 'flow_only' then case when x_score > 0.5 then 1 else 0 end else 0 end as pred from (
        select *, case when t_score is null then 'flow_only' when x_score <= 0.1e0 then 'cleared' when t_score < 0.15e0 then 'vetoed'
          when least(greatest(t_score * 2.5e0, 0.0e0), 1.0e0) * 0.7e0 + x_score * 0.3e0 > 0.45e0 then 'verified' else 'below_consensus' end as outcome
        from (select *, (packet_id * 7919 + 104729) % 1000 / 1000.0e0 as x_score,
          case when packet_id % 11 = 0 then null else (packet_id * 6101 + 224737) % 1000 / 1000.0e0 end as t_score from labelled)))""")
def _(t):
    pid = F.col("packet_id")
    scored = packets_of(_events(t)).withColumns({
        "x_score": (pid * 7919 + 104729) % 1000 / F.lit(1000.0),
        "t_score": F.when(pid % 11 != 0, (pid * 6101 + 224737) % 1000 / F.lit(1000.0)),
    })
    return _finish(t, ST.label_and_triage(scored, t.log).select("packet_id", "label", "outcome", "pred"), "triage")


#: Every event arrives once. Nothing that arrives in the first two batches is late.
ARRIVALS = ["event_id % 10 between 1 and 8", "event_id % 10 not between 0 and 8", "coalesce(event_id % 10, 0) = 0"]


def _late_minutes(t: Tables, name):
    """Minute counts of events that land in three batches of as many files as tasks read the table; and the checkpoint.

    Lateness is judged by the mark of the batch before, so the rows that are on time arrive in two batches.
    """
    rows, folder = events(t.spark, t.sf_dir), scratch_path(t.spark, f"{name}-arrivals")
    path, left = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-state")
    for part in ARRIVALS:  # a stream is started anew for each, on the same checkpoint
        rows.filter(part).write.mode("append").parquet(folder)
        counts = ST.minute_counts(packets_of(ST.event_stream(t.spark, folder, EVENT_SCHEMA, "*.parquet")))
        closed = ST.run_available(counts, path, left, more=part != ARRIVALS[-1])
    return closed, left


@query("str_04_late_rows", """
    with ends as (select max(ts) filter (event_id % 10 between 1 and 8) - interval 10 minute as first_mark, max(ts) - interval 10 minute as last_mark from events)
    select date_trunc('minute', packet_ts) as bin, count(*) as packets, cast(sum(frame_len) as bigint) as bytes from packets, ends
    where packet_id % 10 <> 0 or date_trunc('minute', packet_ts) + interval 1 minute > first_mark
    group by 1, last_mark having date_trunc('minute', packet_ts) + interval 1 minute <= last_mark""")
def _(t):
    """Every tenth row arrives last; those behind the watermark are dropped."""
    return _late_minutes(t, "late")[0]


@query("str_04_accounted_rows", """
    with ends as (select max(ts) filter (event_id % 10 between 1 and 8) - interval 10 minute as first_mark, max(ts) - interval 10 minute as last_mark from events),
      m as (select case when coalesce(packet_id % 10, 0) = 0 and date_trunc('minute', packet_ts) + interval 1 minute <= first_mark then 'late'
        when date_trunc('minute', packet_ts) + interval 1 minute <= last_mark then 'closed' else 'open' end as state from packets, ends where packet_ts is not null)
    select s.state, count(m.state) as packets from (values ('closed'), ('open'), ('late')) as s(state) left join m on m.state = s.state group by 1""")
def _(t):
    """Where every packet with a time ended up in that stream: in a closed minute, an open one, or behind the watermark."""
    closed, left = _late_minutes(t, "accounted")
    open_ = ST.open_minutes(t.spark, left)
    timed = packets_of(events(t.spark, t.sf_dir)).filter("packet_ts is not null")
    late = ST.late_minutes(timed, closed.unionByName(open_))
    total = lambda df, state: df.agg(F.coalesce(F.sum("packets"), F.lit(0)).alias("packets")).select(F.lit(state).alias("state"), "packets")
    return total(closed, "closed").unionByName(total(open_, "open")).unionByName(total(late, "late"))

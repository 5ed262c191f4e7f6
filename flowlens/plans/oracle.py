"""ANSI-SQL text of the base tables, composed into check queries."""

from __future__ import annotations

import re

from flowlens.plans.fixtures import ATTACK_WINDOWS, PACKET_COLUMNS

FLOW_KEY = "ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport"
FILE_KEY = f"capture_day, capture_file, {FLOW_KEY}"


def _text(value: str | None) -> str:
    return "cast(null as varchar)" if value is None else f"'{value}'"


def _flows(key: str, source: str = "clean") -> str:
    return f"""
    select a.*, l.label,
      (epoch_us(timestamp_max) - epoch_us(timestamp_min)) / 1e6 as flow_duration_sec,
      frame_len_count / case when epoch_us(timestamp_max) = epoch_us(timestamp_min) then 0.001
        else (epoch_us(timestamp_max) - epoch_us(timestamp_min)) / 1e6 end as packet_rate
    from (select {key}, count(*) as frame_len_count, cast(sum(frame_len) as bigint) as frame_len_sum,
            avg(frame_len) as frame_len_mean, stddev_samp(frame_len) as frame_len_std,
            min(packet_ts) as timestamp_min, max(packet_ts) as timestamp_max,
            avg(ip_ttl) as ip_ttl_mean, avg(tcp_window) as tcp_window_mean, min(packet_id) as first_packet_id
          from {source} where ip_src is not null and ip_dst is not null group by {key}) a
    join (select {key}, label from (
            select {key}, label, row_number() over (partition by {key} order by count(*) desc, label) as r
            from {source} where ip_src is not null and ip_dst is not null group by {key}, label) where r = 1) l
      using ({key})"""


def windows_sql(key: str, size: int, stride: int) -> str:
    part = f"partition by {key} order by packet_ts, packet_id"
    return f"""
    select * from (
      select *, unnest(generate_series(
          cast(greatest(0, ceil((rn - {size}) / {stride}.0)) as bigint),
          cast(least((rn - 1) // {stride}, last) as bigint))) as win
      from (select *, case when n <= {size} then 0 else (n - {size}) // {stride} end as last
            from (select *, row_number() over ({part}) as rn, count(*) over (partition by {key}) as n
                  from clean where ip_src is not null and ip_dst is not null)))"""


def window_labels_sql(key: str, rows: str) -> str:
    return f"""
    select {key}, win, label from (
      select {key}, win, label, row_number() over (partition by {key}, win order by count(*) desc, label) as r
      from {rows} group by {key}, win, label) where r = 1"""


TRIAGE = """
    select *, case when t_score is not null and x_score > 0.1 then 1 else 0 end as triggered,
      case when t_score is null then 'flow_only' when x_score <= 0.1 then 'cleared'
        when t_score < 0.15 then 'vetoed'
        when least(greatest(t_score * 2.5e0, 0.0e0), 1.0e0) * 0.7e0 + x_score * 0.3e0 > 0.45e0 then 'verified'
        else 'below_consensus' end as outcome
    from scored"""

BASE = {
    "packets": "select " + ", ".join(f"{e} as {n}" for n, e in PACKET_COLUMNS.items()) + " from events",
    "attack_log": "select * from (values " + ", ".join(
        f"(cast({i} as int), timestamp '{s}', timestamp '{e}', {_text(t)}, '{a}')" for i, s, e, t, a in ATTACK_WINDOWS
    ) + ") as t(log_id, start_ts, end_ts, target_ip, attack_type)",
    "labelled": """
    select p.*, coalesce((select arg_max(a.attack_type, a.log_id) from attack_log a
      where p.packet_ts between a.start_ts and a.end_ts
        and (a.target_ip is null or starts_with(p.ip_src, a.target_ip) or starts_with(p.ip_dst, a.target_ip))),
      'Benign') as label from packets p""",
    "clean": """
    select packet_id, capture_day, capture_file, packet_ts, ip_src, ip_dst, ip_proto,
      coalesce(tcp_srcport, 0) as tcp_srcport, coalesce(tcp_dstport, 0) as tcp_dstport, udp_srcport, udp_dstport,
      case when tcp_flags like '0x%' then coalesce(try_cast(tcp_flags as int), 0)
           when regexp_full_match(tcp_flags, '[0-9]+') then cast(tcp_flags as int) else 0 end as tcp_flags,
      frame_len, ip_ttl, coalesce(tcp_window, 0) as tcp_window,
      case when frame_len > 40 then (frame_len - 40) / cast(frame_len as double) else 0.0e0 end as payload_ratio, label
    from labelled""",
    "flows": _flows(FLOW_KEY),
    "file_flows": _flows(FILE_KEY),
    "window_rows": windows_sql("ip_src, ip_dst", 200, 50),
    "small_window_rows": windows_sql("ip_src, ip_dst", 20, 5),
    "file_window_rows": windows_sql("capture_day, capture_file, ip_src, ip_dst", 20, 5),
    "window_labels": window_labels_sql("ip_src, ip_dst", "window_rows"),
    "small_window_labels": window_labels_sql("ip_src, ip_dst", "small_window_rows"),
    "file_window_labels": window_labels_sql("capture_day, capture_file, ip_src, ip_dst", "file_window_rows"),
    # values of one window's steps, one row per window, feature and step, padding as missing rows
    "window_steps": """
    select ip_src, ip_dst, win, f.idx as feature_idx, rn - win * 50 as step, cast(cast(f.v as float) as double) as v
    from (select *, unnest([{'idx': 0, 'v': cast(frame_len as double)}, {'idx': 1, 'v': ip_proto}, {'idx': 2, 'v': tcp_srcport},
      {'idx': 3, 'v': tcp_dstport}, {'idx': 4, 'v': tcp_flags}, {'idx': 5, 'v': ip_ttl}, {'idx': 6, 'v': tcp_window},
      {'idx': 7, 'v': 1}, {'idx': 8, 'v': payload_ratio}]) as f from window_rows)""",
    "scored": f"""
    select f.*, cast((s.lo * 7919 + 104729) % 1000 as int) / 1000.0e0 as x_score,
      case when s.lo % 11 = 0 then null else cast((s.hi * 6101 + 224737) % 1000 as int) / 1000.0e0 end as t_score
    from flows f join (select {FLOW_KEY}, min(packet_id) as lo, max(packet_id) as hi from clean
      where ip_src is not null and ip_dst is not null group by {FLOW_KEY}) s using ({FLOW_KEY})""",
    "file_scored": f"""
    select f.*, cast((s.lo * 7919 + 104729) % 1000 as int) / 1000.0e0 as x_score,
      case when s.lo % 11 = 0 then null else cast((s.hi * 6101 + 224737) % 1000 as int) / 1000.0e0 end as t_score
    from file_flows f join (select {FILE_KEY}, min(packet_id) as lo, max(packet_id) as hi from clean
      where ip_src is not null and ip_dst is not null group by {FILE_KEY}) s using ({FILE_KEY})""",
    "triaged": f"""
    select *, case outcome when 'verified' then 1 when 'flow_only' then case when x_score > 0.5 then 1 else 0 end else 0 end as pred
    from ({TRIAGE})""",
    "file_triaged": f"""
    select *, case outcome when 'verified' then 1 when 'flow_only' then case when x_score > 0.5 then 1 else 0 end else 0 end as pred
    from ({TRIAGE.replace("from scored", "from file_scored")})""",
    "split_rows": """
    select * exclude (r, n), case when r <= case when label = 'Benign' then floor(n * 0.15e0)
        when n > 1 then greatest(1, floor(n * 0.15e0)) else 0 end then 'test' else 'train' end as split
    from (select *, row_number() over (partition by capture_day, capture_file, label <> 'Benign'
              order by (first_packet_id * 7919 + 104729) % 1000003, first_packet_id) as r,
            count(*) over (partition by capture_day, capture_file, label <> 'Benign') as n from file_flows)""",
    "files": """
    select *, (cast(substr(capture_day, 2, 2) as int) * 5 + cast(substr(capture_file, 5, 1) as int) + 1) * 245489 % 1000003 as file_key
    from (select capture_day, capture_file, count(*) as n, bool_or(label <> 'Benign') as has_attack
          from file_flows group by 1, 2)""",
    "golden": """
    select capture_day, capture_file from (
      select *, row_number() over (partition by capture_day order by file_key, capture_file) as r,
        count(*) over (partition by capture_day) as c from files)
    where r <= greatest(1, floor(c * 0.05e0))""",
    "seqs": """
    select capture_day, capture_file, ip_src, ip_dst, win, label,
      row_number() over (partition by capture_day, capture_file order by ip_src, ip_dst, win) - 1 as row_idx
    from file_window_labels""",
    "indexed_flows": """
    select *, row_number() over (partition by capture_day, capture_file
      order by ip_src, ip_dst, ip_proto, tcp_srcport, tcp_dstport) - 1 as row_idx from file_flows""",
}


def with_base(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the base tables it mentions, dependencies first."""
    tables = BASE | (extra or {})
    names, ordered = set(), []

    def need(text: str) -> None:
        for name in tables:
            if name not in names and re.search(rf"\b(from|join)\s+{name}\b", text):
                names.add(name)
                need(tables[name])
                ordered.append(name)

    need(body)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} as ({tables[n].strip()})" for n in ordered)
    body = body.strip()
    if body.startswith("with "):
        return f"with {ctes},\n{body.removeprefix('with ')}"
    return f"with {ctes}\n{body}"

"""Packet-level tables projected from the ``events`` table.

The expressions read the same in Spark SQL and in ANSI engines, so a check query
can use them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import configure

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

PACKET_COLUMNS = {
    "packet_id": "event_id",
    "capture_day": "concat('D', lpad(cast(cast(floor((extract(day from ts) - 1) / 3) as int) as string), 2, '0'))",
    "capture_file": "concat('cap-', cast(event_id % 5 as string))",
    "packet_ts": "ts",
    "ip_src": "case when event_id % 97 = 0 then null when user_id % 2 = 0 then concat('172.31.64.', cast(user_id % 6 as string)) else concat('10.0.0.', cast(100 + user_id % 75 as string)) end",
    "ip_dst": "concat('172.31.', cast(66 + event_id % 3 as string), '.25')",
    "ip_proto": "case when event_type = 'signup' then 17 when event_type = 'error' then 1 else 6 end",
    "tcp_srcport": "case when event_type in ('signup','error') then null else cast(1015 + (event_id * 31) % 40 as int) end",
    "tcp_dstport": "case event_type when 'click' then 80 when 'view' then 443 when 'purchase' then 22 else null end",
    "udp_srcport": "case event_type when 'signup' then cast(5000 + event_id % 7 as int) else null end",
    "udp_dstport": "case event_type when 'signup' then 53 else null end",
    "tcp_flags": "case event_type when 'click' then '0x0002' when 'view' then '0x0018' when 'purchase' then '16' when 'error' then 'bad' else null end",
    "frame_len": "cast(floor(value * 10) as bigint) + 28",
    "ip_ttl": "case user_id % 5 when 0 then 31 when 1 then 255 when 2 then 64 else 128 end",
    "tcp_window": "case when event_type in ('signup','error') then null else cast((event_id * 7919) % 65536 as int) end",
}

ATTACK_WINDOWS = [
    (0, "2024-01-02 09:00:00", "2024-01-04 17:00:00", "172.31.66.25", "DDoS-LOIC-HTTP"),
    (1, "2024-01-04 00:00:00", "2024-01-06 00:00:00", "172.31.66", "DDoS-HOIC"),
    (2, "2024-01-08 00:00:00", "2024-01-12 12:00:00", "172.31.64", "Infiltration"),
    (3, "2024-01-10 00:00:00", "2024-01-10 06:00:00", None, "Botnet"),
    (4, "2024-01-14 00:00:00", "2024-01-15 00:00:00", "172.31.6", "SSH-BruteForce"),
    (5, "2024-01-18 00:00:00", "2024-01-19 00:00:00", "10.0.0.1", "Web-XSS"),
    (6, "2024-01-22 00:00:00", "2024-01-23 00:00:00", "192.168.10.50", "FTP-BruteForce"),
    (7, "2024-02-03 00:00:00", "2024-02-03 12:00:00", "172.31.66.25", "DoS-Slowloris"),
]


def packets_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{expr} as {name}" for name, expr in PACKET_COLUMNS.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared schema spares the job that would infer it."""
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return packets_of(events(spark, sf_dir))


def attack_log(spark: SparkSession) -> DataFrame:
    text = lambda v: "null" if v is None else f"'{v}'"
    rows = ", ".join(
        f"({i}, timestamp_ntz'{start}', timestamp_ntz'{end}', {text(target)}, '{attack}')"
        for i, start, end, target, attack in ATTACK_WINDOWS
    )
    return spark.sql(f"select * from values {rows} as t(log_id, start_ts, end_ts, target_ip, attack_type)")


def packet_ids() -> dict[str, Column]:
    """Extra flow aggregates the fixture scores and row ids come from."""
    return {"first_packet_id": F.min("packet_id"), "last_packet_id": F.max("packet_id")}


def with_scores(flows: DataFrame) -> DataFrame:
    """Deterministic stage scores per flow, for triage and evaluation without a model."""
    first, last = F.col("first_packet_id"), F.col("last_packet_id")
    return flows.withColumns({
        "x_score": (first * 7919 + 104729) % 1000 / F.lit(1000.0),
        "t_score": F.when(first % 11 != 0, (last * 6101 + 224737) % 1000 / F.lit(1000.0)),
    })

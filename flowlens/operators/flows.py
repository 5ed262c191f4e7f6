"""5-tuple flow aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.ordering import epoch_us
from flowlens.operators.labels import sql_text
from flowlens.schema import FLOW_KEY, FLOW_METADATA


def mode_in_domain(domain: Sequence[str]) -> Column:
    """Most frequent label, lowest on ties, from one counter per known label.

    Counters are fixed-width, so the whole aggregate stays in the code-generated
    hash aggregate, which ``mode`` would leave.
    """
    names = [sql_text(name) for name in sorted(domain)]
    counts = [f"count_if(label = {name})" for name in names]
    top = f"greatest({', '.join(counts)})" if len(counts) > 1 else counts[0]
    branches = " ".join(f"when {top} = {count} then {name}" for name, count in zip(names, counts))
    return F.expr(
        f"case when count(1) > {' + '.join(counts)} then "
        f"cast(raise_error('label outside the given label domain') as string) {branches} end"
    )


def build_flows(
    packets: DataFrame,
    per_file: bool = False,
    label_domain: Sequence[str] | None = None,
    use_udp_ports: bool = False,
    extra: dict[str, Column] | None = None,
    ts: str = "packet_ts",
) -> DataFrame:
    """One row per 5-tuple (and capture file): length, time, TTL, window statistics and label.

    One shuffle of partially aggregated rows. ``label_domain`` lists every label
    that can occur; without it the label comes from ``mode``. ``extra`` adds
    aggregates, such as the lowest packet id as a row id.
    """
    keyed = packets.filter(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())
    # cleaned TCP ports are 0 on UDP rows
    port = "coalesce(nullif({0}, 0), udp_{1}, 0)" if use_udp_ports else "coalesce({0}, 0)"
    keyed = keyed.withColumns({
        f"tcp_{side}": F.expr(port.format(f"tcp_{side}", side)) for side in ("srcport", "dstport")
    })
    key = [*(["capture_day", "capture_file"] if per_file else []), *FLOW_KEY]
    label = mode_in_domain(label_domain) if label_domain else F.mode("label", True)
    aggs = [
        F.count(F.lit(1)).alias("frame_len_count"),
        F.sum("frame_len").alias("frame_len_sum"),
        F.avg("frame_len").alias("frame_len_mean"),
        F.stddev_samp("frame_len").alias("frame_len_std"),
        F.min(ts).alias("timestamp_min"),
        F.max(ts).alias("timestamp_max"),
        F.avg("ip_ttl").alias("ip_ttl_mean"),
        F.avg("tcp_window").alias("tcp_window_mean"),
        label.alias("label"),
    ]
    aggs += [column.alias(name) for name, column in (extra or {}).items()]
    return with_rates(keyed.groupBy(*key).agg(*aggs))


def with_rates(flows: DataFrame) -> DataFrame:
    """Duration in seconds and packets per second; a zero duration counts as a millisecond."""
    duration = (epoch_us("timestamp_max") - epoch_us("timestamp_min")) / F.lit(1e6)
    return flows.withColumn("flow_duration_sec", duration).withColumn(
        "packet_rate",
        F.col("frame_len_count")
        / F.when(F.col("flow_duration_sec") == 0, F.lit(0.001)).otherwise(F.col("flow_duration_sec")),
    )


def flow_durations(packets: DataFrame, ts: str = "packet_ts") -> DataFrame:
    """Positive flow durations straight from packets."""
    return (
        packets.filter(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tcp_srcport", "tcp_dstport")})
        .groupBy(*FLOW_KEY)
        .agg(((epoch_us(F.max(ts)) - epoch_us(F.min(ts))) / F.lit(1e6)).alias("duration_sec"))
        .filter(F.col("duration_sec") > 0)
    )


def feature_matrix(flows: DataFrame) -> DataFrame:
    """Everything but the metadata columns, as 32-bit floats."""
    kept = [c for c in flows.columns if c not in FLOW_METADATA]
    return flows.select(*[F.col(c).cast("float").alias(c) for c in kept])
